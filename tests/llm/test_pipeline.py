"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import queries
from broadsheet.scratch import Scratch
from tests.llm.test_pairs import plain_components


def plain_pipeline(spark, sf):
    """Stages in plain Python; the language stage keeps every text that has a letter (all of these are clean)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(spark))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and any(c.isalpha() for c in r.text)}
    components = plain_components(list(docs.items()))
    docs = {i: t for i, t in docs.items() if components[i][1] == i}
    words = {i: t.split() for i, t in docs.items()}
    low: dict = {}
    for i in sorted(docs):
        w = words[i]
        for p in range(len(w) - 49):
            low.setdefault(tuple(w[p : p + 50]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if low[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        if any(gone):
            docs[i] = " ".join(x for x, g in zip(w, gone) if not g)
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return {i: sp.encode(t) for i, t in docs.items() if not any(x in flat(t) for x in items)}


def test_pipeline_matches_plain_version(spark, sf):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == plain_pipeline(spark, sf)


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name


def test_stages_take_nulls(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**7, None, None, None, None), (10**7 + 1, "", "en", "s", 0), (None, "the text and nothing but the text of it", "en", None, 40)], docs.schema)
    at = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
    assert at.where("doc_id >= 10000000").count() == 0 and at.where("doc_id is null").count() == 1


def test_stages_keep_further_columns_and_repeated_ids(spark, sf):
    """Names that the operators use themselves, rows that repeat an id, ties, and a table without n_chars."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").drop("n_chars")
    twice = docs.unionByName(docs.where("doc_id % 10 = 0"))
    extra = ("id", "body", "rest", "kept", "bucket", "label", "host", "c1", "rejected", "items", "_text")
    at = twice.select("*", *[F.lit(c).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES:
        columns = at.columns
        at = Scratch(spark, "test").keep(stage(spark, at, sf), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == columns, name
    rows = at.collect()
    assert all(r[c] == c for r in rows for c in extra) and len({r.doc_id for r in rows}) < len(rows)
    plain = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    ids = {r.doc_id: r.ids for r in plain.collect()}
    assert all(r.ids == ids[r.doc_id] for r in rows if r.doc_id in ids and r.n_tokens == len(ids[r.doc_id]))
