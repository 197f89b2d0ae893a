"""Training-corpus pipeline over ``documents``: language ID, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. Every stage works on all rows that the one before has kept, and all but the last return the columns of
``documents``. Null and empty texts are rejected by the first stage; an empty table passes through as one. Further columns,
whatever their names, stay; the last stage's own columns (n_tokens, ids, decoded) take the place of others so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import decontaminate, jaccard, language, pieces, queries, repeats
from broadsheet.llm.shared import Scratch

#: SQL can express neither the language models nor the tokenizer; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go; models are learned from the labelled documents."""
    return language.keep_identified(docs, language.fit(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    return jaccard.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id holds are cut out of the text."""
    rest = tuple(c for c in docs.columns if c != "text")
    out = repeats.remove_repeats(docs, carry=rest)
    made = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them."""
    return pieces.encode(docs, queries.tokenizer_path(spark))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result but the last is written to the shared folder and read again."""
    scratch, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        # Only the last stage's copy of the corpus is kept.
        scratch.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
