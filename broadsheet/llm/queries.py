"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import collocations, decontaminate, filter_audit, html_text, jaccard, language, licenses, minhash, outliers, pieces, quotations, repeats, rules


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(spark: SparkSession, name: str = "piece_bpe_32k.model") -> str:
    """The model file; ``spark.broadsheet.tokenizer`` names another one."""
    set_path = spark.conf.get("spark.broadsheet.tokenizer", None)
    if set_path:
        return set_path
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = language.held_out("doc_id", 4, 2)
    model = language.fit(docs.where(~out))
    return language.identify(docs, model).select(F.col("id").alias("doc_id"), language.held_out("id", 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_docs(spark, sf_dir), digest=True)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = rules.fit(docs, labels.where(~language.held_out("doc_id", 5, 0)))
    scored = rules.score(docs, ensemble)
    return scored.select(F.col("id").alias("doc_id"), language.held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(_docs(spark, sf_dir), tokenizer_path(spark))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_docs(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _linked_sql(width: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of ``width``-word shingles are similar by ``percent``."""
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("{0}", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, shingle FROM (
            SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
                ELSE list_transform(generate_series(1, len(ws) - {width - 1}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS shingle FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= {percent} * (na.n + nb.n - o)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
        c AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(reached) FROM r WHERE r.id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id)
        SELECT *{more} FROM c"""


_ORACLES = {
    "op1_ngram_jaccard_join": _linked_sql(5, 75),
    "op13_minhash_dedup": _linked_sql(2, 80, ", doc_id = component_id AS kept"),
    "op5_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.replace("{0}", "coalesce(text, '')")} AS ws FROM documents),
        p AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS p FROM w)),
        m AS (SELECT k, min(doc_id) AS low FROM p GROUP BY 1),
        g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS i FROM p JOIN m USING (k) WHERE low < doc_id),
        x AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM x ANTI JOIN g USING (doc_id, i) GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_phrase_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
        s AS (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
        f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 30),
        t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
        c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
        x AS (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c),
        b AS (SELECT x.lang, x.phrase, x.a, l.n AS l, r.n AS r, (2000000::HUGEINT * a) // (l.n + r.n) AS score FROM x
            JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[j + 1:x.k], ' ')
            QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, j) = 1),
        m AS (SELECT lang, ws, a, k, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2),
        y AS (SELECT lang, ws, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM m),
        z AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS around FROM y GROUP BY 1, 2),
        q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase
            WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT)
        SELECT q.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000""",
    "op12_filter_audit": f"""
        WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
        t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.replace("{0}", "coalesce(text, '')")} AS ws FROM documents),
        d AS (SELECT doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, len(ws) < 200 AS a,
            100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
            regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t LEFT JOIN l USING (doc_id)),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
        m AS (SELECT part, good, toxic, a, b, c, d, e, count(*) AS n FROM d GROUP BY ALL),
        f AS (SELECT m.*, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails FROM m),
        x AS (SELECT part, filter_order, step, n, good, toxic, fails, contains(fails, filter_order[step]) AS own,
            len(list_filter(generate_series(1, step - 1), lambda i: contains(fails, filter_order[i]))) > 0 AS gone, fails = filter_order[step] AS only_this
            FROM f, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        g AS (SELECT part, filter_order, step, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY 1, 2, 3)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM g""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against plain versions."""
    return dict(_ORACLES)
