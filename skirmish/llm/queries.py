"""Queries of the training-data operators over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode, token_counts
from .co_training import co_trained_scores
from .common import remainder_of, table
from .context_tree import language_scores
from .decontamination import contamination
from .jaccard_join import similarity_classes
from .language import identify, train
from .licences import LEAST_COSINE, LICENCE_FILE, MARKS, TEMPLATES, TERM, YEAR, licence_scan
from .repetition import repetition_rules
from .secret_scan import secret_spans


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), remainder_of("doc_id", 7) == 2)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/id``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return licence_scan(docs.select("doc_id", path.alias("path"), "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (remainder_of("doc_id", 4) == 2).alias("held_out")
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text", held_out), model, "doc_id", "text", "held_out")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_trained_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_repetition_rules": op2_repetition_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_context_tree": op4_context_tree,
    "op5_licence_scan": op5_licence_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_co_training": op10_co_training,
}

def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TERMS = f"[t FOR t IN regexp_extract_all(lower({{}}), {_sql(TERM)}) IF NOT regexp_matches(t, {_sql(YEAR)})]"

#: Lower case for A-Z only, in DuckDB.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_licence_scan": rf"""
        WITH template(licence, body) AS (VALUES {", ".join(f"({_sql(x)}, {_sql(y)})" for x, y in TEMPLATES)}),
        size AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM template)),
        had AS (SELECT licence, body, term, count(*) AS tf FROM (SELECT licence, body, unnest({_TERMS.format("body")}) AS term FROM template) GROUP BY 1, 2, 3),
        idf AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM had, size GROUP BY 1),
        raw AS (SELECT licence, body, term, (ln(tf) + 1.0) * idf AS w FROM had JOIN idf USING (term)),
        weight AS (SELECT licence, body, term, w / sqrt(sum(w * w) OVER (PARTITION BY licence, body)) AS w FROM raw),
        file AS (
            SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(text, {_sql(MARKS)}, '', 'g') AS body
            FROM (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || CAST(doc_id AS VARCHAR) AS path, text FROM documents)),
        unit AS (
            SELECT doc_id, 0 AS kind, 0 AS unit, body FROM file
            UNION ALL SELECT doc_id, 1, unnest(range(len(b))), unnest(b) FROM (SELECT doc_id, string_split_regex(body, '\n([ \t\r]*\n)+') AS b FROM file)
            UNION ALL SELECT doc_id, 2, unnest(range(len(b))), unnest(b) FROM (SELECT doc_id, string_split(body, chr(10)) AS b FROM file)),
        tf AS (
            SELECT doc_id, kind, unit, term, count(*) AS tf FROM (SELECT doc_id, kind, unit, unnest({_TERMS.format("body")}) AS term FROM unit) GROUP BY 1, 2, 3, 4),
        u AS (SELECT tf.doc_id, kind, unit, term, idf, (ln(tf) + 1.0) * coalesce(idf, (SELECT ln(1.0 + n) + 1.0 FROM size)) AS u FROM tf LEFT JOIN idf USING (term)),
        norm AS (SELECT doc_id, kind, unit, sqrt(sum(u * u)) AS norm FROM u GROUP BY 1, 2, 3),
        dot AS (SELECT doc_id, kind, unit, licence, body, sum(u * w) AS dot FROM u JOIN weight USING (term) GROUP BY 1, 2, 3, 4, 5),
        near AS (SELECT doc_id, kind, licence, round(dot / norm, 6) AS cosine FROM dot JOIN norm USING (doc_id, kind, unit) WHERE round(dot / norm, 6) >= {LEAST_COSINE}),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind > 0, -cosine, licence) AS k FROM near) WHERE k = 1),
        known AS (
            SELECT file.doc_id, path, dir, licence AS own, cosine, licence IS NOT NULL AND (kind = 0 OR regexp_matches(path, {_sql(LICENCE_FILE)})) AS speaks
            FROM file LEFT JOIN best USING (doc_id)),
        says AS (SELECT * FROM (SELECT dir AS up, own AS dir_licence, path AS declared_in, row_number() OVER (PARTITION BY dir ORDER BY -cosine, path, own) AS k FROM known WHERE speaks) WHERE k = 1),
        above AS (
            SELECT DISTINCT dir, array_to_string(s[1:i], '/') AS up
            FROM (SELECT dir, s, unnest(range(0, len(s) + 1)) AS i FROM (SELECT DISTINCT dir, string_split(dir, '/') AS s FROM file))),
        given AS (SELECT * FROM (SELECT dir, dir_licence, declared_in, row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC, dir_licence DESC, declared_in DESC) AS k FROM above JOIN says USING (up)) WHERE k = 1)
        SELECT doc_id, path, coalesce(own, dir_licence) AS licence, cosine,
               CASE WHEN own IS NOT NULL THEN CASE WHEN speaks THEN 'file' ELSE 'header' END WHEN dir_licence IS NOT NULL THEN 'inherited' END AS how,
               CASE WHEN own IS NULL THEN declared_in END AS declared_in
        FROM known LEFT JOIN given USING (dir)""",
    "op3_jaccard_join": rf"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        link AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s)
                WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
        reach AS (
            SELECT doc_id AS d, doc_id AS r FROM doc
            UNION
            SELECT d, b FROM reach JOIN link ON r = a)
        SELECT d AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
        FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY 1""",
    "op8_decontamination": rf"""
        WITH item AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
                   regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS k
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
        doc AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        spot AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, spot.n, item_id FROM spot JOIN win USING (n, k)),
        hits AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
