"""Queries of the problems of training corpora (pN_...), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cordwood.llm import abuse, heavy_hitters, leaks, runs, tokenizer
from cordwood.plans.base import normal
from cordwood.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters.found(table(spark, folder, "pattern_hits"))


def p3_frequent(spark: SparkSession, folder: str) -> DataFrame:
    """kind, signature, n: the frequent signatures with exact counts."""
    return heavy_hitters.exact(table(spark, folder, "pattern_hits"), "kind", "signature", 1 / 200).select("kind", "signature", "n")


def p3_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """kind, signature, low, high, n_rows: what the summaries guarantee of every signature that may be frequent."""
    return heavy_hitters.frequent(table(spark, folder, "pattern_hits"), "kind", "signature", 1 / 200)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.found(table(spark, folder, "log_events"))


def p6_near(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of nearly alike events."""
    return runs.near(table(spark, folder, "log_events"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"), "text", ["doc_id"])


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.round_trip(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id, n_words, at: with the words found and the offset of the passage."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.found(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, score and worst sentence of every document."""
    return abuse.score(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


QUERIES = {f.__name__: f for f in (p3_found, p3_frequent, p3_intervals, p6_found, p6_near, p8_ids, p8_round_trip, p9_found, p9_leaks, p10_found, p10_scores, p10_rates)}
_P3 = """
    SELECT kind, signature, n FROM (
        SELECT kind, signature, count(*) AS n, sum(count(*)) OVER (PARTITION BY kind) AS n_rows
        FROM pattern_hits GROUP BY kind, signature)
    WHERE signature IS NOT NULL AND signature <> '' AND n * 200 >= n_rows"""
ORACLES: dict[str, str] = {
    "p3_found": f"SELECT kind, signature FROM ({_P3})",
    "p3_frequent": _P3,
    "p6_found": f"""WITH e AS (SELECT source, line_number, ts, {normal('level')} AS level, regexp_replace(regexp_replace(regexp_replace(coalesce(message, ''),
            '"[^"]*"|''[^'']*''', '<v>', 'g'), '[0-9A-Za-z_.:\\-]*[0-9][0-9A-Za-z_.:\\-]*', '<v>', 'g'), '\\s+', '', 'g') AS words
            FROM log_events QUALIFY row_number() OVER (PARTITION BY source, line_number ORDER BY event_id) = 1),
        s AS (SELECT *, CASE WHEN level || words = lag(level || words) OVER (PARTITION BY source ORDER BY line_number) THEN 0 ELSE 1 END AS fresh FROM e),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY line_number) AS g FROM s)
        SELECT source, min(line_number) AS first_line, max(line_number) AS last_line, count(*) AS n_events, coalesce(max(epoch_us(ts)) - min(epoch_us(ts)), 0) AS duration_us
        FROM g GROUP BY source, g HAVING count(*) >= 2""",
}
