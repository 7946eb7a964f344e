"""Queries of the general data problems (pN_...), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cordwood.operators import drift, hierarchy, templates, timestamps, wide
from cordwood.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.found(table(spark, folder, "raw_events"), table(spark, folder, "pending_lines"), table(spark, folder, "log_sources"))


def p1_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its notation, the zone it was read in, the posterior of the reading and whether it is ambiguous."""
    return timestamps.readings(table(spark, folder, "raw_events"), table(spark, folder, "pending_lines"), table(spark, folder, "log_sources"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return templates.found(table(spark, folder, "tail_lines"))


def p2_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.leaf_templates(table(spark, folder, "tail_lines"))


def p2_messages(spark: SparkSession, folder: str) -> DataFrame:
    """source, line_number, template, slots of every entry's message."""
    return templates.messages(table(spark, folder, "tail_lines"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "drift_records"))


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent(table(spark, folder, "drift_records"))


def p4_columns(spark: SparkSession, folder: str) -> DataFrame:
    """p4_table with a typed column for each field that at least one in twenty applications has."""
    return drift.projected(drift.consistent(table(spark, folder, "drift_records")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.found(table(spark, folder, "trace_spans"))


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.paths(table(spark, folder, "trace_spans"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.below(table(spark, folder, "trace_spans"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return wide.found(table(spark, folder, "prop_rows"), table(spark, folder, "prop_catalog"))


def p7_wide(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "prop_catalog")
    return wide.widen(wide.cells(table(spark, folder, "prop_rows"), catalog), wide.header(catalog))


QUERIES = {f.__name__: f for f in (p1_found, p1_readings, p2_found, p2_templates, p2_messages, p4_found, p4_table, p4_columns, p5_found, p5_paths, p5_descendants, p7_found, p7_wide)}
_NODES = """n AS (SELECT t, s, nullif(p, '') AS p FROM (
        SELECT lower(trim(trace_id)) AS t, lower(trim(span_id)) AS s, CASE WHEN regexp_full_match(trim(parent_span_id), '0*') THEN NULL ELSE lower(trim(parent_span_id)) END AS p, row_id
        FROM trace_spans WHERE start_ts IS NOT NULL) WHERE t <> '' AND s <> '' QUALIFY row_number() OVER (PARTITION BY t, s ORDER BY row_id) = 1),
    l AS (SELECT n.t, n.s, m.s AS p FROM n LEFT JOIN n m ON n.t = m.t AND n.p = m.s),
    tree AS (SELECT t, s, s AS root, 0 AS depth, [s] AS path FROM l WHERE p IS NULL
        UNION ALL SELECT l.t, l.s, tree.root, tree.depth + 1, list_append(tree.path, l.s) FROM tree JOIN l ON l.t = tree.t AND l.p = tree.s)"""
_PLAIN = "lower(regexp_replace({}, '[\\s_.\\-]', '', 'g'))"
_DIGITS = "(\\d{1,3}(,\\d{3})+|\\d+)"
ORACLES: dict[str, str] = {
    "p5_found": f"""WITH RECURSIVE {_NODES},
        below AS (SELECT t, a AS s, count(*) - 1 AS n FROM (SELECT t, unnest(path) AS a FROM tree) GROUP BY t, a),
        lost AS (SELECT l.* FROM l ANTI JOIN tree USING (t, s)),
        reach AS (SELECT t, s, p AS up FROM lost UNION SELECT reach.t, reach.s, lost.p FROM reach JOIN lost ON lost.t = reach.t AND lost.s = reach.up)
        SELECT tree.t AS trace_id, tree.s AS span_id, root AS root_span_id, depth, n AS n_desc, 'tree' AS state FROM tree JOIN below USING (t, s)
        UNION ALL SELECT t, s, '', -1, -1, CASE WHEN bool_or(up = s) THEN 'cycle' ELSE 'below' END FROM reach GROUP BY t, s""",
    "p5_paths": f"WITH RECURSIVE {_NODES} SELECT t AS trace_id, s AS span_id, array_to_string(path, '/') AS path FROM tree",
    "p5_descendants": f"""WITH RECURSIVE {_NODES} SELECT t AS trace_id, unnest(path[:-2]) AS span_id, s AS descendant_id, unnest(range(depth, 0, -1)) AS distance FROM tree WHERE depth > 0""",
    "p7_found": f"""WITH c AS (SELECT prop_name AS name, prop_type, {_PLAIN.format('prop_name')} AS k FROM prop_catalog),
        r AS (SELECT event_id, name, prop_type, op, set_at, row_id, trim(prop_value) AS v FROM prop_rows JOIN c ON {_PLAIN.format('prop_rows.prop_name')} = k WHERE event_id IS NOT NULL),
        x AS (SELECT *, CASE WHEN op <> 'set' OR v IS NULL OR lower(v) IN ('', '-', 'n/a', 'null') THEN NULL WHEN prop_type = 'text' THEN v
            WHEN prop_type = 'bool' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', 'y', '1', 'on') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', 'n', '0', 'off') THEN 'false' END
            WHEN prop_type = 'int' THEN CASE WHEN regexp_full_match(v, '[+-]?{_DIGITS}(\\.0*)?') THEN regexp_replace(replace(v, ',', ''), '\\.0*$', '')::BIGINT::VARCHAR END
            WHEN prop_type = 'num' THEN CASE WHEN regexp_full_match(v, '[+-]?{_DIGITS}(\\.\\d*)?([eE][+-]?\\d+)?') THEN printf('%.3f', replace(v, ',', '')::DOUBLE) END
            WHEN regexp_full_match(v, '\\d{{1,15}}') THEN strftime(epoch_ms(try_cast(v AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')
            ELSE strftime(try_cast(v AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS value FROM r),
        b AS (SELECT *, row_number() OVER (PARTITION BY event_id, name ORDER BY set_at DESC NULLS LAST, row_id DESC) AS rn FROM x WHERE op = 'unset' OR value IS NOT NULL)
        SELECT event_id, name AS prop_name, value AS prop_value FROM b WHERE rn = 1 AND op = 'set'""",
}
