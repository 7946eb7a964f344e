"""Queries of the log operators, each over whole tables, with the same results in SQL where SQL has them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.constants import NICE_WIDTHS_MS
from cordwood.formats import native
from cordwood.formats.parsers import EXAMPLES
from cordwood.formats.read import detect_sources, join_continuations, parse
from cordwood.functions import fields, levels, masking, text
from cordwood.functions.ordered import numbered
from cordwood.operators import annotations, blocks, exceptions, highlight, patterns, search, traces, volume
from cordwood.operators import grid as grids
from cordwood.plans import base as B
from cordwood.session import cut, table
from cordwood.sources import exported, merge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FROM, TO = dt.datetime(2024, 9, 5, tzinfo=dt.timezone.utc), dt.datetime(2024, 9, 9, tzinfo=dt.timezone.utc)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def us(c: str):
    return F.unix_micros(c)


# ---- scalars ----------------------------------------------------------------------------------------------------


@query(f"WITH {B.E} SELECT level, {B.normal('level')} AS normalized, {B.rank('level')} AS severity, {B.rank(B.normal('level'))} AS normal_severity, count(*) AS n FROM e GROUP BY level")
def level_normalize(spark, d):
    level = F.col("level")
    rows = B.once(B.events(spark, d), "level").groupBy("level").agg(F.count("*").alias("n"))
    normal = levels.normalize_level(level)
    return rows.select("level", normal.alias("normalized"), levels.severity(level).alias("severity"), levels.severity(normal).alias("normal_severity"), "n")


@query(f"WITH {B.L} SELECT {B.guess('text')} AS severity, count(*) AS n FROM l GROUP BY 1")
def severity_guess(spark, d):
    return B.once(B.lines(spark, d), levels.guess_severity(F.col("text")).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT s AS status, CASE WHEN s >= 500 THEN 'Error' WHEN s >= 400 THEN 'Warning' ELSE 'Information' END AS level, count(*) AS n FROM (SELECT user_id % 500 + 100 AS s FROM events) GROUP BY 1, 2")
def http_level(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 500 + 100).alias("status")).agg(F.count("*").alias("n"))
    return rows.select("status", levels.http_level(F.col("status")).alias("level"), "n")


@query("SELECT s AS code, CASE WHEN s <= 2 THEN 'Fatal' WHEN s = 3 THEN 'Error' WHEN s = 4 THEN 'Warning' WHEN s <= 6 THEN 'Information' ELSE 'Debug' END AS level, count(*) AS n FROM (SELECT event_id % 8 AS s FROM events) GROUP BY 1, 2")
def syslog_level(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("event_id") % 8).alias("code")).agg(F.count("*").alias("n"))
    return rows.select("code", levels.syslog_level(F.col("code")).alias("level"), "n")


@query(f"WITH {B.E} SELECT source, line_number, {B.mask('message')} AS masked FROM e")
def mask_message(spark, d):
    return B.once(B.events(spark, d), masking.mask(F.col("message")).alias("masked"))


@query(f"WITH {B.E} SELECT source, line_number, {B.signature()} AS signature FROM e")
def signature(spark, d):
    return B.once(patterns.with_signature(B.events(spark, d)), "signature")


@query(f"WITH {B.E} SELECT source, line_number, nullif(trim(regexp_extract(exception, '(?m)^\\s*at\\s+(.+?)\\(', 1)), '') AS frame FROM e WHERE exception IS NOT NULL")
def top_frame(spark, d):
    return B.once(B.events(spark, d).where("exception is not null"), fields.top_frame(F.col("exception")).alias("frame"))


_ENDINGS = "|".join(fields.ID_ENDINGS)


@query(f"WITH {B.E}, k AS (SELECT DISTINCT unnest(map_keys(properties)) AS name FROM e) SELECT name, regexp_matches(lower(regexp_replace(name, '[^0-9A-Za-z]', '', 'g')), '(?:{_ENDINGS})$') AS is_key FROM k")
def correlation_keys(spark, d):
    names = B.events(spark, d).select(F.explode(F.map_keys("properties")).alias("name")).distinct()
    return names.select("name", fields.is_correlation_key(F.col("name")).alias("is_key"))


@query()
def correlation_ids(spark, d):
    """source, line_number, name, value of every id of every event."""
    e = B.events(spark, d)
    ids = fields.correlation_ids(F.col("message"), F.col("trace_id"), F.col("span_id"), F.col("properties"))
    return e.select("source", "line_number", F.inline(ids)).distinct()


@query(f"WITH {B.L} SELECT source, line_number, upper(substr(sha256(text), 1, 16)) AS hash, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…(truncated)' ELSE text END AS cut FROM l")
def hash_and_truncate(spark, d):
    t = F.col("text")
    return B.once(B.lines(spark, d), text.text_hash(t).alias("hash"), text.truncate(t, 40).alias("cut"))


_DELTA = """CASE WHEN u IS NULL THEN NULL WHEN abs(u) < 1000000 THEN s || (abs(u) // 1000) || 'ms'
    WHEN abs(u) < 60000000 THEN s || (round(abs(u) / 1000)::BIGINT // 1000) || '.' || lpad((round(abs(u) / 1000)::BIGINT % 1000)::VARCHAR, 3, '0') || 's'
    WHEN abs(u) < 3600000000 THEN s || (abs(u) // 60000000) || 'm' || lpad((abs(u) // 1000000 % 60)::VARCHAR, 2, '0') || 's'
    WHEN abs(u) < 86400000000 THEN s || (abs(u) // 3600000000) || 'h' || lpad((abs(u) // 60000000 % 60)::VARCHAR, 2, '0') || 'm'
    ELSE s || (abs(u) // 86400000000) || 'd' || lpad((abs(u) // 3600000000 % 24)::VARCHAR, 2, '0') || 'h' END"""
_EFFECTIVE = f"WITH {B.E}, t AS (SELECT source, line_number, epoch_us(ts) AS own, last_value(epoch_us(ts) IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS eff FROM e)"


def timed(spark, d) -> DataFrame:
    return search.with_effective_ts(B.once(B.events(spark, d), "ts"), F.col("ts"))


@query(f"{_EFFECTIVE} SELECT source, line_number, own AS own_us, eff AS effective_us FROM t")
def effective_ts(spark, d):
    return timed(spark, d).select("source", "line_number", us("own_ts").alias("own_us"), us("effective_ts").alias("effective_us"))


@query(f"{_EFFECTIVE}, x AS (SELECT source, line_number, own - lag(eff) OVER (PARTITION BY source ORDER BY line_number) AS u FROM t), y AS (SELECT *, CASE WHEN u < 0 THEN '-' ELSE '+' END AS s FROM x) SELECT source, line_number, u AS delta_us, {_DELTA} AS delta FROM y")
def delta(spark, d):
    return search.with_delta(timed(spark, d)).select("source", "line_number", "delta_us", text.format_delta(F.col("delta_us")).alias("delta"))


@query("SELECT row_id, CASE WHEN duration_us IS NULL THEN NULL ELSE least(greatest(log10(duration_us / 1000 + 1) / log10(5001.0), 0), 1) >= 0.5 END AS hot FROM trace_spans")
def span_heat(spark, d):
    return table(spark, d, "trace_spans").select("row_id", (text.heat(F.col("duration_us")) >= 0.5).alias("hot"))


_TENTHS, _HUNDREDTHS = "((duration_us + 50) // 100)", "((duration_us + 5000) // 10000)"


@query(f"""SELECT row_id, CASE WHEN duration_us IS NULL THEN NULL WHEN duration_us < 1000000 THEN ({_TENTHS} // 10) || '.' || ({_TENTHS} % 10) || ' ms'
    ELSE ({_HUNDREDTHS} // 100) || '.' || lpad(({_HUNDREDTHS} % 100)::VARCHAR, 2, '0') || ' s' END AS duration FROM trace_spans""")
def span_durations(spark, d):
    return table(spark, d, "trace_spans").select("row_id", text.format_duration(F.col("duration_us")).alias("duration"))


_NATURAL = "r IS NULL, try_cast(r AS DOUBLE) IS NULL, try_cast(r AS DOUBLE), upper(r), r"


@query(f"WITH {B.E}, r AS (SELECT DISTINCT properties['Elapsed'] AS r FROM e) SELECT r AS value, row_number() OVER (ORDER BY {_NATURAL}) AS place FROM r")
def natural_order(spark, d):
    """The distinct values of a property, numbers by value before texts, with their places."""
    values = B.events(spark, d).select(fields.resolve("Elapsed").alias("value")).distinct()
    return numbered(values, "place", text.natural_sort_keys(F.col("value")))


@query("""SELECT row_id, CASE WHEN strpos(lower(span_name), 'port') = 1 THEN 1000 WHEN strpos(lower(span_name), 'port') > 1 THEN 801 - strpos(lower(span_name), 'port')
    WHEN strpos(lower(source), 'port') > 0 THEN 501 - strpos(lower(source), 'port') WHEN regexp_matches(lower(span_name), 'p.*o.*r.*t') THEN 100 END::INT AS score FROM (SELECT DISTINCT row_id, span_name, source FROM trace_spans)""")
def fuzzy_names(spark, d):
    rows = table(spark, d, "trace_spans").select("row_id", "span_name", "source").distinct()
    return rows.select("row_id", text.fuzzy_score(F.col("span_name"), F.col("source"), "Port").cast("int").alias("score"))


# ---- search and filters -----------------------------------------------------------------------------------------


@query(f"WITH {B.L} SELECT source, line_number, text FROM l WHERE contains(lower(text), 'timed out')")
def search_substring(spark, d):
    return B.once(search.search(B.lines(spark, d), "Timed Out"), "text")


@query(f"WITH {B.L} SELECT source, line_number, text FROM l WHERE regexp_matches(text, 'ref_[0-9]+: limit [0-9]{{3}} ')")
def search_regex(spark, d):
    return B.once(search.search(B.lines(spark, d), "ref_[0-9]+: limit [0-9]{3} ", True, True), "text")


@query(f"WITH {B.E} SELECT source, line_number FROM e WHERE contains(lower(properties['SourceContext']), 'gateway')")
def search_property(spark, d):
    """Over the events as compact JSON lines."""
    event = F.map_concat(F.create_map(F.lit("@t"), iso(), F.lit("@mt"), F.lit("event")), "properties")
    lines = B.events(spark, d).select("source", "line_number", F.to_json(event).alias("text"))
    return B.once(search.search(lines, "Gateway", prop="SourceContext"))


@query(f"WITH {B.L} SELECT count(*) AS n FROM l WHERE contains(lower(text), 'error')")
def count_matches(spark, d):
    return search.count_matches(B.lines(spark, d), search.line_matcher("error"), ["source", "line_number"])


@query(f"WITH {B.V} SELECT min(line_number) AS line_number FROM v WHERE line_number > 500 AND contains(message, 'signup')")
def find_next(spark, d):
    rows = B.event_log(spark, d).withColumn("text", F.col("message"))
    return search.find_next(rows, 500, True, search.line_matcher("signup", case=True))


@query(f"WITH {B.V} SELECT max(line_number) AS line_number FROM v WHERE line_number < 500 AND contains(message, 'signup')")
def find_previous(spark, d):
    rows = B.event_log(spark, d).withColumn("text", F.col("message"))
    return search.find_next(rows, 500, False, search.line_matcher("signup", case=True))


@query(f"WITH {B.V} SELECT line_number, message FROM v WHERE line_number BETWEEN 90 AND 110")
def line_context(spark, d):
    from cordwood.sources.lines import line_window

    return line_window(B.event_log(spark, d), 100, 10, 10).select("line_number", "message")


@query(f"""{_EFFECTIVE} SELECT e.source, e.line_number FROM e JOIN t USING (source, line_number)
    WHERE NOT regexp_matches(message, '(?i)heartbeat|quota') AND coalesce({B.rank('level')}, {B.guess('message')}) >= 3
      AND eff >= epoch_us(TIMESTAMP '2024-09-05') AND eff <= epoch_us(TIMESTAMP '2024-09-09') AND e.line_number >= 10""")
def filter_view(spark, d):
    view = search.FilterView("view", text="heartbeat|quota", exclude=True, min_level="Warning", time_from="2024-09-05", time_to="2024-09-09", hide_before=10)
    return B.once(search.filtered(B.events(spark, d).withColumn("text", F.col("message")), view, F.col("ts")))


@query(f"WITH {B.E} SELECT source, line_number FROM e WHERE properties['ThreadId'] = '7'")
def filter_property(spark, d):
    view = search.FilterView(field="ThreadId", value="7")
    return B.once(search.apply_filters(B.events(spark, d), view))


@query(f"WITH {B.E} SELECT source, line_number FROM e WHERE contains(lower(message), '10.1')")
def filter_correlation(spark, d):
    return B.once(search.filter_correlation(B.events(spark, d).withColumn("text", F.col("message")), "10.1"))


@query(f"""WITH {B.E}, lo AS (SELECT source, min(line_number) AS lo FROM e WHERE ts >= TIMESTAMP '2024-09-05' GROUP BY source),
    hi AS (SELECT e.source, min(line_number) AS hi FROM e JOIN lo USING (source) WHERE line_number > lo AND ts > TIMESTAMP '2024-09-09' GROUP BY e.source)
    SELECT e.source, e.line_number FROM e JOIN lo USING (source) LEFT JOIN hi USING (source) WHERE line_number >= lo AND (hi IS NULL OR line_number < hi)
      AND (line_number > lo OR NOT coalesce(ts > TIMESTAMP '2024-09-09', false))""")
def time_range(spark, d):
    rows = B.once(B.events(spark, d), F.col("ts").alias("own_ts"))
    return search.time_range(rows, FROM, TO).select("source", "line_number")


@query(f"""WITH {B.E}, m AS (SELECT source, max(line_number) AS top FROM e GROUP BY source)
    SELECT source, epoch_us(arg_max(ts, line_number)) AS us FROM e JOIN m USING (source) WHERE line_number > top - 500 AND ts IS NOT NULL GROUP BY source""")
def latest_ts(spark, d):
    return search.latest_ts(B.once(B.events(spark, d), F.col("ts").alias("own_ts"))).select("source", us("ts").alias("us"))


@query(f"WITH {B.V} SELECT line_number, message FROM v WHERE line_number > 950 ORDER BY line_number LIMIT 20")
def new_lines_since(spark, d):
    return search.new_lines_since(B.event_log(spark, d), 950, 20).select("line_number", "message")


_RULES = [search.EventRule("limit [0-9]+ reached"), search.EventRule("^(err|error|fatal)$", "Level"), search.EventRule("peer", provider="tarn.gateway"), search.EventRule("(", "Provider"), search.EventRule(".", enabled=False)]
_PASS = "(regexp_matches(coalesce(message, ''), '(?i)limit [0-9]+ reached') OR regexp_matches(coalesce(level, ''), '(?i)^(err|error|fatal)$') OR (regexp_matches(coalesce(message, ''), '(?i)peer') AND lower(coalesce(properties['SourceContext'], '')) = 'tarn.gateway'))"


def _channel(spark, d) -> DataFrame:
    return B.events(spark, d).withColumns({"provider": fields.resolve("SourceContext"), "text": F.col("message"), "record_id": F.col("line_number")})


@query(f"WITH {B.E} SELECT source, line_number FROM e WHERE {_PASS}")
def event_log_filters(spark, d):
    return B.once(_channel(spark, d).where(search.event_log_filter(_RULES)))


@query(f"WITH {B.E}, p AS (SELECT source, event_id, message, row_number() OVER (PARTITION BY source ORDER BY line_number) AS line_number FROM e WHERE {_PASS}) SELECT source, event_id, line_number FROM p WHERE contains(lower(message), 'ticket')")
def search_event_log(spark, d):
    passing = B.once(_channel(spark, d).where(search.event_log_filter(_RULES)), "event_id", "message", "provider", "level", "text", "record_id")
    return search.search_event_log(passing, _RULES, "ticket").select("source", "event_id", "line_number")


@query(f"""WITH {B.E} SELECT line_number, epoch_us(ts) AS us, level, properties['SourceContext'] AS SourceContext, properties['Elapsed'] AS Elapsed, message FROM e
    WHERE properties['ThreadId'] IS NULL AND properties['SourceContext'] IS DISTINCT FROM 'Tarn.Gateway'
      AND (contains(lower(message), 'slow') OR contains(lower(level), 'slow') OR contains(lower(coalesce(properties['SourceContext'], '')), 'slow') OR contains(lower(coalesce(properties['Elapsed'], '')), 'slow'))""")
def grid(spark, d):
    filters = (grids.ValueFilter("ThreadId", None), grids.ValueFilter("SourceContext", "Tarn.Gateway", True))
    rows = grids.grid(B.once_each(grids.filtered(B.events(spark, d), ["SourceContext", "Elapsed"], filters, "Slow")), ["SourceContext", "Elapsed"], filters, "Slow", "Elapsed", True)
    return rows.withColumn("us", us("ts")).drop("ts")


# ---- aggregations -----------------------------------------------------------------------------------------------

def _shapes(spark, d, *more: str, where=None) -> DataFrame:
    """Events with their signature, copies once; neither templates nor properties move."""
    rows = B.events(spark, d)
    return B.once(patterns.with_signature(rows if where is None else rows.where(where)), "signature", *more)


_S = f"s AS (SELECT *, {B.signature()} AS signature FROM e)"
_TOP = "row_number() OVER (ORDER BY line_number, source)"
_FIRST = "arg_min({}, (line_number, source))"


@query(f"""WITH {B.E}, {_S} SELECT signature, count(*) AS count, min(line_number) AS first_line, max(line_number) AS last_line,
    min(struct_pack(a := line_number, b := source, c := coalesce(level, ''))).c AS level, min(struct_pack(a := line_number, b := source, c := coalesce(message, ''))).c AS sample_message,
    nullif(min(struct_pack(a := line_number, b := source, c := coalesce(epoch_us(ts), -1))).c, -1) AS first_us,
    nullif(max(struct_pack(a := line_number, b := source, c := coalesce(epoch_us(ts), -1))).c, -1) AS last_us, list_sort(list_distinct(list(line_number)))[1:3] AS sample_lines
    FROM s GROUP BY signature ORDER BY count DESC, first_line, signature LIMIT 20""")
def top_patterns(spark, d):
    """With the first three line numbers of each."""
    rows = _shapes(spark, d, "ts", "level", "message")
    top = patterns.top_patterns(rows, None, 20)
    top = top.join(patterns.sample_lines(rows, top), "signature")
    return top.select("signature", "count", "first_line", "last_line", "level", "sample_message", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "sample_lines")


def _values(value: str, least: int) -> str:
    return f"""WITH {B.E}, {_S}, x AS (SELECT {value} AS value, signature, line_number, source FROM s WHERE coalesce({B.rank('level')}, -1) >= {least}),
    h AS (SELECT value, signature, count(*) AS n, min(line_number) AS a, max(line_number) AS b, min(struct_pack(a := line_number, b := source)) AS p FROM x WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT value, sum(n)::BIGINT AS count, count(*) AS signatures, min(a) AS first_line, max(b) AS last_line, list(signature ORDER BY p)[1:3] AS first_signatures
    FROM h GROUP BY value ORDER BY count DESC, first_line, value LIMIT 20"""


@query(_values("CASE WHEN trim(properties['SourceContext']) <> '' THEN properties['SourceContext'] END", 3))
def top_values(spark, d):
    rows = B.once_each(B.events(spark, d).where(patterns.at_least("Warning")))
    return patterns.top_values(rows, "SourceContext", "Warning", False, 20).select("value", "count", "signatures", "first_line", "last_line", "first_signatures")


_SOURCE = "coalesce(nullif(trim(properties['SourceContext']), ''), nullif(trim(regexp_extract(exception, '(?m)^\\s*at\\s+(.+?)\\(', 1)), ''))"


@query(_values(_SOURCE, 4))
def top_error_sources(spark, d):
    rows = B.once_each(B.events(spark, d).where(patterns.at_least("Error")))
    return patterns.top_error_sources(rows, n=20).select("value", "count", "signatures", "first_line", "last_line", "first_signatures")


@query(f"WITH {B.E}, {_S}, t AS (SELECT signature FROM s GROUP BY signature ORDER BY count(*) DESC, min(line_number), signature LIMIT 1) SELECT source, line_number, message FROM s JOIN t USING (signature) ORDER BY line_number, source LIMIT 50")
def pattern_occurrences(spark, d):
    e = _shapes(spark, d, "ts", "level", "message")
    top = patterns.top_patterns(e, None, 1).first()
    return patterns.pattern_occurrences(e, top.signature if top else "", 50).select("source", "line_number", "message")


def _names():
    return F.array_sort(F.map_keys("properties")).alias("names")


@query(f"WITH {B.E} SELECT name, count(*) AS events FROM (SELECT unnest(map_keys(properties)) AS name FROM e) GROUP BY name")
def property_usage(spark, d):
    return patterns.property_usage(B.once(B.events(spark, d), _names()), F.col("names"))


@query(f"WITH {B.E} SELECT DISTINCT unnest(map_keys(properties)) AS name FROM (SELECT * FROM e ORDER BY line_number, source LIMIT 2000)")
def list_properties(spark, d):
    return patterns.list_properties(B.once(B.events(spark, d), _names()), 2000, F.col("names"))


@query(f"WITH {B.E} SELECT count(*) FILTER ({B.rank('level')} >= 4) AS errors, count(*) FILTER ({B.rank('level')} = 3) AS warnings, count(*) AS total FROM e")
def level_counts(spark, d):
    return patterns.level_counts(B.once(B.events(spark, d), "level"))


@query(f"WITH {B.L} SELECT epoch_us(date_trunc('second', read_at)) AS second_us, count(*) AS lines FROM l GROUP BY 1")
def line_rate(spark, d):
    return patterns.line_rate(B.once(B.lines(spark, d), "read_at")).select(us("second").alias("second_us"), "lines")


_WIDTH = "list_filter([" + ", ".join(str(w * 1000) for w in NICE_WIDTHS_MS) + "]::BIGINT[], lambda w: (hi - lo) / w <= 120)[1]"
_BINS = f"""WITH {B.V}, s AS (SELECT epoch_us(ts) AS u, line_number, {B.rank('level')} AS sev FROM v), r AS (SELECT min(u) AS lo, max(u) AS hi FROM s),
    w AS (SELECT lo, hi, {_WIDTH} AS width FROM r), g AS (SELECT unnest(generate_series(0, (hi - lo) // width)) AS bin, lo, width FROM w),
    c AS (SELECT (u - lo) // width AS bin, count(*) AS total, count(*) FILTER (sev = 3) AS warnings, count(*) FILTER (sev >= 4) AS errors,
        min(struct_pack(a := u, b := line_number)).b AS first_line, max(struct_pack(a := u, b := line_number)).b AS last_line FROM s, w GROUP BY 1),
    b AS (SELECT bin, lo + bin * width AS start_us, coalesce(total, 0) AS total, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) AS errors,
        coalesce(first_line, -1) AS first_line, coalesce(last_line, -1) AS last_line FROM g LEFT JOIN c USING (bin))"""


def _bins(spark, d) -> DataFrame:
    return volume.volume_bins(B.event_log(spark, d).withColumn("severity", levels.severity(F.col("level"))))


@query(f"{_BINS} SELECT * FROM b")
def volume_bins(spark, d):
    return _bins(spark, d).drop("width_us")


def _spike(c: str, least: int, floor: float) -> str:
    p = "(ORDER BY bin ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
    return f"coalesce(count(*) OVER {p} >= 5 AND {c} >= {least} AND {c} > avg({c}) OVER {p} + 3 * greatest(stddev_pop({c}) OVER {p}, {floor}), false)"


@query(f"{_BINS} SELECT bin, {_spike('total', 10, 1.0)} AS is_volume_spike, {_spike('errors', 3, 0.5)} AS is_error_spike FROM b")
def volume_spikes(spark, d):
    return volume.volume_spikes(_bins(spark, d)).select("bin", "is_volume_spike", "is_error_spike")


def _fresh(warmup: int) -> str:
    return f"""WITH {B.E}, p AS (SELECT source, line_number, {B.rank('level')} AS severity, {B.mask('message')} AS shape, row_number() OVER (PARTITION BY source ORDER BY line_number) AS place FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY source, severity, shape ORDER BY line_number) AS nth FROM p WHERE severity >= 3)
    SELECT source, line_number, severity, shape FROM f WHERE nth = 1 AND place > {warmup}"""


def _new_patterns(spark, d, warmup: int) -> DataFrame:
    rows = B.events(spark, d).withColumn("severity", levels.severity(F.col("level")))
    return volume.new_patterns(rows, warmup).select("source", "line_number", "severity", "shape")


@query(_fresh(50))
def new_patterns(spark, d):
    return _new_patterns(spark, d, 50)


@query(_fresh(200))
def new_patterns_200(spark, d):
    return _new_patterns(spark, d, 200)


_TYPE = "regexp_extract(exception, '((?:[A-Za-z_][\\w$]*\\.)*[A-Za-z_][\\w$]*(?:Exception|Error|Fault))', 1)"


@query(f"""WITH {B.E}, x AS (SELECT line_number, ts, {_TYPE} AS type, list_transform(regexp_extract_all(exception, '(?m)^\\s+at\\s+(.+)$', 1),
        lambda f: trim(regexp_replace(f, '\\d+', '#', 'g'))) AS frames, string_split(exception, chr(10))[1] AS head FROM e WHERE coalesce(exception, '') <> ''),
    g AS (SELECT *, type || '|' || CASE WHEN len(frames) > 0 THEN array_to_string(frames[1:3], '|') ELSE regexp_replace(regexp_extract(head, ':\\s*(.*)', 1), '\\d+', '#', 'g') END AS signature FROM x)
    SELECT signature, type, count(*) AS count, min(line_number) AS first_line, max(line_number) AS last_line FROM g GROUP BY signature, type""")
def exception_groups(spark, d):
    e = B.once(B.events(spark, d).where("coalesce(exception, '') <> ''"), "ts", "exception")
    rows = exceptions.occurrences(e.select("source", "line_number", F.lit("").alias("text")), e)
    return exceptions.groups(rows).select("signature", "type", "count", "first_line", "last_line")


@query()
def exception_groups_of_lines(spark, d):
    """Exceptions of all tail_lines, by the state machine over their text."""
    return exceptions.groups(exceptions.occurrences(B.lines(spark, d))).select("signature", "type", "message", "top_frame", "count", "first_line", "last_line", us("first_seen").alias("first_us"))


@query()
def multiline_entries(spark, d):
    return exceptions.group_entries(B.lines(spark, d)).select("source", "line_number", "head_line")


# ---- blocks and traces ------------------------------------------------------------------------------------------

_PROX = f"""WITH {B.E}, a AS (SELECT *, coalesce(properties['ThreadId'], chr(0)) AS th FROM e),
    b AS (SELECT *, abs(epoch_us(ts) - lag(epoch_us(ts)) OVER w) > 2000000 AS gap, row_number() OVER w AS rn FROM a WINDOW w AS (PARTITION BY source, th ORDER BY line_number)),
    c AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY source, th ORDER BY line_number) AS sess FROM b),
    f AS (SELECT *, (row_number() OVER (PARTITION BY source, th, sess ORDER BY line_number) - 1) // 200 AS sub FROM c)"""


@query(f"{_PROX} SELECT source, min(line_number) AS first_line, max(line_number) AS last_line, count(*) AS lines, coalesce(bool_or({B.rank('level')} >= 4), false) AS has_error FROM f GROUP BY source, th, sess, sub")
def blocks_proximity(spark, d):
    made = blocks.block_summary(blocks.blocks_by_proximity(B.narrow(B.events(spark, d), ["ts", "level", "message"], ["ThreadId"])))
    return made.select(F.substring_index("block_id", "\x1f", 1).alias("source"), "first_line", "last_line", "lines", "has_error")


@query(f"WITH {B.E} SELECT source, properties['SourceContext'] AS value, min(line_number) AS first_line, max(line_number) AS last_line, count(*) AS lines FROM e WHERE coalesce(properties['SourceContext'], '') <> '' GROUP BY 1, 2")
def blocks_correlation(spark, d):
    made = blocks.blocks_by_correlation(B.narrow(B.events(spark, d), [], ["SourceContext"]), "SourceContext")
    return made.groupBy("source", fields.resolve("SourceContext").alias("value"), "block_id").agg(
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.count("*").alias("lines")).drop("block_id")


@query(f"""WITH {B.E}, o AS (SELECT source, line_number, properties['SourceContext'] AS val, row_number() OVER (PARTITION BY source ORDER BY line_number) AS o FROM e WHERE coalesce(properties['SourceContext'], '') <> ''),
    p AS (SELECT *, lag(o) OVER w AS op, lag(line_number) OVER w AS lp, 10 * ((o - 1) // 10) AS look FROM o WINDOW w AS (PARTITION BY source, val ORDER BY line_number)),
    q AS (SELECT p.*, s.line_number AS sline FROM p LEFT JOIN o s ON p.source = s.source AND p.look = s.o),
    r AS (SELECT *, sum(CASE WHEN op IS NULL OR (look >= op AND coalesce(sline - lp > 20, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY source, val ORDER BY line_number) AS g FROM q)
    SELECT source, val AS value, min(line_number) AS first_line, count(*) AS lines FROM r GROUP BY source, val, g""")
def blocks_quiet(spark, d):
    made = blocks.blocks_by_correlation(B.narrow(B.events(spark, d), [], ["SourceContext"]), "SourceContext", quiet=20, sweep=10)
    return made.groupBy("source", fields.resolve("SourceContext").alias("value"), "block_id").agg(F.min("line_number").alias("first_line"), F.count("*").alias("lines")).drop("block_id")


@query()
def similar_blocks(spark, d):
    """Blocks of all sources most like the one around line 20 of the source with most events."""
    made = cut(blocks.blocks_by_proximity(B.narrow(patterns.with_signature(B.events(spark, d)), ["ts", "signature"], ["ThreadId"]), gap_us=120_000_000))
    anchor = blocks.block_containing(made, 20)
    mine = made.join(F.broadcast(anchor), "block_id", "left_semi").drop("block_id")
    return blocks.similar_blocks(mine, made, 10)


@query()
def compare_sources(spark, d):
    e = B.events(spark, d)
    return blocks.align(B.once_each(e.where("source = 'stock-core'")), B.once_each(e.where("source = 'pricing-core'")))


@query(f"WITH {B.V} SELECT line_number FROM v WHERE user_id = 7")
def anchor_block(spark, d):
    return blocks.anchor_block(B.event_log(spark, d), 1, field="UserId", value="7").select("line_number")


_SPANS = "sp AS (SELECT * FROM trace_spans WHERE start_ts IS NOT NULL AND trace_id IS NOT NULL AND span_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY line_number) = 1)"


@query(f"WITH {_SPANS} SELECT trace_id, count(*) AS spans, epoch_us(min(start_ts)) AS start_us, min(row_id) AS first_line FROM sp GROUP BY trace_id")
def trace_summary(spark, d):
    return traces.trace_summary(B.span_events(spark, d)).select("trace_id", "spans", us("start").alias("start_us"), "first_line")


@query(f"""WITH RECURSIVE {_SPANS}, n AS (SELECT trace_id, span_id, nullif(parent_span_id, '') AS p FROM sp QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY row_id) = 1),
    t AS (SELECT n.trace_id, n.span_id, 0 AS depth, n.span_id AS root FROM n WHERE NOT EXISTS (SELECT 1 FROM n q WHERE q.trace_id = n.trace_id AND q.span_id = n.p)
        UNION ALL SELECT n.trace_id, n.span_id, t.depth + 1, t.root FROM t JOIN n ON n.trace_id = t.trace_id AND n.p = t.span_id)
    SELECT trace_id, span_id, root, depth FROM t""")
def trace_tree(spark, d):
    tree = traces.trace_tree(B.span_events(spark, d))
    return tree.where("depth is not null").select("trace_id", "span_id", "root", "depth")


# ---- highlight, alerts, annotations, exports --------------------------------------------------------------------

_PRESETS = [
    highlight.Preset("a", (highlight.Rule("slow", "slow query"), highlight.Rule("thread", "1", target="ThreadId"), highlight.Rule("off", ".", True, enabled=False))),
    highlight.Preset("b", (highlight.Rule("ref", "ref_[0-9]{6}", True, True), highlight.Rule("fatal", "FATAL", target="@Level"))),
    highlight.Preset("c", (highlight.Rule("all", "e"),), enabled=False),
]


@query(f"""WITH {B.E} SELECT source, line_number, CASE WHEN contains(lower(message), 'slow query') THEN 'slow' WHEN contains(properties['ThreadId'], '1') THEN 'thread'
    WHEN regexp_matches(message, 'ref_[0-9]{{6}}') THEN 'ref' WHEN contains(lower(level), 'fatal') THEN 'fatal' END AS rule_id FROM e""")
def highlight_first_match(spark, d):
    rows = highlight.highlight(B.events(spark, d).withColumn("text", F.col("message")), _PRESETS)
    return B.once(rows, "rule_id")


# matches of both rules are ten characters long; they begin where the parts between them end
_PARTS = "CASE WHEN contains(lower(message), 'slow query') THEN string_split(lower(message), 'slow query') ELSE regexp_split_to_array(message, 'ref_[0-9]{6}') END"


@query(f"""WITH {B.E}, r AS (SELECT source, line_number, CASE WHEN contains(lower(message), 'slow query') THEN 'slow' ELSE 'ref' END AS rule_id, {_PARTS} AS parts FROM e
        WHERE contains(lower(message), 'slow query') OR (NOT coalesce(contains(properties['ThreadId'], '1'), false) AND regexp_matches(message, 'ref_[0-9]{{6}}'))),
    x AS (SELECT *, unnest(range(1, len(parts))) AS i FROM r)
    SELECT source, line_number, rule_id, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * 10)::INT AS start, 10 AS length FROM x""")
def highlight_spans(spark, d):
    rows = highlight.with_spans(B.events(spark, d).withColumn("text", F.col("message")), _PRESETS)
    return rows.select("source", "line_number", "rule_id", F.inline("spans")).distinct()


# the hits of a rule in order; a hit whose threshold-th one backwards lies within the window fires if no alert took it
_HITS = """h AS (SELECT CASE WHEN {r} >= 4 THEN 'errors' ELSE 'warnings' END AS rule_id, epoch_us(ts) AS at_us, event_id AS line_number FROM e WHERE {r} >= 3 AND ts IS NOT NULL),
    n AS (SELECT *, row_number() OVER w AS i, CASE rule_id WHEN 'errors' THEN 3 ELSE 5 END AS k, CASE rule_id WHEN 'errors' THEN 600000000 ELSE 3600000000 END AS width,
        lag(at_us, 2) OVER w AS back3, lag(at_us, 4) OVER w AS back5 FROM h WINDOW w AS (PARTITION BY rule_id ORDER BY at_us, line_number)),
    f AS (SELECT * FROM n WHERE at_us - CASE k WHEN 3 THEN back3 ELSE back5 END <= width),
    j AS (SELECT a.rule_id, a.i, min(b.i) AS nxt FROM f a LEFT JOIN f b ON b.rule_id = a.rule_id AND b.i >= a.i + a.k AND b.i <= a.i + 400 GROUP BY 1, 2),
    t AS (SELECT j.rule_id, j.i, coalesce(j.nxt, (SELECT min(b.i) FROM f b WHERE b.rule_id = j.rule_id AND b.i > j.i + 400)) AS nxt FROM j),
    o AS (SELECT rule_id, min(i) AS i FROM f GROUP BY 1 UNION ALL SELECT t.rule_id, t.nxt FROM o JOIN t USING (rule_id, i) WHERE t.nxt IS NOT NULL)"""


@query(f"WITH RECURSIVE {B.E}, {_HITS.format(r=B.rank('level'))} SELECT rule_id, at_us, line_number FROM o JOIN n USING (rule_id, i)")
def alert_threshold(spark, d):
    """Alerts of two rules over all events: three errors within ten minutes, five warnings within an hour."""
    rules = [highlight.Rule("errors", "x", threshold=3, window_us=600_000_000), highlight.Rule("warnings", "x", threshold=5, window_us=3_600_000_000)]
    rank = levels.severity(F.col("level"))
    hits = B.once(B.events(spark, d).where((rank >= 3) & F.col("ts").isNotNull()), "ts", "event_id", F.when(rank >= 4, "errors").otherwise("warnings").alias("rule_id"))
    return highlight.threshold_alerts(hits.select("rule_id", "ts", F.col("event_id").alias("line_number")), rules)


def _notes(spark, d) -> DataFrame:
    v = B.event_log(spark, d).where("event_type = 'error'")
    written_on = F.when(F.col("user_id") % 2 == 0, F.col("message")).otherwise(F.lit("other"))
    return v.select("source", "line_number", F.concat(F.lit("note "), F.col("user_id").cast("string")).alias("note"), text.text_hash(written_on).alias("text_hash"))


@query(f"WITH {B.V} SELECT line_number, 'note ' || user_id AS note, message AS text, user_id % 2 <> 0 AS line_changed FROM v WHERE event_type = 'error'")
def notes(spark, d):
    rows = annotations.notes(B.event_log(spark, d).withColumn("text", F.col("message")), _notes(spark, d))
    return rows.select("line_number", "note", "text", "line_changed")


@query(f"WITH {B.V} SELECT line_number, 'note ' || user_id AS note, message AS text FROM v WHERE event_type = 'error'")
def bookmarks(spark, d):
    rows = annotations.bookmarks(B.event_log(spark, d).withColumn("text", F.col("message")), _notes(spark, d))
    return rows.select("line_number", "note", "text")


@query(f"WITH {B.V} SELECT coalesce(min(line_number) FILTER (line_number > 500), min(line_number)) AS line_number FROM v WHERE event_type = 'error'")
def next_mark(spark, d):
    return annotations.next_mark(B.event_log(spark, d).where("event_type = 'error'"), 500)


@query(f"""WITH {B.V}, m AS (SELECT greatest(line_number - 2, 1) AS a, least(line_number + 2, (SELECT max(line_number) FROM v)) AS b FROM v WHERE event_type = 'error'),
    n AS (SELECT *, CASE WHEN a <= max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM m),
    g AS (SELECT *, sum(fresh) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT min(a) AS first, max(b) AS last FROM g GROUP BY g""")
def merge_windows(spark, d):
    v = B.event_log(spark, d)
    total = v.agg(F.max("line_number")).first()[0] or 0
    return annotations.merge_windows(v.where("event_type = 'error'"), 2, total)


@query()
def incident_report(spark, d):
    """The report on one log file as lines of Markdown."""
    rows = B.lines(spark, d)
    report = annotations.build_report(rows, "Night shift", "lab/audit.log", [5, 9], (), [20], now=FROM)
    return spark.createDataFrame(list(enumerate(annotations.report_markdown(report).split("\n"))), "n long, text string")


@query(f"WITH {B.E} SELECT source, line_number, coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ', '') || '[' || coalesce(level, 'Information') || '] ' || message || CASE WHEN coalesce(exception, '') <> '' THEN chr(10) || exception ELSE '' END AS value FROM e")
def export_formatted(spark, d):
    e = B.once(B.events(spark, d), "ts", "level", "message", "exception")
    return annotations.formatted(e.select("source", "line_number", F.col("message").alias("text")), e)


_MEMBERS = "list_transform(map_entries(properties), lambda p: to_json(p.key) || ':' || to_json(p.value))"


@query(f"""WITH {B.E} SELECT '{{"lineNumber":' || line_number || coalesce(',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"', '') || coalesce(',"level":' || to_json(level), '')
    || coalesce(',"messageTemplate":' || to_json(message_template), '') || ',"message":' || to_json(message) || coalesce(',"exception":' || to_json(exception), '')
    || coalesce(',"properties":{{' || array_to_string({_MEMBERS}, ',') || '}}', '') || coalesce(',"traceId":' || to_json(trace_id), '') || coalesce(',"spanId":' || to_json(span_id), '') || '}}' AS value FROM e""")
def export_json(spark, d):
    e = B.once_each(B.events(spark, d))
    columns = ["source", "line_number", "ts", "ts_offset_min", "level", "message_template", "message", "exception", "properties", "trace_id", "span_id"]
    return annotations.export_json(e.select("source", "line_number", F.col("message").alias("text")), e.select(*columns))


@query(f"WITH {B.E} SELECT source, line_number, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || coalesce(level, 'Information') || '] ' || coalesce(properties['SourceContext'], '') || ': ' || trim(message) AS text FROM e")
def event_log_lines(spark, d):
    line = exported.event_log_line(F.col("ts"), F.col("level"), fields.resolve("SourceContext"), F.col("message"))
    return B.once(B.events(spark, d), line.alias("text"))


@query(f"""WITH {B.E}, k AS (SELECT source, line_number, message, last_value(ts IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS key FROM e)
    SELECT row_number() OVER (ORDER BY key NULLS FIRST, source, line_number) AS line_number, source, line_number AS source_line, source || '│ ' || message AS text FROM k""")
def merge_sources(spark, d):
    rows = B.once(B.events(spark, d), "ts", F.col("message").alias("text"))
    return merge.merge(rows, time=F.col("ts")).select("line_number", "source", "source_line", "text")


@query("SELECT pending_id, regexp_replace(text, '^[^│]*│ ?', '') AS text FROM (SELECT DISTINCT pending_id, text FROM pending_lines)")
def strip_labels(spark, d):
    rows = table(spark, d, "pending_lines").select("pending_id", "text").distinct()
    return rows.select("pending_id", merge.strip_label(F.col("text")).alias("text"))


# ---- formats ----------------------------------------------------------------------------------------------------

def iso():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _typed(spark, d, line, fmt, **more) -> DataFrame:
    rows = B.event_log(spark, d).withColumn("text", line)
    return parse(rows.select("source", "line_number", "text"), fmt, **more)


def _out(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("line_number", us("ts").alias("us"), "level", "message", *[F.try_element_at("properties", F.lit(n)).alias(n) for n in names])


_PLAIN = f"WITH {B.V} SELECT line_number, epoch_us(ts) AS us, level, message, user_id::VARCHAR AS UserId, k FROM v"


@query(_PLAIN)
def parse_clef(spark, d):
    line = F.to_json(F.struct(iso().alias("@t"), F.lit("User {UserId} {EventType} k={k}").alias("@mt"), F.col("level").alias("@l"), F.col("properties.UserId").alias("UserId"), F.col("event_type").alias("EventType"), F.col("properties.k").alias("k")))
    return _out(_typed(spark, d, line, "serilog"), "UserId", "k")


@query(_PLAIN)
def parse_standard_json(spark, d):
    line = F.to_json(F.struct(iso().alias("Timestamp"), F.col("level").alias("Level"), F.lit("User {UserId} {EventType} k={k}").alias("MessageTemplate"), F.col("properties").alias("Properties")))
    return _out(_typed(spark, d, line, "serilog"), "UserId", "k")


@query(_PLAIN)
def parse_ndjson(spark, d):
    line = F.to_json(F.struct(us("ts").alias("x"), iso().alias("time"), F.lower("level").alias("level"), F.col("message").alias("msg"), F.col("properties.UserId").alias("UserId"), F.col("properties.k").alias("k")))
    return _out(_typed(spark, d, line, "ndjson"), "UserId", "k")


@query(_PLAIN)
def parse_logfmt(spark, d):
    line = F.concat(F.lit("ts="), iso(), F.lit(" level="), F.lower("level"), F.lit(' msg="'), "message", F.lit('" UserId='), F.col("properties.UserId"), F.lit(" k="), F.col("properties.k"))
    return _out(_typed(spark, d, line, "logfmt"), "UserId", "k")


@query(_PLAIN)
def parse_syslog(spark, d):
    pri = F.when(F.col("level") == "Error", "11").when(F.col("level") == "Warning", "12").otherwise("14")
    line = F.concat(F.lit("<"), pri, F.lit(">1 "), iso(), F.lit(" box app 1 - [x@1 UserId=\""), F.col("properties.UserId"), F.lit("\" k=\""), F.col("properties.k"), F.lit("\"] "), "message")
    return _out(_typed(spark, d, line, "syslog"), "UserId", "k")


@query(f"WITH {B.V} SELECT line_number, epoch_us(date_trunc('second', ts)) AS us, level, message, 'app' AS tag FROM v")
def parse_syslog_old(spark, d):
    pri = F.when(F.col("level") == "Error", "11").when(F.col("level") == "Warning", "12").otherwise("14")
    line = F.concat(F.lit("<"), pri, F.lit(">"), F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" box app: "), "message")
    return _out(_typed(spark, d, line, "syslog", year=2024), "tag")


@query(f"WITH {B.E} SELECT source, line_number, trace_id, span_id FROM e WHERE trace_id IS NOT NULL")
def parse_trace_ids(spark, d):
    """Trace and span of compact events, from their own members."""
    rows = B.events(spark, d).where("trace_id is not null")
    line = F.to_json(F.struct(iso().alias("@t"), F.lit("m").alias("@mt"), F.col("trace_id").alias("@tr"), F.col("span_id").alias("@sp")))
    return B.once(parse(rows.select("source", "line_number", line.alias("text")), "serilog"), "trace_id", "span_id")


@query(f"""WITH {B.V} SELECT line_number, CASE WHEN event_id % 2 = 0 THEN message ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' [' || upper(level) || '] ' || message END AS message,
    epoch_us(CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('millisecond', ts) END) AS us, level FROM v""")
def parse_unknown(spark, d):
    """Lines of no one format: structured ones as such, all others as plain text."""
    compact = F.to_json(F.struct(iso().alias("@t"), F.lit("User {UserId} {EventType} k={k}").alias("@mt"), F.col("level").alias("@l"), F.col("properties.UserId").alias("UserId"), F.col("event_type").alias("EventType"), F.col("properties.k").alias("k")))
    plain = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), F.upper("level"), F.lit("] "), "message")
    return _typed(spark, d, F.when(F.col("event_id") % 2 == 0, compact).otherwise(plain), None).select("line_number", "message", us("ts").alias("us"), "level")


@query(f"WITH {B.V} SELECT line_number + 1 AS line_number, epoch_us(date_trunc('second', ts)) AS us, CASE WHEN level = 'Error' THEN 'Error' WHEN level = 'Warning' THEN 'Warning' ELSE 'Information' END AS level, 'GET /' || event_type || ' → ' || CASE level WHEN 'Error' THEN '500' WHEN 'Warning' THEN '404' ELSE '200' END || ' (' || k || ' ms)' AS message, '' AS \"cs-uri-query\" FROM v")
def parse_w3c(spark, d):
    status = F.when(F.col("level") == "Error", "500").when(F.col("level") == "Warning", "404").otherwise("200")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("GET"), F.concat(F.lit("/"), "event_type"), F.lit("-"), status, F.col("properties.k"))
    rows = B.event_log(spark, d).select("source", (F.col("line_number") + 1).alias("line_number"), line.alias("text"))
    head = spark.createDataFrame([("events", 1, "#Fields: date time cs-method cs-uri-stem cs-uri-query sc-status time-taken")], "source string, line_number long, text string")
    return _out(native.parse_w3c(rows.unionByName(head)), "cs-uri-query")


@query(f"WITH {B.V} SELECT line_number, epoch_us(date_trunc('millisecond', ts)) AS us, level, message, 'app.' || event_type AS logger FROM v")
def parse_custom(spark, d):
    word = F.when(F.col("level") == "Error", "ERROR").when(F.col("level") == "Warning", "WARN").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [main] "), word, F.lit(" app."), "event_type", F.lit(" - "), "message")
    return _out(_typed(spark, d, line, EXAMPLES[0]), "logger")


@query(f"WITH {B.V} SELECT line_number, epoch_us(date_trunc('millisecond', ts)) AS us, CASE level WHEN 'Information' THEN 'Information' ELSE level END AS level, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' [' || upper(level) || '] ' || message AS message FROM v")
def parse_plain(spark, d):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), F.upper("level"), F.lit("] "), "message")
    rows = _typed(spark, d, line, "plain")
    return rows.select("line_number", us("ts").alias("us"), "level", "message")


@query()
def detect_formats(spark, d):
    return detect_sources(B.lines(spark, d))


_LOG4J = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s+\[[^\]]+\]\s+([A-Za-z]+)\s+\S+\s+-\s+"


@query(f"""WITH {B.L}, h AS (SELECT source, line_number, text, regexp_matches(text, '{_LOG4J}') AS is_head, {B.normal(f"regexp_extract(text, '{_LOG4J}', 1)")} AS lv FROM l),
    o AS (SELECT source, line_number, text, last_value(CASE WHEN is_head THEN line_number END IGNORE NULLS) OVER w AS owner, last_value(CASE WHEN is_head THEN lv END IGNORE NULLS) OVER w AS lv
        FROM h WINDOW w AS (PARTITION BY source ORDER BY line_number ROWS UNBOUNDED PRECEDING))
    SELECT source, line_number, CASE WHEN text <> '' THEN owner END AS owner, CASE WHEN text <> '' THEN lv END AS level FROM o""")
def continuation_lines(spark, d):
    rows = B.lines(spark, d)
    first = B.once(rows, F.substring("text", 1, 1).alias("text"))  # all that tells a blank line
    heads = B.once(parse(rows, EXAMPLES[0]), "level")
    return join_continuations(first, heads).select("source", "line_number", "owner", "level")
