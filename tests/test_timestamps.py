import datetime as dt

import pandas as pd
import pytest

from cordwood.operators import timestamps as T

UTC = dt.timezone.utc
ZONES = [("berlin", "Europe/Berlin", "dmy"), ("york", "America/New_York", "mdy"), ("howe", "Australia/Lord_Howe", "dmy"), ("utc", "Etc/UTC", "dmy")]


def run(spark, rows):
    zones = spark.createDataFrame(ZONES, "source string, zone_name string, date_order string")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, source string, raw string, read_at timestamp")
    return [r.asDict() for r in T.normalise(df, "source", "raw", "read_at", zones).orderBy("id").collect()]


def us(*a):
    return int((dt.datetime(*a, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


LATE = dt.datetime(2026, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize(
    ("source", "raw", "expected"),
    [
        ("utc", "2025-07-21T18:37:28.3168849Z", us(2025, 7, 21, 18, 37, 28, 316884)),
        ("berlin", "2025-07-04 07:03:07+0200", us(2025, 7, 4, 5, 3, 7)),
        ("york", "2025-06-15 05:59:14.564707+10", us(2025, 6, 14, 19, 59, 14, 564707)),
        ("berlin", "  [2025-03-04 02:35:56,522] ", us(2025, 3, 4, 1, 35, 56, 522000)),
        ("berlin", '"2025-08-16 02:03"', us(2025, 8, 16, 0, 3)),
        ("utc", "20250810 203144.426", us(2025, 8, 10, 20, 31, 44, 426000)),
        ("utc", "20251102t054540z", us(2025, 11, 2, 5, 45, 40)),
        ("berlin", "04/08/2025 06:26:20", us(2025, 8, 4, 4, 26, 20)),
        ("york", "04/08/2025 06:26:20 PM", us(2025, 4, 8, 22, 26, 20)),
        ("york", "08.12.2024 17:07:21,008", us(2024, 12, 8, 22, 7, 21, 8000)),
        ("york", "24/Oct/2024:07:22:01 -0400", us(2024, 10, 24, 11, 22, 1)),
        ("york", "Fri, 1 Aug 2025 13:58:31 +0530", us(2025, 8, 1, 8, 28, 31)),
        ("york", "Fri, 01 Aug 2025 13:58:31 GMT", us(2025, 8, 1, 13, 58, 31)),
        ("york", "Aug  1 2025 16:20:17", us(2025, 8, 1, 20, 20, 17)),
        ("york", "2025-11-02T01:08:13-05:00[America/New_York]", us(2025, 11, 2, 6, 8, 13)),
        ("utc", "1753066876", 1753066876 * 10**6),
        ("utc", "1730311197.680", 1730311197680000),
        ("utc", "1761038650641", 1761038650641000),
        ("utc", "1750185431024123", 1750185431024123),
        ("utc", "1754353305994516371", 1754353305994516),
        ("berlin", "2025-10-26 02:50:31.251 CEST", us(2025, 10, 26, 0, 50, 31, 251000)),
        ("berlin", "2025-10-26 02:50:31.251 CET", us(2025, 10, 26, 1, 50, 31, 251000)),
        ("york", "2025-11-02 01:01:55.888 EDT", us(2025, 11, 2, 5, 1, 55, 888000)),
        ("york", "2025-11-02 01:01:55.888 EST", us(2025, 11, 2, 6, 1, 55, 888000)),
        (None, "2025-01-02 03:04:05", us(2025, 1, 2, 3, 4, 5)),
    ],
)
def test_notations(spark, source, raw, expected):
    assert run(spark, [(source, raw, LATE)])[0]["utc_us"] == expected


def test_unreadable_and_impossible(spark):
    bad = [None, "", "-", "n/a", "null", "unknown", "2025-02-30 11:12:13", "2025-13-07T08:00:00Z", "0000-00-00 00:00:00", "2025-06-11T27:75:00Z", "??/??/2025", "boot+12.4s", "x" * 100_000, "2025-01-01 10:00:60"]
    assert [r["utc_us"] for r in run(spark, [("utc", b, LATE) for b in bad])] == [None] * len(bad)


def test_wall_times_that_occur_twice_or_never(spark):
    early, late = us(2025, 10, 26, 0, 30), us(2025, 10, 26, 1, 30)
    read = lambda u: dt.datetime.fromtimestamp(u / 1e6, UTC)
    rows = [("berlin", "2025-10-26 02:30:00", read(late)), ("berlin", "2025-10-26 02:30:00", read(late - 1_000_000)), ("berlin", "2025-10-26 02:30:00", read(early - 1_000_000))]
    rows += [("berlin", "2025-10-26 02:30:00", None), ("berlin", "2025-03-30 02:30:00", LATE), ("howe", "2025-04-06 01:45:00", LATE)]
    got = [r["utc_us"] for r in run(spark, rows)]
    assert got == [late, early, early, early, us(2025, 3, 30, 1, 30), us(2025, 4, 5, 15, 15)]


def test_em_finds_the_order_without_declaration():
    counts = pd.DataFrame({"notation": ["slash"] * 3, "ba": [None, 5, 20], "bb": [5, 22, 5], "bu": [None] * 3, "declared": [None] * 3, "n": [50, 3, 40]})
    assert T.fit(counts, strength=1.0).weight_a.iat[0] < 0.2


def planted(source, offset_h, stamps=60):
    """Stamps of a source whose wall clock is offset_h ahead of UTC: read 2 to 40 s later; every third has its offset."""
    out = []
    for i in range(stamps):
        at = dt.datetime(2025, 6, 1 + i % 28, 1 + i % 22, 10, i % 60, tzinfo=UTC)
        wall = at + dt.timedelta(hours=offset_h)
        raw = wall.strftime("%Y-%m-%d %H:%M:%S") + (f"+{offset_h:02d}:00" if i % 3 == 0 else "") if i % 4 else wall.strftime("%m/%d/%Y %H:%M:%S")
        out.append((source, raw, at + dt.timedelta(seconds=2 + i % 39), int(at.timestamp()) * 1_000_000))
    return out


def test_mixtures_decide_what_is_not_declared(spark):
    rows = [*planted("east", 2), *planted("plain", 0)]
    zones = spark.createDataFrame([*ZONES, ("tokyo", "Asia/Tokyo", "dmy")], "source string, zone_name string, date_order string")
    df = spark.createDataFrame(rows, "source string, raw string, read_at timestamp, true_us long")
    got = T.normalise(df, "source", "raw", "read_at", zones).collect()
    assert all(r.utc_us == r.true_us for r in got) and {r.zone for r in got if r.source == "east"} == {"Europe/Berlin", None}
    without = T.normalise(df, "source", "raw", "read_at", zones, rounds=0).collect()
    assert sum(r.utc_us != r.true_us for r in without) > 20  # without the mixtures zone and order are wrong


def test_equal_wall_times_are_marked(spark):
    late = us(2025, 10, 26, 1, 30)
    rows = [("berlin", "2025-10-26 02:30:00", dt.datetime.fromtimestamp(late / 1e6 + d, UTC)) for d in (20_000, -1)] + [("berlin", "2025-10-27 02:30:00", LATE)]
    assert [r["ambiguous"] for r in run(spark, rows)] == [True, False, False]


def test_ambiguity_is_marked(spark):
    zones = spark.createDataFrame([("s", "Etc/UTC", None)], "source string, zone_name string, date_order string")
    df = spark.createDataFrame([("s", "03/04/2025 10:00:00", None)], "source string, raw string, read_at timestamp")
    row = T.normalise(df, "source", "raw", "read_at", zones).first()
    assert row.ambiguous and row.utc_us in (us(2025, 4, 3, 10), us(2025, 3, 4, 10))


def test_copies_extra_columns_and_empty_tables(spark):
    zones = spark.createDataFrame(ZONES, "source string, zone_name string, date_order string")
    raw = spark.createDataFrame([(1, "utc", "2025-01-01T00:00:00Z", LATE, 5)] * 3 + [(2, None, None, None, None)], "raw_id long, source string, ts_raw string, read_at timestamp, utc_us int")
    pending = spark.createDataFrame([(1, "utc", "1753066876", LATE)], "pending_id long, label string, sort_key string, enqueued_utc timestamp")
    assert sorted(map(tuple, T.found(raw, pending, zones).collect())) == [("event", 1, us(2025, 1, 1)), ("pending", 1, 1753066876000000)]
    assert T.found(raw.limit(0), pending.limit(0), zones).count() == 0
    assert T.normalise(raw, "source", "ts_raw", "read_at", zones).columns.count("utc_us") == 1
