"""Mixed timestamp notations and zones to one UTC instant (problem 1).

Every value is rewritten, inside the JVM, into the fields its notation carries and read in every way that is valid: with
day before month or month before day, in the source's zone or in any other zone at hand where the source has none, as
the earlier or the later of two equal wall times, as a number in the unit its size implies or a neighbouring one. An
expectation-maximisation over the mixture of readings decides: a value contributes to a reading the likelihood of its
delay (read time less instant, in logarithmic buckets; negative delays are impossible), the posteriors re-weight the
readings and the densities of delays. What a source declares (zone, order of dates) is the prior, so strong that only
impossible readings overturn it; where it declares nothing, the data decide. A value is marked ambiguous if the
posterior of its reading stays below a bound; of two equal wall times a rule takes one, and what likelihood the other
has makes it unsure.

Two mixtures are fitted. The zone is one for each source without one: its values' delays under each candidate zone
are weighed against the delays of stamps that carry their own offset. The other readings are weighed value by value in
each source. Only counts by source, notation, reading and delay bucket (a bounded number per source) reach Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.plan import fenced
from cordwood.session import cut

# Abbreviations that mean UTC wherever they occur.
_UTC_NAMES = ("GMT", "UTC", "Z", "UT")
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

_D2, _CLOCK = r"(\d{1,2})", r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*([+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5})?(?:\[([A-Za-z0-9_+\-/]+)\])?"
_MON = r"([A-Za-z]{3})[a-z]*"

# notation -> (pattern, order of its groups as: year month day hour minute second fraction half zone region)
_NOTATIONS = {
    "iso": (rf"^(\d{{4}})-{_D2}-{_D2}(?:[Tt]|\s+){_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt\s](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE + "$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    "slash": (rf"^{_D2}/{_D2}/(\d{{4}})\s+{_CLOCK}(?:\s*([AaPp][Mm]))?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    "yslash": (rf"^(\d{{4}})/{_D2}/{_D2}\s+{_CLOCK}(?:\s*([AaPp][Mm]))?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
    "dot": (rf"^{_D2}\.{_D2}\.(\d{{4}})\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 9)),
    "clf": (rf"^{_D2}/{_MON}/(\d{{4}}):{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 9)),
    "rfc": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_D2}\s+{_MON}\s+(\d{{4}})\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 9)),
    "month": (rf"^{_MON}\s+{_D2},?\s+(\d{{4}})\s+{_CLOCK}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 0, 8, 9)),
}
_NUMBER = r"^(\d{1,19})(?:\.(\d+))?$"
_BUCKETS = 24
DAY_US = 86_400_000_000
IMPOSSIBLE = 1e-12  # likelihood of a delay below zero
OTHERWISE = 1e-9  # prior of a reading against what its source declares
MOST_ZONES = 700  # more than the world has


def _fields(text: Column) -> Column:
    """'notation|year|month|day|hour|minute|second|fraction|half|zone|region' or null."""
    out = F.lit(None).cast("string")
    for name, (pattern, order) in reversed(_NOTATIONS.items()):
        shape = "|".join([name, *(f"${g}" if g else "" for g in order)])
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, shape)).otherwise(out)
    return out


def _wall(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, us: Column) -> Column:
    """Microseconds of a wall time read as UTC, null if there is no such time."""
    ok = (s < 60) & (mi < 60) & (h < 24) & (y >= 1)
    return F.when(ok, F.unix_micros(F.try_make_timestamp(y, mo, d, h, mi, s.cast("decimal(16,6)"), F.lit("UTC"))) + us)


def _offset_at(utc_us: Column, zone: Column) -> Column:
    """Offset in microseconds that zone has at an instant."""
    at = F.timestamp_micros(utc_us)
    return F.unix_micros(F.from_utc_timestamp(at, zone)) - utc_us


def _in_zone(wall: Column, zone: Column, read_us: Column) -> Column:
    """Instant of a wall time in a zone: in a gap the offset before it holds; of two readings the later one that is
    not after read_us, else the earlier; without read_us the earlier."""
    before, after = _offset_at(wall - DAY_US, zone), _offset_at(wall + DAY_US, zone)
    first, second = wall - before, wall - after
    twice = (before > after) & (_offset_at(first, zone) == before) & (_offset_at(second, zone) == after)
    valid_second = _offset_at(second, zone) == after
    return (
        F.when(before == after, first)
        .when(twice, F.when(second <= read_us, second).otherwise(first))
        .when(_offset_at(first, zone) == before, first)
        .when(valid_second, second)
        .otherwise(first)
    )


def _named(wall: Column, zone: Column, name: Column) -> Column:
    """Instant of a wall time whose abbreviation belongs to the zone: names of summer times take the larger of the
    zone's offsets of that year, all others the smaller."""
    year = F.timestamp_micros(wall)
    winter = _offset_at(F.unix_micros(F.date_trunc("year", year)) + F.lit(14 * DAY_US), zone)
    summer = _offset_at(F.unix_micros(F.date_trunc("year", year)) + F.lit(195 * DAY_US), zone)
    light = name.rlike("^(?i:[A-Z]+DT|[CEW]EST|BST|BRST|MSD)$")
    return wall - F.when(light, F.greatest(winter, summer)).otherwise(F.least(winter, summer))


def candidates(df: DataFrame, text: str, zone: str, read_at: str) -> DataFrame:
    """df with notation, bare (whether zone decides the reading) and an instant in microseconds for each reading that
    is valid, else null: cand_a (for dates of digits and slashes day/month), cand_b (month/day), cand_later and
    cand_first (where a wall time occurs twice), cand_unit (for numbers that are as well readable in the next smaller
    or larger unit).

    zone is the zone's name; null is UTC. Values that are null, unreadable or impossible have no reading.
    """
    raw = F.regexp_replace(F.col(text), r"^[\s\"'\[\( \ufeff]+|[\s\"'\) ]+$", "")
    raw = F.regexp_replace(raw, r"^([^\[]*)\]$", "$1")
    df = df.withColumn("_raw", raw)
    df = fenced(df, _f=F.split(_fields(F.col("_raw")), r"\|"))
    part = lambda i: F.nullif(F.get("_f", F.lit(i)), F.lit(""))
    num = lambda c: F.col(c).try_cast("int")
    month_names = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m, i + 1)])
    df = df.select(
        "*",
        part(0).alias("notation0"),
        part(1).cast("int").alias("_y"),
        part(2).alias("_mo0"),
        part(3).cast("int").alias("_d"),
        part(4).cast("int").alias("_h0"),
        part(5).cast("int").alias("_mi"),
        F.coalesce(part(6).cast("int"), F.lit(0)).alias("_s"),
        F.rpad(F.substring(F.coalesce(part(7), F.lit("0")), 1, 6), 6, "0").cast("long").alias("_us"),
        F.upper(part(8)).alias("_half"),
        part(9).alias("_zone"),
        part(10).alias("_region"),
        F.unix_micros(F.col(read_at)).alias("_read"),
    )
    mo = F.coalesce(num("_mo0"), F.try_element_at(month_names, F.upper(F.substring("_mo0", 1, 3))))
    hour = (
        F.when(F.col("_half").isNull(), F.col("_h0"))
        .when(~F.col("_h0").between(1, 12), F.lit(99))
        .otherwise(F.col("_h0") % 12 + F.when(F.col("_half") == "PM", 12).otherwise(0))
    )
    df = fenced(df, _mo=mo, _h=hour)
    clock = (F.col("_h"), F.col("_mi"), F.col("_s"), F.col("_us"))
    df = fenced(
        df,
        _wa=_wall(F.col("_y"), F.col("_mo"), F.col("_d"), *clock),
        _wb=F.when(F.col("notation0") == "slash", _wall(F.col("_y"), F.col("_d"), F.col("_mo"), *clock)),
    )

    off = F.col("_zone")
    digits = F.regexp_replace(off, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    offset = F.when(off.rlike("^[+-]") & (F.length(digits) >= 2), minutes * F.when(off.startswith("-"), F.lit(-60_000_000).cast("long")).otherwise(F.lit(60_000_000).cast("long")))
    own = F.coalesce(F.col("_region"), F.col(zone), F.lit("UTC"))

    free = off.isNull() & F.col("_region").isNull()

    def instant(wall: Column) -> Column:
        return (
            F.when(wall.isNull(), F.lit(None).cast("long"))
            .when(offset.isNotNull(), wall - offset)
            .when(F.upper(off).isin(*_UTC_NAMES), wall)
            .when(off.isNotNull(), _named(wall, own, off))
            .otherwise(_in_zone(wall, own, F.col("_read")))
        )

    whole = F.when(F.col("_raw").rlike(_NUMBER), F.regexp_extract("_raw", _NUMBER, 1).try_cast("decimal(20,0)"))
    fraction = F.regexp_extract("_raw", _NUMBER, 2)
    first = lambda n: F.rpad(F.substring(fraction, 1, n), n, "0").cast("long")
    number = (
        F.when(whole < 100_000_000_000, whole.cast("long") * 1_000_000 + first(6))
        .when(whole < 100_000_000_000_000, whole.cast("long") * 1_000 + first(3))
        .when(whole < 100_000_000_000_000_000, whole.cast("long"))
        .otherwise(F.floor(whole / 1000).cast("long"))
    )
    # the next unit that is not in the future and not before 1990 either
    other = [F.when(whole < 9_000_000_000_000_000_000 // k, (whole * k).cast("long")) for k in (1_000_000, 1_000, 1)]
    least = F.lit(631_152_000_000_000).cast("long")
    unit = F.coalesce(*[F.when((x != number) & x.between(least, F.col("_read")), x) for x in other])
    df = fenced(df, cand_a=F.coalesce(instant(F.col("_wa")), number), cand_b=instant(F.col("_wb")), cand_unit=unit, _own=own, _free=free & F.col("_wa").isNotNull())
    before, after = _offset_at(F.col("_wa") - DAY_US, F.col("_own")), _offset_at(F.col("_wa") + DAY_US, F.col("_own"))
    twice = F.col("_free") & (before > after) & (_offset_at(F.col("_wa") - before, F.col("_own")) == before) & (_offset_at(F.col("_wa") - after, F.col("_own")) == after)
    df = fenced(df, cand_first=F.when(twice, F.col("_wa") - before), cand_later=F.when(twice, F.col("_wa") - after))
    df = df.withColumns({"notation": F.coalesce("notation0", F.when(F.col("cand_a").isNotNull(), "number")), "bare": F.col("_free"), "_wall": F.col("_wa")})
    return df.drop("_raw", "_f", "notation0", "_y", "_mo0", "_d", "_h0", "_mi", "_s", "_us", "_half", "_zone", "_region", "_mo", "_h", "_wa", "_wb", "_own", "_free")


def _bucket(delay_us: Column) -> Column:
    """Logarithmic bucket of a delay: -1 impossible, 0 below a second, then powers of two of seconds."""
    log = F.floor(F.log2(F.greatest(delay_us / 1e6, F.lit(0.5)))) + 1
    return F.when(delay_us < 0, -1).otherwise(F.least(F.greatest(log, F.lit(0)), F.lit(_BUCKETS - 1))).cast("int")


def _like(density: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Likelihood of delay buckets: impossible ones next to none, an unknown delay (no read time) like any, -2: no such
    reading."""
    out = np.where(bucket >= _BUCKETS, 1.0 / _BUCKETS, density[np.clip(bucket, 0, _BUCKETS - 1)])
    return np.where(bucket == -2, 0.0, np.where(bucket < 0, IMPOSSIBLE, out))


def fit(counts: pd.DataFrame, strength: float = 50.0, rounds: int = 100) -> pd.DataFrame:
    """Expectation-maximisation of one source: weights of the readings of each notation and the density of delays.

    counts: notation, ba, bb, bu (delay bucket of the readings a, b and unit; null: not valid; _BUCKETS: no read time),
    declared (a, b or null), n. The declared reading is the prior, worth strength values, or more where a notation has
    more; without a declaration all readings begin equal. Returns notation, weight_a, weight_b, weight_unit and the
    density of each delay bucket as one array.
    """
    notations, of = np.unique(counts["notation"].to_numpy(object).astype(str), return_inverse=True)
    bucket = np.stack([counts[c].astype("float64").fillna(-2).to_numpy().astype(int) for c in ("ba", "bb", "bu")], 1)
    n = counts["n"].to_numpy(float)
    prior = np.tile([1 / 2, 1 / 2, 0.0], (len(notations), 1))
    for k, d in zip(of, counts["declared"]):
        if d in ("a", "b"):
            prior[k] = (1 - 2 * OTHERWISE, OTHERWISE, OTHERWISE) if d == "a" else (OTHERWISE, 1 - 2 * OTHERWISE, OTHERWISE)
    declared = np.array([prior[k].max() > 0.9 for k in range(len(notations))])
    weight, density = prior.copy(), np.full(_BUCKETS, 1 / _BUCKETS)
    total = np.bincount(of, n, len(notations))
    held = np.where(declared, np.maximum(strength, 1000 * total), strength)[:, None]
    for _ in range(rounds):
        share = weight[of] * _like(density, bucket)
        whole = share.sum(1)
        share = np.where(whole[:, None] > 0, share / np.where(whole > 0, whole, 1)[:, None], 0.0) * n[:, None]
        got = np.stack([np.bincount(of, share[:, r], len(notations)) for r in range(3)], 1)
        fresh = (held * prior + got) / (held + got.sum(1, keepdims=True))
        inside = (bucket >= 0) & (bucket < _BUCKETS)
        seen = np.bincount(bucket[inside], share[inside], _BUCKETS) + 1e-3
        density = seen / seen.sum()
        moved = np.abs(fresh - weight).max() if len(weight) else 0.0
        weight = fresh
        if moved < 1e-9:
            break
    out = pd.DataFrame({"notation": notations, "weight_a": weight[:, 0], "weight_b": weight[:, 1], "weight_unit": weight[:, 2]})
    out["density"] = [density.tolist()] * len(out)
    return out


def fit_zones(counts: pd.DataFrame, known: np.ndarray, rounds: int = 50) -> tuple[str, float]:
    """(zone, posterior) of one source without a declared one. counts: zone, bucket, n of its stamps without offset
    under each candidate zone, UTC among them; known: counts by bucket of the source's stamps with one (or of all
    sources' if it has none). The zone is one for the source; the density of delays is re-estimated under the
    posteriors of the zones."""
    zones = sorted(set(counts["zone"]), key=lambda z: (z != "UTC", z))
    table = np.zeros((len(zones), _BUCKETS))
    impossible = np.zeros(len(zones))
    for z, b, n in zip(counts["zone"], counts["bucket"], counts["n"]):
        if b < 0:
            impossible[zones.index(z)] += n
        elif b < _BUCKETS:
            table[zones.index(z), int(b)] += n
    base = known + 0.5
    density = base / base.sum()
    posterior = np.full(len(zones), 1 / len(zones))
    for _ in range(rounds):
        log = table @ np.log(density) + impossible * np.log(IMPOSSIBLE)
        fresh = np.exp(np.maximum(log - log.max(), -700))
        fresh /= fresh.sum()
        seen = base + fresh @ table
        density = seen / seen.sum()
        if np.abs(fresh - posterior).max() < 1e-9:
            posterior = fresh
            break
        posterior = fresh
    best = int(np.argmax(posterior))
    return zones[best], float(posterior[best])


def zones_of(df: DataFrame, source: str, text: str, read_at: str, zones: DataFrame, most: int = MOST_ZONES) -> DataFrame:
    """_us (source), _uz (zone name), _up (posterior) of every source that zones does not declare a zone for.

    Candidates are UTC and the zones that others declare, of which there are a few hundred in the world; more than
    most raise. Null sources count as one source.
    """
    names = sorted({r.zone_name for r in zones.select("zone_name").where("zone_name is not null").distinct().limit(most + 1).collect()} | {"UTC"})
    if len(names) > most:
        raise ValueError(f"more than {most} zones")
    declared = zones.where("zone_name is not null").select(F.col("source").alias("_zs")).distinct()
    rows = df.select(F.col(source).alias("_zk"), F.col(text).alias("_zt"), F.col(read_at).alias("_zr"), F.lit(None).cast("string").alias("_none")).where("_zt is not null and _zr is not null")
    rows = candidates(rows.join(declared, F.col("_zk") == F.col("_zs"), "left_anti"), "_zt", "_none", "_zr")
    rows = rows.where("cand_a is not null").select(F.coalesce("_zk", F.lit("")).alias("_us"), "bare", "_wall", "_read", "cand_a")
    own = rows.where("not bare").select("_us", F.lit("").alias("zone"), _bucket(F.col("_read") - F.col("cand_a")).alias("bucket"))
    each = rows.where("bare").withColumn("zone", F.explode(F.array(*map(F.lit, names))))
    each = each.select("_us", "zone", _bucket(F.col("_read") - _in_zone(F.col("_wall"), F.col("zone"), F.col("_read"))).alias("bucket"))
    counts = own.unionByName(each).groupBy("_us", "zone", "bucket").agg(F.count("*").alias("n"))

    def per_source(key, pdf):
        mine = pdf[pdf["zone"] != ""]
        stated = pdf[(pdf["zone"] == "") & pdf["bucket"].between(0, _BUCKETS - 1)]
        known = np.bincount(stated["bucket"].astype(int), stated["n"], _BUCKETS).astype(float)
        zone, posterior = fit_zones(mine, known) if len(mine) else ("UTC", 1.0)
        return pd.DataFrame({"_us": [key[0]], "_uz": [zone], "_up": [posterior]})

    return counts.groupBy("_us").applyInPandas(per_source, "_us string, _uz string, _up double")


def normalise(
    df: DataFrame, source: str, text: str, read_at: str, zones: DataFrame, certain: float = 0.9, max_sources: int = 100_000, rounds: int = 100
) -> DataFrame:
    """df with utc_us (null if unreadable), notation, zone, posterior and ambiguous.

    zones: source, zone_name, date_order, one row per source; it is broadcast up to max_sources rows and joined by
    shuffle beyond. Sources without a declared zone or order (null and unknown ones too) are read as the mixtures
    decide. Of a wall time that occurs twice the later reading that is not after read_at is taken, else the earlier.
    Extra columns pass through; columns of the names this operator adds are replaced. An empty table gives an empty
    result. rounds: of the mixtures; 0 takes the declarations and, without any, day before month.
    """
    keep = [c for c in df.columns if c not in ("utc_us", "notation", "zone", "posterior", "ambiguous")]
    df = df.select(*keep)
    zones = zones.select("source", "zone_name", "date_order").where("source is not null").dropDuplicates(["source"])
    small = zones.limit(max_sources + 1).count() <= max_sources
    hint = F.broadcast if small else lambda x: x
    given = zones.select(F.col("source").alias("_zs"), F.col("zone_name").alias("_zn"), F.col("date_order").alias("_zo"))
    rows = df.join(hint(given), F.col(source) == F.col("_zs"), "left").withColumn("_key", F.coalesce(F.col(source), F.lit("")))
    guessed = cut(zones_of(df, source, text, read_at, zones)).withColumnRenamed("_us", "_gk") if rounds else None
    if guessed is not None and not guessed.isEmpty():
        rows = rows.join(hint(guessed) if guessed.limit(max_sources + 1).count() <= max_sources else guessed, (F.col("_key") == F.col("_gk")) & F.col("_zn").isNull(), "left")
    else:
        rows = rows.withColumns({"_uz": F.lit(None).cast("string"), "_up": F.lit(None).cast("double")})
    rows = rows.withColumn("_zone_used", F.coalesce("_zn", "_uz", F.lit("UTC")))
    rows = candidates(rows, text, "_zone_used", read_at)
    bucket = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(_bucket(F.col("_read") - F.col(c)), F.lit(_BUCKETS)))
    rows = fenced(rows, _ba=bucket("cand_a"), _bb=bucket("cand_b"), _bu=bucket("cand_unit"), _b1=bucket("cand_first"), _b2=bucket("cand_later"))
    # kept, since both the counts and the rows need the readings, which cost far more than to write them
    rows = cut(rows.drop("_wall", "_read", "_zs", "_gk", "_uz", "cand_first"))

    declared = F.when(F.col("notation") == "slash", F.when(F.col("_zo") == "dmy", "a").when(F.col("_zo") == "mdy", "b")).otherwise(F.lit("a"))
    counts = rows.where(F.col("notation").isNotNull()).groupBy(
        "_key", "notation", F.col("_ba").alias("ba"), F.col("_bb").alias("bb"), F.col("_bu").alias("bu"), declared.alias("declared"),
    ).agg(F.count("*").alias("n"))

    def per_source(key, pdf):
        return fit(pdf, rounds=rounds).assign(_k=key[0])[["_k", "notation", "weight_a", "weight_b", "weight_unit", "density"]]

    weights = counts.groupBy("_key").applyInPandas(per_source, "_k string, notation string, weight_a double, weight_b double, weight_unit double, density array<double>")
    weights = weights.withColumnRenamed("notation", "_n")
    rows = rows.join(hint(weights), (F.col("_key") == F.col("_k")) & (F.col("notation") == F.col("_n")), "left")

    def like(bucket: str) -> Column:
        b = F.col(bucket)
        return F.when(b.isNull(), F.lit(0.0)).when(b < 0, F.lit(IMPOSSIBLE)).when(b >= _BUCKETS, F.lit(1.0 / _BUCKETS)).otherwise(F.get("density", b))

    rows = fenced(rows, _la=F.col("weight_a") * like("_ba"), _lb=F.col("weight_b") * like("_bb"), _lu=F.col("weight_unit") * like("_bu"), _l1=like("_b1"), _l2=like("_b2"))
    whole = F.col("_la") + F.col("_lb") + F.col("_lu")
    best = F.when((F.col("_lb") > F.col("_la")) & (F.col("_lb") >= F.col("_lu")), "b").when(F.col("_lu") > F.col("_la"), "unit").otherwise("a")
    rows = fenced(rows, _take=best, _post=F.try_divide(F.greatest("_la", "_lb", "_lu"), whole))
    taken = F.when(F.col("_take") == "b", F.col("cand_b")).when(F.col("_take") == "unit", F.col("cand_unit")).otherwise(F.coalesce("cand_a", "cand_b"))
    # two equal wall times: the rule takes one, its share of the likelihood says how sure that is
    fold = F.when((F.col("_take") == "a") & F.col("cand_later").isNotNull(), F.try_divide(F.when(taken == F.col("cand_later"), F.col("_l2")).otherwise(F.col("_l1")), F.col("_l1") + F.col("_l2")))
    sure = F.col("_post") * F.coalesce(fold, F.lit(1.0)) * F.when(F.col("bare") & F.col("_zn").isNull(), F.coalesce("_up", F.lit(1.0))).otherwise(1.0)
    rows = fenced(rows, utc_us=taken, posterior=sure)
    return rows.select(
        *keep, "utc_us", "notation", F.when(F.col("bare"), F.col("_zone_used")).alias("zone"), "posterior",
        F.when(F.col("utc_us").isNotNull(), F.coalesce(F.col("posterior") < certain, F.lit(True))).alias("ambiguous"),
    )


def _both(raw_events: DataFrame, pending: DataFrame) -> DataFrame:
    return raw_events.select(
        F.lit("event").alias("origin"), F.col("raw_id").alias("rec_id"), "source", F.col("ts_raw").alias("stamp"), "read_at"
    ).unionByName(
        pending.select(
            F.lit("pending").alias("origin"), F.col("pending_id").alias("rec_id"), F.col("label").alias("source"),
            F.col("sort_key").alias("stamp"), F.col("enqueued_utc").alias("read_at"),
        )
    )


def readings(raw_events: DataFrame, pending: DataFrame, zones: DataFrame) -> DataFrame:
    """origin, rec_id, utc_us, notation, zone, posterior, ambiguous of every record, unreadable ones with nulls."""
    done = normalise(_both(raw_events, pending), "source", "stamp", "read_at", zones)
    return done.select("origin", "rec_id", "utc_us", "notation", "zone", F.round("posterior", 6).alias("posterior"), "ambiguous").distinct()


def found(raw_events: DataFrame, pending: DataFrame, zones: DataFrame) -> DataFrame:
    """origin, rec_id, utc_us of every record with a readable stamp; exact copies give one row."""
    done = normalise(_both(raw_events, pending), "source", "stamp", "read_at", zones)
    return done.where("utc_us is not null").select("origin", "rec_id", "utc_us").distinct()
