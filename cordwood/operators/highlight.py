"""Highlight rules and threshold alerts."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.fields import resolve
from cordwood.operators.search import line_matcher, valid_pattern
from cordwood.session import cut


@dataclass(frozen=True)
class Rule:
    """A highlight rule; with target it looks at a field and never at the line's text."""

    id: str
    pattern: str
    regex: bool = False
    case: bool = False
    target: str | None = None
    enabled: bool = True
    threshold: int = 0  # hits within window_us that raise an alert
    window_us: int = 0


@dataclass(frozen=True)
class Preset:
    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)
    enabled: bool = True


def _hit(rule: Rule) -> Column:
    text = resolve(rule.target) if rule.target else F.col("text")
    if not rule.pattern or (rule.regex and not valid_pattern(rule.pattern)):
        return F.lit(False)
    if rule.regex:
        return F.coalesce(text.rlike(("(?U)" if rule.case else "(?iuU)") + rule.pattern), F.lit(False))
    return F.coalesce(line_matcher(rule.pattern, False, rule.case)(text), F.lit(False))


def active(presets: list[Preset]) -> list[Rule]:
    return [r for p in presets if p.enabled for r in p.rules if r.enabled]


def highlight(rows: DataFrame, presets: list[Preset]) -> DataFrame:
    """rows with rule_id: the first enabled rule, in order of presets and rules, that matches; null without one."""
    found = F.lit(None).cast("string")
    for rule in reversed(active(presets)):
        found = F.when(_hit(rule), F.lit(rule.id)).otherwise(found)
    return rows.withColumn("rule_id", found)


def spans_of(text: str | None, rule: Rule) -> list[tuple[int, int]]:
    """(start, length) of what a rule matches in a line; empty matches and rules with a target give none."""
    if not text or not rule.pattern or rule.target:
        return []
    flags = 0 if rule.case else re.I
    return [(m.start(), m.end() - m.start()) for m in re.finditer(rule.pattern if rule.regex else re.escape(rule.pattern), text, flags) if m.end() > m.start()]


def with_spans(rows: DataFrame, presets: list[Preset]) -> DataFrame:
    """highlight() with spans: array of (start, length) of the rule's matches in the text."""
    rules = {r.id: r for r in active(presets)}

    @F.pandas_udf("array<struct<start:int,length:int>>")
    def spans(text: pd.Series, rule_id: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "length": n} for a, n in spans_of(t, rules[r])] if r in rules else [] for t, r in zip(text, rule_id)])

    return highlight(rows, presets).withColumn("spans", spans("text", "rule_id"))


# ---- alerts -----------------------------------------------------------------------------------------------------


class HitWindow:
    """Hits of one rule: fires when threshold of them lie within the window, then starts afresh."""

    def __init__(self, threshold: int, window_us: int, hits=()):
        self.threshold, self.window, self.hits = threshold, window_us, deque(hits)

    def record(self, at: int) -> bool:
        self.hits.append(at)
        while at - self.hits[0] > self.window:
            self.hits.popleft()
        if len(self.hits) < self.threshold:
            return False
        self.hits.clear()
        return True


def _firing(times: np.ndarray, before: np.ndarray, threshold: int, window_us: int) -> np.ndarray:
    """Places in times whose threshold-th hit backwards, themselves counted, lies within the window; before are the
    hits ahead of them."""
    both = np.concatenate([before, times])
    at = np.arange(len(before), len(both))
    far = at - (threshold - 1)
    return np.flatnonzero((far >= 0) & (both[at] - both[np.maximum(far, 0)] <= window_us))


def _alerts(firing: np.ndarray, n: int, open_hits: int, threshold: int) -> tuple[list[int], int]:
    """(places of the alerts, hits open at the end) of a chunk of n hits that open_hits since the last alert precede. An
    alert takes all hits up to it, so the next one is the first firing place threshold hits further on."""
    out, at = [], threshold - 1 - open_hits
    while (k := np.searchsorted(firing, at)) < len(firing):
        out.append(int(firing[k]))
        at = out[-1] + threshold
    return out, min(n - 1 - out[-1] if out else open_hits + n, threshold - 1)


def threshold_alerts(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_id, at_us, line_number of every alert. hits: rule_id, ts, line_number, taken in order of time, then line;
    hits without time are left out.

    All that a stretch of hits hands on is how many of its last hits are open, fewer than the threshold. Hits are cut
    into ranges of rule and time; each range says, for every number of open hits it may begin with, how many it ends
    with; these answers are chained over one row per range; and then every range is read with what it begins with. A
    rule that keeps firing is spread like any other.
    """
    limits = {r.id: (r.threshold, r.window_us) for r in rules if r.threshold > 0}
    if not limits:
        return hits.sparkSession.createDataFrame([], "rule_id string, at_us long, line_number long")
    rows = hits.where(F.col("ts").isNotNull() & F.col("rule_id").isin(list(limits))).select("rule_id", F.unix_micros("ts").alias("at_us"), "line_number")
    # kept, since all looks at the ranges have to see the same ones
    placed = cut(rows.repartitionByRange("rule_id", "at_us", "line_number").withColumn("part", F.spark_partition_id()))

    def sums(key, pdf):
        most = limits[key[0]][0] - 1
        return pd.DataFrame({"rule_id": [key[0]], "part": [key[1]], "tail": [sorted(pdf["at_us"])[-most:] if most else []]})

    def carried(key, pdf):
        most, seen, out = limits[key[0]][0] - 1, [], []
        for r in pdf.sort_values("part").itertuples():
            out.append((key[0], r.part, list(seen)))
            seen = (seen + [int(x) for x in r.tail])[-most:] if most else []
        return pd.DataFrame(out, columns=["rule_id", "part", "before"])

    def ends(key, pdf, given):
        threshold, window = limits[key[0]]
        firing = _firing(np.sort(pdf["at_us"].to_numpy()), np.array(given["before"].iat[0], dtype="int64"), threshold, window)
        return pd.DataFrame({"rule_id": [key[0]], "part": [key[1]], "ends": [[_alerts(firing, len(pdf), s, threshold)[1] for s in range(threshold)]]})

    def chained(key, pdf):
        state, out = 0, []
        for r in pdf.sort_values("part").itertuples():
            out.append((key[0], r.part, state))
            state = int(r.ends[state])
        return pd.DataFrame(out, columns=["rule_id", "part", "begins"])

    def fired(key, pdf, given):
        threshold, window = limits[key[0]]
        pdf = pdf.sort_values(["at_us", "line_number"])
        firing = _firing(pdf["at_us"].to_numpy(), np.array(given["before"].iat[0], dtype="int64"), threshold, window)
        return pdf.iloc[_alerts(firing, len(pdf), int(given["begins"].iat[0]), threshold)[0]][["rule_id", "at_us", "line_number"]]

    chunk = ["rule_id", "part"]
    before = placed.groupBy(*chunk).applyInPandas(sums, "rule_id string, part int, tail array<long>").groupBy("rule_id").applyInPandas(carried, "rule_id string, part int, before array<long>")
    before = cut(before)
    answers = placed.groupBy(*chunk).cogroup(before.groupBy(*chunk)).applyInPandas(ends, "rule_id string, part int, ends array<int>")
    begins = answers.groupBy("rule_id").applyInPandas(chained, "rule_id string, part int, begins int")
    return placed.groupBy(*chunk).cogroup(before.join(begins, chunk).groupBy(*chunk)).applyInPandas(fired, "rule_id string, at_us long, line_number long")


def alert_history(alerts: DataFrame, n: int = 200) -> DataFrame:
    """The last n alerts, newest first."""
    return alerts.orderBy(F.desc("at_us"), F.desc("line_number")).limit(n)
