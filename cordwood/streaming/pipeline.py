"""Live pipelines: novelty, alerts, merged order, volume. Sources are the tails of cordwood.sources.tail or any stream."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cordwood import constants as K
from cordwood.functions.fields import text_time
from cordwood.functions.levels import guess_severity
from cordwood.functions.masking import mask
from cordwood.operators.highlight import HitWindow, Rule
from cordwood.sources.merge import MARK


def prepared(lines: DataFrame) -> DataFrame:
    """lines with own_ts, severity and shape: what live views need of a line, without state."""
    return lines.withColumns({"own_ts": text_time(F.col("text")), "severity": guess_severity(F.col("text")), "shape": mask(F.col("text"))})


def novelty(rows: DataFrame, warmup: int = K.NOVELTY_WARMUP, min_severity: int = K.NOVELTY_SEVERITY) -> DataFrame:
    """source, epoch, line_number, severity, shape of the first line of each severity and shape of a source and epoch,
    past the first warmup lines that were observed, wherever the tail began; lines of any severity and without one are
    observed.

    rows: as prepared() gives them, with epoch. The state holds a hash for each shape of min_severity or more; a reset
    of the source begins a new epoch and with it new shapes. Shapes met during warm-up stay known. Texts stay behind.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        observed, known = state.get if state.exists else (0, [])
        known = set(known)
        out = []
        for r in pd.concat(list(batches)).sort_values("line_number").itertuples():
            observed += 1
            if pd.isna(r.severity) or r.severity < min_severity or r.hash in known:
                continue
            known.add(r.hash)
            if observed > warmup:
                out.append((*key, r.line_number, int(r.severity), r.shape))
        state.update((observed, list(known)))
        yield pd.DataFrame(out, columns=["source", "epoch", "line_number", "severity", "shape"])

    grave = F.col("severity") >= min_severity
    narrow = rows.select("source", "epoch", "line_number", "severity", F.when(grave, F.col("shape")).alias("shape"), F.xxhash64("severity", "shape").alias("hash"))
    return narrow.groupBy("source", "epoch").applyInPandasWithState(
        step, "source string, epoch int, line_number long, severity int, shape string", "observed long, known array<long>", "append", GroupStateTimeout.NoTimeout
    )


def sessions(rows: DataFrame, gap_us: int = K.BLOCK_GAP_US, most: int = K.BLOCK_LINES) -> DataFrame:
    """source, thread, line_number, block_id of a stream of events (source, thread, line_number, ts): the blocks of
    blocks_by_proximity as they grow. Per source and thread the state holds the time of the last event and where its
    block began; a missing time parts nothing, nothing is dropped for being late."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, first, n = state.get if state.exists else (None, None, 0)
        out = []
        for line, us in pd.concat(list(batches)).sort_values("line_number")[["line_number", "us"]].itertuples(index=False):
            us = None if pd.isna(us) else int(us)
            if first is None or (last is not None and us is not None and abs(us - last) > gap_us):
                first, n = int(line), 0
            out.append((*key, line, "\x1f".join((key[0], key[1], str(first), str(n // most)))))
            last, n = us, n + 1
        state.update((last, first, n))
        yield pd.DataFrame(out, columns=["source", "thread", "line_number", "block_id"])

    narrow = rows.select("source", F.coalesce("thread", F.lit("\0")).alias("thread"), "line_number", F.unix_micros("ts").alias("us"))
    return narrow.groupBy("source", "thread").applyInPandasWithState(
        step, "source string, thread string, line_number long, block_id string", "last long, first long, n long", "append", GroupStateTimeout.NoTimeout
    )


def alerts(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_id, at_us, line_number of every alert of a stream of hits (rule_id, ts, line_number)."""
    limits = {r.id: (r.threshold, r.window_us) for r in rules if r.threshold > 0}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counter = HitWindow(*limits[key[0]], state.get[0] if state.exists else ())
        out = []
        for row in pd.concat(list(batches)).sort_values(["at_us", "line_number"]).itertuples():
            if counter.record(int(row.at_us)):
                out.append((key[0], row.at_us, row.line_number))
        state.update((list(counter.hits),))
        yield pd.DataFrame(out, columns=["rule_id", "at_us", "line_number"])

    rows = hits.where(F.col("rule_id").isin(list(limits)) & F.col("ts").isNotNull()).select("rule_id", F.unix_micros("ts").alias("at_us"), "line_number")
    return rows.groupBy("rule_id").applyInPandasWithState(step, "rule_id string, at_us long, line_number long", "hits array<long>", "append", GroupStateTimeout.NoTimeout)


class Reorder:
    """Lines of several sources held back for a while and let go in order of key, then arrival."""

    def __init__(self, window_s: float = 2.0, kept: dict | None = None):
        kept = kept or {"held": [], "last": {}, "next": 1, "seq": 0}
        self.window, self.held, self.last, self.next, self.seq = window_s, kept["held"], kept["last"], kept["next"], kept["seq"]

    def add(self, source: str, key: int | None, text: str, now: float) -> None:
        if key is not None:
            self.last[source] = key
        self.held.append([self.last.get(source, -(1 << 62)), self.seq, now, source, text])
        self.seq += 1

    def due(self, now: float, everything: bool = False) -> list[tuple[int, str, str]]:
        """(number, source, text) of all lines once the oldest of them was held for the window."""
        if not self.held or not (everything or now - min(h[2] for h in self.held) >= self.window):
            return []
        out = [(self.next + i, h[3], h[4]) for i, h in enumerate(sorted(self.held, key=lambda h: (h[0], h[1])))]
        self.next += len(out)
        self.held = []
        return out

    def kept(self) -> dict:
        return {"held": self.held, "last": self.last, "next": self.next, "seq": self.seq}


def merged(lines: DataFrame, group: str, window_s: float = 2.0, clock: Callable[[], float] = time.time) -> DataFrame:
    """group, line_number, source, text ('source│ text') of each merged view. Lines wait window_s by arrival, none is
    dropped, and one that comes later still is let go later. A view's order is one sequence, so one task keeps it."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        order = Reorder(window_s, json.loads(state.get[0]) if state.exists else None)
        if not state.hasTimedOut:
            for pdf in batches:
                for r in pdf.itertuples():
                    order.add(r.source, None if pd.isna(r.key) else int(r.key), r.text, clock())
        out = order.due(clock(), state.hasTimedOut)
        state.update((json.dumps(order.kept()),))
        if order.held:
            state.setTimeoutDuration(max(1, int(window_s * 1000)))
        yield pd.DataFrame([(key[0], n, s, f"{s}{MARK} {t}") for n, s, t in out], columns=["group", "line_number", "source", "text"])

    rows = lines.select(F.col(group).alias("group"), "source", F.unix_micros(text_time(F.col("text"))).alias("key"), "text")
    return rows.groupBy("group").applyInPandasWithState(step, "group string, line_number long, source string, text string", "kept string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def volume(rows: DataFrame, width: str, late: str | None = None, first: dt.datetime | None = None) -> DataFrame:
    """start, total, warnings, errors per window of event time, counted from first on if it is given.

    With late, windows close once they are that old, and what comes later still is lost. Without it nothing is: the
    stream is to be written in update or complete mode, and bins, of which there are few, stay open.
    """
    timed = rows.where("own_ts is not null")
    timed = timed.withWatermark("own_ts", late) if late else timed
    shift = f"{int(first.timestamp() * 1_000_000) % _width_us(width)} microseconds" if first else "0 seconds"
    counts = timed.groupBy(F.window("own_ts", width, None, shift)).agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == 3).alias("warnings"), F.count_if(F.col("severity") >= 4).alias("errors")
    )
    return counts.select(F.col("window.start").alias("start"), "total", "warnings", "errors")


def _width_us(width: str) -> int:
    units = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    n, unit = width.split()
    return int(n) * units[unit.rstrip("s")]


def last_lines(path: str, n: int = 50_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last n lines of each source as Parquet under path."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/{epoch - 1}")
        except Exception:  # there is none before the first batch
            old = None
        both = batch if old is None else old.unionByName(batch.select(*old.columns))
        top = both.groupBy("source").agg(F.max("line_number").alias("_top"))
        both.join(top, "source").where(F.col("line_number") > F.col("_top") - n).drop("_top").write.mode("overwrite").parquet(f"{path}/{epoch}")

    return write
