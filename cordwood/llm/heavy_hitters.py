"""Most frequent items by lossy counting (problem 3).

Every partition keeps one summary per group: items with a count and the greatest number of occurrences that were
missed (delta), pruned at each bucket boundary, so its size is bounded by the error and not by the number of distinct
items. A partition hands on only items that reach a share of its rows; what the others may have had there is known
from its totals. Merged summaries sum counts and deltas and give an interval that holds the true count of every item.
Items that may reach the support are then counted exactly in a second pass that carries nothing but those items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.session import cut


class LossyCounter:
    """Lossy counting of one stream with error epsilon: true count - epsilon * n <= count <= true count."""

    def __init__(self, epsilon: float):
        self.width = math.ceil(1 / epsilon)
        self.n = 0  # rows seen
        self.bucket = 0  # full buckets seen: what an item without entry may have had at most
        self.entries: dict = {}

    def add(self, items: list, counts: list[int], rows: int) -> None:
        """Adds a batch of distinct items with counts, rows in all; batches may hold less or more than a bucket."""
        entries, bucket = self.entries, self.bucket
        for item, n in zip(items, counts):
            held = entries.get(item)
            if held:
                held[0] += n
            else:
                entries[item] = [n, bucket]
        self.n += rows
        if self.n // self.width > self.bucket:
            self.bucket = self.n // self.width
            self.prune(self.bucket)

    def prune(self, least: int) -> None:
        self.entries = {k: v for k, v in self.entries.items() if v[0] + v[1] > least}


def summaries(df: DataFrame, group: str, item: str, epsilon: float, hand_on: float) -> DataFrame:
    """One row per partition, group and item handed on: _g, _item, count, missed (delta), absent; and one per
    partition and group with null item: its rows in count, and in absent what an item not handed on had at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in batches:
            step = 16_384
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)])
                sums = part.group_by(["_g", "_item"]).aggregate([([], "count_all")])
                rows: dict = {}
                for g, x, n in zip(*(sums.column(c).to_pylist() for c in ("_g", "_item", "count_all"))):
                    items, counts, total = rows.setdefault(g, ([], [], [0]))
                    total[0] += n
                    if x:
                        items.append(x)
                        counts.append(n)
                for g, (items, counts, total) in rows.items():
                    counters.setdefault(g, LossyCounter(epsilon)).add(items, counts, total[0])
        for g, c in counters.items():
            least = max(c.bucket, int(hand_on * c.n))
            c.prune(least)
            held = list(c.entries.items())
            yield pa.RecordBatch.from_pydict(
                {
                    "_g": [g] * (len(held) + 1), "_item": [k for k, _ in held] + [None], "count": [v[0] for _, v in held] + [c.n],
                    "missed": [v[1] for _, v in held] + [0], "absent": [least] * (len(held) + 1),
                },
                schema=pa.schema([("_g", pa.string()), ("_item", pa.string()), ("count", pa.int64()), ("missed", pa.int64()), ("absent", pa.int64())]),
            )

    rows = df.select(F.col(group).cast("string").alias("_g"), F.col(item).cast("string").alias("_item"))
    return rows.mapInArrow(count, "_g string, _item string, count long, missed long, absent long")


def frequent(df: DataFrame, group: str, item: str, support: float = 0.005, epsilon: float | None = None) -> DataFrame:
    """group, item, low, high, n_rows: every item that may have at least support of its group's rows, with an
    interval that holds its true count.

    Null and empty items are no items but count as rows; a null group is a group. epsilon defaults to a twentieth of
    support. An empty table gives an empty result; extra columns are ignored.
    """
    epsilon = epsilon or support / 20
    parts = cut(summaries(df, group, item, epsilon, support / 4))  # a few rows a partition, looked at twice
    total = F.col("_item").isNull()
    sums = parts.groupBy("_g", "_item").agg(F.sum("count").alias("low"), F.sum("missed").alias("_missed"), F.sum("absent").alias("_absent"))
    # the rows of each group's totals: one per group, taken along by a second look at the same small sums
    totals = sums.where(total).select(F.col("_g").alias("_tg"), F.col("low").alias("n_rows"), F.col("_absent").alias("_all"))
    joined = sums.where(~total).join(totals, F.col("_g").eqNullSafe(F.col("_tg")))
    high = F.col("low") + F.col("_missed") + F.col("_all") - F.col("_absent")
    return joined.select(F.col("_g").alias(group), F.col("_item").alias(item), "low", high.alias("high"), "n_rows").where(F.col("high") >= F.ceil(F.col("n_rows") * F.lit(support)))


def exact(df: DataFrame, group: str, item: str, support: float = 0.005, most: int = 100_000) -> DataFrame:
    """group, item, n, n_rows: the items that do have at least support of their group's rows, with exact counts.

    The candidates of one group number at most about 2 / support; they are broadcast up to most of them and joined by
    shuffle beyond.
    """
    found = frequent(df, group, item, support)
    found = cut(found.select(F.col(group).alias("_g"), F.col(item).alias("_i"), "n_rows"))
    small = found.limit(most + 1).count() <= most
    rows = df.select(F.col(group).alias("_rg"), F.col(item).alias("_ri")).where("_ri is not null and _ri <> ''")
    same = F.col("_rg").cast("string").eqNullSafe(F.col("_g")) & (F.col("_ri") == F.col("_i"))
    counted = rows.join(F.broadcast(found) if small else found, same).groupBy("_rg", "_ri", "n_rows").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= F.col("n_rows") * F.lit(support)).select(F.col("_rg").alias(group), F.col("_ri").alias(item), "n", "n_rows")


def found(hits: DataFrame) -> DataFrame:
    """kind, signature of every signature in at least one of 200 rows of its kind."""
    return exact(hits, "kind", "signature", 1 / 200).select("kind", "signature")
