"""Running values in order, without one task for a whole entity.

A window over an entity reads all its rows in one task. Here an entity is cut into chunks of its order; windows run
within chunks, and what a chunk hands on is carried over one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood.session import cut

CHUNK = 65_536


def running(
    df: DataFrame, keys: list[str], order: str, lasts: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None, size: int = CHUNK,
) -> DataFrame:
    """df with, for each row: lasts - the last value that isn't null up to it; sums - the sum up to it; previous - the
    last value that isn't null before it. keys may be null (nulls are one key); order is a whole number, and rows of
    the same order stand in no order among each other. Rows with null order are dropped.
    """
    lasts, sums, previous = lasts or {}, sums or {}, previous or {}
    values = {f"_v_{n}": c for n, c in {**lasts, **sums, **previous}.items()}
    rows = df.where(F.col(order).isNotNull()).withColumns({**values, "_chunk": F.floor(F.col(order) / size)})
    inside = W.partitionBy(*keys, "_chunk").orderBy(order)
    upto, before = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        **{f"_i_{n}": F.last(f"_v_{n}", True).over(upto) for n in lasts},
        **{f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in sums},
        **{f"_i_{n}": F.last(f"_v_{n}", True).over(before) for n in previous},
    })
    ends = rows.groupBy(*keys, "_chunk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in {**lasts, **previous}],
        *[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in sums],
    )
    past = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"),
        *[F.last(f"_e_{n}", True).over(past).alias(f"_b_{n}") for n in {**lasts, **previous}],
        *[F.sum(f"_e_{n}").over(past).alias(f"_b_{n}") for n in sums],
    )
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    joined = rows.join(ends, same, "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_i_{n}", f"_b_{n}").alias(n) for n in {**lasts, **previous}],
        *[(F.col(f"_i_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums],
    )


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """df with name: the place of each row, from 1 on, in an order over all rows. Rows are sorted in ranges; the rows of
    each range are counted, and a range's places go on where those of the ranges before it end."""
    # kept, since counts and rows have to come from the same ranges
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_id", 33))
    sums = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per range
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(sums, "_p").select(*df.columns, (F.col("_base") + F.col("_id") - F.shiftleft(F.col("_p"), 33) + 1).alias(name))


def safe_groups(df: DataFrame, key: str, order: str, safe: Column, size: int = 8192) -> DataFrame:
    """df with _g: parts of each entity that begin at a safe row, one from which on no row needs those before it.

    A part holds about size rows and those up to the next safe row; state machines run over the parts in parallel.
    """
    rows = df.where(F.col(order).isNotNull()).withColumns({"_chunk": F.floor(F.col(order) / size), "_safe": safe})
    first = rows.groupBy(key, "_chunk").agg(F.min(F.when(F.col("_safe"), F.col(order))).alias("_from"))
    past = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    first = first.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), "_from", F.last(F.when(F.col("_from").isNotNull(), F.col("_chunk")), True).over(past).alias("_before"))
    joined = rows.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    part = F.when(F.col(order) >= F.col("_from"), F.col("_chunk")).otherwise(F.coalesce("_before", F.lit(-1)))
    return joined.select(*df.columns, part.alias("_g"))
