"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added such that filters above are not rewritten into their expressions.

    Predicates that are pushed through a projection repeat its expressions wherever they refer to them; over several
    layers that grows exponentially. A generator over one struct costs next to nothing and stops it.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(F.inline(F.array(F.struct(*kept, *[c.alias(n) for n, c in columns.items()]))))
