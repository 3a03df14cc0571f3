"""Contiguous numbering within keys that does not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Arrival numbers that one numbering slice spans.
SLICE = 1 << 16


def numbered(df: DataFrame, order: str, outs: dict[str, list[str]], slice_width: int = SLICE) -> DataFrame:
    """Adds each of ``outs``: the rows of the same keys with a lower ``order`` (a unique long), from 0.

    All key lists share some keys; rows are shuffled once, by those and by slices of the order
    column. A row for every slice carries how many rows of the keys are in earlier slices, from
    a window over the slices' counts, and a running sum inside the slice does the rest. Columns
    starting with ``__`` are reserved.
    """
    lists = list(outs.values())
    shared = [k for k in lists[0] if all(k in keys for keys in lists)]
    sliced = df.withColumn("__slice", F.floor(F.col(order) / slice_width)).withColumn("__row", F.lit(True))
    rows = sliced.select("*", *[F.lit(1).cast("long").alias(f"__{out}") for out in outs])
    for out, keys in outs.items():
        earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
        bases = counts.select(*keys, "__slice", F.sum("__n").over(earlier).alias(f"__{out}"), F.lit(False).alias("__row"))
        rows = rows.unionByName(bases.filter(F.col(f"__{out}").isNotNull()), allowMissingColumns=True)
    rows = rows.repartition(*shared, "__slice")
    for out, keys in outs.items():
        upto = Window.partitionBy(*keys, "__slice").orderBy("__row", order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(out, F.coalesce(F.sum(f"__{out}").over(upto), F.lit(0)) - 1)
    return rows.filter("__row").drop("__slice", "__row", *[f"__{out}" for out in outs])
