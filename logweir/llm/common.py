"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: space and the control characters tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is bound to the value, so an expensive expression that ``body``
    mentions inside other lambdas is not evaluated again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text, in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. In local mode, where
    driver and tasks share the disk, an unset one becomes a folder below the warehouse; on a
    cluster it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints"))
    return df.checkpoint(eager=True)


def row_id() -> Column:
    """Identifies a row of documents by its id and whole text; null ids and texts are told from empty ones."""
    told = lambda c, shown: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), shown))
    doc, text = F.col("doc_id"), F.col("text")
    return F.concat(told(doc, doc.cast("string")), F.lit(":"), told(text, F.md5(text)))


#: Keys that hold more than a 4096th of all rows; there are fewer than that many of them.
HOT_KEYS = 4096


def spread_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], counted: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with ``keyed``, which has one row a key and the number ``counted`` of ``rows`` under it.

    Keys that hold more than one in ``HOT_KEYS`` of the ``total`` rows are fewer than
    ``HOT_KEYS``, so they are broadcast and their rows stay where they are; no key of the
    shuffled rest is large; it is shuffled at every size alike. ``rows`` is read twice. ``counted`` is dropped; a left join keeps
    rows without a key in ``keyed``.
    """
    hot = keyed.filter(F.col(counted) * HOT_KEYS > total).drop(counted)
    cold = keyed.filter(F.col(counted) * HOT_KEYS <= total).drop(counted)
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("merge"), key, how))


def hash_order(*parts: Column) -> Column:
    """A reproducible random sort key: 32 hex digits, uniform over its parts."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


#: Hash keys are ranged by their first three hex digits, 4096 equal slices per group.
SLICE_DIGITS = 3


def key_slice(key: Column) -> Column:
    return F.substring(key, 1, SLICE_DIGITS)


def prefix_sums(df: DataFrame, group: list[str], key: str, value: str, out: str, ties: list[str]) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that sort before this one.

    Rows sort by ``key`` (from ``hash_order``) and then by ``ties``. The key space is cut into
    4096 equal ranges: one small aggregate sums each (group, range), a window over those sums
    gives every range its offset, and a second window runs inside each range. No task ever
    holds a whole group, so one group with a third of the rows is spread like any other.
    ``group`` columns must not be null. Columns starting with ``__`` are reserved.
    """
    sliced = df.withColumn("__slice", key_slice(F.col(key)))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "__slice")
        .agg(F.sum(value).alias("__sum"))
        .select(*group, "__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    )
    inside = (
        Window.partitionBy(*group, "__slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*group, "__slice"])
        .withColumn(out, F.col("__offset") + F.col("__inside"))
        .drop("__slice", "__inside", "__offset")
    )
