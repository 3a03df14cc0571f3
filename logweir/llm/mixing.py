"""Operator 2: mixing sources to target weights.

Every document gets a hash-random key; documents are ranged by key within their source and
distributed prefix sums of their sizes give each its place; the mix takes whole epochs of a
source and then the documents up to its exact budget. Only DataFrame functions run.

Defined cases: a null text has size 0 and a null source is a source of its own, last in
order; sources and documents of size 0 take nothing; equal keys (repeated rows) are ordered
by document id and size, after which they are interchangeable; an empty table gives an empty
table; other columns are kept by ``mix`` and ignored by ``plan``. Columns starting with
``__`` are reserved.

The per-source table (one row a source: a mix specification) is computed in one task; the
documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import hash_order, prefix_sums, table, word_count

#: Weights by the order of the source names, repeating.
WEIGHTS = (1, 2, 3)
#: A source is repeated this often at most.
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """__null, __source, source_size, target: what the mix takes of each source.

    ``sizes`` has __null, __source and __size. The targets share all sizes by weight, none above ``max_epochs``
    times its source. Handing the excess on by weight until none is above ends at the water
    level L with sum(min(L * weight, cap)) = total. Ordered by cap/weight, a source is capped
    where the level that the rest would have with it uncapped is at or over its own ratio.
    """
    by_name = Window.orderBy("__null", "__source")
    by_ratio = Window.orderBy("__ratio", "__null", "__source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1
    )
    return (
        sizes.groupBy("__null", "__source")
        .agg(F.sum("__size").alias("source_size"))
        .withColumn("__weight", weight)
        .withColumn("__cap", F.col("source_size") * max_epochs)
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
        .withColumn("__left", F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__share", F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0)))
        .withColumn("__capped", F.col("__left") / F.col("__share") >= F.col("__ratio"))
        .withColumn("__free_left", F.max(F.when(~F.col("__capped"), F.col("__left"))).over(everything))
        .withColumn("__free_share", F.max(F.when(~F.col("__capped"), F.col("__share"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(
                F.col("__free_left") * F.col("__weight") / F.col("__free_share")
            ),
        )
        .select("__null", "__source", "source_size", "target")
    )


def plan(docs: DataFrame, seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken and the document's key, source and null flag.

    ``taken`` counts words, repeats included: size times the whole epochs, plus what the last
    epoch takes. Its budget is what the whole epochs leave of the target; it goes to the
    documents in key order until it is used up. The document at the cut gives the words that
    are left or, with ``whole``, all of its words if half of them or more fit and else none.
    """
    sized = docs.select(
        "doc_id",
        F.col("source").isNull().alias("__null"),
        F.coalesce("source", F.lit("")).alias("__source"),
        word_count(F.col("text")).alias("__size"),
        hash_order(F.lit(seed), F.col("doc_id")).alias("__key"),
    )
    placed = prefix_sums(sized, ["__null", "__source"], "__key", "__size", "__before", ["doc_id", "__size"])
    goals = targets(sized)
    epochs = F.floor(F.col("target") / F.col("source_size"))
    left = F.floor(F.col("target")) - epochs * F.col("source_size") - F.col("__before")
    part = F.when(2 * left >= F.col("__size"), F.col("__size")).otherwise(0) if whole else F.least("__size", left)
    taken = F.when(F.col("__size") > 0, epochs * F.col("__size") + F.greatest(part, F.lit(0))).otherwise(0)
    return placed.join(goals, ["__null", "__source"]).select(
        "doc_id",
        F.col("__size").alias("size"),
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        "__key",
        "__null",
        "__source",
    )


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it whole, columns as they came.

    Repeats of rows with the same doc_id and size are decided together.
    """
    times: Column = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    share = plan(docs, seed, whole=True).groupBy("doc_id", "size", "__null", "__source").agg(F.max(times).alias("__times"))
    keyed = (
        docs.withColumn("__id", F.col("doc_id"))
        .withColumn("__size", word_count(F.col("text")))
        .withColumn("__null0", F.col("source").isNull())
        .withColumn("__source0", F.coalesce("source", F.lit("")))
    )
    joined = keyed.join(
        share.select(
            F.col("doc_id").alias("__id1"),
            F.col("size").alias("__size1"),
            F.col("__null").alias("__null1"),
            F.col("__source").alias("__source1"),
            "__times",
        ),
        F.col("__id").eqNullSafe(F.col("__id1"))
        & (F.col("__size") == F.col("__size1"))
        & (F.col("__null0") == F.col("__null1"))
        & (F.col("__source0") == F.col("__source1")),
    )
    return (
        joined.filter("__times > 0")
        .withColumn("__epoch", F.explode(F.array_repeat(F.lit(0), F.col("__times"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).drop("__key", "__null", "__source")


def plan_sql(source: str = "documents", seed: int = 0, whole: bool = False) -> str:
    """The plan as one ordered running sum a source, and the targets by the same closed form."""
    part = "CASE WHEN 2 * rest >= size THEN size ELSE 0 END" if whole else "least(size, rest)"
    return f"""
WITH d AS (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('{seed}:' || coalesce(doc_id::VARCHAR, '~')) AS k FROM {source}),
s0 AS (SELECT sn, s, sum(size)::BIGINT AS source_size FROM d GROUP BY sn, s),
s1 AS (SELECT *, (row_number() OVER (ORDER BY sn, s) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS remaining,
              sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share
       FROM s1 WINDOW o AS (ORDER BY cap / weight, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, remaining / share >= cap / weight AS capped FROM s2),
s4 AS (SELECT sn, s, source_size,
              CASE WHEN capped THEN cap::DOUBLE
                   ELSE (max(remaining) FILTER (NOT capped) OVER () * weight)::DOUBLE
                        / (max(share) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM s3),
p AS (SELECT d.*, source_size, target, floor(target / source_size) AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.sn, d.s ORDER BY k, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN s4 ON s4.sn = d.sn AND s4.s = d.s),
q AS (SELECT *, floor(target) - epochs * source_size - before AS rest FROM p)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN epochs * size + greatest({part}, 0) ELSE 0 END)::BIGINT AS taken FROM q
"""
