"""Offsets: assignment, watermarks, time look-ups, gaps; reads by isolation and byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.ordering import SLICE, numbered
from logweir.sources.log import KEYS

#: A row's estimated overhead, and the estimate by which a byte budget limits rows.
ROW_OVERHEAD = 64
ROW_ESTIMATE = 500
MIN_ROWS, MAX_ROWS = 10, 5000


def append(records: DataFrame, counters: DataFrame, order: str = "global_offset") -> DataFrame:
    """``records`` with partition_offset from the counters (topic_id, partition_id, next_offset) on."""
    placed = numbered(records, order, {"__at": KEYS}).join(counters.select(*KEYS, "next_offset"), KEYS, "left")
    at = F.coalesce("next_offset", F.lit(0)) + F.col("__at")
    return placed.withColumn("partition_offset", at.cast("long")).drop("__at", "next_offset")


def transactional(records: DataFrame, producer_id: int, producer_epoch: int) -> DataFrame:
    """``records`` as a transaction's: its producer's, and pending until the transaction ends."""
    return records.withColumns(
        {"producer_id": F.lit(producer_id).cast("long"), "producer_epoch": F.lit(producer_epoch), "txn_state": F.lit("pending")}
    )


def counters(log: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """next_offset of every partition; never below an older counter, so offsets are not reused."""
    found = log.groupBy(*KEYS).agg((F.max("partition_offset") + 1).alias("next_offset"))
    both = found if old is None else found.unionByName(old.select(*KEYS, "next_offset"))
    return both.groupBy(*KEYS).agg(F.greatest(F.max("next_offset"), F.lit(0)).alias("next_offset"))


def watermarks(log: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """high_watermark, earliest_offset and last_stable_offset of every partition in one pass.

    An emptied partition keeps its watermark, its earliest offset is 0.
    """
    offset = F.col("partition_offset")
    own = log.groupBy(*KEYS).agg(
        F.max(offset + 1).alias("top"),
        F.min(offset).alias("low"),
        F.min(F.when(F.col("txn_state") == "pending", offset)).alias("pending"),
    )
    held = own if old is None else own.join(old.select(*KEYS, F.col("next_offset").alias("kept")), KEYS, "full")
    kept = F.lit(0) if old is None else F.coalesce("kept", F.lit(0))
    high = F.greatest(F.coalesce("top", F.lit(0)), kept, F.lit(0)).cast("long")
    return held.select(
        *KEYS,
        high.alias("high_watermark"),
        F.coalesce("low", F.lit(0)).cast("long").alias("earliest_offset"),
        F.coalesce("pending", high).cast("long").alias("last_stable_offset"),
    )


def visible(log: DataFrame, committed: bool) -> DataFrame:
    """Read-committed hides every row from a partition's first pending one on, and aborted rows.

    The first pending offsets are one row a partition, joined rather than windowed.
    """
    if not committed:
        return log
    pending = log.filter("txn_state = 'pending'").groupBy(*KEYS).agg(F.min("partition_offset").alias("__pending"))
    clean = log.filter("txn_state IS NULL").join(pending, KEYS, "left")
    return clean.filter("__pending IS NULL OR partition_offset < __pending").drop("__pending")


def pending_exists(partitions: DataFrame, log: DataFrame) -> DataFrame:
    """Whether each partition holds a pending record."""
    some = log.filter("txn_state = 'pending'").select(*KEYS).distinct().withColumn("has_pending", F.lit(True))
    return partitions.select(*KEYS).join(some, KEYS, "left").fillna(False, ["has_pending"])


def stored_bytes(key: Column, value: Column) -> Column:
    none = F.lit(0)
    return F.coalesce(F.octet_length(key), none) + F.coalesce(F.octet_length(value), none) + ROW_OVERHEAD


def fetch(log: DataFrame, start: int, max_bytes: int, committed: bool = True) -> DataFrame:
    """From ``start`` on, each partition's rows that fit ``max_bytes``, one at least.

    The row limit is a filter of its own right above the rank, which Spark then applies before
    the shuffle; the running sum sees the limited rows only.
    """
    limit = min(max(max_bytes // ROW_ESTIMATE, MIN_ROWS), MAX_ROWS)
    w = Window.partitionBy(*KEYS).orderBy("partition_offset")
    rows = visible(log, committed).filter(F.col("partition_offset") >= start)
    ranked = rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= limit)
    size = stored_bytes(F.col("key"), F.col("value")).cast("long")
    summed = ranked.withColumn("bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.filter((F.col("bytes") <= max_bytes) | (F.col("__rank") == 1)).drop("__rank")


#: Milliseconds of a time slice of ``offset_for_time``.
TIME_SLICE = 3_600_000


def offset_for_time(log: DataFrame, probes: DataFrame, width: int = TIME_SLICE) -> DataFrame:
    """The first committed offset at or after each probe (probe_ms) in each partition, or (-1, -1).

    Offsets decide, not times; rows without a time never match and pending rows don't clamp.
    Slices of time give their lowest offset in one aggregate, and a running minimum over the
    slices, latest first, serves what lies beyond a probe's own slice. Only rows of slices that
    hold a probe meet it, in time order. No row meets every probe.
    """
    dated = log.filter("txn_state IS NULL AND timestamp_ms >= 0").select(
        *KEYS, F.col("timestamp_ms").alias("at_ms"), F.struct("partition_offset", "timestamp_ms").alias("first"), F.lit(0).alias("asks")
    )
    slice_ = F.floor(F.col("at_ms") / width).alias("slice")
    asked = probes.agg(F.collect_set("probe_ms")).scalar()
    every = log.select(*KEYS).distinct().select(
        *KEYS, F.explode(asked).alias("at_ms"), F.lit(None).cast(dated.schema["first"].dataType).alias("first"), F.lit(1).alias("asks")
    )
    sliced, questions = dated.withColumn("slice", slice_), every.withColumn("slice", slice_)
    hit = questions.select(*KEYS, "slice").distinct()
    # At equal times rows come before probes, which they answer.
    upto = Window.partitionBy(*KEYS, "slice").orderBy(F.desc("at_ms"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.join(hit, [*KEYS, "slice"], "left_semi").unionByName(questions).withColumn("own", F.min("first").over(upto)).filter("asks = 1")
    later = Window.partitionBy(*KEYS).orderBy(F.desc("slice"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    lowest = sliced.groupBy(*KEYS, "slice").agg(F.min("first").alias("first")).select(
        *KEYS, (F.col("slice") - 1).alias("slice"), "first", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("at_ms"), F.lit(None).cast(dated.schema["first"].dataType).alias("own")
    )
    answered = lowest.unionByName(inside).withColumn("beyond", F.min("first").over(later)).filter("asks = 1")
    best = F.least("own", "beyond")
    return answered.select(
        *KEYS,
        F.col("at_ms").alias("probe_ms"),
        F.coalesce(best["partition_offset"], F.lit(-1)).cast("long").alias("offset"),
        F.coalesce(best["timestamp_ms"], F.lit(-1)).cast("long").alias("timestamp_ms"),
    )


def gaps(log: DataFrame, slice_width: int = SLICE) -> DataFrame:
    """from_offset, missing: holes between consecutive offsets of a partition.

    Rows are compared inside slices of offsets; a window over the slices' borders finds the
    holes between slices.
    """
    own = log.select(*KEYS, "partition_offset", F.floor(F.col("partition_offset") / slice_width).alias("__slice"))
    next_row = F.lead("partition_offset").over(Window.partitionBy(*KEYS, "__slice").orderBy("partition_offset"))
    next_slice = F.lead("low").over(Window.partitionBy(*KEYS).orderBy("__slice"))
    inside = own.select(*KEYS, F.col("partition_offset").alias("at"), next_row.alias("next"))
    ends = own.groupBy(*KEYS, "__slice").agg(F.min("partition_offset").alias("low"), F.max("partition_offset").alias("at"))
    between = ends.select(*KEYS, "at", next_slice.alias("next"))
    return inside.unionByName(between).filter("next > at + 1").select(
        *KEYS, (F.col("at") + 1).alias("from_offset"), (F.col("next") - F.col("at") - 1).cast("long").alias("missing")
    )


def with_time(log: DataFrame) -> DataFrame:
    """timestamp_ms with the creation time where none was given."""
    from logweir.sources.log import epoch_ms

    own = F.when(F.col("timestamp_ms") >= 0, F.col("timestamp_ms")).otherwise(epoch_ms(F.col("created_at")))
    return log.withColumn("timestamp_ms", own.cast("long"))
