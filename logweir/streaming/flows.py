"""The log operators over Structured Streaming; every flow can run with ``availableNow``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweir.functions.routing import forwarded
from logweir.operators.producer import validate_sequence
from logweir.sources.log import KEYS


def stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A Parquet folder as a stream; ``files`` a trigger bound what one micro-batch takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _appended(batch: DataFrame, log_path: str, batch_id: int) -> None:
    """Writes a batch's folder, and the counters of all batches up to it, from those of the one before.

    Both are written whole, so a batch that is run again assigns the same offsets once.
    """
    from logweir.operators.offsets import append, counters

    spark, next_offsets = batch.sparkSession, f"{log_path}/_counters"
    if batch_id:
        old = spark.read.parquet(f"{next_offsets}/batch={batch_id - 1}")
    else:
        old = spark.createDataFrame([], "topic_id int, partition_id int, next_offset long")
    append(batch, old).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
    written = spark.read.parquet(f"{log_path}/batch={batch_id}")
    counters(written, old).coalesce(1).write.mode("overwrite").parquet(f"{next_offsets}/batch={batch_id}")


def append_offsets(records: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Appends micro-batches to a log with contiguous offsets; each reads one small counters table."""
    write = lambda batch, batch_id: _appended(batch, log_path, batch_id)
    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transformed(log: DataFrame, make: Callable[[DataFrame], DataFrame], group: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """Consumes a log, appends what ``make`` makes of its committed records, and commits the group's offsets.

    Output, its offsets and the committed offsets (at ``log_path``/_commits) of a batch are
    written under the batch's number, so a batch that is run again takes effect once.
    """
    from logweir.operators.offsets import visible

    def write(batch: DataFrame, batch_id: int) -> None:
        _appended(make(visible(batch, True)), log_path, batch_id)
        done = batch.groupBy(*KEYS).agg((F.max("partition_offset") + 1).alias("committed_offset"))
        marked = done.withColumns({"group_id": F.lit(group), "seq": F.lit(batch_id).cast("long")})
        marked.coalesce(1).write.mode("overwrite").parquet(f"{log_path}/_commits/batch={batch_id}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(batches: DataFrame) -> DataFrame:
    """outcome of every produce batch, with the last sequence of each producer and partition as state.

    A step sorts the batches of its key that one trigger took, which the files a trigger bound.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("arrival")
        outcomes = []
        for base, count in zip(rows["base_sequence"], rows["n_records"]):
            outcome, last = validate_sequence(last, int(base), int(count))
            outcomes.append(outcome)
        state.update((last,))
        yield rows[["producer_id", "topic_id", "partition_id", "arrival"]].assign(outcome=outcomes)

    return batches.groupBy("producer_id", *KEYS).applyInPandasWithState(
        step,
        "producer_id long, topic_id int, partition_id int, arrival long, outcome string",
        "last long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


#: A step in Python has a fixed cost, so it serves a bucket of members rather than one.
BUCKETS = 1024


def expired_sessions(heartbeats: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Members whose session ran out in event time: no heartbeat (at_ms) within timeout_ms, by a timer each.

    The stream's watermark, one second late, is the clock; a heartbeat without time or timeout is
    none. A member that heartbeats again later starts a new session. The last heartbeats and timers
    of a bucket's members are one row of state and are tested together.
    """
    ids, columns = ["group_id", "member_id"], ["group_id", "member_id", "last", "timeout", "due"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(columns, state.get)) if state.exists else {c: [] for c in columns})
        if not state.hasTimedOut:
            seen = pd.DataFrame({c: [] for c in columns})
            for rows in frames:
                rows = rows.rename(columns={"at_ms": "last", "timeout_ms": "timeout"})[columns[:4]].assign(due=0)
                rows = rows if seen.empty else pd.concat([seen, rows], ignore_index=True)
                seen = rows.sort_values(["last", "timeout"]).drop_duplicates(ids, keep="last")
            both = seen if held.empty else pd.concat([held, seen], ignore_index=True)
            beat = both.duplicated(ids, keep=False) | (both["due"] == 0)
            held = both.assign(beat=beat).sort_values("last", kind="stable").drop_duplicates(ids, keep="last")
            held["due"] = held["due"].mask(held["beat"], (held["last"] + held["timeout"]).clip(lower=now + 1))
        gone = held["due"] < now
        kept, over = held[~gone], held[gone]
        if kept.empty:
            state.remove()
        else:
            state.update(tuple([None if pd.isna(v) else v for v in kept[c].tolist()] for c in columns))
            state.setTimeoutTimestamp(int(kept["due"].min()))
        yield over[ids].assign(expired_ms=over["last"] + over["timeout"])

    bucket = F.pmod(F.xxhash64(*ids), F.lit(buckets)).alias("bucket")
    timed = heartbeats.dropna(subset=["at_ms", "timeout_ms"]).select(bucket, *ids, "at_ms", "timeout_ms", F.timestamp_millis("at_ms").alias("ts"))
    return timed.withWatermark("ts", "1 second").groupBy("bucket").applyInPandasWithState(
        step,
        "group_id string, member_id string, expired_ms long",
        "group_id array<string>, member_id array<string>, last array<long>, timeout array<long>, due array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def watermark_stream(log: DataFrame) -> DataFrame:
    """The running high watermark of every partition."""
    return log.groupBy(*KEYS).agg(F.max(F.col("partition_offset") + 1).alias("high_watermark"))


def forward_stream(log: DataFrame, percent: int) -> DataFrame:
    """Sampled committed records, for an external sink."""
    return log.filter(F.col("txn_state").isNull() & forwarded(F.col("key"), F.col("partition_offset"), F.lit(percent)))


def windowed_counts(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records of each topic by event-time window, with late rows dropped after the watermark."""
    timed = log.withColumn("ts", F.timestamp_millis("timestamp_ms")).filter("timestamp_ms >= 0")
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "topic_id").agg(F.count(F.lit(1)).alias("n"))
