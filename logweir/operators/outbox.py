"""Sampled forwarding to an external log: enqueue, claim, acknowledge, replay and read suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.routing import forwarded
from logweir.sources.log import KEYS

BATCH = 256
MAX_RETRIES = 10
RETRY_AFTER_MS = 5000
ID = [*KEYS, "local_offset"]


def effective(config: DataFrame) -> DataFrame:
    """Percentages between 0 and 100; external-only topics forward everything, local ones nothing."""
    percent = F.least(F.greatest("forward_percentage", F.lit(0)), F.lit(100))
    percent = F.when(F.col("write_mode") == "external_only", 100).otherwise(percent)
    return config.withColumn("percent", F.when(F.col("mode") == "shadow", percent).otherwise(0))


def loaded(config: DataFrame, topics: DataFrame) -> DataFrame:
    """The configuration of known topics, with the percentage that counts and the target topic's name."""
    known = effective(config).join(topics.select("topic_id", "topic"), "topic_id")
    return known.withColumn("target", F.coalesce("external_topic_name", "topic")).withColumn("forwards", F.col("percent") > 0)


def sample(log: DataFrame, config: DataFrame) -> DataFrame:
    """Committed records that their topic's percentage forwards."""
    on = effective(config).filter("percent > 0").select("topic_id", "percent")
    chosen = log.filter("txn_state IS NULL").join(on, "topic_id")
    return chosen.filter(forwarded(F.col("key"), F.col("partition_offset"), F.col("percent"))).drop("percent")


def enqueue(log: DataFrame, config: DataFrame, queued: DataFrame) -> DataFrame:
    """New outbox rows; what is queued already stays as it is."""
    rows = sample(log, config).select(*KEYS, F.col("partition_offset").alias("local_offset"))
    return rows.join(queued.select(*ID), ID, "left_anti").withColumn("retry_count", F.lit(0))


def enqueue_at_commit(log: DataFrame, fates: DataFrame, config: DataFrame, queued: DataFrame) -> DataFrame:
    """New outbox rows of transactional records, once their transaction has committed.

    ``fates`` (global_offset, txn_state) come from the transactions' end markers, so a pending or
    aborted transaction enqueues nothing, and the configuration is the one at the commit.
    """
    committed = fates.filter("txn_state IS NULL").select("global_offset")
    return enqueue(log.drop("txn_state").join(committed, "global_offset").withColumn("txn_state", F.lit(None).cast("string")), config, queued)


def decisions(log: DataFrame, config: DataFrame) -> DataFrame:
    """Per topic: committed records forwarded and skipped by its percentage."""
    on = effective(config).select("topic_id", "percent")
    chosen = forwarded(F.col("key"), F.col("partition_offset"), F.coalesce("percent", F.lit(0)))
    judged = log.filter("txn_state IS NULL").join(on, "topic_id", "left").select("topic_id", chosen.alias("chosen"))
    return judged.groupBy("topic_id").agg(F.count_if("chosen").alias("forwarded"), F.count_if(~F.col("chosen")).alias("skipped"))


def payloads(batch: DataFrame, log: DataFrame, config: DataFrame, topics: DataFrame) -> DataFrame:
    """A claimed batch with what is sent: target topic, key and value of each record."""
    targets = topics.select("topic_id", "topic").join(config.select("topic_id", "external_topic_name"), "topic_id", "left")
    target = F.coalesce("external_topic_name", "topic").alias("target")
    records = log.select(*KEYS, F.col("partition_offset").alias("local_offset"), "key", "value")
    return batch.join(targets.select("topic_id", target), "topic_id").join(records, ID)


def due(outbox: DataFrame, log: DataFrame, as_of_ms: int, limit: int = BATCH) -> DataFrame:
    """The next batch to send: pending, retries left, not tried lately, and its record exists."""
    waiting = outbox.filter(
        F.col("external_offset").isNull()
        & (F.col("retry_count") < MAX_RETRIES)
        & (F.col("attempted_ms").isNull() | (F.col("attempted_ms") < as_of_ms - RETRY_AFTER_MS))
    )
    records = log.select(*KEYS, F.col("partition_offset").alias("local_offset"))
    batch = waiting.join(records, ID, "left_semi").orderBy(*ID).limit(limit)
    return batch.withColumn("retry_count", F.col("retry_count") + 1).withColumn("attempted_ms", F.lit(as_of_ms))


def acknowledged(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    """The outbox after versioned acks (ID, seq, ok, external_offset, error), any number a row.

    The first success sets the external offset, once; failures leave the latest error, also one
    from before a success; an ack of an unknown row is ignored.
    """
    ok = F.col("ok")
    folded = acks.groupBy(*ID).agg(
        F.min_by(F.when(ok, F.col("external_offset")), F.when(ok, F.col("seq"))).alias("__external"),
        F.min(F.when(ok, F.col("seq"))).alias("__sent"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("seq", "error")))).alias("__errors"),
    )
    fresh = F.col("external_offset").isNull()
    failed = F.filter("__errors", lambda e: F.col("__sent").isNull() | (e["seq"] < F.col("__sent")))
    last_error = F.try_element_at(failed, F.lit(-1))["error"]
    return (
        outbox.join(folded, ID, "left")
        .withColumn("error", F.when(fresh, F.coalesce(last_error, F.col("error"))).otherwise(F.col("error")))
        .withColumn("external_offset", F.coalesce("external_offset", "__external"))
        .drop("__external", "__sent", "__errors")
    )


def dead_letters(outbox: DataFrame) -> DataFrame:
    return outbox.filter(F.col("external_offset").isNull() & (F.col("retry_count") >= MAX_RETRIES))


def metrics(outbox: DataFrame) -> DataFrame:
    """messages_forwarded, messages_failed and the last forwarded offset and time of every partition, derived."""
    sent = F.col("external_offset").isNotNull()
    return outbox.groupBy(*KEYS).agg(
        F.count_if(sent).alias("messages_forwarded"),
        F.count_if(~sent & F.col("error").isNotNull()).alias("messages_failed"),
        F.max(F.when(sent, F.col("local_offset"))).alias("last_forwarded_offset"),
        F.max(F.when(sent, F.col("attempted_ms"))).alias("last_forwarded_ms"),
    )


def status(topics: DataFrame, config: DataFrame, measured: DataFrame, log: DataFrame) -> DataFrame:
    """Per topic: settings with their defaults, totals and lag = highest offset - last forwarded (or 0)."""
    totals = measured.groupBy("topic_id").agg(
        F.sum("messages_forwarded").alias("f"), F.sum("messages_failed").alias("e"), F.max("last_forwarded_offset").alias("l"), F.max("last_forwarded_ms").alias("t")
    )
    tops = log.groupBy("topic_id").agg(F.max("partition_offset").alias("top"))
    joined = topics.join(config, "topic_id", "left").join(totals, "topic_id", "left").join(tops, "topic_id", "left")
    none = F.lit(0)
    return joined.select(
        "topic_id",
        "topic",
        F.coalesce("mode", F.lit("local")).alias("mode"),
        F.coalesce("forward_percentage", none).alias("forward_percentage"),
        F.coalesce("f", none).alias("total_forwarded"),
        F.coalesce("e", none).alias("total_failed"),
        F.col("l").alias("last_forwarded_offset"),
        F.col("t").alias("last_forwarded_ms"),
        (F.col("top") - F.coalesce("l", none)).alias("lag"),
    )


def replay(log: DataFrame, outbox: DataFrame, topic_id: int, start: int, stop: int | None) -> DataFrame:
    """The outbox with a topic's committed records of [start, stop) pending again."""
    offset = F.col("partition_offset")
    inside = (F.col("topic_id") == topic_id) & (offset >= start)
    inside = inside if stop is None else inside & (offset < stop)
    again = log.filter(inside & F.col("txn_state").isNull()).select(*KEYS, offset.alias("local_offset"))
    rest = outbox.join(again, ID, "left_anti")
    fresh = again.withColumn("retry_count", F.lit(0))
    return rest.unionByName(fresh, allowMissingColumns=True)


def _hidden(config: DataFrame, dead: DataFrame, strict: bool) -> DataFrame:
    """Topics that are read from outside: external-only ones, but not, unless ``strict``, those with dead letters."""
    external = config.filter("mode = 'shadow' AND write_mode = 'external_only'").select("topic_id")
    return external if strict else external.join(dead.select("topic_id"), "topic_id", "left_anti")


def readable(marks: DataFrame, config: DataFrame, dead: DataFrame, strict: bool) -> DataFrame:
    """Watermarks with hidden topics read as empty."""
    flagged = marks.join(_hidden(config, dead, strict).withColumn("__hidden", F.lit(True)), "topic_id", "left")
    names = ["high_watermark", "earliest_offset", "last_stable_offset"]
    return flagged.select(*KEYS, *[F.when(F.col("__hidden"), 0).otherwise(F.col(n)).cast("long").alias(n) for n in names])


def readable_rows(rows: DataFrame, config: DataFrame, dead: DataFrame, strict: bool) -> DataFrame:
    """Fetched records without those of hidden topics."""
    return rows.join(_hidden(config, dead, strict), "topic_id", "left_anti")


def readable_times(found: DataFrame, config: DataFrame, dead: DataFrame, strict: bool) -> DataFrame:
    """Time look-ups (offset, timestamp_ms), which find nothing in hidden topics."""
    flagged = found.join(_hidden(config, dead, strict).withColumn("__hidden", F.lit(True)), "topic_id", "left")
    none = lambda c: F.when(F.col("__hidden"), -1).otherwise(F.col(c)).cast("long")
    return flagged.withColumns({"offset": none("offset"), "timestamp_ms": none("timestamp_ms")}).drop("__hidden")


def lag_by_partition(log: DataFrame, measured: DataFrame) -> DataFrame:
    """The true lag of every partition: records after the last forwarded one."""
    tops = log.groupBy(*KEYS).agg(F.max("partition_offset").alias("top"))
    return tops.join(measured.select(*KEYS, "last_forwarded_offset"), KEYS, "left").select(
        *KEYS, (F.col("top") - F.coalesce("last_forwarded_offset", F.lit(-1))).alias("lag")
    )
