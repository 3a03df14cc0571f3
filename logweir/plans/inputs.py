"""Relations that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.routing import forwarded
from logweir.sources import log as L
from logweir.sources.log import KEYS, table

ACTIONS = {"view": "begin", "click": "begin", "purchase": "commit", "error": "abort", "signup": "init"}
#: 2024-01-31, after the last event.
AS_OF_MS = 1_706_659_200_000
PROBES = (0, 1_704_500_000_000, 1_705_300_000_000, 1_706_000_000_000, 1_800_000_000_000)


def commits(log: DataFrame) -> DataFrame:
    """A commit for every record, by the group of its producer; some rewind, by the length of the value."""
    behind = F.length("value") % 3
    return log.select(
        F.concat(F.lit("group-"), (F.col("producer_id") % 3).cast("string")).alias("group_id"),
        *KEYS,
        F.greatest(F.col("partition_offset") + 1 - behind, F.lit(0)).alias("committed_offset"),
        F.col("global_offset").alias("seq"),
    )


def batches(log: DataFrame) -> DataFrame:
    """Produce batches: every record, every eleventh sent twice, and every thirteenth preceded by a gap."""
    seq = F.col("global_offset")
    sent = lambda rows, arrival, base: rows.select(
        "producer_id", *KEYS, arrival.cast("long").alias("arrival"), base.alias("base_sequence"), F.lit(1).alias("n_records")
    )
    own = F.col("sequence")
    again, early = log.filter(seq % 11 == 0), log.filter(seq % 13 == 0)
    return sent(log, 3 * seq, own).unionByName(sent(again, 3 * seq + 1, own)).unionByName(sent(early, 3 * seq - 1, own + 7))


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("txn-"), (F.col("user_id") % 20).cast("string")).alias("txn_id"),
        F.col("event_id").alias("seq"),
        F.element_at(action, F.col("event_type")).alias("action"),
        L.epoch_ms(F.col("ts")).alias("at_ms"),
        "user_id",
    )


def members(spark: SparkSession, sf_dir: str, mixed: bool) -> DataFrame:
    """Group members from the supplier table, in groups of 700 at most; ``mixed`` ones subscribe to different topics."""
    k = F.col("s_suppkey")
    block = F.when(k >= 4900, F.concat(F.lit("-"), F.expr("s_suppkey div 4900").cast("string"))).otherwise(F.lit(""))
    every = F.array(*[F.lit(t) for t in L.TOPIC_NAMES])
    some = F.when(k % 3 == 1, F.slice(every, 1, 3)).when(k % 3 == 2, F.slice(every, 3, 3)).otherwise(every)
    choice = F.array(*[F.array(*[F.lit(p) for p in ps.split()]) for ps in ("sticky range", "range roundrobin", "roundrobin range", "range")])
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("group-"), (k % 7).cast("string"), block).alias("group_id"),
        F.concat(F.lit("m-"), F.lpad(k.cast("string"), 8, "0")).alias("member_id"),
        (some if mixed else every).alias("topics"),
        F.get(choice, (k % 4).cast("int")).alias("protocols"),
        (F.lit(AS_OF_MS) - k * 1000).alias("heartbeat_ms"),
        F.lit(30_000).cast("long").alias("timeout_ms"),
    )


def config(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "shadow", 50, None, "dual_write"),
        (2, "shadow", 10, "errors-out", "external_only"),
        (3, "shadow", 25, None, "dual_write"),
        (4, "local", 90, None, "dual_write"),
        (5, "shadow", 0, None, "external_only"),
    ]
    return spark.createDataFrame(
        rows, "topic_id INT, mode STRING, forward_percentage INT, external_topic_name STRING, write_mode STRING"
    )


def outbox(log: DataFrame) -> DataFrame:
    """Queued rows of topics 1 to 3 in various states of delivery, by their global offset."""
    g = F.col("global_offset")
    return log.filter("topic_id <= 3 AND txn_state IS NULL").select(
        *KEYS,
        F.col("partition_offset").alias("local_offset"),
        F.when(g % 4 == 0, g + 1_000_000).alias("external_offset"),
        (g % 13).cast("int").alias("retry_count"),
        F.when(g % 3 != 0, F.lit(AS_OF_MS) - (g % 10) * 1000).alias("attempted_ms"),
        F.when((g % 4 != 0) & (g % 5 == 0), "timed out").alias("error"),
    )


def acks(outbox_: DataFrame) -> DataFrame:
    """Two rounds of acknowledgements of every queued row."""
    at = F.col("local_offset")
    ack = lambda seq, ok, error: F.struct(F.lit(seq).alias("seq"), ok.alias("ok"), (at + seq * 1_000_000).alias("external_offset"), F.lit(error).alias("error"))
    both = F.array(ack(5, at % 2 == 0, "refused"), ack(6, at % 3 == 0, "late"))
    return outbox_.select(*KEYS, "local_offset", F.inline(both))


def begin_requests(spark: SparkSession, sf_dir: str, states: DataFrame) -> DataFrame:
    """A request to begin for each of 25 transactional ids, some unknown, every fourth of an older epoch."""
    k = F.col("n_nationkey")
    ids = table(spark, sf_dir, "nation").select(F.concat(F.lit("txn-"), k.cast("string")).alias("txn_id"), (k % 4 == 3).cast("int").alias("behind"))
    known = states.select("txn_id", "producer_epoch")
    return ids.join(known, "txn_id", "left").select(
        "txn_id", (F.coalesce("producer_epoch", F.lit(0)) - F.col("behind")).alias("producer_epoch"), F.lit(AS_OF_MS).alias("at_ms")
    )


def samples(log: DataFrame, percent: int) -> DataFrame:
    return log.filter(forwarded(F.col("key"), F.col("partition_offset"), F.lit(percent))).select(
        *KEYS, "partition_offset", "key"
    )
