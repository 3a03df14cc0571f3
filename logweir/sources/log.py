"""The canonical log: schemas, the projection of an event table to it, and Parquet in and out."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.ordering import SLICE, numbered
from logweir.functions.routing import murmur2_udf, partition_for

KEYS = ["topic_id", "partition_id"]
LOG = (
    "topic_id INT, topic STRING, partition_id INT, partition_offset BIGINT, global_offset BIGINT, key STRING, "
    "value STRING, timestamp_ms BIGINT, created_at TIMESTAMP_NTZ, producer_id BIGINT, producer_epoch INT, "
    "sequence BIGINT, txn_state STRING"
)
COLUMNS = [c.split()[0] for c in LOG.split(", ")]
TOPIC_NAMES = ("click", "error", "purchase", "signup", "view")
PARTITIONS = 4
CODECS = ("none", "gzip", "snappy", "lz4", "zstd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics(spark: SparkSession) -> DataFrame:
    """topic_id, topic, partitions: a dimension of a fixed few rows."""
    rows = [(i + 1, name, PARTITIONS) for i, name in enumerate(TOPIC_NAMES)]
    return spark.createDataFrame(rows, "topic_id INT, topic STRING, partitions INT")


def topic_id(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TOPIC_NAMES]), name).cast("int")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records without offsets, with the topic and partition they route to."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).scalar()
    e = F.col("event_id")
    key = F.when(e % 10 == 0, F.lit(None)).when(e % 10 == 1, "").otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return events.select(
        topic_id(F.col("event_type")).alias("topic_id"),
        F.col("event_type").alias("topic"),
        partition_for(key, F.lit(PARTITIONS), e).alias("partition_id"),
        e.alias("global_offset"),
        key.alias("key"),
        F.col("props").alias("value"),
        F.when(e % 50 == 0, F.lit(-1)).otherwise(epoch_ms(F.col("ts"))).cast("long").alias("timestamp_ms"),
        (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("created_at"),
        (F.col("user_id") % 5).alias("producer_id"),
        F.lit(0).alias("producer_epoch"),
        F.when(e % 20 == 3, "aborted").when((e > 0.95 * last) & (e % 97 == 0), "pending").alias("txn_state"),
    )


def built_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical log over the event table, computed from it."""
    keys = {"partition_offset": KEYS, "sequence": ["producer_id", *KEYS]}
    return numbered(event_records(spark, sf_dir), "global_offset", keys).select(*COLUMNS)


def shared_folder(spark: SparkSession) -> str:
    """Where relations that queries share are written: the checkpoint folder, or else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


_WRITTEN: set[str] = set()


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical log over the event table, written once a session and read with pruned columns.

    A table of other files is another log.
    """
    files = "\n".join(sorted(table(spark, sf_dir, "events").inputFiles()))
    stamp = hashlib.md5(files.encode()).hexdigest()
    path = f"{shared_folder(spark)}/logweir-log-{spark.sparkContext.applicationId}-{stamp}"
    if path not in _WRITTEN:
        write_log(built_log(spark, sf_dir), path)
        _WRITTEN.add(path)
    return read_log(spark, path)


def write_log(log: DataFrame, path: str, codec: str = "zstd") -> None:
    """Parquet by topic, sorted so that row-group statistics serve offset ranges; unknown codecs write none.

    Slices of a partition are spread, so that a large one is the work of many tasks.
    """
    chosen = codec.lower() if codec.lower() in CODECS else "none"
    (
        log.repartition(*KEYS, F.floor(F.col("partition_offset") / SLICE))
        .sortWithinPartitions(*KEYS, "partition_offset")
        .write.mode("overwrite")
        .option("compression", chosen)
        .partitionBy("topic_id")
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path).select(*COLUMNS)


#: Times in text keep their microseconds.
JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def to_json(log: DataFrame) -> DataFrame:
    """One JSON string a record, for text sinks."""
    return log.select(F.to_json(F.struct(*log.columns), JSON).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", LOG, JSON).alias("r")).select("r.*")


def kafka_source(spark: SparkSession, servers: str, topic: str, streaming: bool = False) -> DataFrame:
    """A topic of an external broker; the connector jar is the deployment's."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def kafka_sink(log: DataFrame, servers: str) -> None:
    """Forwards records; the broker chooses partitions by key."""
    out = log.select("topic", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").save()


def register_views(spark: SparkSession, relations: dict[str, DataFrame]) -> None:
    """Every relation as a temporary view of its name, and the routing hash as a SQL function."""
    for name, df in relations.items():
        df.createOrReplaceTempView(name)
    spark.udf.register("murmur2", murmur2_udf())


def with_partitions(topics_: DataFrame, log: DataFrame) -> DataFrame:
    """Topics with the number of partitions they have and of those that hold records."""
    used = log.groupBy("topic_id").agg(F.countDistinct("partition_id").alias("used_partitions"))
    return topics_.join(used, "topic_id", "left").fillna(0, ["used_partitions"])
