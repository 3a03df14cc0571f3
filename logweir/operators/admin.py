"""Topics and monitoring: metadata, validation, cascades, sizes and the metrics relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.ordering import numbered
from logweir.sources.log import KEYS

TOPIC_NAME = r"^[A-Za-z0-9._-]{1,249}$"
# Public protocol error codes.
TOPIC_EXISTS, INVALID_TOPIC, INVALID_PARTITIONS, UNKNOWN_TOPIC = 36, 17, 37, 3


# Estimated overheads of a request, a topic and a partition.
REQUEST_BYTES, TOPIC_BYTES, PARTITION_BYTES = 256, 32, 48


def valid_name(name: Column) -> Column:
    return F.coalesce(F.rlike(name, F.lit(TOPIC_NAME)) & ~name.isin(".", ".."), F.lit(False))


def create_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """error_code of (request, topic, partitions) requests, and the id and partitions of the created ones.

    Of several requests for one new name the first (by ``request``) creates it. Ids follow the
    order of the requests, numbered by slices.
    """
    old = topics.select("topic", F.lit(True).alias("__old"))
    again = F.row_number().over(Window.partitionBy("topic").orderBy("request")) > 1
    code = F.when(~valid_name(F.col("topic")), INVALID_TOPIC).when(F.col("__old") | again, TOPIC_EXISTS).otherwise(0)
    judged = requests.join(old, "topic", "left").withColumn("error_code", code).drop("__old")
    top = topics.agg(F.coalesce(F.max("topic_id"), F.lit(0))).scalar()
    placed = numbered(judged, "request", {"__at": ["error_code"]})
    created = F.when(F.col("error_code") == 0, top + F.col("__at") + 1).cast("int")
    return placed.withColumn("topic_id", created).withColumn(
        "partitions", F.when(F.col("partitions") <= 0, 1).otherwise(F.col("partitions"))
    ).drop("__at")


def get_or_create_topics(names: DataFrame, topics: DataFrame, default_partitions: int) -> DataFrame:
    """topic_id, topic, partitions of every distinct valid name (topic), new ones with the default number."""
    wanted = names.select("topic").distinct()
    fresh = wanted.join(topics, "topic", "left_anti").select("topic", F.lit(default_partitions).alias("partitions"))
    at = F.row_number().over(Window.partitionBy("__slice").orderBy("topic"))
    # Names are numbered by their order inside 4096 hash slices and the slices' running counts.
    sliced = fresh.withColumn("__slice", F.pmod(F.xxhash64("topic"), F.lit(4096)))
    numbered_ = sliced.withColumn("request", F.col("__slice") * (1 << 40) + at)
    made = create_topics(numbered_.drop("__slice"), topics).filter("error_code = 0")
    columns = ["topic_id", "topic", "partitions"]
    return topics.join(wanted, "topic", "left_semi").select(*columns).unionByName(made.select(*columns))


def topic_lookup(names: DataFrame, topics: DataFrame) -> DataFrame:
    """Whether each name (topic) exists, with its id and partitions, else -1 and 0."""
    known = topics.select("topic", "topic_id", "partitions")
    return names.join(known, "topic", "left").select(
        *names.columns,
        F.col("topic_id").isNotNull().alias("known"),
        F.coalesce("topic_id", F.lit(-1)).alias("topic_id"),
        F.coalesce("partitions", F.lit(0)).alias("partitions"),
    )


def with_partition_counts(topics: DataFrame, changes: DataFrame) -> DataFrame:
    """Topics after (topic, new_partitions) requests: counts grow to the largest valid request, never shrink."""
    good = create_partitions(changes, topics).filter("error_code = 0")
    grown = good.groupBy("topic").agg(F.max("new_partitions").alias("__grown"))
    return topics.join(grown, "topic", "left").withColumn(
        "partitions", F.greatest(F.col("partitions"), F.coalesce("__grown", F.lit(0))).cast("int")
    ).drop("__grown")


def create_partitions(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """error_code of (topic, new_partitions) requests: unknown topic, or not more than there are."""
    code = F.when(F.col("partitions").isNull(), UNKNOWN_TOPIC).when(F.col("new_partitions") <= F.col("partitions"), INVALID_PARTITIONS)
    return requests.join(topics.select("topic", "partitions"), "topic", "left").select(
        "topic", "new_partitions", F.coalesce(code, F.lit(0)).alias("error_code")
    )


def delete_topics(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Any relation with a topic_id after the deletion of topics cascades to it."""
    return rows.join(deleted.select("topic_id"), "topic_id", "left_anti")


def partition_metadata(topics: DataFrame) -> DataFrame:
    return topics.filter("partitions > 0").select(
        "topic_id", "topic", F.explode(F.expr("sequence(0, partitions - 1)")).alias("partition_id")
    )


def bytes_per_topic(log: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(size).cast("long").alias("total_bytes"), F.max(size).cast("long").alias("largest")
    )


def record_size(key: Column, value: Column, headers: Column) -> Column:
    """An estimate of a record's bytes in memory; headers are a map of strings."""
    none = F.lit(0)
    pairs = F.aggregate(F.map_entries(headers), none, lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return (F.lit(64) + F.coalesce(F.octet_length(key), none) + F.coalesce(F.octet_length(value), none) + F.coalesce(pairs, none)).cast("long")


def headers_json(pairs: Column) -> Column:
    """JSON of (name, bytes) pairs with lower-case hex values; of repeated names the last counts."""
    kept = F.filter(
        pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"])
    )
    return F.to_json(F.map_from_entries(F.transform(kept, lambda p: F.struct(p["name"], F.lower(F.hex(p["value"]))))))


def request_sizes(records: DataFrame) -> DataFrame:
    """Estimated bytes of produce requests of (request, topic, partition_id, size) records, with the overheads of each level."""
    parts = records.groupBy("request", "topic", "partition_id").agg((F.sum("size") + PARTITION_BYTES).alias("size"))
    per_topic = parts.groupBy("request", "topic").agg((F.sum("size") + F.octet_length("topic") + TOPIC_BYTES).alias("size"))
    return per_topic.groupBy("request").agg((F.sum("size") + REQUEST_BYTES).cast("long").alias("size"))


METRICS = (
    ("topics", "count", "topics"),
    ("messages", "count", "messages"),
    ("messages", "total_bytes", "bytes"),
    ("consumer_groups", "active_members", "members"),
    ("consumer_offsets", "committed", "offsets"),
    ("producers", "active", "producers"),
    ("transactions", "ongoing", "transactions"),
    ("transactions", "pending_messages", "messages"),
    ("shadow", "forwarded", "messages"),
    ("shadow", "failed", "messages"),
    ("shadow", "lag", "messages"),
)


def metrics_overview(log: DataFrame, topics: DataFrame, members: DataFrame, commits: DataFrame, producers: DataFrame, states: DataFrame, outbox: DataFrame, as_of_ms: int) -> DataFrame:
    """(category, metric, value, unit): eleven aggregates, from one pass over each relation."""
    n = F.count(F.lit(1))
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    sent = F.col("external_offset").isNotNull()
    # The lag is a difference of two relations; each contributes its part of the sum.
    passes = [
        (topics, {("topics", "count"): n}),
        (log, {
            ("messages", "count"): n,
            ("messages", "total_bytes"): F.sum(size),
            ("transactions", "pending_messages"): F.count_if(F.col("txn_state") == "pending"),
            ("shadow", "lag"): F.max("partition_offset"),
        }),
        (members, {("consumer_groups", "active_members"): F.countDistinct("group_id", "member_id")}),
        (commits, {("consumer_offsets", "committed"): n}),
        (producers, {("producers", "active"): F.count_if(F.col("last_active_ms") > as_of_ms - 300_000)}),
        (states, {("transactions", "ongoing"): F.count_if(F.col("state") == "Ongoing")}),
        (outbox, {
            ("shadow", "forwarded"): F.count_if(sent),
            ("shadow", "failed"): F.count_if(~sent & F.col("error").isNotNull()),
            ("shadow", "lag"): -F.max(F.when(sent, F.col("local_offset"))),
        }),
    ]
    units = {(c, m): u for c, m, u in METRICS}

    def rows(df: DataFrame, measures: dict[tuple[str, str], Column]) -> DataFrame:
        named = [F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), F.lit(units[c, m]).alias("unit"), F.coalesce(v, F.lit(0)).cast("long").alias("v")) for (c, m), v in measures.items()]
        return df.agg(F.array(*named).alias("all")).select(F.inline("all"))

    parts = reduce(DataFrame.unionByName, [rows(df, measures) for df, measures in passes])
    return parts.groupBy("category", "metric", "unit").agg(F.sum("v").alias("value")).select("category", "metric", "value", "unit")


#: Slices of values in an octave.
OCTAVE = 64


def nearest_rank(df: DataFrame, group: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """Exact nearest-rank percentiles: the smallest value with at least p percent of rows at or below it.

    Counts of slices of values, in their order, tell which slice holds each rank. Only the rows of
    those slices are counted by value, so no group is sorted whole. Rows of a null group take no part.
    """
    v = F.col(value).cast("double")
    near = F.signum(v) * F.floor(F.log2(F.abs(v)) * OCTAVE + 2000 * OCTAVE)
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value), F.when(v == 0, 0.0).otherwise(near).alias("__slice"))
    upto = lambda *order: Window.partitionBy(*group, *order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).alias("__n")
    slices = (
        rows.groupBy(*group, "__slice").agg(n)
        .withColumn("__upto", F.sum("__n").over(upto("__slice")))
        .withColumn("__all", F.sum("__n").over(Window.partitionBy(*group)))
    )
    # Rank of each percentile, from 1, and how much of it is left in the slice that holds it.
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.col("__all") * p / F.lit(100)), F.lit(1)).alias("r")) for p in percents])
    wanted = (
        slices.select(*group, "__slice", "__n", "__upto", F.inline(ranks))
        .filter((F.col("r") <= F.col("__upto")) & (F.col("r") > F.col("__upto") - F.col("__n")))
        .select(*group, "__slice", "p", (F.col("r") - F.col("__upto") + F.col("__n")).alias("__left"))
    )
    values = rows.join(wanted.select(*group, "__slice").distinct(), [*group, "__slice"], "left_semi").groupBy(*group, "__slice", value).agg(n)
    placed = values.withColumn("__upto", F.sum("__n").over(upto("__slice", value)))
    found = placed.join(wanted, [*group, "__slice"]).filter("__upto >= __left")
    return found.groupBy(*group).agg(*[F.min(F.when(F.col("p") == p, F.col(value))).alias(f"p{p}") for p in percents])


def row_distinct(log: DataFrame) -> DataFrame:
    """txn_state and key counts of every partition: plain, filtered and distinct aggregates."""
    return log.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("txn_state") == "aborted").alias("n_aborted"),
        F.countDistinct("key").alias("n_keys"),
        F.countDistinct("producer_id", "producer_epoch").alias("n_producers"),
    )
