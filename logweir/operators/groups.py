"""Consumer groups: committed offsets, lag, commit fences and partition assignment."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.sources.log import KEYS

# Public protocol error codes.
UNKNOWN_MEMBER, ILLEGAL_GENERATION, UNKNOWN_GROUP, REBALANCING = 25, 22, 25, 27
PRIORITY = {"sticky": 3, "cooperative-sticky": 3, "roundrobin": 2, "range": 1}


def committed(changes: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The latest commit (by seq) of each group and partition; a later commit may rewind."""
    live = changes if deleted is None else changes.join(deleted.select("group_id"), "group_id", "left_anti")
    return live.groupBy("group_id", *KEYS).agg(F.max_by("committed_offset", "seq").alias("committed_offset"))


def lag(current: DataFrame, marks: DataFrame) -> DataFrame:
    """high_watermark - committed_offset of every group and partition with a commit."""
    return current.join(marks.select(*KEYS, "high_watermark"), KEYS).select(
        "group_id", *KEYS, "committed_offset", "high_watermark", (F.col("high_watermark") - F.col("committed_offset")).alias("lag")
    )


def commit_fence(requests: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """error_code of each commit request, by the first rule that fails.

    A negative generation passes; then the group, its generation, the member and an ongoing
    rebalance are tested. ``groups``: group_id, generation, state; ``members``: group_id, member_id.
    """
    known = members.select("group_id", "member_id", F.lit(True).alias("__member"))
    joined = requests.join(groups.withColumnRenamed("generation", "__generation"), "group_id", "left").join(
        known, ["group_id", "member_id"], "left"
    )
    code = (
        F.when(F.col("generation") < 0, 0)
        .when(F.col("__generation").isNull(), UNKNOWN_GROUP)
        .when(F.col("generation") != F.col("__generation"), ILLEGAL_GENERATION)
        .when(F.col("__member").isNull(), UNKNOWN_MEMBER)
        .when(F.col("state").isin("PreparingRebalance", "CompletingRebalance"), REBALANCING)
        .otherwise(0)
    )
    return joined.withColumn("error_code", code).drop("__generation", "__member", "state")


def expired_members(members: DataFrame, as_of_ms: int) -> DataFrame:
    """Members whose session ran out: no heartbeat within their timeout, or a timeout of zero or less."""
    return members.filter((F.lit(as_of_ms) - F.col("heartbeat_ms") > F.col("timeout_ms")) | (F.col("timeout_ms") <= 0))


def live_groups(members: DataFrame, as_of_ms: int) -> DataFrame:
    """group_id and its members left after expiry; groups that lose all of them go."""
    gone = expired_members(members, as_of_ms).select("group_id", "member_id")
    return members.join(gone, ["group_id", "member_id"], "left_anti").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))


def unread(log: DataFrame, current: DataFrame) -> DataFrame:
    """group_id and the records that each group has still to read: from its committed offset on.

    ``current`` has one row a group and partition, with -1 or 0 where nothing is committed.
    """
    marks = current.select("group_id", *KEYS, "committed_offset")
    return log.join(marks, KEYS).filter(F.col("partition_offset") >= F.col("committed_offset"))


def positions(current: DataFrame, partitions: DataFrame, group_id: str) -> DataFrame:
    """A group's position in every partition: its committed offset, or -1."""
    own = current.filter(F.col("group_id") == group_id).select(*KEYS, "committed_offset")
    return partitions.select(*KEYS).join(own, KEYS, "left").select(
        F.lit(group_id).alias("group_id"), *KEYS, F.coalesce("committed_offset", F.lit(-1)).alias("committed_offset")
    )


def common_protocol(members: DataFrame) -> DataFrame:
    """Each group's protocol: the leader's first choice that every member supports, else its first."""
    wide = members.groupBy("group_id").agg(
        F.min_by("protocols", "member_id").alias("wanted"),
        F.collect_set("protocols").alias("all"),
    )
    shared = F.aggregate("all", F.col("wanted"), lambda a, p: F.array_intersect(a, p))
    return wide.select("group_id", F.coalesce(F.get(shared, F.lit(0)), F.get("wanted", F.lit(0))).alias("protocol"))


def priority(protocol: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), protocol), F.lit(0))


def preferred_protocol(members: DataFrame) -> DataFrame:
    """Each group's protocol of highest priority among those that every member supports, or null; ties by name."""
    own = members.select("group_id", "member_id", F.explode("protocols").alias("p")).select("group_id", "member_id", F.lower("p").alias("p")).distinct()
    sizes = members.select("group_id", "member_id").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("m"))
    shared = own.groupBy("group_id", "p").agg(F.count(F.lit(1)).alias("n")).join(sizes, "group_id").filter("n = m")
    best = shared.groupBy("group_id").agg(F.max_by("p", F.struct(priority(F.col("p")), "p")).alias("protocol"))
    return sizes.select("group_id").join(best, "group_id", "left")


def assign(members: DataFrame, topics: DataFrame, previous: DataFrame, protocols: DataFrame) -> DataFrame:
    """The assignment of every group by its own protocol (group_id, protocol); unknown protocols assign nothing."""
    named = protocols.select("group_id", F.lower("protocol").alias("__p"))
    of = lambda *names: members.join(named.filter(F.col("__p").isin(*names)).select("group_id"), "group_id", "left_semi")
    return (
        assign_range(of("range"), topics)
        .unionByName(assign_roundrobin(of("roundrobin"), topics))
        .unionByName(assign_sticky(of("sticky", "cooperative-sticky"), topics, previous))
    )


def unassigned(members: DataFrame, topics: DataFrame, assigned: DataFrame) -> DataFrame:
    """Partitions of subscribed topics that no member of the group has."""
    parts = _subscribed(members, topics).select("group_id", "topic", F.explode(F.expr("sequence(0, partitions - 1)")).alias("partition_id"))
    return parts.distinct().join(assigned, ["group_id", "topic", "partition_id"], "left_anti")


def _subscribed(members: DataFrame, topics: DataFrame) -> DataFrame:
    return members.select("group_id", "member_id", F.explode(F.array_distinct("topics")).alias("topic")).join(
        topics.filter("partitions > 0").select("topic", "partitions"), "topic"
    )


def assign_range(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Per topic, contiguous runs in member order; the first members get one partition more."""
    own = _subscribed(members, topics)
    each = Window.partitionBy("group_id", "topic")
    i = F.row_number().over(each.orderBy("member_id")) - 1
    m = F.count(F.lit(1)).over(each)
    base, extra = F.expr("partitions div m"), F.col("partitions") % F.col("m")
    cut = own.withColumn("i", i).withColumn("m", m).withColumn("base", base).withColumn("extra", extra)
    start = F.col("i") * F.col("base") + F.least("i", "extra")
    size = F.col("base") + F.when(F.col("i") < F.col("extra"), 1).otherwise(0)
    got = cut.withColumn("start", start).withColumn("size", size).filter("size > 0")
    return got.select(
        "group_id", "member_id", "topic", F.explode(F.expr("sequence(int(start), int(start + size - 1))")).alias("partition_id")
    )


def assign_roundrobin(members: DataFrame, topics: DataFrame) -> DataFrame:
    """All partitions in order, dealt around the sorted members.

    Groups whose members all subscribe alike have a closed form; in the others the pointer
    skips members without the topic, a fold over one group's assignment table.
    """
    own = _subscribed(members, topics)
    topic_sets = members.groupBy("group_id").agg(F.countDistinct(F.array_sort(F.array_distinct("topics"))).alias("kinds"))
    alike = topic_sets.filter("kinds = 1").select("group_id")
    parts = own.select("group_id", "topic", F.explode(F.expr("sequence(0, partitions - 1)")).alias("partition_id")).distinct()
    ranked = members.select("group_id", "member_id").distinct()
    by_member = Window.partitionBy("group_id").orderBy("member_id")
    ranked = ranked.withColumn("i", F.row_number().over(by_member) - 1)
    sizes = ranked.groupBy("group_id").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("group_id").orderBy("topic", "partition_id")
    dealt = parts.join(alike, "group_id").join(sizes, "group_id").withColumn("i", (F.row_number().over(order) - 1) % F.col("m"))
    closed = dealt.join(ranked, ["group_id", "i"]).select("group_id", "member_id", "topic", "partition_id")
    mixed = own.join(alike, "group_id", "left_anti")
    folded = mixed.groupBy("group_id").applyInPandas(_roundrobin, "group_id string, member_id string, topic string, partition_id int")
    return closed.unionByName(folded)


def _roundrobin(rows: pd.DataFrame) -> pd.DataFrame:
    wants = rows.groupby("member_id")["topic"].agg(set).to_dict()
    ring, at, out = sorted(wants), 0, []
    sizes = rows.groupby("topic")["partitions"].max().to_dict()
    for topic in sorted(sizes):
        for partition in range(sizes[topic]):
            while topic not in wants[ring[at % len(ring)]]:
                at += 1
            out.append((rows["group_id"].iloc[0], ring[at % len(ring)], topic, partition))
            at += 1
    return pd.DataFrame(out, columns=["group_id", "member_id", "topic", "partition_id"])


def assign_sticky(members: DataFrame, topics: DataFrame, previous: DataFrame) -> DataFrame:
    """Keeps what is still valid of ``previous`` (group_id, member_id, topic, partition_id) and evens out.

    One group's members and partitions are a bounded coordination table; it is folded whole,
    in a total order of members, topics and partitions.
    """
    wanted = _subscribed(members, topics)
    empty = members.select("group_id", "member_id", F.lit(None).cast("string").alias("topic"), F.lit(0).alias("partitions"))
    before = previous.selectExpr("group_id AS g", "member_id AS m", "topic AS t", "partition_id AS p")
    return (
        wanted.select("group_id", "member_id", "topic", "partitions")
        .unionByName(empty)
        .groupBy("group_id")
        .cogroup(before.groupBy("g"))
        .applyInPandas(_sticky, "group_id string, member_id string, topic string, partition_id int")
    )


def _sticky(rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    columns = ["group_id", "member_id", "topic", "partition_id"]
    if rows.empty:
        return pd.DataFrame([], columns=columns)
    wants: dict[str, set] = defaultdict(set)
    for member, topic in zip(rows["member_id"], rows["topic"]):
        wants[member] |= {topic} - {None}
    sizes = rows.dropna(subset=["topic"]).groupby("topic")["partitions"].max().to_dict()
    held: dict[str, list] = {m: [] for m in sorted(wants)}
    free = {(t, p) for t, n in sizes.items() for p in range(n)}
    for member, topic, partition in sorted(zip(old["m"], old["t"], old["p"])):
        if (topic, partition) in free and topic in wants.get(member, ()):
            held[member].append((topic, partition))
            free.remove((topic, partition))
    for topic, partition in sorted(free):
        able = [m for m in held if topic in wants[m]]
        held[min(able, key=lambda m: (len(held[m]), m))].append((topic, partition))
    moved = True
    while moved:
        moved = False
        for giver in sorted(held, key=lambda m: (-len(held[m]), m)):
            for tp in sorted(held[giver], reverse=True):
                able = [m for m in held if m != giver and tp[0] in wants[m] and len(held[m]) + 1 < len(held[giver])]
                if able:
                    held[giver].remove(tp)
                    held[min(able, key=lambda m: (len(held[m]), m))].append(tp)
                    moved = True
                    break
            if moved:
                break
    out = [(rows["group_id"].iloc[0], m, t, p) for m in held for t, p in sorted(held[m])]
    return pd.DataFrame(out, columns=columns)
