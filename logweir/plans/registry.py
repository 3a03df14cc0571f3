"""Named queries over the event log and their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import parsing
from logweir.functions.routing import murmur2
from logweir.operators import admin, groups, offsets, outbox, producer, txn
from logweir.plans import inputs, oracles
from logweir.sources.log import (
    KEYS, built_log, event_log, event_records, register_views, shared_folder, table, topics, with_partitions,
)
from logweir.streaming import flows

OnLog = Callable[[SparkSession, str, DataFrame], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]


def _on_log(f: OnLog) -> Query:
    return lambda spark, sf_dir: f(spark, sf_dir, event_log(spark, sf_dir))


FETCHED = [*KEYS, "partition_offset", "key", "value", "timestamp_ms", "bytes"]
START, BUDGET = 20, 4000


def _fetch(committed: bool) -> Query:
    return _on_log(lambda s, d, log: offsets.with_time(offsets.fetch(log, START, BUDGET, committed)).select(*FETCHED))


def _marks(*columns: str) -> Query:
    return _on_log(lambda s, d, log: offsets.watermarks(log).select(*KEYS, *columns))


def _cleaned(log: DataFrame) -> DataFrame:
    return txn.without_aborted(log, inputs.AS_OF_MS)


def _fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    members = inputs.members(spark, sf_dir, False)
    own = members.groupBy("group_id").agg(F.lit(3).alias("generation")).withColumn(
        "state", F.when(F.col("group_id") == "group-2", "PreparingRebalance").otherwise("Stable")
    )
    requests = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("group-"), (k % 9).cast("string")).alias("group_id"),
        F.concat(F.lit("m-"), F.lpad((k + k % 2 * 7).cast("string"), 8, "0")).alias("member_id"),
        F.when(k % 5 == 0, -1).when(k % 5 == 1, 2).otherwise(3).alias("generation"),
        k.alias("request"),
    )
    return groups.commit_fence(requests, own, members).select("request", "group_id", "member_id", "error_code")


def _sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = inputs.members(spark, sf_dir, True)
    before = groups.assign_range(members.filter("member_id NOT LIKE '%3'"), topics(spark))
    return groups.assign_sticky(members, topics(spark), before)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("..")).otherwise(F.col("p_name")).alias("name"))
    return named.select("p_partkey", "name", admin.valid_name(F.col("name")).alias("valid"))


def _create(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").select(
        F.when(F.col("n_nationkey") % 6 == 0, "view").otherwise(F.concat_ws("-", F.lit("topic"), F.col("n_nationkey").cast("string"))).alias("topic"),
        (F.col("n_nationkey") % 9).alias("new_partitions"),
    )
    return admin.create_partitions(wanted, topics(spark))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda n, v: F.struct(n.alias("name"), v.cast("binary").alias("value"))
    pairs = F.array(pair(F.lit("type"), F.col("event_type")), pair(F.lit("props"), F.col("props")), pair(F.lit("type"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", admin.headers_json(pairs).alias("headers"))


def _committed_txn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    events = inputs.txn_events(spark, sf_dir)
    pending = log.filter("key IS NULL").join(
        events.select("txn_id", F.col("seq").alias("global_offset")), "global_offset"
    ).select("txn_id", F.lit("group-1").alias("group_id"), *KEYS, (F.col("partition_offset") + 1).alias("committed_offset"), F.col("global_offset").alias("seq"))
    return txn.commit_offsets(inputs.commits(log), pending, txn.latest_state(events))


def _timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.txn_events(spark, sf_dir)
    states = txn.latest_state(events)
    limits = states.select("txn_id", ((F.length("txn_id") - 4) * 3_600_000).cast("long").alias("timeout_ms"))
    return txn.timed_out(states, limits, events.agg(F.max("at_ms")).scalar())


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request"), F.concat(F.lit("txn-"), (F.col("user_id") % 25).cast("string")).alias("txn_id"), (F.col("event_id") % 120).alias("producer_epoch")
    )
    return txn.validate(asked, txn.latest_state(inputs.txn_events(spark, sf_dir))).select("request", "error_code")


def _begun(continuing: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        states = txn.latest_state(inputs.txn_events(spark, sf_dir))
        found = txn.begun(inputs.begin_requests(spark, sf_dir, states), states, continuing)
        return found.select("txn_id", "error_code", "state", "started_ms")

    return run


def _reconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.txn_events(spark, sf_dir)
    views = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("seq"))
    return txn.reconnected(events, events.join(views, "seq", "left_semi"), 3)


def _enqueued_at_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    fates = txn.visibility(inputs.txn_events(spark, sf_dir)).select(F.col("seq").alias("global_offset"), "txn_state")
    return outbox.enqueue_at_commit(log, fates, inputs.config(spark), inputs.outbox(log.filter("key IS NULL")))


def _produced(spark: SparkSession, sf_dir: str, log: DataFrame) -> DataFrame:
    producers = spark.createDataFrame([(i, i % 3) for i in range(4)], "producer_id long, producer_epoch int")
    sent = inputs.batches(log).withColumn("producer_epoch", F.lit(0))
    return producer.produced(sent, producers).select("arrival", "error_code", "stored")


def _due(spark: SparkSession, sf_dir: str, log: DataFrame) -> DataFrame:
    kept = log.filter("key IS NULL OR key <> ''")
    batch = outbox.due(inputs.outbox(log), kept, inputs.AS_OF_MS).select(*outbox.ID, "retry_count")
    return outbox.payloads(batch, kept, inputs.config(spark), topics(spark))


def _dead(log: DataFrame) -> DataFrame:
    return outbox.dead_letters(inputs.outbox(log))


def _times(spark: SparkSession, log: DataFrame) -> DataFrame:
    return offsets.offset_for_time(log, spark.createDataFrame([(p,) for p in inputs.PROBES], "probe_ms long"))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    register_views(spark, {"event_log": log, "log_topics": topics(spark), "log_commits": groups.committed(inputs.commits(log))})
    return spark.sql(
        "SELECT t.topic, count(*) AS n, max(murmur2(CAST(key AS BINARY))) AS top_hash, any_value(n_commits) AS n_commits "
        "FROM event_log JOIN log_topics t USING (topic_id) "
        "LEFT JOIN (SELECT topic_id, count(*) AS n_commits FROM log_commits GROUP BY topic_id) USING (topic_id) GROUP BY t.topic, t.topic_id"
    )


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    said = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        parsing.one_of(said("GZIP", "Snappy", "lz4", "ZSTD", "brotli", None), parsing.CODECS).alias("codec"),
        parsing.one_of(said("Shadow", "other", "LOCAL_ONLY"), parsing.MODES).alias("mode"),
        parsing.one_of(said("SYNC", "async", ""), parsing.SYNC_MODES).alias("sync_mode"),
        parsing.one_of(said("External_Only", "dual_write", "x"), parsing.WRITE_MODES).alias("write_mode"),
        parsing.isolation(k % 3).alias("isolation"),
    )


def _request_sizes(spark: SparkSession, sf_dir: str, log: DataFrame) -> DataFrame:
    size = admin.record_size(F.col("key"), F.col("value"), F.create_map(F.lit("t"), F.col("topic")))
    return admin.request_sizes(log.select(F.expr("global_offset div 100").alias("request"), "topic", "partition_id", size.alias("size")))


def _topic_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.when(k % 6 == 0, "view").when(k % 7 == 0, "..").otherwise(F.concat(F.lit("topic-"), (k % 10).cast("string")))
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("request"), name.alias("topic"), (k % 5 - 1).cast("int").alias("partitions"))


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.get(F.array(*[F.lit(t) for t in ("click", "view", "signup", "nowhere")]), (k % 4).cast("int"))
    wanted = table(spark, sf_dir, "nation").select(name.alias("topic"), (k % 9).cast("int").alias("new_partitions"))
    return admin.with_partition_counts(topics(spark), wanted)


def _by_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = inputs.members(spark, sf_dir, False)
    names = F.array(*[F.lit(p) for p in ("Range", "roundrobin", "cooperative-sticky", "unknown")])
    protocols = members.select("group_id").distinct().withColumn("protocol", F.get(names, F.regexp_extract("group_id", r"group-(\d+)", 1).cast("int") % 4))
    none = spark.createDataFrame([], "group_id string, member_id string, topic string, partition_id int")
    return groups.assign(members, topics(spark), none, protocols)


def _unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = inputs.members(spark, sf_dir, True)
    held = groups.assign_range(members, topics(spark)).filter("member_id NOT LIKE '%3'")
    return groups.unassigned(members, topics(spark), held)


def _txn_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = event_records(spark, sf_dir).filter("topic = 'view'").drop("producer_id", "producer_epoch", "txn_state")
    made = offsets.append(offsets.transactional(again, 7, 1), offsets.counters(event_log(spark, sf_dir)))
    return made.select("global_offset", *KEYS, "partition_offset", "producer_id", "producer_epoch", "txn_state")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    events = inputs.txn_events(spark, sf_dir)
    live = events.groupBy((F.col("user_id") % 5).alias("producer_id")).agg(F.max("at_ms").alias("last_active_ms"))
    return admin.metrics_overview(
        log, topics(spark), inputs.members(spark, sf_dir, True), groups.committed(inputs.commits(log)), live,
        txn.latest_state(events), inputs.outbox(log), inputs.AS_OF_MS,
    )


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return outbox.status(topics(spark), inputs.config(spark), outbox.metrics(inputs.outbox(log)), log)


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return outbox.readable(offsets.watermarks(log), inputs.config(spark), _dead(log), True)


#: Micro-batches of the streamed queries: the input is written as so many files and taken one by one.
BATCHES = 4


def _streamed(kind: str) -> Query:
    """A flow over the log's records, run to the end of its input in several micro-batches and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        top = os.path.join(shared_folder(spark), f"logweir-{kind}-{spark.range(1).select(F.uuid()).first()[0]}")
        log = None if kind in ("append", "sessions") else event_log(spark, sf_dir)  # these two do not read it
        made = {
            "append": lambda: event_records(spark, sf_dir),
            "dedup": lambda: inputs.batches(log),
            "sessions": lambda: inputs.members(spark, sf_dir, False).select("group_id", "member_id", F.col("heartbeat_ms").alias("at_ms"), "timeout_ms"),
        }
        rows = made.get(kind, lambda: log)()
        order = {"dedup": "arrival", "sessions": "at_ms"}.get(kind, "global_offset")
        low, high = rows.agg(F.min(order), F.max(order)).first()
        part = F.floor((F.col(order) - low) * BATCHES / (high - low + 1))
        for i in range(BATCHES):  # one after the other, as files are taken by their times
            rows.filter(part == i).coalesce(1).write.mode("append").parquet(f"{top}/in")
        incoming = flows.stream(spark, f"{top}/in", rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
        if kind == "append":
            flows.append_offsets(incoming, f"{top}/log", f"{top}/state").awaitTermination()
            return spark.read.parquet(f"{top}/log").select(*KEYS, "global_offset", "partition_offset")
        if kind in ("transform", "commits"):
            upper = lambda df: df.select(F.lit(9).alias("topic_id"), "partition_id", "global_offset", F.upper("value").alias("value"))
            flows.transformed(incoming, upper, "copier", f"{top}/log", f"{top}/state").awaitTermination()
            if kind == "commits":
                return groups.committed(spark.read.parquet(f"{top}/log/_commits"))
            return spark.read.parquet(f"{top}/log").select(*KEYS, "global_offset", "partition_offset", "value")
        by_batch = lambda b, i: b.write.mode("overwrite").parquet(f"{top}/out/batch={i}")
        if kind == "forward":
            out = flows.forward_stream(incoming, 50).select(*KEYS, "partition_offset").writeStream.format("parquet").option("path", f"{top}/out")
        elif kind == "dedup":
            out = flows.deduplicated(incoming).writeStream.foreachBatch(by_batch)
        elif kind == "sessions":
            out = flows.expired_sessions(incoming).writeStream.foreachBatch(by_batch)
        elif kind == "windows":
            out = flows.windowed_counts(incoming).writeStream.outputMode("append").foreachBatch(by_batch)
        else:
            out = flows.watermark_stream(incoming).writeStream.outputMode("complete").foreachBatch(
                lambda b, i: b.write.mode("overwrite").parquet(f"{top}/out")
            )
        out.option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(f"{top}/out")
        if kind == "lag":
            return groups.lag(groups.committed(inputs.commits(log)), found)
        if kind == "windows":
            return found.select(F.unix_millis("window.start").alias("start_ms"), "topic_id", "n")
        return found.drop("batch")

    return run


QUERIES: dict[str, Query] = {
    "log_ingest": built_log,
    "log_scan": _on_log(lambda s, d, log: log),
    "txn_append": _txn_append,
    "consume_from_committed": _on_log(lambda s, d, log: groups.unread(offsets.visible(log, True), groups.committed(inputs.commits(log))).select("group_id", *KEYS, "partition_offset")),
    "group_positions": _on_log(lambda s, d, log: groups.positions(groups.committed(inputs.commits(log.filter("txn_state = 'pending'"))), admin.partition_metadata(topics(s)), "group-2")),
    "pending_exists": _on_log(lambda s, d, log: offsets.pending_exists(admin.partition_metadata(topics(s)), log)),
    "value_text": _on_log(lambda s, d, log: log.select("global_offset", parsing.to_text(parsing.to_bytes(F.col("value"))).alias("value"), F.octet_length(parsing.to_bytes(F.col("value"))).alias("n_bytes"))),
    "sql_views": _views,
    "setting_parse": _parsed,
    "request_sizes": _on_log(_request_sizes),
    "partition_route": lambda s, d: event_records(s, d).select("global_offset", "key", murmur2(F.col("key")).alias("hash"), "partition_id"),
    "key_distribution": _on_log(lambda s, d, log: admin.row_distinct(log)),
    "read_committed_fetch": _fetch(True),
    "read_uncommitted_fetch": _fetch(False),
    "high_watermark": _marks("high_watermark"),
    "earliest_offset": _marks("earliest_offset"),
    "last_stable_offset": _marks("last_stable_offset"),
    "offset_for_timestamp": _on_log(lambda s, d, log: _times(s, log)),
    "offset_gaps": _on_log(lambda s, d, log: offsets.gaps(_cleaned(log))),
    "offset_boundaries": _on_log(lambda s, d, log: log.groupBy(*KEYS).agg(F.min("partition_offset").alias("low"), (F.max("partition_offset") + 1).alias("high"))),
    "offset_arrays": _on_log(lambda s, d, log: log.filter("txn_state = 'pending'").groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list("partition_offset")), ",").alias("pending"))),
    "global_order_scan": _on_log(lambda s, d, log: log.filter("global_offset > 500").select("global_offset", *KEYS, "partition_offset").orderBy("global_offset")),
    "topic_metadata": _on_log(lambda s, d, log: with_partitions(topics(s), log)),
    "partition_metadata": lambda s, d: admin.partition_metadata(topics(s)),
    "committed_offsets": _on_log(lambda s, d, log: groups.committed(inputs.commits(log))),
    "fetch_all_offsets": _on_log(lambda s, d, log: groups.committed(inputs.commits(log)).filter("group_id = 'group-1'").join(topics(s), "topic_id").select("topic", "partition_id", "committed_offset").orderBy("topic", "partition_id")),
    "consumer_lag": _on_log(lambda s, d, log: groups.lag(groups.committed(inputs.commits(log)), offsets.watermarks(log))),
    "uncommitted_partitions": _on_log(lambda s, d, log: admin.partition_metadata(topics(s)).join(groups.committed(inputs.commits(log.filter("txn_state = 'pending'"))).filter("group_id = 'group-2'"), KEYS, "left_anti")),
    "commit_fence": _fence,
    "delete_group_offsets": _on_log(lambda s, d, log: groups.committed(inputs.commits(log), s.createDataFrame([("group-1",)], "group_id string"))),
    "expired_members": lambda s, d: groups.expired_members(inputs.members(s, d, True), inputs.AS_OF_MS).select("group_id", "member_id"),
    "live_groups": lambda s, d: groups.live_groups(inputs.members(s, d, True), inputs.AS_OF_MS),
    "preferred_protocol": lambda s, d: groups.preferred_protocol(inputs.members(s, d, True)),
    "assign_by_protocol": _by_protocol,
    "unassigned_partitions": _unassigned,
    "assign_range": lambda s, d: groups.assign_range(inputs.members(s, d, True), topics(s)),
    "assign_roundrobin": lambda s, d: groups.assign_roundrobin(inputs.members(s, d, False), topics(s)),
    "assign_roundrobin_mixed": lambda s, d: groups.assign_roundrobin(inputs.members(s, d, True), topics(s)),
    "assign_sticky": _sticky,
    "common_protocol": lambda s, d: groups.common_protocol(inputs.members(s, d, True)),
    "sequence_validate": _on_log(lambda s, d, log: producer.sequence_outcomes(inputs.batches(log))),
    "dedup_log": _on_log(lambda s, d, log: producer.deduplicated(inputs.batches(log)).select("producer_id", *KEYS, "base_sequence")),
    "next_sequence": _on_log(lambda s, d, log: producer.next_sequence(producer.sequence_outcomes(inputs.batches(log)))),
    "epoch_fence": _on_log(lambda s, d, log: producer.epoch_fence(log.select("global_offset", F.col("producer_id"), (F.col("global_offset") % 3).cast("int").alias("producer_epoch")), s.createDataFrame([(i, i % 3) for i in range(4)], "producer_id long, producer_epoch int")).select("global_offset", "error_code")),
    "produce_checked": _on_log(_produced),
    "producer_reconnect": _reconnected,
    "txn_validate": _validated,
    "txn_begin": _begun(False),
    "txn_begin_or_continue": _begun(True),
    "txn_latest_state": lambda s, d: txn.latest_state(inputs.txn_events(s, d)),
    "txn_visibility": lambda s, d: txn.visibility(inputs.txn_events(s, d)),
    "txn_pending_offsets_commit": _committed_txn_offsets,
    "txn_timeouts": _timeouts,
    "aborted_cleanup": _on_log(lambda s, d, log: _cleaned(log).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))),
    "hwm_after_cleanup": _on_log(lambda s, d, log: offsets.watermarks(_cleaned(log).filter("topic_id <> 4"), offsets.counters(log)).select(*KEYS, "high_watermark", "earliest_offset")),
    "forward_sample_10": _on_log(lambda s, d, log: inputs.samples(log, 10)),
    "forward_sample_50": _on_log(lambda s, d, log: inputs.samples(log, 50)),
    "forward_sample_90": _on_log(lambda s, d, log: inputs.samples(log, 90)),
    "outbox_enqueue": _on_log(lambda s, d, log: outbox.enqueue(log, inputs.config(s), inputs.outbox(log.filter("key IS NULL")))),
    "outbox_enqueue_at_commit": _enqueued_at_commit,
    "outbox_acknowledged": _on_log(lambda s, d, log: outbox.acknowledged(inputs.outbox(log), inputs.acks(inputs.outbox(log))).select(*outbox.ID, "external_offset", "error")),
    "forward_config": lambda s, d: outbox.loaded(inputs.config(s), topics(s)).select("topic_id", "topic", "mode", "write_mode", "percent", "target", "forwards"),
    "forward_decisions": _on_log(lambda s, d, log: outbox.decisions(log, inputs.config(s))),
    "forward_lag_by_partition": _on_log(lambda s, d, log: outbox.lag_by_partition(log, outbox.metrics(inputs.outbox(log)))),
    "outbox_due": _on_log(_due),
    "outbox_dead_letters": _on_log(lambda s, d, log: outbox.dead_letters(inputs.outbox(log)).select(*outbox.ID)),
    "forward_metrics": _on_log(lambda s, d, log: outbox.metrics(inputs.outbox(log))),
    "topic_forward_status": _status,
    "replay_range": _on_log(lambda s, d, log: outbox.replay(log, inputs.outbox(log), 1, 10, 40).select(*outbox.ID, "external_offset", "retry_count")),
    "external_primary_reads": _external,
    "external_primary_lenient": _on_log(lambda s, d, log: outbox.readable(offsets.watermarks(log), inputs.config(s), _dead(log), False)),
    "external_primary_fetch": _on_log(lambda s, d, log: outbox.readable_rows(offsets.fetch(log, START, BUDGET), inputs.config(s), _dead(log), False).select(*KEYS, "partition_offset", "bytes")),
    "external_primary_times": _on_log(lambda s, d, log: outbox.readable_times(_times(s, log), inputs.config(s), _dead(log), True)),
    "metrics_overview": _metrics,
    "bytes_per_topic": _on_log(lambda s, d, log: admin.bytes_per_topic(log)),
    "record_size_estimate": _on_log(lambda s, d, log: log.select("global_offset", admin.record_size(F.col("key"), F.col("value"), F.create_map(F.lit("t"), F.col("topic"))).alias("size"))),
    "topic_name_validate": _names,
    "create_partitions_check": _create,
    "create_topics": lambda s, d: admin.create_topics(_topic_requests(s, d), topics(s)),
    "get_or_create_topics": lambda s, d: admin.get_or_create_topics(_topic_requests(s, d).filter("topic <> '..'"), topics(s), 4).select("topic", "partitions", (F.col("topic_id") > 5).alias("fresh")),
    "topic_lookup": lambda s, d: admin.topic_lookup(_topic_requests(s, d).select("request", "topic"), topics(s)),
    "topic_partition_growth": _grown,
    "delete_topic_cascade": _on_log(lambda s, d, log: admin.delete_topics(log, s.createDataFrame([(2,), (5,)], "topic_id int")).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))),
    "headers_json": _headers,
    "nearest_rank_percentiles": lambda s, d: admin.nearest_rank(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (50, 95, 99)),
    "stream_append_offsets": _streamed("append"),
    "stream_dedup": _streamed("dedup"),
    "stream_lag": _streamed("lag"),
    "stream_forward": _streamed("forward"),
    "stream_transform": _streamed("transform"),
    "stream_commits": _streamed("commits"),
    "stream_sessions": _streamed("sessions"),
    "stream_windows": _streamed("windows"),
}
ORACLES: dict[str, str] = oracles.ORACLES
