import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from logweir.functions.ordering import numbered
from logweir.functions.routing import forwarded, murmur2, partition_for
from logweir.operators import admin, groups, offsets, outbox, producer, txn
from logweir.operators.producer import DUPLICATE, INT_MAX, OUT_OF_ORDER, PROCEED, validate_sequence
from logweir.plans.registry import ORACLES, QUERIES
from logweir.sources.log import COLUMNS, KEYS, event_records, from_json, read_log, to_json, write_log
from logweir.streaming import flows

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def test_every_query_has_sql_but_the_fold():
    assert set(QUERIES) - set(ORACLES) == {"assign_sticky"}


def test_murmur2_vectors(spark):
    known = {"": 275646681, "a": 2731586172, "ab": 316155434, "abc": 479470107, "abcd": 2971317748, "21": 3321034988, "foobar": 3504634814}
    rows = spark.createDataFrame([(k, v) for k, v in known.items()] + [(None, None)], "k string, v long")
    assert rows.filter(~murmur2(F.col("k")).eqNullSafe(F.col("v"))).count() == 0


def test_partitions_and_sampling(spark):
    rows = spark.range(10_000).select(F.concat(F.lit("unique-key-"), F.col("id")).alias("k"), "id")
    counts = rows.groupBy(partition_for(F.col("k"), F.lit(10), F.col("id")).alias("p")).count().collect()
    assert len(counts) == 10 and all(500 <= r["count"] <= 1500 for r in counts)
    kept = rows.select(*[forwarded(F.col("k"), F.col("id"), F.lit(p)).alias(f"p{p}") for p in (0, 10, 50, 100)])
    r = kept.agg(*[F.count_if(c).alias(c) for c in kept.columns], F.count_if(F.col("p10") & ~F.col("p50")).alias("lost")).first()
    assert r["p0"] == 0 and r["p100"] == 10_000 and 900 < r["p10"] < 1100 and r["lost"] == 0


@pytest.mark.parametrize(
    "given,outcome,last",
    [
        ((-1, 0, 5), PROCEED, 4), ((4, 5, 3), PROCEED, 7), ((7, 5, 3), DUPLICATE, 7), ((7, 0, 5), DUPLICATE, 7), ((7, 7, 1), DUPLICATE, 7),
        ((7, 10, 3), OUT_OF_ORDER, 7), ((7, 5, 8), OUT_OF_ORDER, 7), ((7, 7, 2), OUT_OF_ORDER, 7), ((-1, -1, 1), OUT_OF_ORDER, -1),
        ((7, -5, 3), OUT_OF_ORDER, 7), ((7, 8, -1), OUT_OF_ORDER, 7), ((INT_MAX, INT_MAX, 1), DUPLICATE, INT_MAX), ((INT_MAX - 1, INT_MAX, 2), OUT_OF_ORDER, INT_MAX - 1),
    ],
)
def test_sequences(given, outcome, last):
    assert validate_sequence(*given) == (outcome, last)


def test_murmur2_over_lengths(spark):
    """Against a plain fold over one key at a time."""

    def plain(data):
        m, mask = 0x5BD1E995, 0xFFFFFFFF
        h = (0x9747B28C ^ len(data)) & mask
        for i in range(0, len(data) - len(data) % 4, 4):
            k = int.from_bytes(data[i : i + 4], "little") * m & mask
            h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
        if tail := data[len(data) - len(data) % 4 :]:
            h = (h ^ int.from_bytes(tail, "little")) * m & mask
        h = (h ^ h >> 13) * m & mask
        return h ^ h >> 15

    rng = random.Random(2)
    keys = [rng.randbytes(rng.randrange(40)) for _ in range(500)] + [rng.randbytes(5000), b"", None]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    got = [r["h"] for r in df.select(murmur2(F.col("k")).alias("h")).collect()]
    assert got == [None if k is None else plain(k) for k in keys]


def test_explicit_partitions(spark):
    rows = spark.createDataFrame([("k", 4, 9), ("k", 0, None), ("k", -2, None), ("k", 4, -1)], "k string, n int, p int")
    got = [r["x"] for r in rows.select(partition_for(F.col("k"), F.col("n"), F.lit(0), F.col("p")).alias("x")).collect()]
    assert got[:3] == [9, 0, 0] and 0 <= got[3] < 4


def test_numbering_two_keys_at_once(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice("xyz"), i) for i in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "k string, p string, o long")
    got = numbered(df, "o", {"n": ["k"], "m": ["p", "k"]}, slice_width=50).collect()
    assert len(got) == len(rows)
    for out, key in (("n", lambda r: r["k"]), ("m", lambda r: (r["k"], r["p"]))):
        for k in {key(r) for r in got}:
            assert [r[out] for r in sorted(got, key=lambda r: r["o"]) if key(r) == k] == list(range(sum(key(r) == k for r in got)))


def test_gaps_over_slices(spark):
    log = spark.createDataFrame([(1, 0, o) for o in (0, 1, 4, 9, 10, 25, 60)], "topic_id int, partition_id int, partition_offset long")
    got = sorted((r["from_offset"], r["missing"]) for r in offsets.gaps(log, 10).collect())
    assert got == [(2, 2), (5, 4), (11, 14), (26, 34)]


@pytest.mark.parametrize("codec", ["none", "GZIP", "snappy", "lz4", "zstd", "brotli"])
def test_log_round_trip_by_codec(spark, tmp_path, codec):
    rows = event_records(spark, SF).filter("global_offset < 200")
    log = numbered(rows, "global_offset", {"partition_offset": KEYS, "sequence": ["producer_id", *KEYS]}).select(*COLUMNS)
    write_log(log, str(tmp_path / "log"), codec)
    back = read_log(spark, str(tmp_path / "log"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, log.collect()))
    assert sorted(map(repr, from_json(to_json(log)).collect())) == sorted(map(repr, log.collect()))


def test_appending_restarts(spark, tmp_path):
    """Four files, then two more: offsets go on from the stored counters, batch by batch."""
    at = lambda lo, hi: spark.range(lo, hi).select(F.lit(1).alias("topic_id"), (F.col("id") % 2).cast("int").alias("partition_id"), F.col("id").alias("global_offset"))
    schema = "topic_id int, partition_id int, global_offset long"
    for round_ in ((0, 40), (40, 60)):
        for lo in range(*round_, 10):
            at(lo, lo + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = flows.stream(spark, str(tmp_path / "in"), schema)
        flows.append_offsets(source, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len({r["batch"] for r in got}) == 6
    for p in (0, 1):
        own = sorted((r["global_offset"], r["partition_offset"]) for r in got if r["partition_id"] == p)
        assert [o for _, o in own] == list(range(30))


def test_sessions_against_a_plain_model(spark, tmp_path):
    """Changing timeouts, returns, late and unordered heartbeats over eight files; many members share a row of state."""
    rng, named = random.Random(9), [(f"g{i % 3}", f"m{i}") for i in range(2500)] + [(None, "m1"), ("g1", None)]
    files = [[(*rng.choice(named), 60_000 * b + rng.randrange(-90_000, 60_000), rng.choice((0, 20_000, 90_000, 200_000))) for _ in range(1500)] for b in range(2, 10)]
    files = [list({row[:3]: row for row in rows}.values()) for rows in files]
    held, expected, mark, late, most = {}, [], 0, 0, 0
    for rows in [*files, []]:
        beats = [row for row in rows if row[2] > late]  # Spark drops by the mark of the batch before
        for *name, at, limit in sorted(beats, key=lambda row: row[2]):
            last = held.get(tuple(name), (0, 0, 0))
            last = (at, limit) if at >= last[0] else last[:2]
            held[tuple(name)] = (*last, max(sum(last), mark + 1))
        most = max(most, len(held))
        for name in [n for n, (_, _, due) in held.items() if due < mark and n not in {row[:2] for row in beats}]:
            last, limit, _ = held.pop(name)
            expected.append((*name, last + limit))
        late, mark = mark, max([mark, *(row[2] - 1000 for row in rows)])
    schema = "group_id string, member_id string, at_ms long, timeout_ms long"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = flows.expired_sessions(flows.stream(spark, str(tmp_path / "in"), schema))
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == sorted(expected, key=repr) and {n for *ids, _ in got for n in ids} >= {None, "m1", "g1"} and len(got) > 2500
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 1024 < most


def test_transform_takes_effect_once(spark, tmp_path):
    """A batch that is run again, as after a crash, writes the same output, offsets and commits."""
    log = spark.createDataFrame([(1, 0, i, i, None) for i in range(6)], "topic_id int, partition_id int, partition_offset long, global_offset long, txn_state string")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    make = lambda df: df.select(F.lit(2).alias("topic_id"), "partition_id", "global_offset")
    for state in ("a", "b"):  # a lost checkpoint runs the batch of number 0 again
        source = flows.stream(spark, str(tmp_path / "in"), log.schema.simpleString()[7:-1].replace(":", " "))
        flows.transformed(source, make, "g", str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["partition_offset"] for r in got) == list(range(6))
    assert [r["committed_offset"] for r in spark.read.parquet(str(tmp_path / "out/_commits")).collect()] == [6]


def test_sticky_against_its_rules(spark):
    """Every partition once, to a subscriber; loads even; what was valid and not needed elsewhere stays."""
    rng = random.Random(6)
    names = [f"m{i}" for i in range(9)]
    all_topics = [("a", 7), ("b", 5), ("c", 6)]
    members = spark.createDataFrame([("g", m, ["a", "b", "c"]) for m in names], "group_id string, member_id string, topics array<string>")
    topics = spark.createDataFrame(all_topics, "topic string, partitions int")
    held = [("g", rng.choice(names[:6]), t, p) for t, n in all_topics for p in range(n)]
    before = spark.createDataFrame([*held, ("g", "gone", "a", 0)], "group_id string, member_id string, topic string, partition_id int")
    got = _assigned(groups.assign_sticky(members, topics, before))
    assert sorted((t, p) for (_, t), ps in got.items() for p in ps) == sorted((t, p) for t, n in all_topics for p in range(n))
    loads = [sum(len(ps) for (m, _), ps in got.items() if m == name) for name in names]
    assert max(loads) - min(loads) <= 1
    kept = sum(p in got.get((m, t), []) for _, m, t, p in held)
    assert kept >= sum(min(2, sum(m == h[1] for h in held)) for m in names)


def test_numbering_over_slices(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i * 7) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "k string, o long"), "o", {"n": ["k"]}, slice_width=100).collect()
    for key in "abc":
        own = sorted((r["o"], r["n"]) for r in got if r["k"] == key)
        assert [n for _, n in own] == list(range(len(own)))


LOG = "topic_id int, partition_id int, partition_offset long, key string, value string, timestamp_ms long, txn_state string"


def test_offsets_are_not_reused(spark):
    log = spark.createDataFrame([(1, 0, i, None, "v", -1, None) for i in range(3)], LOG)
    old = offsets.counters(log)
    tail_gone = log.filter("partition_offset < 2")
    assert offsets.watermarks(tail_gone, old).first()["high_watermark"] == 3
    more = spark.createDataFrame([(1, 0, 99)], "topic_id int, partition_id int, global_offset long")
    assert offsets.append(more, offsets.counters(tail_gone, old)).first()["partition_offset"] == 3


def test_pending_hides_later_rows_and_time_lookup(spark):
    t = 1_600_000_000_000
    log = spark.createDataFrame(
        [(1, 0, 0, None, "a", t, None), (1, 0, 1, None, "b", t + 1000, "pending"), (1, 0, 2, None, "c", t + 2000, None)], LOG
    )
    assert [r["partition_offset"] for r in offsets.fetch(log, 0, 4000).collect()] == [0]
    assert offsets.fetch(log, 0, 1, committed=False).count() == 1
    probes = spark.createDataFrame([(t + 1500,), (t - 1,), (t + 9000,)], "probe_ms long")
    assert {r["probe_ms"]: r["offset"] for r in offsets.offset_for_time(log, probes).collect()} == {t + 1500: 2, t - 1: 0, t + 9000: -1}


def _assigned(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["member_id"], r["topic"]), []).append(r["partition_id"])
    return {k: sorted(v) for k, v in out.items()}


def test_assignments(spark):
    members = spark.createDataFrame([("g", "m1", ["a"]), ("g", "m2", ["a", "b"])], "group_id string, member_id string, topics array<string>")
    topics = spark.createDataFrame([("a", 4), ("b", 4), ("c", 0)], "topic string, partitions int")
    assert _assigned(groups.assign_range(members, topics)) == {("m1", "a"): [0, 1], ("m2", "a"): [2, 3], ("m2", "b"): [0, 1, 2, 3]}
    assert _assigned(groups.assign_roundrobin(members, topics)) == {("m1", "a"): [0, 2], ("m2", "a"): [1, 3], ("m2", "b"): [0, 1, 2, 3]}
    only = members.withColumn("topics", F.array(F.lit("a")))
    before = spark.createDataFrame([("g", "m1", "a", p) for p in range(4)], "group_id string, member_id string, topic string, partition_id int")
    got = _assigned(groups.assign_sticky(only, topics, before))
    assert sorted(len(v) for v in got.values()) == [2, 2] and sorted(sum(got.values(), [])) == [0, 1, 2, 3]


def test_batches_fold_as_the_plain_model(spark):
    rng = random.Random(3)
    rows = [(k, 1, 0, i, rng.randrange(6), rng.randrange(1, 3)) for k in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "producer_id long, topic_id int, partition_id int, arrival long, base_sequence long, n_records int")
    got = {(r["producer_id"], r["arrival"]): r["outcome"] for r in producer.sequence_outcomes(df).collect()}
    for k in range(4):
        last = -1
        for _, _, _, i, base, count in (r for r in rows if r[0] == k):
            outcome, last = validate_sequence(last, base, count)
            assert got[(k, i)] == outcome


def test_transactions_and_outbox(spark):
    events = spark.createDataFrame([("t", 0, "init", 0), ("t", 1, "begin", 10), ("t", 2, "abort", 20), ("t", 3, "begin", 30)], "txn_id string, seq long, action string, at_ms long")
    state = txn.latest_state(events).first()
    assert (state["state"], state["started_ms"], state["producer_epoch"]) == ("Ongoing", 30, 0)
    assert {r["seq"]: r["txn_state"] for r in txn.visibility(events).collect()} == {1: "aborted", 3: "pending"}
    log = spark.createDataFrame([(1, 0, 0, "k", "v", 1, None), (1, 0, 1, "k", "v", 1, "aborted")], LOG)
    empty = spark.createDataFrame([], "topic_id int, partition_id int, local_offset long, external_offset long, retry_count int")
    assert [r["local_offset"] for r in outbox.replay(log, empty, 1, 0, None).collect()] == [0]


def test_pending_offset_of_a_commits_seq(spark):
    """On an equal seq the group's own commit holds, in whatever order the rows come; else the later one."""
    offset = "group_id string, topic_id int, partition_id int, committed_offset long, seq long"
    own = [("g", 1, p, 10, 5) for p in range(4)]
    moves = [("t", "g", 1, 0, 12, 5), ("t", "g", 1, 1, 12, 6), ("t", "g", 1, 2, 12, 4), ("open", "g", 1, 3, 12, 6), ("t", "g", 1, 4, 12, 5)]
    states = spark.createDataFrame([("t", "CompleteCommit"), ("open", "Ongoing")], "txn_id string, state string")
    pending = spark.createDataFrame(moves, f"txn_id string, {offset}")
    for rows in (own, own[::-1]):
        got = txn.commit_offsets(spark.createDataFrame(rows, offset), pending, states).collect()
        assert {r["partition_id"]: r["committed_offset"] for r in got} == {0: 10, 1: 12, 2: 10, 3: 10, 4: 12}


def test_nearest_rank_against_sorting(spark):
    rng = random.Random(8)
    rows = [("a", rng.choice((-1, 1)) * rng.lognormvariate(0, 3)) for _ in range(700)] + [("b", float(i % 3)) for i in range(200)] + [("c", 0.0), ("c", None), ("d", -5.0)]
    got = {r["k"]: r for r in admin.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", (0, 1, 50, 95, 100)).collect()}
    for k in "abcd":
        own = sorted(v for g, v in rows if g == k and v is not None)
        for p in (0, 1, 50, 95, 100):
            assert got[k][f"p{p}"] == own[max(-(-len(own) * p // 100), 1) - 1]


def test_topic_names_and_creation(spark):
    topics = spark.createDataFrame([(1, "view", 4)], "topic_id int, topic string, partitions int")
    wanted = spark.createDataFrame([(1, "view", 1), (2, "..", 1), (3, "new", 0), (4, "new", 3), (5, "other", 2)], "request long, topic string, partitions int")
    got = {r["request"]: (r["error_code"], r["topic_id"], r["partitions"]) for r in admin.create_topics(wanted, topics).collect()}
    assert got == {1: (36, None, 1), 2: (17, None, 1), 3: (0, 2, 1), 4: (36, None, 3), 5: (0, 3, 2)}
    made = admin.get_or_create_topics(wanted.filter("topic <> '..'"), topics, 7).collect()
    assert {(r["topic"], r["partitions"]) for r in made} == {("view", 4), ("new", 7), ("other", 7)} and len({r["topic_id"] for r in made}) == 3
