"""DuckDB SQL that gives the rows of the registered queries from the same tables."""

from __future__ import annotations

from logweir.functions.routing import MASK, SEED, M

AS_OF_MS = 1_706_659_200_000
_byte = lambda i: f"ord(substr(key, ({i} + 1)::INT, 1))::BIGINT"
_word = f"({_byte('4 * j')} + ({_byte('4 * j + 1')} << 8) + ({_byte('4 * j + 2')} << 16) + ({_byte('4 * j + 3')} << 24))"
_mul = lambda x: f"(({x}) * {M}::BIGINT & {MASK}::BIGINT)"
_shift = lambda x, n: f"xor({x}, {x} >> {n})"

HASHED = f"""
e AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN '' ELSE 'user-' || user_id END AS key FROM events),
h0 AS (SELECT *, length(key) AS n, list_reduce(list_prepend(xor({SEED}::BIGINT, length(key)),
         list_transform(range(0, length(key) // 4), lambda j: {_mul(_shift(_mul(_word), 24))})),
         lambda h, x: xor({_mul('h')}, x)) AS h FROM e),
h1 AS (SELECT *, CASE n % 4 WHEN 0 THEN h WHEN 1 THEN {_mul(f"xor(h, {_byte('n - 1')})")}
         WHEN 2 THEN {_mul(f"xor(h, {_byte('n - 2')} + ({_byte('n - 1')} << 8))")}
         ELSE {_mul(f"xor(h, {_byte('n - 3')} + ({_byte('n - 2')} << 8) + ({_byte('n - 1')} << 16))")} END AS g FROM h0),
h2 AS (SELECT *, {_mul(_shift('g', 13))} AS f FROM h1),
h3 AS (SELECT *, {_shift('f', 15)} AS hash FROM h2)"""

LOG = f"""WITH {HASHED},
r AS (SELECT list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::INT AS topic_id, event_type AS topic,
             (CASE WHEN key IS NULL THEN event_id % 4 ELSE (hash & 2147483647) % 4 END)::INT AS partition_id,
             event_id AS global_offset, key, props AS value,
             (CASE WHEN event_id % 50 = 0 THEN -1 ELSE (epoch_us(ts) // 1000) END)::BIGINT AS timestamp_ms,
             ts + INTERVAL 5 SECOND AS created_at, user_id % 5 AS producer_id, 0::INT AS producer_epoch,
             CASE WHEN event_id % 20 = 3 THEN 'aborted'
                  WHEN event_id > 0.95 * (SELECT max(event_id) FROM events) AND event_id % 97 = 0 THEN 'pending' END AS txn_state
      FROM h3),
log AS (SELECT *, row_number() OVER (PARTITION BY topic_id, partition_id ORDER BY global_offset) - 1 AS partition_offset,
               row_number() OVER (PARTITION BY producer_id, topic_id, partition_id ORDER BY global_offset) - 1 AS sequence FROM r),
topics AS (SELECT unnest([1, 2, 3, 4, 5])::INT AS topic_id, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS topic, 4::INT AS partitions),
marks AS (SELECT topic_id, partition_id, max(partition_offset) + 1 AS high_watermark, min(partition_offset) AS earliest_offset,
                 coalesce(min(partition_offset) FILTER (txn_state = 'pending'), max(partition_offset) + 1) AS last_stable_offset
          FROM log GROUP BY ALL),
commits AS (SELECT 'group-' || (producer_id % 3) AS group_id, topic_id, partition_id, greatest(partition_offset + 1 - length(value) % 3, 0) AS committed_offset,
                   global_offset AS seq FROM log),
committed AS (SELECT group_id, topic_id, partition_id, arg_max(committed_offset, seq) AS committed_offset FROM commits GROUP BY ALL),
clean AS (SELECT * FROM log WHERE NOT (txn_state IS NOT DISTINCT FROM 'aborted' AND (epoch_us(created_at) // 1000) < {AS_OF_MS})),
batches AS (SELECT producer_id, topic_id, partition_id, 3 * global_offset AS arrival, sequence AS base_sequence, 'proceed' AS outcome, sequence AS expected FROM log
            UNION ALL SELECT producer_id, topic_id, partition_id, 3 * global_offset + 1, sequence, 'duplicate', sequence + 1 FROM log WHERE global_offset % 11 = 0
            UNION ALL SELECT producer_id, topic_id, partition_id, 3 * global_offset - 1, sequence + 7, 'out_of_order', sequence FROM log WHERE global_offset % 13 = 0),
config AS (SELECT * FROM (VALUES (1, 'shadow', 50, 'dual_write', NULL, 50), (2, 'shadow', 10, 'external_only', 'errors-out', 100), (3, 'shadow', 25, 'dual_write', NULL, 25),
           (4, 'local', 90, 'dual_write', NULL, 0), (5, 'shadow', 0, 'external_only', NULL, 100)) AS t(topic_id, mode, forward_percentage, write_mode, external_topic_name, percent)),
bucketed AS (SELECT log.*, CASE WHEN log.key IS NULL OR log.key = '' THEN partition_offset % 100 ELSE hash % 100 END AS bucket
             FROM log JOIN h3 ON h3.event_id = global_offset),
outbox AS (SELECT topic_id, partition_id, partition_offset AS local_offset,
                  CASE WHEN global_offset % 4 = 0 THEN global_offset + 1000000 END AS external_offset, (global_offset % 13)::INT AS retry_count,
                  CASE WHEN global_offset % 3 <> 0 THEN {AS_OF_MS} - (global_offset % 10) * 1000 END AS attempted_ms,
                  CASE WHEN global_offset % 4 <> 0 AND global_offset % 5 = 0 THEN 'timed out' END AS error, global_offset
           FROM log WHERE topic_id <= 3 AND txn_state IS NULL),
tx AS (SELECT 'txn-' || (user_id % 20) AS txn_id, event_id AS seq, (epoch_us(ts) // 1000) AS at_ms, user_id,
              CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'abort' WHEN 'signup' THEN 'init' ELSE 'begin' END AS action FROM events),
states AS (SELECT t.txn_id, CASE arg_max(action, seq) WHEN 'init' THEN 'Empty' WHEN 'begin' THEN 'Ongoing' WHEN 'commit' THEN 'CompleteCommit' ELSE 'CompleteAbort' END AS state,
                  min(at_ms) FILTER (action = 'begin' AND seq > coalesce(ended, -1)) AS started_ms,
                  greatest(count(*) FILTER (action = 'init') - 1, 0) AS producer_epoch
           FROM tx t LEFT JOIN (SELECT txn_id, max(seq) AS ended FROM tx WHERE action <> 'begin' GROUP BY 1) USING (txn_id) GROUP BY 1),
fates AS (SELECT t.*, (SELECT arg_min(u.action, u.seq) FROM tx u WHERE u.txn_id = t.txn_id AND u.seq > t.seq AND u.action <> 'begin') AS fate FROM tx t WHERE action = 'begin'),
times AS (SELECT m.topic_id, m.partition_id, p.probe_ms, coalesce(min(o), -1) AS "offset", coalesce(arg_min(t, o), -1) AS timestamp_ms
      FROM (SELECT m.topic_id, m.partition_id, p.probe_ms, l.partition_offset AS o, l.timestamp_ms AS t FROM marks m
            CROSS JOIN (SELECT unnest([0, 1704500000000, 1705300000000, 1706000000000, 1800000000000]) AS probe_ms) p
            LEFT JOIN log l ON l.topic_id = m.topic_id AND l.partition_id = m.partition_id AND l.txn_state IS NULL AND l.timestamp_ms >= 0 AND l.timestamp_ms >= p.probe_ms) m
      JOIN (SELECT unnest([0, 1704500000000, 1705300000000, 1706000000000, 1800000000000]) AS probe_ms) p USING (probe_ms) GROUP BY ALL),
parts AS (SELECT topic_id, topic, unnest(range(0, 4))::INT AS partition_id FROM topics),
members AS (SELECT s_suppkey AS k, 'group-' || (s_suppkey % 7) || CASE WHEN s_suppkey >= 4900 THEN '-' || (s_suppkey // 4900) ELSE '' END AS group_id,
                   'm-' || lpad(s_suppkey::VARCHAR, 8, '0') AS member_id FROM supplier)
"""
_VISIBLE = """, vis AS (SELECT l.* FROM log l JOIN (SELECT topic_id, partition_id, min(partition_offset) FILTER (txn_state = 'pending') AS p FROM log GROUP BY ALL)
  USING (topic_id, partition_id) WHERE txn_state IS NULL AND (p IS NULL OR partition_offset < p))"""
_FETCH = """, f AS (SELECT *, sum(coalesce(strlen(key), 0) + coalesce(strlen(value), 0) + 64) OVER w AS bytes, row_number() OVER w AS rn
  FROM {rows} WHERE partition_offset >= 20 WINDOW w AS (PARTITION BY topic_id, partition_id ORDER BY partition_offset))
SELECT topic_id, partition_id, partition_offset, key, value,
       CASE WHEN timestamp_ms >= 0 THEN timestamp_ms ELSE (epoch_us(created_at) // 1000) END AS timestamp_ms, bytes::BIGINT AS bytes
FROM f WHERE rn <= 10 AND (bytes <= 4000 OR rn = 1)"""
_mark = lambda c: f"SELECT topic_id, partition_id, {c} FROM marks"
_sampled = lambda n: f"SELECT topic_id, partition_id, partition_offset, key FROM bucketed WHERE bucket < {n}"
_RANGE = """, subs AS (SELECT group_id, member_id, t.topic FROM members, topics t
   WHERE k % 3 = 0 OR (k % 3 = 1 AND topic_id <= 3) OR (k % 3 = 2 AND topic_id >= 3)),
 x AS (SELECT *, row_number() OVER (PARTITION BY group_id, topic ORDER BY member_id) - 1 AS i, count(*) OVER (PARTITION BY group_id, topic) AS m FROM subs),
 y AS (SELECT *, i * (4 // m) + least(i, 4 % m) AS a, 4 // m + (i < 4 % m)::INT AS n FROM x)
SELECT group_id, member_id, topic, unnest(range(a, a + n))::INT AS partition_id FROM y"""
_ROUND = """, x AS (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS m FROM members),
 p AS (SELECT topic, partition_id, row_number() OVER (ORDER BY topic, partition_id) - 1 AS j FROM parts)
SELECT group_id, member_id, topic, partition_id FROM x JOIN p ON j % m = i"""
#: A pointer walks the ring of members, group by group, and skips those without the partition's topic.
_ROUND_MIXED = """, ring AS (SELECT group_id, member_id, k, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS m FROM members),
 subs AS (SELECT r.*, t.topic FROM ring r, topics t WHERE k % 3 = 0 OR (k % 3 = 1 AND topic_id <= 3) OR (k % 3 = 2 AND topic_id >= 3)),
 p AS (SELECT g.group_id, topic, partition_id, row_number() OVER (PARTITION BY g.group_id ORDER BY topic, partition_id) - 1 AS j
       FROM parts JOIN (SELECT DISTINCT group_id, topic FROM subs) g USING (topic)),
 walk AS (SELECT DISTINCT group_id, -1::BIGINT AS j, -1::BIGINT AS at FROM members
          UNION ALL
          SELECT w.group_id, p.j, min(w.at + 1 + (s.i - (w.at + 1) % s.m + s.m) % s.m)
          FROM walk w JOIN p ON p.group_id = w.group_id AND p.j = w.j + 1 JOIN subs s ON s.group_id = w.group_id AND s.topic = p.topic GROUP BY ALL)
SELECT w.group_id, member_id, topic, partition_id FROM walk w JOIN p ON p.group_id = w.group_id AND p.j = w.j JOIN ring r ON r.group_id = w.group_id AND r.i = w.at % r.m"""
_PROTOCOL = """, c AS (SELECT group_id, member_id, CASE k % 4 WHEN 0 THEN ['sticky', 'range'] WHEN 1 THEN ['range', 'roundrobin'] WHEN 2 THEN ['roundrobin', 'range'] ELSE ['range'] END AS ps FROM members),
 l AS (SELECT group_id, arg_min(ps, member_id) AS ps, count(*) AS n FROM c GROUP BY 1),
 u AS (SELECT l.group_id, p, i, n FROM (SELECT *, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM l) l),
 ok AS (SELECT u.group_id, p, i FROM u JOIN c ON c.group_id = u.group_id AND list_contains(c.ps, p) GROUP BY u.group_id, p, i, n HAVING count(*) = n)
SELECT l.group_id, coalesce(arg_min(ok.p, ok.i), any_value(l.ps[1])) AS protocol FROM l LEFT JOIN ok ON ok.group_id = l.group_id GROUP BY 1"""
_FENCE = """, q AS (SELECT s_suppkey AS request, 'group-' || (s_suppkey % 9) AS group_id, 'm-' || lpad((s_suppkey + s_suppkey % 2 * 7)::VARCHAR, 8, '0') AS member_id,
   CASE s_suppkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 2 ELSE 3 END AS generation FROM supplier)
SELECT request, q.group_id, q.member_id, CASE WHEN generation < 0 THEN 0 WHEN NOT EXISTS (SELECT 1 FROM members m WHERE m.group_id = q.group_id) THEN 25
  WHEN generation <> 3 THEN 22 WHEN NOT EXISTS (SELECT 1 FROM members m WHERE m.group_id = q.group_id AND m.member_id = q.member_id) THEN 25
  WHEN q.group_id = 'group-2' THEN 27 ELSE 0 END::INT AS error_code FROM q"""
_METRICS = f"""SELECT 'topics' AS category, 'count' AS metric, 5::BIGINT AS value, 'topics' AS unit
UNION ALL SELECT 'messages', 'count', (SELECT count(*) FROM log), 'messages'
UNION ALL SELECT 'messages', 'total_bytes', (SELECT sum(coalesce(strlen(key), 0) + coalesce(strlen(value), 0))::BIGINT FROM log), 'bytes'
UNION ALL SELECT 'consumer_groups', 'active_members', (SELECT count(DISTINCT (group_id, member_id)) FROM members), 'members'
UNION ALL SELECT 'consumer_offsets', 'committed', (SELECT count(*) FROM committed), 'offsets'
UNION ALL SELECT 'producers', 'active', (SELECT count(*) FROM (SELECT user_id % 5, max(at_ms) AS m FROM tx GROUP BY 1) WHERE m > {AS_OF_MS} - 300000), 'producers'
UNION ALL SELECT 'transactions', 'ongoing', (SELECT count(*) FROM states WHERE state = 'Ongoing'), 'transactions'
UNION ALL SELECT 'transactions', 'pending_messages', (SELECT count(*) FROM log WHERE txn_state = 'pending'), 'messages'
UNION ALL SELECT 'shadow', 'forwarded', (SELECT count(external_offset) FROM outbox), 'messages'
UNION ALL SELECT 'shadow', 'failed', (SELECT count(*) FROM outbox WHERE external_offset IS NULL AND error IS NOT NULL), 'messages'
UNION ALL SELECT 'shadow', 'lag', (SELECT max(partition_offset) FROM log) - (SELECT max(local_offset) FROM outbox WHERE external_offset IS NOT NULL), 'messages'"""

_hide = lambda c: "SELECT topic_id, partition_id, " + ", ".join(f"CASE WHEN {c} THEN 0 ELSE {m} END AS {m}" for m in ("high_watermark", "earliest_offset", "last_stable_offset")) + " FROM marks"
_BEGIN = """, q AS (SELECT 'txn-' || n_nationkey AS txn_id, (n_nationkey % 4 = 3)::INT AS behind FROM nation),
 b AS (SELECT q.txn_id, state, started_ms, CASE WHEN s.txn_id IS NULL THEN 105 WHEN behind = 1 THEN 90 {extra} ELSE 0 END AS e FROM q LEFT JOIN states s USING (txn_id))
SELECT txn_id, e::INT AS error_code, CASE WHEN e = 0 THEN 'Ongoing' ELSE state END AS state,
       CASE WHEN e = 0 AND state <> 'Ongoing' THEN 1706659200000 ELSE started_ms END AS started_ms FROM b"""
_BY_PROTOCOL = """, x AS (SELECT group_id, member_id, k % 7 % 4 AS kind, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS m FROM members),
 y AS (SELECT *, i * (4 // m) + least(i, 4 % m) AS a, 4 // m + (i < 4 % m)::INT AS n FROM x WHERE kind = 0),
 p AS (SELECT topic, partition_id, row_number() OVER (ORDER BY topic, partition_id) - 1 AS j FROM parts)
SELECT group_id, member_id, topic, unnest(range(a, a + n))::INT AS partition_id FROM y, topics
UNION ALL SELECT group_id, member_id, topic, partition_id FROM x JOIN p ON j % m = i WHERE kind IN (1, 2)"""
_REQUESTS = """, q AS (SELECT n_nationkey::BIGINT AS request, CASE WHEN n_nationkey % 6 = 0 THEN 'view' WHEN n_nationkey % 7 = 0 THEN '..' ELSE 'topic-' || (n_nationkey % 10) END AS topic,
   (n_nationkey % 5 - 1)::INT AS partitions FROM nation)"""

_BODIES = {
    "log_ingest": "SELECT topic_id, topic, partition_id, partition_offset, global_offset, key, value, timestamp_ms, created_at, producer_id, producer_epoch, sequence, txn_state FROM log",
    "txn_append": """SELECT global_offset, topic_id, partition_id, high_watermark + row_number() OVER (PARTITION BY topic_id, partition_id ORDER BY global_offset) - 1 AS partition_offset,
      7::BIGINT AS producer_id, 1::INT AS producer_epoch, 'pending' AS txn_state FROM log JOIN marks USING (topic_id, partition_id) WHERE topic = 'view'""",
    "consume_from_committed": _VISIBLE + " SELECT group_id, topic_id, partition_id, partition_offset FROM vis JOIN committed USING (topic_id, partition_id) WHERE partition_offset >= committed_offset",
    "group_positions": """SELECT 'group-2' AS group_id, topic_id, partition_id, coalesce(c, -1) AS committed_offset FROM parts LEFT JOIN (SELECT topic_id, partition_id, arg_max(committed_offset, seq) AS c
      FROM commits WHERE group_id = 'group-2' AND seq IN (SELECT global_offset FROM log WHERE txn_state = 'pending') GROUP BY ALL) USING (topic_id, partition_id)""",
    "pending_exists": "SELECT topic_id, partition_id, EXISTS (SELECT 1 FROM log l WHERE l.topic_id = p.topic_id AND l.partition_id = p.partition_id AND txn_state = 'pending') AS has_pending FROM parts p",
    "value_text": "SELECT global_offset, value, strlen(value)::INT AS n_bytes FROM log",
    "sql_views": "SELECT topic, count(*) AS n, max(hash) AS top_hash, (SELECT count(*) FROM committed c WHERE c.topic_id = log.topic_id) AS n_commits FROM log JOIN h3 ON event_id = global_offset GROUP BY topic, log.topic_id",
    "setting_parse": """SELECT n_nationkey, coalesce(['gzip', 'snappy', 'lz4', 'zstd', 'none', 'none'][n_nationkey % 6 + 1]) AS codec, ['shadow', 'local_only', 'local_only'][n_nationkey % 3 + 1] AS mode,
      ['sync', 'async', 'async'][n_nationkey % 3 + 1] AS sync_mode, ['external_only', 'dual_write', 'dual_write'][n_nationkey % 3 + 1] AS write_mode,
      CASE WHEN n_nationkey % 3 = 1 THEN 'read_committed' ELSE 'read_uncommitted' END AS isolation FROM nation""",
    "request_sizes": """SELECT request, (sum(b) + 256)::BIGINT AS size FROM (SELECT request, topic, sum(b) + 32 + strlen(topic) AS b FROM (SELECT global_offset // 100 AS request, topic, partition_id,
      sum(64 + coalesce(strlen(key), 0) + coalesce(strlen(value), 0) + 1 + strlen(topic)) + 48 AS b FROM log GROUP BY 1, 2, 3) GROUP BY request, topic) GROUP BY 1""",
    "live_groups": "SELECT group_id, count(*) AS n_members FROM members WHERE k * 1000 <= 30000 GROUP BY 1",
    "preferred_protocol": """, c AS (SELECT group_id, member_id, unnest(CASE k % 4 WHEN 0 THEN ['sticky', 'range'] WHEN 1 THEN ['range', 'roundrobin'] WHEN 2 THEN ['roundrobin', 'range'] ELSE ['range'] END) AS p FROM members),
 ok AS (SELECT c.group_id, p FROM c JOIN (SELECT group_id, count(*) AS m FROM members GROUP BY 1) USING (group_id) GROUP BY c.group_id, p, m HAVING count(*) = m)
SELECT g.group_id, arg_max(p, CASE p WHEN 'sticky' THEN 3 WHEN 'roundrobin' THEN 2 ELSE 1 END) AS protocol FROM (SELECT DISTINCT group_id FROM members) g LEFT JOIN ok USING (group_id) GROUP BY 1""",
    "assign_by_protocol": _BY_PROTOCOL,
    "unassigned_partitions": _RANGE.replace("SELECT group_id, member_id, topic, unnest", "SELECT group_id, topic, unnest") + " WHERE member_id LIKE '%3'",
    "create_topics": _REQUESTS + """, nth AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY request) AS nth FROM q),
 er AS (SELECT *, CASE WHEN topic = '..' THEN 17 WHEN topic = 'view' OR nth > 1 THEN 36 ELSE 0 END::INT AS error_code FROM nth)
SELECT request, topic, CASE WHEN partitions <= 0 THEN 1 ELSE partitions END AS partitions, error_code,
       CASE WHEN error_code = 0 THEN (5 + row_number() OVER (PARTITION BY error_code ORDER BY request))::INT END AS topic_id FROM er""",
    "get_or_create_topics": _REQUESTS + " SELECT DISTINCT topic, 4::INT AS partitions, topic <> 'view' AS fresh FROM q WHERE topic <> '..'",
    "topic_lookup": _REQUESTS + " SELECT request, topic, topic = 'view' AS known, CASE WHEN topic = 'view' THEN 5 ELSE -1 END AS topic_id, CASE WHEN topic = 'view' THEN 4 ELSE 0 END AS partitions FROM q",
    "topic_partition_growth": """SELECT topic_id, topic, greatest(4, coalesce((SELECT max(n_nationkey % 9) FROM nation WHERE ['click', 'view', 'signup', 'nowhere'][n_nationkey % 4 + 1] = topic), 0))::INT AS partitions FROM topics""",
    "log_scan": "SELECT topic_id, topic, partition_id, partition_offset, global_offset, key, value, timestamp_ms, created_at, producer_id, producer_epoch, sequence, txn_state FROM log",
    "partition_route": "SELECT global_offset, log.key, hash, partition_id FROM log JOIN h3 ON event_id = global_offset",
    "key_distribution": "SELECT topic_id, partition_id, count(*) AS n, count(*) FILTER (txn_state = 'aborted') AS n_aborted, count(DISTINCT key) AS n_keys, count(DISTINCT producer_id) AS n_producers FROM log GROUP BY ALL",
    "read_committed_fetch": _VISIBLE + _FETCH.format(rows="vis"),
    "read_uncommitted_fetch": _FETCH.format(rows="log"),
    "high_watermark": _mark("high_watermark"),
    "earliest_offset": _mark("earliest_offset"),
    "last_stable_offset": _mark("last_stable_offset"),
    "offset_for_timestamp": "SELECT * FROM times",
    "offset_gaps": "SELECT topic_id, partition_id, partition_offset + 1 AS from_offset, nxt - partition_offset - 1 AS missing FROM (SELECT *, lead(partition_offset) OVER (PARTITION BY topic_id, partition_id ORDER BY partition_offset) AS nxt FROM clean) WHERE nxt > partition_offset + 1",
    "offset_boundaries": "SELECT topic_id, partition_id, min(partition_offset) AS low, max(partition_offset) + 1 AS high FROM log GROUP BY ALL",
    "offset_arrays": "SELECT topic_id, partition_id, string_agg(partition_offset::VARCHAR, ',' ORDER BY partition_offset) AS pending FROM log WHERE txn_state = 'pending' GROUP BY ALL",
    "global_order_scan": "SELECT global_offset, topic_id, partition_id, partition_offset FROM log WHERE global_offset > 500 ORDER BY 1",
    "topic_metadata": "SELECT topic_id, topic, partitions, (SELECT count(*) FROM marks m WHERE m.topic_id = t.topic_id) AS used_partitions FROM topics t",
    "partition_metadata": "SELECT * FROM parts",
    "committed_offsets": "SELECT * FROM committed",
    "fetch_all_offsets": "SELECT topic, partition_id, committed_offset FROM committed JOIN topics USING (topic_id) WHERE group_id = 'group-1'",
    "consumer_lag": "SELECT group_id, topic_id, partition_id, committed_offset, high_watermark, high_watermark - committed_offset AS lag FROM committed JOIN marks USING (topic_id, partition_id)",
    "uncommitted_partitions": "SELECT p.* FROM parts p WHERE NOT EXISTS (SELECT 1 FROM commits c JOIN log l ON l.global_offset = c.seq AND l.txn_state = 'pending' WHERE c.topic_id = p.topic_id AND c.partition_id = p.partition_id AND group_id = 'group-2')",
    "commit_fence": _FENCE,
    "delete_group_offsets": "SELECT * FROM committed WHERE group_id <> 'group-1'",
    "expired_members": "SELECT group_id, member_id FROM members WHERE k * 1000 > 30000",
    "assign_range": _RANGE,
    "assign_roundrobin": _ROUND,
    "assign_roundrobin_mixed": _ROUND_MIXED,
    "common_protocol": _PROTOCOL,
    "sequence_validate": "SELECT producer_id, topic_id, partition_id, arrival, base_sequence, 1::INT AS n_records, outcome, expected FROM batches",
    "dedup_log": "SELECT producer_id, topic_id, partition_id, sequence AS base_sequence FROM log",
    "next_sequence": "SELECT producer_id, topic_id, partition_id, max(sequence) + 1 AS next_sequence FROM log GROUP BY ALL",
    "epoch_fence": "SELECT global_offset, CASE WHEN producer_id > 3 THEN 59 WHEN global_offset % 3 < producer_id % 3 THEN 90 ELSE 0 END::INT AS error_code FROM log",
    "txn_latest_state": "SELECT * FROM states",
    "txn_visibility": "SELECT txn_id, seq, CASE WHEN fate IS NULL THEN 'pending' WHEN fate <> 'commit' THEN 'aborted' END AS txn_state FROM fates",
    "txn_validate": """SELECT event_id AS request, CASE WHEN s.txn_id IS NULL THEN 105 WHEN s.producer_epoch <> event_id % 120 THEN 90 ELSE 0 END::INT AS error_code
      FROM events e LEFT JOIN states s ON s.txn_id = 'txn-' || (user_id % 25)""",
    "txn_begin": _BEGIN.format(extra="WHEN state = 'Ongoing' THEN 48", kept="state = 'Ongoing'"),
    "txn_begin_or_continue": _BEGIN.format(extra="", kept="false"),
    "producer_reconnect": """SELECT txn_id, ((n - 1) // 4)::BIGINT AS generation, ((n - 1) % 4)::INT AS producer_epoch, coalesce(a, 0) AS aborted, coalesce(d, 0) AS dropped_offsets
      FROM (SELECT txn_id, count(*) AS n FROM tx WHERE action = 'init' GROUP BY 1)
      LEFT JOIN (SELECT txn_id, count(*) AS a, count(*) FILTER (event_type = 'view') AS d FROM fates JOIN events ON event_id = seq WHERE fate = 'init' GROUP BY 1) USING (txn_id)""",
    "produce_checked": """SELECT arrival, e::INT AS error_code, e = 0 AND outcome = 'proceed' AS stored FROM (SELECT *, CASE WHEN producer_id > 3 THEN 59 WHEN producer_id % 3 > 0 THEN 90
      WHEN outcome = 'out_of_order' THEN 45 ELSE 0 END AS e FROM batches)""",
    "txn_pending_offsets_commit": """SELECT group_id, topic_id, partition_id, arg_max(committed_offset, seq) AS committed_offset FROM (SELECT * FROM commits UNION ALL
      SELECT 'group-1', topic_id, partition_id, partition_offset + 1, global_offset FROM log JOIN tx ON tx.seq = global_offset JOIN states USING (txn_id)
      WHERE log.key IS NULL AND state = 'CompleteCommit') GROUP BY ALL""",
    "txn_timeouts": "SELECT txn_id, started_ms, ((length(txn_id) - 4) * 3600000)::BIGINT AS timeout_ms FROM states WHERE state = 'Ongoing' AND started_ms < (SELECT max(at_ms) FROM tx) - (length(txn_id) - 4) * 3600000",
    "aborted_cleanup": "SELECT topic_id, partition_id, count(*) AS n FROM clean GROUP BY ALL",
    "hwm_after_cleanup": "SELECT m.topic_id, m.partition_id, high_watermark, coalesce(c.low, 0) AS earliest_offset FROM marks m LEFT JOIN (SELECT topic_id, partition_id, min(partition_offset) AS low FROM clean WHERE topic_id <> 4 GROUP BY ALL) c USING (topic_id, partition_id)",
    "forward_sample_10": _sampled(10),
    "forward_sample_50": _sampled(50),
    "forward_sample_90": _sampled(90),
    "outbox_enqueue": """SELECT topic_id, partition_id, partition_offset AS local_offset, 0::INT AS retry_count FROM bucketed
      WHERE txn_state IS NULL AND bucket < CASE topic_id WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 25 WHEN 5 THEN 100 ELSE 0 END AND (key IS NOT NULL OR topic_id > 3)""",
    "outbox_enqueue_at_commit": """SELECT b.topic_id, partition_id, partition_offset AS local_offset, 0::INT AS retry_count FROM bucketed b JOIN fates f ON f.seq = global_offset JOIN config c ON c.topic_id = b.topic_id
      WHERE fate = 'commit' AND bucket < percent AND NOT (key IS NULL AND b.topic_id <= 3 AND txn_state IS NULL)""",
    "outbox_acknowledged": """SELECT topic_id, partition_id, local_offset, coalesce(external_offset, CASE WHEN local_offset % 2 = 0 THEN local_offset + 5000000 WHEN local_offset % 3 = 0 THEN local_offset + 6000000 END) AS external_offset,
      CASE WHEN external_offset IS NOT NULL OR local_offset % 2 = 0 THEN error WHEN local_offset % 3 = 0 THEN 'refused' ELSE 'late' END AS error FROM outbox""",
    "forward_config": """SELECT topic_id, topic, mode, write_mode, percent, coalesce(external_topic_name, topic) AS target, percent > 0 AS forwards FROM config JOIN topics USING (topic_id)""",
    "forward_decisions": "SELECT topic_id, count(*) FILTER (bucket < percent) AS forwarded, count(*) FILTER (bucket >= percent) AS skipped FROM bucketed JOIN config USING (topic_id) WHERE txn_state IS NULL GROUP BY 1",
    "forward_lag_by_partition": """SELECT topic_id, partition_id, high_watermark - 1 - coalesce(l, -1) AS lag FROM marks
      LEFT JOIN (SELECT topic_id, partition_id, max(local_offset) FILTER (external_offset IS NOT NULL) AS l FROM outbox GROUP BY ALL) USING (topic_id, partition_id)""",
    "outbox_due": f"""SELECT o.topic_id, o.partition_id, local_offset, o.retry_count + 1 AS retry_count, coalesce(external_topic_name, l.topic) AS target, l.key, l.value
      FROM outbox o JOIN log l ON l.global_offset = o.global_offset LEFT JOIN config c ON c.topic_id = o.topic_id WHERE external_offset IS NULL AND retry_count < 10
      AND (attempted_ms IS NULL OR attempted_ms < {AS_OF_MS} - 5000) AND (l.key IS NULL OR l.key <> '') ORDER BY 1, 2, 3 LIMIT 256""",
    "outbox_dead_letters": "SELECT topic_id, partition_id, local_offset FROM outbox WHERE external_offset IS NULL AND retry_count >= 10",
    "forward_metrics": "SELECT topic_id, partition_id, count(external_offset) AS messages_forwarded, count(*) FILTER (external_offset IS NULL AND error IS NOT NULL) AS messages_failed, max(local_offset) FILTER (external_offset IS NOT NULL) AS last_forwarded_offset, max(attempted_ms) FILTER (external_offset IS NOT NULL) AS last_forwarded_ms FROM outbox GROUP BY ALL",
    "topic_forward_status": """SELECT topic_id, topic, coalesce(mode, 'local') AS mode, coalesce(forward_percentage, 0) AS forward_percentage, coalesce(f, 0) AS total_forwarded, coalesce(e, 0) AS total_failed,
      l AS last_forwarded_offset, t AS last_forwarded_ms, top - coalesce(l, 0) AS lag FROM topics LEFT JOIN config c USING (topic_id)
      LEFT JOIN (SELECT topic_id, count(external_offset) AS f, count(*) FILTER (external_offset IS NULL AND error IS NOT NULL) AS e, max(local_offset) FILTER (external_offset IS NOT NULL) AS l, max(attempted_ms) FILTER (external_offset IS NOT NULL) AS t FROM outbox GROUP BY 1) USING (topic_id)
      LEFT JOIN (SELECT topic_id, max(partition_offset) AS top FROM log GROUP BY 1) USING (topic_id)""",
    "replay_range": """SELECT topic_id, partition_id, local_offset, CASE WHEN topic_id = 1 AND local_offset BETWEEN 10 AND 39 THEN NULL ELSE external_offset END AS external_offset,
      CASE WHEN topic_id = 1 AND local_offset BETWEEN 10 AND 39 THEN 0 ELSE retry_count END AS retry_count FROM outbox""",
    "external_primary_reads": _hide("topic_id IN (2, 5)"),
    "external_primary_lenient": _hide("topic_id = 5"),
    "external_primary_fetch": (_VISIBLE + _FETCH.format(rows="vis")).replace("partition_offset, key, value,", "partition_offset, bytes::BIGINT AS bytes FROM f WHERE topic_id <> 5 AND rn <= 10 AND (bytes <= 4000 OR rn = 1) --").split("--")[0],
    "external_primary_times": "SELECT topic_id, partition_id, probe_ms, CASE WHEN topic_id IN (2, 5) THEN -1 ELSE \"offset\" END AS \"offset\", CASE WHEN topic_id IN (2, 5) THEN -1 ELSE timestamp_ms END AS timestamp_ms FROM times",
    "metrics_overview": _METRICS,
    "bytes_per_topic": "SELECT topic_id, count(*) AS n_messages, sum(coalesce(strlen(key), 0) + coalesce(strlen(value), 0))::BIGINT AS total_bytes, max(coalesce(strlen(key), 0) + coalesce(strlen(value), 0)) AS largest FROM log GROUP BY 1",
    "record_size_estimate": "SELECT global_offset, 64 + coalesce(strlen(key), 0) + coalesce(strlen(value), 0) + 1 + strlen(topic) AS size FROM log",
    "topic_name_validate": "SELECT p_partkey, name, regexp_full_match(name, '[A-Za-z0-9._-]{1,249}') AND name NOT IN ('.', '..') AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '..' ELSE p_name END AS name FROM part)",
    "create_partitions_check": """SELECT CASE WHEN n_nationkey % 6 = 0 THEN 'view' ELSE 'topic-' || n_nationkey END AS topic, n_nationkey % 9 AS new_partitions,
      CASE WHEN n_nationkey % 6 <> 0 THEN 3 WHEN n_nationkey % 9 <= 4 THEN 37 ELSE 0 END AS error_code FROM nation""",
    "delete_topic_cascade": "SELECT topic_id, count(*) AS n FROM log WHERE topic_id NOT IN (2, 5) GROUP BY 1",
    "headers_json": """SELECT event_id, '{"props":"' || lower(hex(encode(props))) || '","type":"' || lower(hex(encode(user_id::VARCHAR))) || '"}' AS headers FROM events""",
    "nearest_rank_percentiles": """SELECT l_returnflag, min(x) FILTER (r * 100 >= n * 50) AS p50, min(x) FILTER (r * 100 >= n * 95) AS p95, min(x) FILTER (r * 100 >= n * 99) AS p99
      FROM (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1""",
    "stream_append_offsets": "SELECT topic_id, partition_id, global_offset, partition_offset FROM log",
    "stream_dedup": "SELECT producer_id, topic_id, partition_id, arrival, outcome FROM batches",
    "stream_lag": "SELECT group_id, topic_id, partition_id, committed_offset, high_watermark, high_watermark - committed_offset AS lag FROM committed JOIN marks USING (topic_id, partition_id)",
    "stream_transform": _VISIBLE.replace("l.* FROM", "l.*, p FROM") + " SELECT 9::INT AS topic_id, partition_id, global_offset, row_number() OVER (PARTITION BY partition_id ORDER BY global_offset) - 1 AS partition_offset, upper(value) AS value FROM vis",
    "stream_commits": "SELECT 'copier' AS group_id, topic_id, partition_id, high_watermark AS committed_offset FROM marks",
    "stream_sessions": "SELECT group_id, member_id, 1706659200000 - k * 1000 + 30000 AS expired_ms FROM members WHERE k * 1000 >= 32000",
    "stream_windows": """SELECT start_ms, topic_id, count(*) AS n FROM (SELECT timestamp_ms // 3600000 * 3600000 AS start_ms, topic_id FROM log WHERE timestamp_ms >= 0)
      GROUP BY 1, 2 HAVING start_ms + 3600000 <= (SELECT max(timestamp_ms) FROM log) - 600000""",
    "stream_forward": "SELECT topic_id, partition_id, partition_offset FROM bucketed WHERE txn_state IS NULL AND bucket < 50",
}
ORACLES: dict[str, str] = {
    name: (LOG.replace("WITH ", "WITH RECURSIVE ", 1) if name == "assign_roundrobin_mixed" else LOG) + body
    for name, body in _BODIES.items()
}
