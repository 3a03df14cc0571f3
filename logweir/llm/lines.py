"""Operator 5: reversible line dedup with sharded cuckoo filters over exact reference counts.

An index holds, for every line key, the exact number of documents that have it, and per
shard a cuckoo filter of the common keys (those in at least ``threshold`` documents).
Documents can be inserted and deleted: counts are added or subtracted and only keys that
cross the threshold enter or leave their shard's filter - cuckoo filters can delete - so
deleting what was inserted restores the index exactly.

Dropping lines probes the filters first, and only the few lines that pass are joined with the
exact counts. The filters travel to the tasks where their measured size is within
``BROADCAST_BYTES``; beyond that the lines travel to their shard's filter. Shards are doubled
as common lines grow, so that one filter stays small. Both ways give the same rows.

A line's key is the line without surrounding white space and with A-Z in lower case; lines
with an empty key are never common. Defined cases: a null or empty text is one empty line
(``drop_common`` leaves a null text null); each row counts as a document, repeated rows
too; an empty table gives an empty table or index; other columns are kept.
Columns starting with ``__`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import checkpointed, let, row_id, table

BLANKS = " \t\n\x0b\x0c\r"
THRESHOLD = 10
#: Shards that an index has at first, and common keys of a shard, about, at which they are doubled.
SHARDS = 64
SHARD_KEYS = 1 << 18
BROADCAST_BYTES = 64 << 20
#: Copies of the exact counts that share the lines of one very common key among tasks.
SALTS = 16

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; supports deletion and vectorised probes."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells  # (buckets, SLOTS) of uint16; 0 is empty

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(n, 1) / (0.6 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def write(self) -> bytes:
        return self.cells.astype("<u2").tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and second bucket of each key (uint64)."""
        mask = np.uint64(len(self.cells) - 1)
        marks = (keys >> np.uint64(48)).astype(np.uint16)
        marks = np.where(marks == 0, np.uint16(1), marks)
        first = keys & mask
        return marks, first, first ^ self._step(marks)

    def _step(self, marks: np.ndarray) -> np.ndarray:
        return (marks.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.cells) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        marks, first, second = self.places(keys)
        return ((self.cells[first] == marks[:, None]) | (self.cells[second] == marks[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Puts all keys (uint64) in; False if some found no place.

        All keys that are left take free slots at once, then at their other bucket; after that
        one key a bucket evicts another, which moves on to its own other bucket.
        """
        marks, at, other = self.places(keys)
        for turn in range(KICKS):
            for _ in range(2):
                order = np.argsort(at, kind="stable")
                marks, at, other = marks[order], at[order], other[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
                free = self.cells[at] == 0
                fits = rank < free.sum(axis=1)
                # The rank-th free slot of the bucket.
                slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
                self.cells[at[fits], slot[fits]] = marks[fits]
                marks, at, other = marks[~fits], other[~fits], at[~fits]
            if not len(at):
                return True
            _, first = np.unique(at, return_index=True)
            slot = turn % SLOTS
            marks[first], self.cells[at[first], slot] = self.cells[at[first], slot], marks[first]
            # The evicted were at this bucket and move on to their other one.
            other[first] = at[first]
            at[first] = at[first] ^ self._step(marks[first])
        return False

    def delete(self, key: int) -> bool:
        marks, first, second = self.places(np.array([key], np.uint64))
        for bucket in (int(first[0]), int(second[0])):
            held = np.flatnonzero(self.cells[bucket] == marks[0])
            if len(held):
                self.cells[bucket, held[0]] = 0
                return True
        return False

    @classmethod
    def built(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all keys, doubled until they fit."""
        room = len(keys)
        while True:
            made = cls.sized(room)
            if made.insert(keys):
                return made
            room = 2 * max(room, 1)


def keyed_lines(text: Column) -> Column:
    """(pos, h1, h2) of every line with a key; the two hashes make a 128-bit key."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    keys = F.transform(F.split(lowered, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = F.transform(
        keys,
        lambda k, i: F.when(
            k != "", F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"))
        ),
    )
    return F.array_compact(hashed)


def counts(docs: DataFrame) -> DataFrame:
    """h1, h2, n_docs: in how many documents each key is."""
    own = F.array_distinct(F.transform(keyed_lines(F.col("text")), lambda x: F.struct(x["h1"], x["h2"])))
    return (
        docs.select(F.explode(own).alias("k"))
        .groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


REFS = "h1 long, h2 long, n_docs long"
FILTERS = "shard int, n_keys long, cells binary"
PASSED = "__id string, pos int, h1 long, h2 long"


def _refilled(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its changes; built anew where it was absent or grew too full."""
    shard = int(keys["shard"].iloc[0] if len(keys) else old["shard"].iloc[0])
    common = keys["h2"][keys["now"]].to_numpy(np.int64).view(np.uint64) if len(keys) else np.zeros(0, np.uint64)
    kept = CuckooFilter.read(old["cells"].iloc[0]) if len(old) else None
    if kept is not None and len(common) <= 0.9 * kept.cells.size:
        gone = keys["h2"][keys["was"] & ~keys["now"]].to_numpy(np.int64).view(np.uint64)
        new = keys["h2"][keys["now"] & ~keys["was"]].to_numpy(np.int64).view(np.uint64)
        if all(kept.delete(int(k)) for k in gone) and kept.insert(new):
            return pd.DataFrame({"shard": [shard], "n_keys": [len(common)], "cells": [kept.write()]})
    return pd.DataFrame({"shard": [shard], "n_keys": [len(common)], "cells": [CuckooFilter.built(common).write()]})


@dataclass(frozen=True)
class LineIndex:
    """Exact reference counts and the filters of common keys; every change gives a new index."""

    refs: DataFrame
    filters: DataFrame
    threshold: int = THRESHOLD
    shards: int = SHARDS

    @classmethod
    def empty(cls, spark: SparkSession, threshold: int = THRESHOLD, shards: int = SHARDS) -> LineIndex:
        return cls(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), threshold, shards)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        none = F.lit(0).cast("long")
        both = self.refs.withColumn("delta", none).unionByName(
            counts(docs).select("h1", "h2", none.alias("n_docs"), (sign * F.col("n_docs")).alias("delta"))
        )
        merged = checkpointed(both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("old"), F.sum("delta").alias("delta")))
        new = F.col("old") + F.col("delta")
        common = merged.agg(F.count_if(new >= self.threshold)).first()[0]
        shards, old = self.shards, self.filters
        while common > shards * SHARD_KEYS:
            shards, old = 2 * shards, self.filters.limit(0)
        # Filters of other shards than before are filled anew.
        was = F.col("old") >= self.threshold if shards == self.shards else F.lit(False)
        marked = merged.select(
            F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h2", was.alias("was"), (new >= self.threshold).alias("now")
        ).filter("was OR now")
        filters = marked.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(_refilled, FILTERS)
        refs = merged.select("h1", "h2", new.alias("n_docs")).filter("n_docs > 0")
        return replace(self, refs=refs, filters=checkpointed(filters), shards=shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes back documents that were inserted before."""
        return self._changed(docs, -1)

    def save(self, path: str) -> None:
        self.refs.write.mode("errorifexists").parquet(f"{path}/refs")
        self.filters.write.mode("errorifexists").parquet(f"{path}/filters")

    @classmethod
    def load(cls, spark: SparkSession, path: str, threshold: int = THRESHOLD, shards: int = SHARDS) -> LineIndex:
        return cls(spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/filters"), threshold, shards)

    def _passing(self, rows: DataFrame) -> DataFrame:
        """The lines that their shard's filter lets pass: __id, pos, h1, h2."""
        measured = self.filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0)).alias("n")).first()["n"]
        if measured > BROADCAST_BYTES:
            return self._meeting(rows)
        sent = rows.sparkSession.sparkContext.broadcast(
            {r["shard"]: bytes(r["cells"]) for r in self.filters.select("shard", "cells").collect()}
        )
        shards = self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.read(v) for k, v in sent.value.items()}
            for batch in batches:
                lists = batch.column(1)
                flat = lists.flatten()
                h1, h2 = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2"))
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                keys, shard, passed = h2.view(np.uint64), h1 % shards, np.zeros(len(h1), bool)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for k, cuckoo in filters.items():
                    at = order[cuts[k] : cuts[k + 1]]
                    if len(at):
                        passed[at] = cuckoo.has(keys[at])
                at = np.flatnonzero(passed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[at])), flat.field("pos").take(pa.array(at)), pa.array(h1[at]), pa.array(h2[at])],
                    names=["__id", "pos", "h1", "h2"],
                )

        return rows.mapInArrow(probe, PASSED)

    def _meeting(self, rows: DataFrame) -> DataFrame:
        """The same where the filters are too large to send: the lines go to their shard's filter.

        Every shard's filter goes to ``SALTS`` tasks, which share its lines, so that a very
        common line is the work of many; a task holds one filter and streams the lines by.
        """
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        filters = self.filters.select("shard", every, "cells")
        lines = rows.select("__id", F.inline("__lines")).select(
            F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard"),
            F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int").alias("salt"),
            "__id", "pos", "h1", "h2",
        )
        met = filters.unionByName(lines, allowMissingColumns=True).repartition("shard", "salt")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, cuckoo = None, None
            for batch in batches:
                shards, cells = batch.column(0).to_numpy(), batch.column(2)
                cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
                passed = np.zeros(len(shards), bool)
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                    if y == x:
                        continue
                    if shards[x] != shard:
                        shard, cuckoo = shards[x], None
                    for i in range(x, y):
                        if not cells[i].is_valid:
                            break
                        cuckoo, x = CuckooFilter.read(cells[i].as_py()), i + 1
                    if cuckoo is not None and y > x:
                        passed[x:y] = cuckoo.has(batch.column(6).slice(x, y - x).to_numpy().view(np.uint64))
                at = pa.array(np.flatnonzero(passed))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (3, 4, 5, 6)], names=["__id", "pos", "h1", "h2"])

        # A shard's filter comes before its lines, whose cells are null.
        return met.sortWithinPartitions("shard", F.desc_nulls_last("cells")).mapInArrow(probe, PASSED)

    def common_lines(self, docs: DataFrame) -> DataFrame:
        """__id (of the row) and the positions of its common lines, for texts that have any."""
        rows = docs.select(row_id().alias("__id"), keyed_lines(F.col("text")).alias("__lines"))
        common = self.refs.filter(F.col("n_docs") >= self.threshold).select(
            "h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        )
        salted = self._passing(rows).withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        return (
            salted.join(common, ["h1", "h2", "salt"], "left_semi")
            .groupBy("__id")
            .agg(F.collect_set("pos").alias("__drop"))
        )

    def marked(self, docs: DataFrame) -> DataFrame:
        """``docs`` with __drop: the positions of the lines that the index calls common, or null.

        What is dropped depends on the text alone; rows are matched by a 128-bit digest of id and
        text, so that a large group of copies is spread like any other rows.
        """
        drops = self.common_lines(docs).hint("shuffle_hash")
        return docs.withColumn("__id", row_id()).join(drops, "__id", "left").drop("__id")

    def drop_common(self, docs: DataFrame) -> DataFrame:
        cut = self.marked(docs)
        return cut.select(
            *[(kept_text().alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns]
        )


def kept_text() -> Column:
    """The text without the lines at ``__drop``; untouched texts stay as they are."""

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.when(F.col("__drop").isNull(), F.col("text")).otherwise(let(F.split(F.col("text"), "\n"), without))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = LineIndex.empty(spark).insert(docs).marked(docs)
    return marked.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(kept_text(), F.lit("")), 256).alias("kept_sha256"),
    )


def lines_sql(source: str = "documents", threshold: int = THRESHOLD) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
l AS (SELECT rid, i, ls[i] AS line,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       '{ascii_uppercase}', '{ascii_lowercase}') AS k
      FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= {threshold}),
o AS (SELECT rid, count(*) AS n_lines, count(c.k) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
      FROM l LEFT JOIN c ON c.k = l.k GROUP BY rid)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, kept_sha256 FROM o JOIN d USING (rid)
"""
