"""Operator 1: approximate nearest neighbours by a forest of random-projection trees.

The trees' hyperplanes are fitted on a bounded sample (``SAMPLE`` distinct vectors, the
smallest by hash; each plane bisects two sample vectors' direction at the sample's median)
and sent to the tasks; every row is indexed, in one leaf of each tree. The depth follows the
number of rows, so leaves stay near ``LEAF_ROWS`` rows for as long as the sample can fit them.

A query walks all trees through one shared priority queue, by the squared margins of the
planes it would have to cross. Its own leaves' sample vectors tell about how far its k-th
neighbour is; seen along one plane a neighbour at distance r is r / sqrt(dim) away, and the walk
ends when the margins exceed ``REACH`` times the square of that. In clustered data few leaves
are that near, in data without structure about half of the rows are. ``SHARE`` of all leaves
is the most that a walk takes. Products below those of its own leaves' k + 1 best sample
vectors cannot be answers and are dropped where they arise. Leaves and the queries that reached them meet by leaf, where
inner products in double precision rank the leaf's vectors; each query's best of all leaves
are its answer.

For the largest inner product the vectors get one more coordinate that makes all norms equal,
so that near in angle is large in product; queries have zero there.

Equal vectors are indexed once, with their k + 1 smallest ids: no answer of k can hold more
of them, as ties go to the smaller id. Equal queries are asked once. A leaf of more than
``BLOCK_ROWS`` rows is cut into blocks; a task holds one block and streams the queries by.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part; shorter vectors are filled up with zeros, which changes no inner product; a repeated
row counts once; a query is never its own answer; with fewer candidates than k all reached are
returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import checkpointed, spread_join, table

SAMPLE = 32_768
TREES = 8
#: Rows that a leaf has about, and sample vectors that it needs.
LEAF_ROWS = 256
LEAF_SAMPLE = 8
REACH = 0.5
SHARE = 0.2
#: Rows of a leaf that one block compares, queries at a time, and answers a task holds.
BLOCK_ROWS = 8_192
QUERY_ROWS = 1_024
HELD = 500_000


def depth_for(rows: int, sample: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, min(rows / LEAF_ROWS, sample / LEAF_SAMPLE))))))


@dataclass(frozen=True)
class Forest:
    """Complete trees in heap order: planes (trees, 2**depth - 1, dim) and offsets.

    ``sample`` are the lifted sample vectors; ``members`` and ``starts`` list them by leaf of each tree.
    """

    planes: np.ndarray
    offsets: np.ndarray
    depth: int
    norm: float
    sample: np.ndarray
    members: np.ndarray
    starts: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, norm: float, depth: int, trees: int = TREES, seed: int = 0) -> Forest:
        data, rng = lifted(sample, norm), np.random.default_rng(seed)
        inner = (1 << depth) - 1
        planes, offsets = np.zeros((trees, inner, data.shape[1])), np.zeros((trees, inner))
        members, starts = np.zeros((trees, len(data)), np.int32), np.zeros((trees, inner + 2), np.int64)
        for t in range(trees):
            held = {0: np.arange(len(data))}
            for node in range(inner):
                rows = held.pop(node)
                a, b = data[rng.choice(rows, 2, replace=False)] if len(rows) > 1 else (data[0], -data[0])
                w = a - b if np.any(a != b) else rng.standard_normal(data.shape[1])
                w = w / np.linalg.norm(w)
                along = data[rows] @ w
                cut = float(np.median(along)) if len(rows) else 0.0
                planes[t, node], offsets[t, node] = w, cut
                held[2 * node + 1], held[2 * node + 2] = rows[along <= cut], rows[along > cut]
            own = [held[node] for node in range(inner, 2 * inner + 1)]
            members[t], starts[t, 1:] = np.concatenate(own), np.cumsum([len(x) for x in own])
        return cls(planes, offsets, depth, norm, data, members, starts)

    def leaves(self, data: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each lifted row in each tree."""
        out = np.zeros((len(data), len(self.planes)), np.int64)
        for t, (planes, offsets) in enumerate(zip(self.planes, self.offsets)):
            for _ in range(self.depth):
                node = out[:, t]
                right = np.einsum("ij,ij->i", data, planes[node]) > offsets[node]
                out[:, t] = 2 * node + 1 + right
        return out - ((1 << self.depth) - 1)

    def near(self, query: np.ndarray, homes: list[tuple[int, int]]) -> np.ndarray:
        """The inner products of the query and the sample vectors in its own leaves, largest first."""
        found = [self.members[t, self.starts[t, x] : self.starts[t, x + 1]] for t, x in homes]
        return np.sort(self.sample[np.unique(np.concatenate(found))] @ query)[::-1]

    def probe(
        self, query: np.ndarray, k: int, nearest: int, reach: float = REACH, share: float = SHARE
    ) -> tuple[list[tuple[int, int]], float]:
        """(tree, leaf) of the leaves near the query (with its zero), by one priority queue over all trees.

        Also a product that k of the indexed vectors reach, so that no worse one is an answer.
        ``nearest`` tells which sample vector is about as far as the k-th of all rows.
        """
        trees, inner = len(self.planes), (1 << self.depth) - 1
        most, limit, floor = max(trees, int(np.ceil(share * trees * (inner + 1)))), np.inf, -np.inf
        margins = (self.planes @ query - self.offsets).tolist()
        queue = [(0.0, t, 0) for t in range(trees)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            distance, t, node = heapq.heappop(queue)
            if distance > limit:
                break
            own = margins[t]
            while node < inner:
                m = own[node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (distance + m * m, t, 4 * node + 3 - near))
                node = near
            found.append((t, node - inner))
            if len(found) == trees:
                products, length = self.near(query, found), float(query @ query)
                floor = float(products[k - 1]) if len(products) >= k else -np.inf
                # All lifted vectors have one norm; the query itself is no neighbour.
                squares = self.norm**2 + length - 2 * products
                squares = squares[squares > 1e-12 * self.norm**2]
                if len(squares):
                    limit = reach * float(squares[min(nearest, len(squares)) - 1]) / (len(query) - 1)
        return found, floor


def lifted(data: np.ndarray, norm: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", data, data), 0.0))
    return np.column_stack([data, extra])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, each once, all of the length of the longest."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & sound & F.exists(e, lambda x: x != 0)
    )
    least, most = rows.agg(F.min(F.size(e)), F.max(F.size(e))).first()
    if least != most:
        rows = rows.withColumn("embedding", F.concat(e, F.array_repeat(e[0] * 0, F.lit(most) - F.size(e))))
    return rows.dropDuplicates()


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best distinct answers, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q, x = query[order], ids[order]
    # A row's scores from several trees are the same sum and so equal.
    fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (x[1:] != x[:-1]))) if len(q) else np.zeros(0, bool)
    order = order[fresh]
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def scored(ids: list[np.ndarray], data: np.ndarray, asked: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query, id and score of each query's k best among the rows, which have sorted ids each, not below its floor."""
    products = q @ data.T
    if len(data) > k:
        floor = np.maximum(floor, np.partition(products, len(data) - k, axis=1)[:, len(data) - k])
    a, b = np.nonzero(products >= (floor - 1e-9 * np.abs(np.maximum(floor, -1e300)))[:, None])
    exact, many = (q[a] * data[b]).sum(axis=1), np.fromiter(map(len, ids), np.int64, len(ids))[b]
    found = np.concatenate([ids[x] for x in b.tolist()]) if len(b) else np.zeros(0, np.int64)
    query, score = np.repeat(asked[a], many), np.repeat(exact, many)
    best = best_of(query, found, score, k)
    return query[best], found[best], score[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, reach: float = REACH, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row (vec_id, embedding) of ``queries``.

    Both inputs come from one call of ``usable``.
    """
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    points = checkpointed(
        vectors.withColumn("at", F.row_number().over(by_id))
        .filter(F.col("at") <= k + 1)
        .groupBy("embedding")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    totals = points.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("m")).first()
    if not totals["n"]:
        return vectors.limit(0).selectExpr("vec_id query_id", "1 rank", "vec_id", "0D score")
    chosen = points.orderBy(F.xxhash64("embedding"), "embedding").select("embedding").limit(SAMPLE).toArrow()
    sample = _matrix(chosen.column("embedding").combine_chunks()).astype(np.float64)
    forest = Forest.fitted(sample, float(np.sqrt(totals["m"])), depth_for(totals["n"], len(sample)))
    sent = points.sparkSession.sparkContext.broadcast(forest)
    blocks = -(-totals["n"] // (BLOCK_ROWS << forest.depth))
    nearest = max(1, round(k * len(sample) / totals["n"]))
    names = ["tree", "leaf", "block", "asks", "id", "ids", "vector", "floor"]
    cells = "tree int, leaf int, block int, asks boolean, id long, ids array<bigint>, vector binary, floor double"

    def row(tree: np.ndarray, leaf: np.ndarray, block: np.ndarray, asks: bool, *rest: pa.Array) -> pa.RecordBatch:
        ints = [pa.array(x, pa.int32()) for x in (tree, leaf, block)]
        return pa.RecordBatch.from_arrays([*ints, pa.array(np.full(len(leaf), asks)), *rest], names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, lists = _matrix(batch.column(0)), batch.column(1).cast(pa.list_(pa.int64()))
                leaves = sent.value.leaves(lifted(data.astype(np.float64), sent.value.norm))
                vector = pa.array([x.tobytes() for x in data], pa.binary())
                ids = np.fromiter((x[0].as_py() for x in lists), np.int64, len(lists))
                block = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)
                for t in range(leaves.shape[1]):
                    yield row(np.full(len(data), t), leaves[:, t], block.astype(np.int32), False, pa.array(ids), lists, vector, pa.nulls(len(ids), pa.float64()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _matrix(batch.column(1)) if batch.num_rows else []
            for asked, q in zip(batch.column(0).to_pylist(), data):
                found, floor = sent.value.probe(np.append(q.astype(np.float64), 0.0), k + 1, nearest, reach, share)
                cut = np.repeat(np.array(found, np.int32), blocks, axis=0)
                ids, vector = pa.array([asked] * len(cut), pa.int64()), pa.array([q.tobytes()] * len(cut), pa.binary())
                lists = pa.nulls(len(cut), pa.list_(pa.int64()))
                yield row(cut[:, 0], cut[:, 1], np.tile(np.arange(blocks), len(found)), True, ids, lists, vector, pa.array(np.full(len(cut), floor)))

    kind = "<f4" if "float" in points.schema["embedding"].dataType.simpleString() else "<f8"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come sorted, rows before queries: a cell's rows are held while its queries stream by."""
        cell, lists, rows, data, answers, n = None, [], [], None, [], 0

        def matrix(vectors: pa.Array) -> np.ndarray:
            flat = np.frombuffer(b"".join(vectors.to_pylist()), kind)
            return flat.reshape(len(vectors), -1).astype(np.float64)

        def handed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asked", "vec_id", "score"])

        for batch in batches:
            where = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
            cuts = np.flatnonzero(np.any(where[1:] != where[:-1], axis=1)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
                if y == x:
                    continue
                part = batch.slice(x, y - x)
                if cell != tuple(where[x, :3]):
                    cell, lists, rows, data = tuple(where[x, :3]), [], [], None
                if not where[x, 3]:
                    rows.append(matrix(part.column(6)))
                    lists += [v.values.to_numpy() for v in part.column(5)]
                    continue
                data = np.concatenate(rows) if data is None and rows else data
                for at in range(0, y - x, QUERY_ROWS) if data is not None else ():
                    some = part.slice(at, QUERY_ROWS)
                    answers.append(scored(lists, data, some.column(4).to_numpy(), matrix(some.column(6)), some.column(7).to_numpy(), k + 1))
                    n += len(answers[-1][0])
                if n > HELD:
                    q, ids, score = (np.concatenate(c) for c in zip(*answers))
                    best = best_of(q, ids, score, k + 1)
                    answers, n = [(q[best], ids[best], score[best])], len(best)
                    if 2 * n > HELD:
                        yield handed(answers)
                        answers, n = [], 0
        if n:
            q, ids, score = (np.concatenate(c) for c in zip(*answers))
            best = best_of(q, ids, score, k + 1)
            answers = [(q[best], ids[best], score[best])]
        yield handed(answers)

    groups = checkpointed(
        queries.groupBy("embedding").agg(F.min("vec_id").alias("asked"), F.count(F.lit(1)).alias("n"))
    )
    indexed = points.select("embedding", "ids").mapInArrow(index, cells)
    walked = groups.select("asked", "embedding").mapInArrow(walk, cells)
    cell = ["tree", "leaf", "block"]
    found = indexed.unionByName(walked).repartition(*cell).sortWithinPartitions(*cell, "asks").mapInArrow(
        rank, "asked long, vec_id long, score double"
    )
    best_first = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    answers = (
        found.groupBy("asked", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("at", F.row_number().over(best_first))
        .filter(F.col("at") <= k + 1)
        .groupBy("asked")
        .agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    )
    keyed = groups.join(answers, "asked").select("embedding", "n", "found")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = spread_join(queries.select("embedding", F.col("vec_id").alias("query_id")), keyed, "embedding", "n", total)
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)
