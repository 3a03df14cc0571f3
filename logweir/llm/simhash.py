"""Operator 4: SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes have
it. Fingerprints within ``max_bits`` of each other are linked and the linked components are
the near-duplicate classes.

Finding the links. Distinct fingerprints only are compared, so exact copies cost nothing.
The 64 bits are cut into ``blocks``; two fingerprints that differ in k bits agree on at least
``blocks - k`` whole blocks, so each is filed once under every choice of that many blocks and
no link can be missed. The pivot distance table - the Hamming distances of every distinct
fingerprint to fixed reference fingerprints, computed once - discards a pair of a file when any
coordinate differs by more than k, which by the triangle inequality loses no link; survivors
are verified. A file
is searched breadth first over its unvisited members and gives the edges of a spanning
forest, not its pairs: a dense ball of near copies costs about one pass over its members. A
file too large for one task is cut into blocks, every two of which meet.
Components of the edges are found by alternating large-star and small-star steps, written to
the shared checkpoint folder. Keys that hold a large share of the rows - a file, a class, a
fingerprint of many copies - are joined by ``spread_join``, which keeps them spread.

Defined cases: null and empty texts have fingerprint zero, linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows share a fingerprint and so a class;
a class is named by its smallest doc_id (nulls apart); an empty table gives an empty table;
other columns are ignored by ``classes`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import checkpointed, row_id, spread_join, table

#: Hamming distance that links two fingerprints, and shingle length, of the op4 query.
MAX_BITS = 4
QUERY_SHINGLE = 4
#: Three of seven blocks agree: 35 files a fingerprint, under keys of 27 or 28 bits.
BLOCKS = 7
N_PIVOTS = 16
#: Shingles counted at once, which bounds the memory a long text takes.
CHUNK = 1 << 15


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: the XXH64 of the numbers from zero."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(n)], dtype=np.uint64)


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The fingerprint of one text (bytes.lower and bytes.split treat ASCII letters and white space only)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens) - shingle + 1
    if not tokens:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        parts = [joined[a:b] for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint(text: Column, shingle: int) -> Column:
    """64-bit fingerprint of a text column, as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint_of(t, shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return of(text)


def block_masks(blocks: int, agree: int) -> list[int]:
    """One bit mask for each choice of ``agree`` out of ``blocks`` nearly equal bit blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column) -> Column:
    """The Hamming distances of a fingerprint to the pivots, a byte each, as an array of longs."""
    apart = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(p))))).cast("long") for p in pivots()]
    packed = lambda xs: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, 8 * i) for i, x in enumerate(xs)])
    return F.array(*[packed(apart[i : i + 8]) for i in range(0, N_PIVOTS, 8)])


#: Members of a file that one task compares with as many others: a share of all filed, within bounds.
FILE_BLOCK = (512, 16_384)
FILE_SHARE = 64


def met(filed: DataFrame, keys: list[str], member: str, *carried: str) -> DataFrame:
    """One row for every two blocks of a file: split and the lists ``member`` and ``carried``.

    A file that holds a large share of all rows is cut into blocks by hash and every two blocks
    meet in a row of their own, so memory stays bounded and no pair is left out. Rows are spread
    by file and blocks, so that a large file is the work of many tasks. The first ``split``
    members are of one block and the rest of the other; it is zero where a block meets itself.
    """
    sizes = checkpointed(filed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block = min(max(FILE_BLOCK[0], total // FILE_SHARE), FILE_BLOCK[1])
    blocks = sizes.select(*keys, "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own, other = F.col("own"), F.col("other")
    spread = (
        spread_join(filed, blocks, keys, "n", total)
        .withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*keys, member, *carried, F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own > other).alias("late"))
        .repartition(*keys, "i", "j")
    )
    rows = spread.groupBy(*keys, "i", "j").agg(F.sort_array(F.collect_list(F.struct("late", member, *carried))).alias("m"))
    first = F.size(F.filter("m", lambda x: ~x["late"]))
    split = F.when(F.col("i") == F.col("j"), 0).otherwise(first).cast("int")
    listed = lambda c: F.col("m")[c].alias(c)
    return rows.filter(F.size("m") > 1).select(split.alias("split"), *map(listed, (member, *carried)))


def forest_of(members: np.ndarray, table_: np.ndarray, split: int, max_bits: int) -> list[tuple[int, int]]:
    """Spanning-forest edges (as positions) of the links in a file, or between its first ``split`` members and the rest."""

    def near(at: int, other: np.ndarray) -> np.ndarray:
        other = other[np.abs(table_[other] - table_[at]).max(axis=1) <= max_bits]
        return other[np.bitwise_count(members[other] ^ members[at]) <= max_bits]

    return _spanning(len(members), split, near)


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) with a > b: edges that connect every pair of linked fingerprints.

    ``prints`` has distinct non-null longs in ``fp``.
    """
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(blocks, blocks - max_bits)])
    tabled = checkpointed(prints.select("fp", pivot_table(F.col("fp")).alias("pivots")))
    filed = tabled.select("fp", "pivots", F.posexplode(masks).alias("file", "mask")).select(
        "fp", "pivots", "file", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            splits, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            packed = batch.column(2).flatten().flatten().to_numpy(zero_copy_only=False)
            table_ = packed.astype("<i8").view(np.uint8).reshape(-1, N_PIVOTS).astype(np.int16)
            offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            sizes = np.diff(offsets)
            # Files of two are most of all: their pairs go through the table together.
            first = offsets[:-1][sizes == 2]
            first = first[np.abs(table_[first] - table_[first + 1]).max(axis=1) <= max_bits] if len(first) else first
            first = first[np.bitwise_count(flat[first] ^ flat[first + 1]) <= max_bits]
            a, b = [flat[first].view(np.int64)], [flat[first + 1].view(np.int64)]
            for i in np.flatnonzero(sizes > 2).tolist():
                at = slice(offsets[i], offsets[i + 1])
                if edges := forest_of(flat[at], table_[at], int(splits[i]), max_bits):
                    pairs = flat[at].view(np.int64)[np.array(edges)]
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
            )

    found = met(filed, ["file", "key"], "fp", "pivots").mapInArrow(search, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node but the roots.

    ``edges`` has (a, b) with a > b. Large-star links every larger neighbour of a node to its
    smallest one and small-star every smaller neighbour; when neither changes anything all
    trees are stars. The number of rounds grows with the logarithm of the diameter.
    """
    state, seen = checkpointed(edges), None
    while True:
        summary = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summary == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = summary
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = checkpointed(small.unionByName(floor.select("a", F.col("m").alias("b"))).distinct())


def grouped(trees: DataFrame) -> DataFrame:
    """(node, root) of every node of a component, its root among them."""
    return checkpointed(trees.unionByName(trees.select(F.col("root").alias("node"), "root").distinct()))


def classes(
    docs: DataFrame, shingle: int = QUERY_SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS
) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = checkpointed(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    members = grouped(components(links(nodes.select("fp"), max_bits, blocks))).withColumnRenamed("node", "fp")
    firsts = nodes.select("fp", "first").join(members, "fp")
    named = firsts.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m"))
    linked = spread_join(members, named, "root", "m", members.count()).drop("root")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n")
    return spread_join(prints, checkpointed(labels), "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Wide sketches: near-duplicates by similarity of word shingles rather than by a bit radius.

#: Shingle length of near-duplicate stages, the Jaccard similarity that links, and sketch width.
SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4
#: Sketches only choose which pairs are compared. A pair of shingle sets with Jaccard similarity J
#: has cosine 2J / (1 + J) or more; at 0.8 the angle is 27 degrees, 39 of 256 bits on average with
#: a deviation of 5.7. The radius is 4.4 deviations above: of pairs at 0.8 it loses 2 in 100,000,
#: of sets under 25 shingles 1 in 10,000 (5 in 1,000 where one has four and the other five).
SKETCH_BITS = 64
#: The smallest shingle hashes of a text; texts of similarity 0.8 share one of eight but for 0.2**8.
ANCHORS = 8
#: Shingle hashes of a candidate class that one task compares with as many others.
SET_BLOCK = 1 << 22


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 hashes of a text's distinct shingles, sorted; never empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(tokens) - shingle + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    if len(tokens) <= shingle:
        parts = [joined]
    else:
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        parts = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts)))


def sketch_of(hashes: np.ndarray) -> list[int]:
    """Four fingerprint words over distinct shingle hashes, as signed longs."""
    words = []
    for w in range(WORDS):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(mixed), CHUNK):
            bits = np.unpackbits(mixed[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        words.append(_signed(sum(1 << i for i in np.flatnonzero(2 * counts > len(mixed)).tolist())))
    return words


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """__row (id and text digest), doc_id, node, size, sketch, pivots and anchors of every row.

    ``node`` is a digest of the whole shingle set, ``size`` the number of its shingles and
    ``pivots`` the sketch's row of the pivot distance table.
    """
    refs = np.random.default_rng(0).integers(0, 1 << 64, (N_PIVOTS, WORDS), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch in batches:
            node, size, sketch, distances, anchors = [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), shingle)
                node.append(xxhash.xxh3_128_hexdigest(hashes.astype("<u8").tobytes()))
                size.append(len(hashes))
                sketch.append(sketch_of(hashes))
                distances.append(_apart(np.array(sketch[-1], np.int64).view(np.uint64), refs).tolist())
                anchors.append(hashes[:ANCHORS].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.string()), pa.array(size, pa.int64()), pa.array(sketch, lists), pa.array(distances, pa.list_(pa.int16())), pa.array(anchors, lists)],
                names=["__row", "doc_id", "node", "size", "sketch", "pivots", "anchors"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(row_id().alias("__row"), "doc_id", "text").mapInArrow(
        run, f"__row string, doc_id {kind}, node string, size bigint, sketch array<bigint>, pivots array<smallint>, anchors array<bigint>"
    )


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _spanning(n: int, split: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning-forest edges of a relation among ``n`` members, or between the first ``split`` and the rest.

    ``near(at, other)`` picks from ``other`` the members related to ``at``.
    """
    left = np.arange(n)
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            related = near(at, left if split == 0 else left[(left < split) != (at < split)])
            found = related.tolist()
            edges += [(at, x) for x in found]
            queue += found
            if found:
                left = np.setdiff1d(left, related, assume_unique=True)
    return edges


def _of_like_size(sizes: np.ndarray, at: int, other: np.ndarray, similarity: float) -> np.ndarray:
    """Sets of a Jaccard similarity are as similar in size."""
    low, high = np.minimum(sizes[other], sizes[at]), np.maximum(sizes[other], sizes[at])
    return other[low >= similarity * high - 1e-9]


def wide_forest(
    sketch: np.ndarray, table_: np.ndarray, sizes: np.ndarray, split: int, max_bits: int, similarity: float
) -> list[tuple[int, int]]:
    """Spanning-forest edges of the candidate pairs in a file, or between its first ``split`` members and the rest."""

    def near(at: int, other: np.ndarray) -> np.ndarray:
        other = _of_like_size(sizes, at, other, similarity)
        other = other[np.abs(table_[other] - table_[at]).max(axis=1) <= max_bits]
        return other[_apart(sketch[other], sketch[at]) <= max_bits]

    return _spanning(len(sketch), split, near)


def exact_forest(
    sets: list[np.ndarray], sketch: np.ndarray, split: int, max_bits: int, similarity: float
) -> list[tuple[int, int]]:
    """Spanning-forest edges of the candidate pairs whose sorted shingle sets are that similar."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))

    def near(at: int, other: np.ndarray) -> np.ndarray:
        other = _of_like_size(sizes, at, other, similarity)
        other = other[_apart(sketch[other], sketch[at]) <= max_bits]
        mine, kept = sets[at], []
        # As many sets at once as about CHUNK hashes take.
        step = max(1, CHUNK // len(mine))
        for some in (other[i : i + step] for i in range(0, len(other), step)):
            joined = np.concatenate([sets[x] for x in some.tolist()])
            at_or_after = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            shared = np.add.reduceat((mine[at_or_after] == joined).astype(np.int64), starts)
            kept.append(some[shared >= similarity * (sizes[some] + len(mine) - shared) - 1e-9])
        return np.concatenate(kept) if kept else other

    return _spanning(len(sets), split, near)


def wide_links(nodes: DataFrame, max_bits: int = SKETCH_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) with a > b: edges that connect the candidate pairs of nodes (node, size, sketch, pivots, anchors).

    Nodes are filed under each anchor. A candidate pair meets in a file, is near by sketch and
    alike in size; whether it is similar is left to ``similar_links``.
    """
    filed = nodes.select("node", "size", "sketch", "pivots", F.explode("anchors").alias("key"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for split, names, size, sketch, pivot in zip(*(batch.column(n) for n in ("split", "node", "size", "sketch", "pivots"))):
                flat, ids = np.array(sketch.as_py(), np.int64).view(np.uint64), names.as_py()
                table_ = np.array(pivot.as_py(), np.int16)
                for x, y in wide_forest(flat, table_, np.array(size.as_py()), split.as_py(), max_bits, similarity):
                    a.append(max(ids[x], ids[y]))
                    b.append(min(ids[x], ids[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return met(filed, ["key"], "node", "size", "sketch", "pivots").mapInArrow(search, "a string, b string").distinct()


def similar_links(
    docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, max_bits: int = SKETCH_BITS, similarity: float = SIMILARITY
) -> DataFrame:
    """(a, b) with a > b: edges that connect the nodes whose shingle sets have that Jaccard similarity.

    ``nodes`` has node, size, sketch, anchors and the ``__row`` of a text with that shingle set.
    Classes of candidates are found first. The shingle sets of a class then meet, each hashed
    from its text again, and are compared whole. A class of more than ``SET_BLOCK`` hashes is
    cut into blocks, every two of which meet, so memory is bounded and no pair is left out.
    """
    members = grouped(components(wide_links(nodes, max_bits, similarity)))
    asked = checkpointed(nodes.select("node", "size", "sketch", "__row").join(members, "node"))
    blocks = asked.groupBy("root").agg(
        F.ceil(F.sum("size") / SET_BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")
    )
    placed = spread_join(asked, blocks, "root", "n", asked.count()).drop("size")
    texts = docs.select(row_id().alias("__row"), "text").join(placed, "__row")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(made, pa.list_(pa.int64()))], names=["root", "blocks", "node", "sketch", "hashes"]
            )

    sets = texts.select("root", "blocks", "node", "sketch", "text").mapInArrow(
        hashed, "root string, blocks int, node string, sketch array<bigint>, hashes array<bigint>"
    )
    own, other = F.col("own"), F.col("other")
    meeting = (
        sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own > other).alias("late"), "node", "sketch", "hashes")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j", "late", "node")
    )

    def compared(rows: pa.Table, a: list[str], b: list[str]) -> None:
        ids, late = rows["node"].to_pylist(), rows["late"].to_pylist()
        # A row that occurs again brings its set again.
        first = [x for x in range(len(ids)) if x == 0 or ids[x] != ids[x - 1]]
        split = sum(not late[x] for x in first) if rows["i"][0] != rows["j"][0] else 0
        sketch = np.array([rows["sketch"][x].as_py() for x in first], np.int64).view(np.uint64)
        hashes = [rows["hashes"][x].values.to_numpy().view(np.uint64) for x in first]
        for x, y in exact_forest(hashes, sketch, split, max_bits, similarity):
            x, y = ids[first[x]], ids[first[y]]
            a.append(max(x, y))
            b.append(min(x, y))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, []
        for batch in batches:
            a, b = [], []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j"))))
            cuts = [x for x in range(len(keys)) if x == 0 or keys[x] != keys[x - 1]]
            for x, y in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[x] != open_:
                    if held:
                        compared(pa.Table.from_batches(held), a, b)
                    open_, held = keys[x], []
                held.append(batch.slice(x, y - x))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
        if held:
            a, b = [], []
            compared(pa.Table.from_batches(held), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return meeting.mapInArrow(search, "a string, b string").distinct()


def drop_copies(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = SKETCH_BITS, similarity: float = SIMILARITY
) -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest doc_id (nulls last, then text digest)."""
    made = checkpointed(sketches(docs, shingle))
    one = lambda c: F.first(c).alias(c)
    nodes = checkpointed(made.groupBy("node").agg(one("size"), one("sketch"), one("pivots"), one("anchors"), F.min("__row").alias("__row")))
    trees = components(similar_links(docs, nodes, shingle, max_bits, similarity)).withColumnRenamed("node", "n")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best")
    firsts = made.groupBy("node").agg(best)
    rooted = firsts.join(trees, firsts["node"] == trees["n"], "left").select(F.coalesce("root", "node").alias("root"), "best")
    keepers = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.__row").alias("__row"))
    kept = docs.withColumn("__row", row_id()).join(keepers, "__row", "left_semi")
    return kept.dropDuplicates(["__row"]).drop("__row")
