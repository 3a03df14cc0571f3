"""Operator 7: sharding by a hierarchical weighted hash tree.

Every document descends region, rack and shard. At a node each child draws
``-ln(u) / weight`` with u a hash of the document id and the child's name, and the smallest
draw wins, so children get documents in proportion to their weights. A child's draw does not
depend on its siblings: when weights change, documents move only between the subtrees whose
weights changed. The number of shards decides the tree: the first ``FOUNDED`` stand in regions
and racks, and each one after them is a region of its own, which takes documents only into
itself.

Defined cases: a null text has no bytes (size 1, checksum 0); null ids hash alike; repeated
ids go to the same shard; an empty table gives an empty table; other columns are ignored by
``assign`` and kept by ``write_sharded``. Columns starting with ``__`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import checkpointed, hash_order, prefix_sums, table


@dataclass(frozen=True)
class Node:
    """An inner node has children and the sum of their weights; a leaf has a shard number."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    @property
    def seed(self) -> np.uint64:
        return np.uint64(xxhash.xxh64_intdigest(self.name.encode()))


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"shard-{shard}", shard=shard, own_weight=weight)


#: Shards that were planned together; those added later are regions of their own.
FOUNDED = 16


def tree(n_shards: int, per_rack: int = 2, racks: int = 2, founded: int = FOUNDED) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` equal shards, numbered in order, then a region for each later shard."""
    planned = min(n_shards, founded)
    rack_nodes = [
        Node(f"rack-{at // per_rack}", tuple(leaf(i) for i in range(at, min(at + per_rack, planned))))
        for at in range(0, planned, per_rack)
    ]
    regions = [Node(f"region-{at // racks}", tuple(rack_nodes[at : at + racks])) for at in range(0, len(rack_nodes), racks)]
    root = Node("root", tuple(regions))
    for shard in range(planned, n_shards):
        root = grow(root, shard)
    return root


def grow(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    rack = Node(f"rack-of-{shard}", (leaf(shard, weight),))
    return Node(root.name, (*root.children, Node(f"region-of-{shard}", (rack,))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def descend(root: Node, hashes: np.ndarray) -> np.ndarray:
    """The shard of each 64-bit document hash."""
    if not root.children:
        return np.full(len(hashes), root.shard, np.int32)
    draws = []
    for child in root.children:
        u = (_mixed(hashes ^ child.seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        draws.append(-np.log(u + 2.0**-54) / child.weight)
    won, out = np.argmin(draws, axis=0), np.empty(len(hashes), np.int32)
    for i, child in enumerate(root.children):
        at = np.flatnonzero(won == i)
        out[at] = descend(child, hashes[at])
    return out


def place(root: Node, doc_id: Column) -> Column:
    """The shard that a document id descends to."""

    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(descend(root, hashes.to_numpy(np.int64).view(np.uint64)))

    return of(F.xxhash64(doc_id))


def assign(docs: DataFrame, root: Node, grown: Node) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot, gapless from 0 in each shard."""
    text = F.coalesce("text", F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        place(root, F.col("doc_id")).alias("shard"),
        place(grown, F.col("doc_id")).alias("grown_shard"),
        hash_order(F.lit("slot"), F.col("doc_id")).alias("__key"),
        F.lit(1).cast("long").alias("__one"),
    )
    numbered = prefix_sums(
        checkpointed(placed), ["shard"], "__key", "__one", "slot", ["doc_id", "size", "text_crc32"]
    )
    return numbered.drop("__key", "__one")


def write_sharded(docs: DataFrame, root: Node, path: str) -> None:
    """Writes the documents as one folder a shard."""
    docs.withColumn("shard", place(root, F.col("doc_id"))).write.partitionBy("shard").parquet(path)


N_SHARDS = 16


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = assign(table(spark, sf_dir, "documents"), tree(N_SHARDS), tree(N_SHARDS + 1))
    return assigned.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )
