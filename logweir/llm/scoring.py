"""Operator 6: language-model scores by masked pseudo-likelihood.

A document's score is the sum, over its words, of the log-probability of the word given the two
words on each side of it. A bidirectional window network, trained in numpy, sees the words
around the masked one and predicts, by a two-level softmax of ``GROUPS`` times ``GROUPS``, its
leaf; the most frequent words have leaves of their own, every other word shares one with the
words of its ending. Of a shared leaf a word has the share of its count in all other
documents, smoothed: what a document says alone doesn't make it likely.

All of this comes from every document and grows with the corpus. The words are counted over the
whole corpus, in a table without a limit. The ``KNOWN`` most frequent ones, at most, are sent
to the tasks with their counts; the words outside are joined with the table by hash. The
network has a fixed size, but learns from every word of every document, once: in each of
``ROUNDS`` every task takes steps over its own words of a part of the documents, all from the
same parameters, and the results are averaged in two levels, embeddings by the counts behind
them. It starts as the model that knows the leaves' frequencies only.

Defined cases: words are runs without ASCII white space, in lower case; a null, empty or blank
text has no words, the score 0 and no mean; the ends of a text are a mark of their own, which is
seen and never predicted; repeated rows count, and score, each for itself, so each knows the
words of the others; an empty table gives an empty table; other columns are ignored, whatever
their names. Scores are the same for every run over the same rows and partitions, up to
floating-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import checkpointed, table

#: Words that are sent to the tasks with their counts, at most; the others are joined.
KNOWN = 65_536
#: Groups of the softmax and leaves in a group; the first half of the groups has a word a leaf.
GROUPS = 32
LEAVES = GROUPS * GROUPS
OWN = LEAVES // 2
#: What is seen beyond the ends of a text.
END = LEAVES
SIDES = (-2, -1, 1, 2)
HIDDEN = 16
#: Words a step takes at first and at most; the number doubles every ``SAME`` steps.
BATCH = 1024
MOST_BATCH = 8_192
SAME = 30
ROUNDS = 3
RATE = 0.2
#: Count of a word that no other document has.
UNSEEN = 0.5
#: Results that meet on the driver in a round.
MEETING = 16
#: Distinct words that a task holds before it hands them on.
HELD_WORDS = 500_000


def _tokens(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _lowered(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.encode(F.lower("text"), "UTF-8").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8 bytes, lower case) and n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        flushed = lambda: pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"]
        )
        for batch in batches:
            for text in batch.column(0):
                held.update(_tokens(text.as_py()))
                if len(held) > HELD_WORDS:
                    yield flushed()
                    held.clear()
        yield flushed()

    return _lowered(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_leaf(word: bytes) -> int:
    """The leaf of a word without one of its own: the group by its last two letters, the leaf by its last three."""
    return OWN + zlib.crc32(word[-2:]) % (GROUPS // 2) * GROUPS + zlib.crc32(word[-3:]) % GROUPS


@dataclass(frozen=True)
class Vocabulary:
    """Leaf and count of the known words; tokens and types of every leaf over the whole corpus."""

    known: dict[bytes, tuple[int, int]]
    tokens: np.ndarray
    types: np.ndarray

    @classmethod
    def of(cls, words: list[tuple[bytes, int]], tokens: np.ndarray, types: np.ndarray) -> Vocabulary:
        """``words`` by falling count; the arrays count the other words by leaf."""
        tokens, types, known = tokens.astype(np.float64), types.astype(np.float64), {}
        # Words with leaves of their own lie by their endings, so that those of a group are alike.
        own = {w: i for i, w in enumerate(sorted((w for w, _ in words[:OWN]), key=lambda w: w[::-1]))}
        for word, n in words:
            leaf = own.get(word, -1)
            leaf = shared_leaf(word) if leaf < 0 else leaf
            known[word] = (leaf, n)
            tokens[leaf] += n
            types[leaf] += 1
        return cls(known, tokens, types)

    @classmethod
    def fitted(cls, counts: DataFrame, most: int = KNOWN) -> Vocabulary:
        """The words at or above the lowest count step (of an eighth of an octave) that fits, and sums over the rest."""
        step = F.floor(F.log2("n") * 8).cast("int")
        steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
        kept, low = 0, None
        for r in steps:
            if kept + r["count"] > most:
                break
            kept, low = kept + r["count"], r["step"]
        found = [] if low is None else counts.filter(step >= low).collect()
        words = sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, types = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
            for batch in batches:
                at = np.fromiter((shared_leaf(w.as_py()) for w in batch.column(0)), np.int64, batch.num_rows)
                np.add.at(tokens, at, batch.column(1).to_numpy())
                np.add.at(types, at, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEAVES)), pa.array(tokens), pa.array(types)], names=["leaf", "tokens", "types"])

        rest = counts if low is None else counts.filter(step < low)
        sums = rest.mapInArrow(leaves, "leaf long, tokens long, types long").groupBy("leaf").agg(F.sum("tokens"), F.sum("types"))
        tokens, types = np.zeros(LEAVES), np.zeros(LEAVES)
        for leaf, n, m in sums.collect():
            tokens[leaf], types[leaf] = n, m
        return cls.of(words, tokens, types)


class Lookup(dict):
    """Word to code; leaf and count (-1 where it isn't known) by code, and the words outside by code from ``first`` on."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(zip(vocabulary.known, range(len(vocabulary.known))))
        self.first = len(self)
        self.leaf = np.zeros(self.first + HELD_WORDS, np.int64)
        self.count = np.full(self.first + HELD_WORDS, -1, np.int64)
        if self.first:
            self.leaf[: self.first], self.count[: self.first] = zip(*vocabulary.known.values())
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self.first + len(self.words)
        if code == len(self.leaf):
            self.leaf, self.count = (np.concatenate((x, np.full(len(x), -1))) for x in (self.leaf, self.count))
        self[word], self.leaf[code] = code, shared_leaf(word)
        self.words.append(word)
        return code

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all words, and words per text. Earlier codes of words outside may lose their meaning."""
        if len(self.words) > HELD_WORDS // 2:
            for word in self.words:
                del self[word]
            self.words = []
        own = [_tokens(text.as_py()) for text in texts]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(own)), np.int64, int(sizes.sum())), sizes

    def marked(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The leaves of the words, with two end marks before, between and after texts."""
        ids = np.full(len(codes) + 2 * len(sizes) + 2, END)
        ids[np.arange(len(codes)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = self.leaf[codes]
        return ids


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves around (words, sides) and leaf of every word between end marks."""
    at = np.flatnonzero(ids != END)
    return ids[at[:, None] + np.array(SIDES)], ids[at]


class Network:
    """Two-level softmax over tanh(sum of side embeddings): group, then leaf within the group."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.embed, self.bias, self.out, self.out_bias, self.leaf, self.leaf_bias = parts

    @classmethod
    def started(cls, tokens: np.ndarray, seed: int = 0) -> Network:
        """A network that predicts the leaves' frequencies, whatever it sees."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
        share = np.log((tokens + 0.1).reshape(GROUPS, GROUPS))
        group = np.log((tokens + 0.1).reshape(GROUPS, GROUPS).sum(axis=1))
        zero = np.zeros((HIDDEN, GROUPS), np.float32)
        return cls([
            small(len(SIDES), LEAVES + 1, HIDDEN), np.zeros(HIDDEN, np.float32), zero, (group - group.max()).astype(np.float32),
            np.zeros((GROUPS, HIDDEN, GROUPS), np.float32), (share - share.max(axis=1, keepdims=True)).astype(np.float32),
        ])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        found = np.take(self.embed[0], around[:, 0], axis=0)
        for p in range(1, len(SIDES)):
            found += np.take(self.embed[p], around[:, p], axis=0)
        found += self.bias
        return np.tanh(found, out=found)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        """Of each row; the largest logit of all is taken off, as rows of one batch are of one size."""
        logits -= logits.max()
        np.exp(logits, out=logits)
        logits /= np.maximum(logits.sum(axis=1, keepdims=True), 1e-30)
        return logits

    @staticmethod
    def _log_of(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log of the softmax at one place of each row."""
        logits -= logits.max(axis=1, keepdims=True)
        chosen = logits[np.arange(len(at)), at].astype(np.float64)
        return chosen - np.log(np.exp(logits, out=logits).sum(axis=1))

    def log_probabilities(self, around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each leaf, given the leaves around it."""
        cuts = range(0, len(leaf), MOST_BATCH)
        return np.concatenate([self._log_probabilities(around[c : c + MOST_BATCH], leaf[c : c + MOST_BATCH]) for c in cuts] or [np.zeros(0)])

    def _log_probabilities(self, around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        hidden = self.hidden(around)
        group, inside = leaf // GROUPS, leaf % GROUPS
        out = self._log_of(hidden @ self.out + self.out_bias, group)
        order, names, starts = _by_group(group)
        seen, inside, inner = hidden[order], inside[order], np.empty(len(leaf))
        for g, x, y in zip(names, starts, [*starts[1:], len(order)]):
            inner[x:y] = self._log_of(seen[x:y] @ self.leaf[g] + self.leaf_bias[g], inside[x:y])
        out[order] += inner
        return out

    def gradient(self, around: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of the mean negative log-likelihood: by the hidden input of each word, and by the parts after the embeddings."""
        n, hidden = np.float32(len(leaf)), self.hidden(around)
        group, inside = leaf // GROUPS, leaf % GROUPS
        wrong = self._softmax(hidden @ self.out + self.out_bias)
        wrong[np.arange(len(leaf)), group] -= 1
        back = wrong @ self.out.T
        by_leaf, by_leaf_bias = np.zeros_like(self.leaf), np.zeros_like(self.leaf_bias)
        order, names, starts = _by_group(group)
        seen, inside, inner = hidden[order], inside[order], np.empty_like(back)
        for g, x, y in zip(names, starts, [*starts[1:], len(order)]):
            own = self._softmax(seen[x:y] @ self.leaf[g] + self.leaf_bias[g])
            own[np.arange(y - x), inside[x:y]] -= 1
            inner[x:y] = own @ self.leaf[g].T
            by_leaf[g], by_leaf_bias[g] = seen[x:y].T @ own, own.sum(axis=0)
        back[order] += inner
        back *= (1 - hidden * hidden) / n
        return back, [back.sum(axis=0), hidden.T @ wrong / n, wrong.sum(axis=0) / n, by_leaf / n, by_leaf_bias / n]


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """The order of positions by group, the groups there are, and where each starts."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    names, starts = np.unique(group[order], return_index=True)
    return order, names.tolist(), starts.tolist()


class Trainer:
    """Steps of a network by Adagrad, over batches of words as they come."""

    def __init__(self, network: Network, rate: float):
        self.network = Network([p.copy() for p in network.parts])
        self.rate, self.squares = np.float32(rate), [np.full_like(p, 1e-8) for p in network.parts]
        self.seen, self.predicted = np.zeros(LEAVES + 1), np.zeros(LEAVES)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.steps = 0

    @property
    def batch(self) -> int:
        return min(BATCH << self.steps // SAME, MOST_BATCH)

    def learn(self, around: np.ndarray, leaf: np.ndarray) -> None:
        self.rest.append((around, leaf))
        self.held += len(leaf)
        if self.held >= self.batch:
            self._steps(False)

    def finish(self) -> Network:
        self._steps(True)
        return self.network

    def _steps(self, last: bool) -> None:
        if not self.held:
            return
        around, leaf = (np.concatenate(c) for c in zip(*self.rest))
        at = 0
        while at + self.batch <= len(leaf) or (last and at < len(leaf)):
            step = slice(at, at + self.batch)
            at = step.stop
            self._step(around[step], leaf[step])
            self.steps += 1
        self.rest, self.held = [(around[at:], leaf[at:])], max(0, len(leaf) - at)

    def _step(self, around: np.ndarray, leaf: np.ndarray) -> None:
        parts, squares = self.network.parts, self.squares
        back, grads = self.network.gradient(around, leaf)
        for p in range(len(SIDES)):
            order = np.argsort(around[:, p].astype(np.int16), kind="stable")
            rows, starts = np.unique(around[order, p], return_index=True)
            g = np.add.reduceat(back[order], starts, axis=0)
            squares[0][p][rows] += g * g
            parts[0][p][rows] -= self.rate * g / np.sqrt(squares[0][p][rows])
        for part, square, g in zip(parts[1:], squares[1:], grads):
            square += g * g
            part -= self.rate * g / np.sqrt(square)
        self.seen += np.bincount(around[:, 1], minlength=LEAVES + 1)
        self.predicted += np.bincount(leaf, minlength=LEAVES)


def _weights(seen: np.ndarray, predicted: np.ndarray) -> list[np.ndarray]:
    """The counts behind each part, shaped to multiply it."""
    n, groups = predicted.sum(), predicted.reshape(GROUPS, GROUPS).sum(axis=1)
    return [seen[None, :, None], n, n, n, groups[:, None, None], groups[:, None]]


class Average:
    """Sums of networks, each part by the counts behind it."""

    def __init__(self, like: list[np.ndarray]):
        self.sums = [np.zeros(p.shape) for p in like]
        self.seen, self.predicted = np.zeros(LEAVES + 1), np.zeros(LEAVES)

    @property
    def arrays(self) -> list[np.ndarray]:
        return [*self.sums, self.seen, self.predicted]

    def add(self, network: Network, seen: np.ndarray, predicted: np.ndarray) -> None:
        for s, p, w in zip(self.sums, network.parts, _weights(seen, predicted)):
            s += p * w
        self.seen += seen
        self.predicted += predicted

    def merge(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, "<f4"), 0
        for a in self.arrays:
            a += flat[at : at + a.size].reshape(a.shape)
            at += a.size

    def write(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays]).astype("<f4").tobytes()

    def network(self, before: Network) -> Network:
        mixed = zip(self.sums, before.parts, _weights(self.seen, self.predicted))
        return Network([np.where(w > 0, s / np.maximum(w, 1e-9), p).astype(np.float32) for s, p, w in mixed])


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """The network after every document was seen once; it has a fixed size."""
    network, context = Network.started(vocabulary.tokens), docs.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds))
    for k in range(rounds):
        sent = context.broadcast((vocabulary, network, rate * 0.7**k))

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, now, step = sent.value  # noqa: B023
            trainer, look = Trainer(now, step), Lookup(known)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    trainer.learn(*windows(look.marked(*look.codes(batch.column(0).slice(at, 256)))))
            made = Average(now.parts)
            made.add(trainer.finish(), trainer.seen, trainer.predicted)
            if made.predicted.any():
                yield _row(TaskContext.get().partitionId() % MEETING, made.write())

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, some = Average(sent.value[1].parts), False  # noqa: B023
            for batch in batches:
                for data in batch.column(1):
                    made.merge(data.as_py())
                    some = True
            if some:
                yield _row(0, made.write())

        own = _lowered(docs.filter(part == k)).mapInArrow(steps, "at int, made binary")
        total = Average(network.parts)
        for r in sorted(bytes(r["made"]) for r in own.repartition(MEETING, "at").mapInArrow(meet, "at int, made binary").collect()):
            total.merge(r)
        network = total.network(network)
        sent.unpersist()
    return network


def _row(at: int, made: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([made], pa.binary())], names=["at", "made"])


def word_hash(word: bytes) -> int:
    """Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def log_share(n: np.ndarray, own: np.ndarray, tokens: np.ndarray, own_tokens: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Log of a word's share of its leaf over all other documents."""
    return np.log(n - own + UNSEEN) - np.log(tokens - own_tokens + UNSEEN * (types + 1))


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of every row.

    A task gives each row its sum over what it knows, and each word outside with its numbers in
    the document; those meet the table of all counts by the word's hash.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, network))
    names = ["row", "doc_id", "h", "own", "tokens", "n_words", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = sent.value
        look = Lookup(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, docs_ = part.column(0).to_numpy(), part.column(1)
                codes, sizes = look.codes(part.column(2))
                of = np.repeat(np.arange(len(sizes)), sizes)
                total = np.bincount(of, net.log_probabilities(*windows(look.marked(codes, sizes))), len(sizes))
                # Words of shared leaves: how often each, and its leaf, is in its text.
                shared = np.flatnonzero(look.leaf[codes] >= OWN)
                pair, n = np.unique(of[shared] * (1 << 32) + codes[shared], return_counts=True)
                text, code = pair >> 32, pair & ((1 << 32) - 1)
                leaf, count = look.leaf[code], look.count[code]
                _, where = np.unique(text * LEAVES + leaf, return_inverse=True)
                own_tokens = np.bincount(where, n)[where] if len(where) else n
                tokens, types = words.tokens[leaf], words.types[leaf]
                known = count >= 0
                found = n[known] * log_share(count[known], n[known], tokens[known], own_tokens[known], types[known])
                total += np.bincount(text[known], found, len(sizes))
                out = np.flatnonzero(~known)
                hashes = np.fromiter((word_hash(look.words[c]) for c in (code[out] - look.first).tolist()), np.int64, len(out))
                rest = tokens[out] - own_tokens[out] + UNSEEN * (types[out] + 1)
                # A row for each word outside, then one for each text with what is known; a text's own
                # number keeps such rows apart in the join.
                both = lambda a, b: pa.array(np.concatenate((a, b)))
                none = np.zeros(len(out))
                yield pa.RecordBatch.from_arrays([
                    both(rows[text[out]], rows),
                    pa.concat_arrays([pa.nulls(len(out), docs_.type), docs_]),
                    both(hashes, rows),
                    both(n[out], np.zeros(len(rows), np.int64)),
                    both(rest, np.ones(len(rows))),
                    both(none.astype(np.int64), sizes),
                    both(none, total),
                ], names=names)

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _lowered(numbered, "row", "doc_id").mapInArrow(
        run, f"row long, doc_id {kind}, h long, own long, tokens double, n_words long, known double"
    )
    table_ = counts.select(F.xxhash64("word").alias("h"), "n").groupBy("h").agg(F.max("n").alias("n"))
    share = F.log(F.coalesce("n", F.lit(0)) - F.col("own") + UNSEEN) - F.log("tokens")
    found = F.when(F.col("own") == 0, F.col("known")).otherwise(F.col("own") * share)
    sums = rows.join(table_.hint("merge"), "h", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum(found).alias("log_likelihood")
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return sums.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = checkpointed(word_counts(docs))
    vocabulary = Vocabulary.fitted(counts)
    return score(docs, counts, vocabulary, train(docs, vocabulary))
