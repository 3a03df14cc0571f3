"""Operator 9: sum-of-squares online packing of tokenised documents.

Each Spark partition packs its own documents as they come: whole windows are cut off a long
document, and what is left of it goes to the fill level that minimises the sum of squared
counts of partially filled windows, kept in an array by level (a new window where that is
best). At the end the fullest of the windows that are still open stay as they are and are
topped up with pieces of the emptiest ones, and the last window is cut at powers of two, which
need no padding. ``Packer`` counts the tokens that were placed by level and those of them that
topped up others. No shuffle takes place; open windows are bounded, so a task's memory does
not grow with its input.

Defined cases: a null or empty text is its end token alone; the text of the special token is
the special token; a long text is cut into whole windows and a rest; repeated rows are packed
separately; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweir.llm.common import table

WINDOW = 1024
END_ID = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as merge ranks, by which single words are encoded several times faster.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Above this many open windows a task empties them into full ones.
MAX_OPEN = 8192
#: Above this many cached words a task forgets them.
MAX_WORDS = 1 << 20


class WordEncoder(dict):
    """Token ids of words, as little-endian unsigned 32-bit bytes, encoded when first met.

    The tokenizer's pre-tokens never cross from a character that isn't white space into a
    space, so a text may be cut there, and only there, and the parts encoded on their own.
    """

    cut = staticmethod(re.compile(r"(?<=\S)(?= )").split)
    #: Finds a space that follows white space, at which a text may not be cut.
    bound = staticmethod(re.compile(r"\s ").search)

    def __init__(self, encode: Callable[[str], list[int]], prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = found = np.array(self.encode(self.prefix + word), "<u4").tobytes()
        return found


class Encoder:
    """The tokenizer's ids; words without one of its special tokens go by ``ranks``, where given."""

    def __init__(self, path: str, ranks: str | None):
        tokenizer = Tokenizer.from_file(path)
        slow = lambda word: tokenizer.encode(word, add_special_tokens=False).ids
        encode = slow
        if ranks:
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
            special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            encode = lambda word: slow(word) if any(t in word for t in special) else fast.encode_ordinary(word)
        self.plain, self.spaced = WordEncoder(encode, ""), WordEncoder(encode, " ")

    def encode(self, text: str) -> bytes:
        if WordEncoder.bound(text):
            return b"".join([self.plain[part] for part in WordEncoder.cut(text)])
        words = text.split(" ")
        return self.plain[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))


class Packer:
    """Packs pieces into windows; ``out`` gets (piece, sequence, offset) of every closed window.

    A piece is (doc_id, start, ids as bytes, tokens of its document).
    """

    def __init__(self, first: int, window: int = WINDOW):
        self.window, self.next = window, first
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.out: list[tuple] = []
        self.placed = self.moved = 0

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for piece in pieces:
            self.out.append((*piece, self.next, at))
            at += len(piece[2]) >> 2
        self.next += 1

    def level(self, size: int) -> int:
        """The level whose window gets ``size`` tokens; 0 for a new window."""
        n, room = self.counts, self.window - size
        # Moving a window from h to h + size changes the sum by 2 (n[h + size] - n[h]) + 2, or
        # by 1 - 2 n[h] where it becomes full; a new window changes it by 2 n[size] + 1.
        change = 2 * (n[1 + size : self.window + 1] - n[1 : room + 1]) + 2
        change[-1:] -= 1
        change[n[1 : room + 1] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        return best + 1 if best >= 0 and change[best] < 2 * n[size] + 1 else 0

    def add(self, doc: int | None, ids: bytes) -> None:
        total, width = len(ids) >> 2, 4 * self.window
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            self.close([(doc, at >> 2, ids[at : at + width], total)])
        if whole < len(ids):
            piece, size = (doc, whole >> 2, ids[whole:], total), (len(ids) - whole) >> 2
            level = self.level(size)
            self.placed += size
            pieces = self.open[level].pop() if level else []
            self.counts[level] -= level > 0
            pieces.append(piece)
            if level + size == self.window:
                self.close(pieces)
            else:
                self.open[level + size].append(pieces)
                self.counts[level + size] += 1
            if self.counts.sum() > MAX_OPEN:
                self.flush(False)

    def flush(self, last: bool) -> None:
        """Tops up the fullest open windows with pieces of the emptiest; what is left stays open or is cut up."""
        windows = [(level, pieces) for level in reversed(range(self.window)) for pieces in self.open[level]]
        self.counts[:], self.open = 0, [[] for _ in range(self.window)]
        full = sum(level for level, _ in windows) // self.window
        given = deque(p for _, pieces in windows[full:] for p in pieces)
        for level, pieces in windows[:full]:
            self._take(given, 4 * (self.window - level), pieces)
            self.moved += self.window - level
            self.close(pieces)
        size = sum(len(p[2]) for p in given) >> 2
        if given and not last:
            self.open[size], self.counts[size] = [list(given)], 1
        elif given:
            self._cut(given, size)

    @staticmethod
    def _take(given: deque[tuple], want: int, pieces: list[tuple]) -> None:
        """Moves ``want`` bytes of ids from the front of ``given`` to ``pieces``."""
        while want:
            doc, start, ids, total = given.popleft()
            part, rest = ids[:want], ids[want:]
            pieces.append((doc, start, part, total))
            want -= len(part)
            if rest:
                given.appendleft((doc, start + (len(part) >> 2), rest, total))

    def _cut(self, given: deque[tuple], size: int) -> None:
        """Closes the last window as sequences of power-of-two lengths, largest first."""
        for bit in reversed(range(size.bit_length())):
            if size >> bit & 1:
                pieces: list[tuple] = []
                self._take(given, 4 << bit, pieces)
                self.close(pieces)


PIECES = "doc_id long, start long, tokens binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, ranks: str | None = RANKS) -> DataFrame:
    """The pieces of every document: their ids as little-endian unsigned 32-bit ``tokens``.

    ``ranks`` is the tokenizer's vocabulary as merge ranks; pass None for a tokenizer without.

    ``sequence_id`` numbers the sequences within each partition, from partition * 2**40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        end = np.array([END_ID], "<u4").tobytes()

        def packed() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "start", "tokens", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, encoder.encode(text.as_py() or "") + end)
                if len(packer.out) >= 4096:
                    yield packed()
        packer.flush(True)
        yield packed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        F.expr("octet_length(tokens) div 4").cast("long").alias("length"),
        F.crc32("tokens").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
