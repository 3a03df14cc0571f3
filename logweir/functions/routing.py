"""Key hashing, partition routing and percentage sampling as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public 32-bit murmur2 hash and its seed.
SEED = 0x9747B28C
M = 0x5BD1E995
MASK = 0xFFFFFFFF


def hashed(keys: pa.Array) -> np.ndarray:
    """Unsigned murmur2 of each binary key (of a null as of an empty one), word by word for all keys at once."""
    keys = keys.cast(pa.binary())
    _, ends, bytes_ = keys.buffers()
    ends = np.frombuffer(ends, np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    start, n, m = ends[:-1], np.diff(ends), np.uint32(M)
    h, left, at = n.astype(np.uint32) ^ np.uint32(SEED), np.flatnonzero(n >= 4), 0
    byte = lambda where, i: data[where + i].astype(np.uint32) << np.uint32(8 * i)
    while len(left):
        where = start[left] + at
        k = (byte(where, 0) | byte(where, 1) | byte(where, 2) | byte(where, 3)) * m
        k = (k ^ (k >> np.uint32(24))) * m
        h[left] = h[left] * m ^ k
        at += 4
        left = left[n[left] >= at + 4]
    rest = n % 4
    for i in (2, 1, 0):
        some = np.flatnonzero(rest > i)
        h[some] ^= byte(start[some] + n[some] - rest[some], i)
    h[rest > 0] *= m
    h = (h ^ (h >> np.uint32(13))) * m
    return h ^ (h >> np.uint32(15))


def murmur2_udf():
    """The hash as an Arrow function of binary keys."""

    @F.arrow_udf("long")
    def murmur2(keys: pa.Array) -> pa.Array:
        return pa.array(hashed(keys).astype(np.int64), mask=keys.is_null().to_numpy(zero_copy_only=False))

    return murmur2


def murmur2(key: Column) -> Column:
    """Unsigned murmur2 of a string or binary column, as a long; null for null."""
    return murmur2_udf()(key.cast("binary"))


def partition_for(key: Column, partitions: Column, fallback: Column, explicit: Column | None = None) -> Column:
    """The partition of a record.

    An explicit partition of zero or more stands unchecked; without partitions it is 0; a key,
    even an empty one, is hashed with the sign bit masked; a null key goes by ``fallback``
    (a record number), so that reruns agree.
    """
    hashed = murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions
    routed = F.when(partitions <= 0, F.lit(0)).when(key.isNotNull(), hashed).otherwise(F.pmod(fallback, partitions))
    if explicit is not None:
        routed = F.when(explicit >= 0, explicit).otherwise(routed)
    return routed.cast("int")


def forwarded(key: Column, offset: Column, percent: Column) -> Column:
    """Deterministic sampling: what a lower percentage keeps, a higher one keeps too.

    A non-empty key goes by its unmasked hash, a null or empty one by its offset.
    """
    keyed = key.isNotNull() & (F.octet_length(key) > 0)
    bucket = F.when(keyed, murmur2(key) % 100).otherwise(F.abs(offset) % 100)
    return F.when(percent <= 0, F.lit(False)).when(percent >= 100, F.lit(True)).otherwise(bucket < percent)
