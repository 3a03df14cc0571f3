"""Settings from text or numbers, case-insensitive and with defaults, and values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of settings; the first of each is the default.
CODECS = ("none", "gzip", "snappy", "lz4", "zstd")
MODES = ("local_only", "shadow")
SYNC_MODES = ("async", "sync")
WRITE_MODES = ("dual_write", "external_only")
READ_COMMITTED = 1


def one_of(text: Column, names: tuple[str, ...]) -> Column:
    """The name that a text is in lower case, or the first name."""
    low = F.lower(text)
    return F.when(low.isin(*names), low).otherwise(F.lit(names[0]))


def isolation(level: Column) -> Column:
    return F.when(level == READ_COMMITTED, "read_committed").otherwise("read_uncommitted")


def to_text(value: Column) -> Column:
    """Bytes as UTF-8 text; null stays null."""
    return F.decode(value, "UTF-8")


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")
