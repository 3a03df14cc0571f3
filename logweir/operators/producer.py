"""Idempotent producers: sequence validation, epoch fencing and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.sources.log import KEYS

INT_MAX = 2**31 - 1
MAX_EPOCH = 32767
PROCEED, DUPLICATE, OUT_OF_ORDER = "proceed", "duplicate", "out_of_order"
# Public protocol error codes.
UNKNOWN_PRODUCER, FENCED, OUT_OF_SEQUENCE = 59, 90, 45


def validate_sequence(last: int, base: int, count: int) -> tuple[str, int]:
    """The outcome of a batch and the last sequence after it; a rejected batch changes nothing."""
    if base < 0 or count < 0:
        return OUT_OF_ORDER, last
    end = base + max(count, 1) - 1
    if base == last + 1:
        return (PROCEED, end) if end <= INT_MAX else (OUT_OF_ORDER, last)
    return (DUPLICATE if end <= last else OUT_OF_ORDER), last


def sequence_outcomes(batches: DataFrame) -> DataFrame:
    """outcome and expected (the next sequence wanted) of produce batches.

    ``batches`` has producer_id, topic_id, partition_id, arrival (unique), base_sequence and
    n_records. Each key is sequential by its meaning; keys are spread over tasks, sorted there
    and streamed through a state of one number, so no key is ever held whole.
    """
    keys = ["producer_id", *KEYS]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, -1
        for rows in frames:
            if rows.empty:
                continue
            ids = rows[keys].to_numpy()
            base, count = (rows[c].to_numpy(np.int64) for c in ("base_sequence", "n_records"))
            end = base + np.maximum(count, 1) - 1
            fresh = np.concatenate(([tuple(ids[0]) != key], (ids[1:] != ids[:-1]).any(axis=1)))
            # A batch that continues the one before it is in sequence if that one was.
            runs_on = np.concatenate(([False], (base[1:] == end[:-1] + 1) & (count[1:] >= 0) & (end[1:] <= INT_MAX))) & ~fresh
            stops = np.append(np.flatnonzero(~runs_on), len(rows))
            outcomes, expected, at = np.empty(len(rows), object), np.empty(len(rows), np.int64), 0
            while at < len(rows):
                last = -1 if fresh[at] else last
                expected[at] = last + 1
                outcomes[at], last = validate_sequence(last, int(base[at]), int(count[at]))
                at += 1
                if outcomes[at - 1] == PROCEED:
                    stop = int(stops[np.searchsorted(stops, at)])
                    if stop > at:
                        outcomes[at:stop], expected[at:stop], last = PROCEED, base[at:stop], int(end[stop - 1])
                        at = stop
            key = tuple(ids[-1])
            yield rows.assign(outcome=outcomes, expected=expected)

    own = batches.select(*keys, "arrival", "base_sequence", "n_records")
    schema = "producer_id long, topic_id int, partition_id int, arrival long, base_sequence long, n_records int, outcome string, expected long"
    return own.repartition(*keys).sortWithinPartitions(*keys, "arrival").mapInPandas(fold, schema)


def deduplicated(batches: DataFrame) -> DataFrame:
    """The batches that are stored: in sequence and not seen before."""
    return sequence_outcomes(batches).filter(F.col("outcome") == PROCEED).drop("outcome", "expected")


def next_sequence(outcomes: DataFrame) -> DataFrame:
    done = outcomes.filter(F.col("outcome") == PROCEED)
    end = F.col("base_sequence") + F.greatest("n_records", F.lit(1))
    return done.groupBy("producer_id", *KEYS).agg(F.max(end).alias("next_sequence"))


def epoch_fence(batches: DataFrame, producers: DataFrame) -> DataFrame:
    """error_code by producer epoch: unknown producers, then older epochs than the current; newer ones pass."""
    known = producers.select("producer_id", F.col("producer_epoch").alias("__epoch"))
    code = (
        F.when(F.col("__epoch").isNull(), UNKNOWN_PRODUCER)
        .when(F.col("producer_epoch") < F.col("__epoch"), FENCED)
        .otherwise(0)
    )
    return batches.join(known, "producer_id", "left").withColumn("error_code", code).drop("__epoch")


def produced(batches: DataFrame, producers: DataFrame) -> DataFrame:
    """error_code, outcome and stored of produce batches: fenced first, then in sequence, then stored.

    A fenced batch does not touch its key's sequence; a duplicate is answered like a success
    but not stored again. ``batches`` also has producer_epoch.
    """
    judged = epoch_fence(batches, producers)
    passed = sequence_outcomes(judged.filter("error_code = 0")).select("arrival", "outcome")
    code = F.when(F.col("outcome") == OUT_OF_ORDER, OUT_OF_SEQUENCE).otherwise(F.col("error_code"))
    return (
        judged.join(passed, "arrival", "left")
        .withColumn("error_code", code)
        .withColumn("stored", F.coalesce(F.col("outcome") == PROCEED, F.lit(False)))
    )


def producer_epochs(inits: DataFrame, max_epoch: int = MAX_EPOCH) -> DataFrame:
    """Latest generation and epoch of each transactional id from its n-th initialisations.

    Beyond the largest epoch a new producer id starts at epoch 0: ``generation`` counts those.
    """
    n = F.count(F.lit(1)) - 1
    return inits.groupBy("txn_id").agg(
        F.floor(n / (max_epoch + 1)).cast("long").alias("generation"), (n % (max_epoch + 1)).cast("int").alias("producer_epoch")
    )
