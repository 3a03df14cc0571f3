"""Transactions: state by event fold, visibility derived from end markers, timeouts, clean-up.

Events (txn_id, seq, action, at_ms) have the actions init, begin, commit and abort; nothing is
updated in place, every table is a view of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.producer import producer_epochs
from logweir.sources.log import KEYS

BEGIN = "begin"
STATES = {"init": "Empty", BEGIN: "Ongoing", "commit": "CompleteCommit", "abort": "CompleteAbort"}
# Public protocol error codes.
NOT_FOUND, FENCED, INVALID_STATE = 105, 90, 48


def latest_state(events: DataFrame) -> DataFrame:
    """state, started_ms of the open transaction (null when none) and the number of inits minus one as epoch."""
    ended = events.filter(F.col("action") != BEGIN).groupBy("txn_id").agg(F.max("seq").alias("__ended"))
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    open_since = F.min(F.when((F.col("action") == BEGIN) & (F.col("seq") > F.coalesce("__ended", F.lit(-1))), F.col("at_ms")))
    return (
        events.join(ended, "txn_id", "left")
        .groupBy("txn_id")
        .agg(
            F.element_at(state, F.max_by("action", "seq")).alias("state"),
            open_since.alias("started_ms"),
            F.greatest(F.count_if(F.col("action") == "init") - 1, F.lit(0)).cast("long").alias("producer_epoch"),
        )
    )


def visibility(events: DataFrame) -> DataFrame:
    """txn_state of every record written (one a begin event): null committed, aborted, or pending.

    A record's fate is the first end marker of its transactional id after it; an init aborts.
    """
    fate = F.when(F.col("marker").isNull(), "pending").when(F.col("marker") != "commit", "aborted")
    return ended_by(events).select("txn_id", "seq", fate.alias("txn_state"))


def ended_by(events: DataFrame) -> DataFrame:
    """txn_id, seq and marker of every record written: the action that ended its transaction, or null.

    Rows run backwards, so that the frame grows at its end and is not evaluated anew for each row.
    """
    ahead = Window.partitionBy("txn_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    marker = F.last(F.when(F.col("action") != BEGIN, F.col("action")), ignorenulls=True).over(ahead)
    return events.withColumn("marker", marker).filter(F.col("action") == BEGIN).select("txn_id", "seq", "marker")


def begun(requests: DataFrame, states: DataFrame, continuing: bool) -> DataFrame:
    """error_code of (txn_id, producer_epoch, at_ms) requests to begin, and the state and start after them.

    An ongoing transaction may be begun again, keeping its start, only where ``continuing``.
    """
    own = states.select("txn_id", F.col("producer_epoch").alias("__epoch"), F.col("state").alias("__state"), F.col("started_ms").alias("__started"))
    ongoing = F.col("__state") == "Ongoing"
    code = (
        F.when(F.col("__epoch").isNull(), NOT_FOUND)
        .when(F.col("__epoch") != F.col("producer_epoch"), FENCED)
        .when(F.lit(not continuing) & ongoing, INVALID_STATE)
        .otherwise(0)
    )
    good = F.col("error_code") == 0
    return (
        requests.join(own, "txn_id", "left")
        .withColumn("error_code", code)
        .withColumn("state", F.when(good, "Ongoing").otherwise(F.col("__state")))
        .withColumn("started_ms", F.when(good & ~ongoing, F.col("at_ms")).otherwise(F.col("__started")))
        .drop("__epoch", "__state", "__started")
    )


def reconnected(events: DataFrame, pending: DataFrame, max_epoch: int) -> DataFrame:
    """Per transactional id what its initialisations did: generation and epoch, records aborted, offsets dropped.

    A reconnecting producer aborts the open records of its older epochs and drops their pending
    offsets (``pending``: txn_id, seq); beyond ``max_epoch`` a new producer id starts at epoch 0.
    """
    inits = events.filter("action = 'init'")
    aborted = ended_by(events).filter("marker = 'init'")
    dropped = aborted.join(pending.select("txn_id", "seq"), ["txn_id", "seq"], "left_semi")
    count = lambda df, name: df.groupBy("txn_id").agg(F.count(F.lit(1)).alias(name))
    return (
        producer_epochs(inits, max_epoch)
        .join(count(aborted, "aborted"), "txn_id", "left")
        .join(count(dropped, "dropped_offsets"), "txn_id", "left")
        .fillna(0, ["aborted", "dropped_offsets"])
    )


def timed_out(states: DataFrame, timeouts: DataFrame, as_of_ms: int) -> DataFrame:
    """Ongoing transactions older than their own timeout."""
    joined = states.filter("state = 'Ongoing'").join(timeouts, "txn_id")
    return joined.filter(F.col("started_ms") < F.lit(as_of_ms) - F.col("timeout_ms")).select("txn_id", "started_ms", "timeout_ms")


def validate(requests: DataFrame, states: DataFrame) -> DataFrame:
    """error_code of (txn_id, producer_epoch) requests: not found, or not exactly the current epoch."""
    own = states.select("txn_id", F.col("producer_epoch").alias("__epoch"))
    code = F.when(F.col("__epoch").isNull(), NOT_FOUND).when(F.col("__epoch") != F.col("producer_epoch"), FENCED).otherwise(0)
    return requests.join(own, "txn_id", "left").withColumn("error_code", code).drop("__epoch")


def commit_offsets(committed: DataFrame, pending: DataFrame, states: DataFrame) -> DataFrame:
    """Group offsets after every committed transaction's pending offsets (latest by seq) are moved in.

    Where a commit of the group and a pending offset share the latest seq, the group's commit holds.
    """
    done = states.filter("state = 'CompleteCommit'").select("txn_id")
    columns = ["group_id", *KEYS, "committed_offset", "seq"]
    moved = pending.join(done, "txn_id", "left_semi").select(*columns, F.lit(True).alias("moved"))
    both = committed.select(*columns, F.lit(False).alias("moved")).unionByName(moved)
    latest = lambda side: F.max_by(F.when(side, F.col("committed_offset")), F.when(side, F.col("seq")))
    last_seq = lambda side: F.max(F.when(side, F.col("seq")))
    is_moved, own = F.col("moved"), ~F.col("moved")
    later = F.coalesce(last_seq(is_moved) > last_seq(own), last_seq(own).isNull())
    return both.groupBy("group_id", *KEYS).agg(F.when(later, latest(is_moved)).otherwise(latest(own)).alias("committed_offset"))


def without_aborted(log: DataFrame, before_ms: int) -> DataFrame:
    """The log after clean-up of aborted records created before a time."""
    from logweir.sources.log import epoch_ms

    return log.filter(~(F.col("txn_state").eqNullSafe("aborted") & (epoch_ms(F.col("created_at")) < before_ms)))
