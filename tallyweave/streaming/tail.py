"""Logs of audits that end: from their start to the event that ends them, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.control import EVENT_TYPES, TERMINAL

#: Types of events that begin a log, as the stream of a run tells them.
STARTS = ("connected", "start")


def known(events: DataFrame) -> DataFrame:
    """Events (..., kind) of the types that a log may hold."""
    return events.where(F.col("kind").isin(*EVENT_TYPES, *STARTS))


def runs(events: DataFrame, late: str, seconds: int) -> DataFrame:
    """Of a stream (audit_id, event_id, ts, kind): each start with each end of the same audit within some seconds from it, or with nulls where
    there is none: (audit_id, start_id, started, end_id, ended, ended_by).

    Rows without audit_id, event_id or ts are left out. Repeated ids count once as long as the repeat is no later than `late` allows, and so do events out of order; what
    comes later than that is dropped by the watermark. Starts meet only the ends of their audit that lie about them in time, so an audit with many events is dealt by
    time and isn't compared as a whole. A start without an end comes out once the watermark is past the time in which it might end."""
    kept = events.where("audit_id is not null and event_id is not null and ts is not null")

    def side(kinds: tuple, names: dict) -> DataFrame:
        rows = kept.where(F.col("kind").isin(*kinds)).select(*(F.col(c).alias(n) for c, n in names.items()))
        return rows.withWatermark(names["ts"], late).dropDuplicatesWithinWatermark([names["event_id"]])

    starts = side(STARTS, {"audit_id": "audit_id", "event_id": "start_id", "ts": "started"})
    ends = side(tuple(TERMINAL), {"audit_id": "_audit", "event_id": "end_id", "ts": "ended", "kind": "ended_by"})
    # slices of time as long as an end may take: a start looks for ends in its own slice and the next one, so an end is there for its own and the one before
    width = max(1, int(seconds)) * 1_000_000
    of = lambda c: F.floor(F.unix_micros(c) / F.lit(width))
    starts = starts.withColumn("_slice", of("started"))
    ends = ends.withColumn("_of", F.explode(F.array(of("ended"), of("ended") - 1)))
    soon = F.expr(f"audit_id = _audit AND _slice = _of AND ended >= started AND ended <= started + INTERVAL {int(seconds)} SECONDS")
    return starts.join(ends, soon, "leftOuter").drop("_audit", "_slice", "_of")


def first_ends(pairs: DataFrame) -> DataFrame:
    """One row for each start of runs(): the first end, of equals that of the smaller id, and how many there are."""
    first = F.min_by(F.struct("ended", "ended_by"), F.when(F.col("end_id").isNotNull(), F.struct("ended", "end_id")))
    out = pairs.groupBy("audit_id", "start_id", "started").agg(first.alias("e"), F.count("end_id").alias("ends"))
    return out.select("audit_id", "start_id", "started", "e.ended", "e.ended_by", "ends")


def follow(events: DataFrame, audit_id: int, start: int, take: Callable[[list], None], checkpoint: str, timeout: float = 60.0) -> bool:
    """Hands the events (audit_id, seq, kind, ...) of one audit's log, from seq `start` on, to take() as they come, in order of seq within a batch and none
    twice, and stops after the first one that ends the log. Whether it has ended within `timeout` seconds.

    Only the rows of one audit's batch come to the driver: this is what a client that watches a run asks for."""
    state = {"next": start, "ended": False}

    def batch(frame: DataFrame, _: int) -> None:
        if state["ended"]:
            return
        rows = frame.where(F.col("seq") >= state["next"]).dropDuplicates(["seq"]).orderBy("seq").collect()
        for k, row in enumerate(rows):
            if row.kind in TERMINAL:
                state["ended"], rows = True, rows[: k + 1]
                break
        if rows:
            state["next"] = rows[-1].seq + 1
            take(rows)

    query = events.where(F.col("audit_id") == audit_id).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    try:
        waited = 0.0
        while not state["ended"] and waited < timeout and query.isActive:
            query.awaitTermination(0.2)
            waited += 0.2
    finally:
        query.stop()
    return state["ended"]
