"""The sessions of audits as a state machine with timers, over a stream of events.

An event (audit_id, event_id, ts, kind) asks for a run (start), shows that a run is alive (beat), ends it (complete, fail) or adds a turn to
the audit's chat (say). What it does depends on the audit's session then:

- start: a completed session is fetched, one that is processing is waited for, and any other (none, failed) is started;
- beat, complete, fail: only a session that is processing takes them;
- say: the chat keeps its last CHAT turns.

Two timers run by event time. A session that is processing fails when its last beat, or start, is BEAT seconds old. A session is
gone TTL seconds after it was last saved (started, completed, failed), and a chat TTL seconds after its last turn. A timer comes before an event of the same time.

Events may come late, out of order and more than once: they wait in the state until the watermark has passed them, are sorted by (ts, event_id) then,
and equal ids of one time count once. What the machine returns is thus the same however the stream is cut into batches, as long as nothing comes later
than the watermark allows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Seconds that a beat and a key live, turns that a chat keeps.
BEAT, TTL, CHAT = 120, 7 * 24 * 3600, 20
KINDS = ("start", "beat", "complete", "fail", "say")
# A waiting event as it lies in the state, its kind a place in the sorted kinds, and how many lie in one value.
EVENT, BLOCK = np.dtype([("at", "<i8"), ("event", "<i8"), ("kind", "<i1")]), 10_000
#: What the machine returns: a row for each event, and for each timer that fires (event_id null).
STEPS = "audit_id long, event_id long, ts timestamp, action string, status string, run int, chat int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Session:
    """A session and its chat; times in microseconds. status None: there is none."""

    status: str | None = None
    run: int = 0
    saved: int = 0
    beat: int = 0
    chat: tuple[int, ...] = ()
    said: int = 0


class Machine:
    """What events and timers do to a session."""

    def __init__(self, beat: int, ttl: int, chat: int) -> None:
        self.beat, self.ttl, self.chat = beat * 1_000_000, ttl * 1_000_000, chat

    def due(self, s: Session) -> int | None:
        """When the session's next timer fires."""
        if s.status is None:
            return s.said + self.ttl if s.chat else None
        gone = s.saved + self.ttl
        return min(gone, s.beat + self.beat) if s.status == "processing" else gone

    def turns(self, s: Session, now: int) -> tuple[int, ...]:
        return s.chat if s.chat and now < s.said + self.ttl else ()

    def fire(self, s: Session, until: int) -> Iterator[tuple]:
        """Timers due by then, in order of time: (event_id None, ts, action, status, run, chat)."""
        while s.status is not None and (at := self.due(s)) <= until:
            s.chat = self.turns(s, at)
            if s.status == "processing" and s.beat + self.beat == at:
                s.status, s.saved = "failed", at
                yield None, at, "timeout", "failed", s.run, len(s.chat)
            else:
                s.status, s.run = None, 0
                yield None, at, "gone", None, 0, len(s.chat)
        s.chat = self.turns(s, until)

    def take(self, s: Session, event: int, at: int, kind: str) -> tuple:
        running = s.status == "processing"
        action = "ignored"
        if kind == "start":
            action = "fetch" if s.status == "completed" else "wait" if running else "start"
            if action == "start":
                s.status, s.run, s.saved, s.beat = "processing", s.run + 1, at, at
        elif kind == "beat" and running:
            action, s.beat = "beat", at
        elif kind in ("complete", "fail") and running:
            action, s.status, s.saved = kind, "completed" if kind == "complete" else "failed", at
        elif kind == "say":
            action, s.chat, s.said = "say", (*s.chat, event)[-self.chat :], at
        return event, at, action, s.status, s.run, len(s.chat)


def packed(events: np.ndarray) -> list[tuple]:
    """Waiting events as values of a list state: a value for each block, not for each event, as each one costs a row between Python and the store."""
    return [(events[k : k + BLOCK].tobytes(),) for k in range(0, len(events), BLOCK)]


def unpacked(values) -> np.ndarray:
    return np.concatenate([np.empty(0, EVENT), *(np.frombuffer(bytes(x[0]), EVENT) for x in values)])


def in_order(events: np.ndarray) -> np.ndarray:
    """Events by time, id and kind, equal ones once."""
    events = events[np.lexsort((events["kind"], events["event"], events["at"]))]
    return events[np.concatenate([np.ones(min(1, len(events)), bool), events[1:] != events[:-1]])]


class Sessions(StatefulProcessor):
    """One key is one audit: its session (value), its chat and the events that wait (lists), and one timer for what comes next."""

    def __init__(self, beat: int, ttl: int, chat: int) -> None:
        self.machine = Machine(beat, ttl, chat)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "status string, run int, saved long, beat long, said long")
        self.chat = handle.getListState("chat", "event long")
        self.waiting = handle.getListState("waiting", "events binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        come = []
        for frame in rows:
            events = np.empty(len(frame), EVENT)
            events["at"], events["event"], events["kind"] = frame["at"], frame["event_id"], frame["kind"]
            come.append(events)
        come = np.concatenate([np.empty(0, EVENT), *come])
        if len(come):
            self.waiting.appendList(packed(come))
            self._wake(int(come["at"].min()), timerValues)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.session.get()
        s = Session(*held[:4], tuple(x[0] for x in self.chat.get()), held[4]) if held else Session()
        waiting = unpacked(self.waiting.get())
        kinds, out = sorted(KINDS), []
        for at, event, kind in in_order(waiting[waiting["at"] <= now]).tolist():
            out += self.machine.fire(s, at)
            out.append(self.machine.take(s, event, at, kinds[kind]))
        out += self.machine.fire(s, now)
        later = waiting[waiting["at"] > now]
        if len(waiting):
            self.waiting.clear()
        if len(later):
            self.waiting.appendList(packed(later))
        self.chat.clear()
        if s.chat:
            self.chat.appendList([(x,) for x in s.chat])
        if s.status is None and not s.chat:
            self.session.clear()
        else:
            self.session.update((s.status, s.run, s.saved, s.beat, s.said))
        after = [t for t in (self.machine.due(s), int(later["at"].min()) if len(later) else None) if t is not None]
        if after:
            self._wake(min(after), timerValues)
        if out:
            names = ["event_id", "ts", "action", "status", "run", "chat"]
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "audit_id", key[0])
            frame["event_id"] = frame["event_id"].astype("Int64")
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame
        else:
            yield pd.DataFrame()

    def _wake(self, at: int, timerValues) -> None:  # noqa: N803
        """One timer for each key: the earliest. A time that the watermark has passed waits for its next step."""
        now = timerValues.getCurrentWatermarkInMs()
        ms = max(-(-at // 1000), now + 1)
        ahead = [t for t in self.handle.listTimers() if t > now]  # those that fire just now are deleted by themselves
        if any(t <= ms for t in ahead):
            return
        for t in ahead:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def session_steps(events: DataFrame, late: str, beat: int = BEAT, ttl: int = TTL, chat: int = CHAT) -> DataFrame:
    """What each event of a stream (audit_id, event_id, ts, kind) does, and each timer: STEPS, appended once the watermark has passed them.

    Rows without audit_id, event_id or ts, and of other kinds, are left out. late: how much later than the newest event one may come; later ones are dropped by the
    watermark. The stream's state is in RocksDB (see STORE), a session, a chat of `chat` turns and the events of that time for each audit."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # the process that looks at a processor before its stream starts has no files of the session: the class goes with its code
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kept = events.where("audit_id is not null and event_id is not null and ts is not null").where(F.col("kind").isin(*KINDS))
    kept = kept.select("audit_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.array_position(F.array(*map(F.lit, sorted(KINDS))), F.col("kind")) - 1).cast("byte").alias("kind")).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return kept.groupBy("audit_id").transformWithStateInPandas(Sessions(beat, ttl, chat), outputStructType=STEPS, outputMode="Append", timeMode="EventTime")
