"""The session machine and the ends of logs, as streams, against plain Python over the whole table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyweave.streaming import replay, sessions, tail

START = datetime(2024, 1, 1)
SCHEMA = "audit_id long, event_id long, ts timestamp, kind string, arrived_at timestamp"


def row(audit, event, seconds, kind, late=0):
    at = None if seconds is None else START + timedelta(seconds=seconds)
    return audit, event, at, kind, START + timedelta(seconds=(seconds or 0) + late)


def made(seed, n=160):
    """Events of a few audits over three weeks, late, out of order, repeated and broken; one audit has a third of them."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        audit = r.choice([1, 1, 2, 3, 4, 5])
        at = r.choice([k * 60, r.randrange(21 * 86400)])
        rows.append(row(audit, k, at, r.choice(["start", "beat", "beat", "say", "say", "complete", "fail"]), r.choice([0, 0, 30, 7200])))
    rows += r.sample(rows, 20)
    rows += [(None, 900, START, "start", START), (1, None, START, "start", START), row(1, 901, None, "start"), row(1, 902, 5, "hello"), row(1, 903, 5, None)]
    r.shuffle(rows)
    return rows


def steps(rows, beat, ttl, chat):
    """What a reader of the rules would do, one event after the other."""
    good = sorted({(a, t, e, k) for a, e, t, k, _ in rows if a is not None and e is not None and t is not None and k in sessions.KINDS})
    out = []
    for audit in sorted({x[0] for x in good}):
        status, run, saved, alive, said, turns = None, 0, None, None, None, 0

        def timers(until):
            nonlocal status, run, saved
            while status is not None:
                gone = saved + timedelta(seconds=ttl)
                dead = alive + timedelta(seconds=beat) if status == "processing" else gone
                at = min(gone, dead)
                if until is not None and at > until:
                    return
                held = turns if turns and at < said + timedelta(seconds=ttl) else 0
                if status == "processing" and at == dead:
                    status, saved = "failed", at
                    out.append((audit, None, at, "timeout", "failed", run, held))
                else:
                    status, run = None, 0
                    out.append((audit, None, at, "gone", None, 0, held))

        for _, at, event, kind in [x for x in good if x[0] == audit]:
            timers(at)
            if turns and at >= said + timedelta(seconds=ttl):
                turns = 0
            action = "ignored"
            if kind == "start":
                action = {"completed": "fetch", "processing": "wait"}.get(status, "start")
                if action == "start":
                    status, run, saved, alive = "processing", run + 1, at, at
            elif kind == "say":
                action, turns, said = "say", min(chat, turns + 1), at
            elif status == "processing":
                action = kind
                if kind == "beat":
                    alive = at
                else:
                    status, saved = ("completed" if kind == "complete" else "failed"), at
            out.append((audit, event, at, action, status, run, turns))
        timers(None)
    return sorted(out, key=str)


def streamed(spark, tmp_path, rows, parts, work):
    frame = spark.createDataFrame(rows, SCHEMA)
    end = START + timedelta(days=400)
    last = spark.createDataFrame([(-1, -1, end, "start", end), (-1, -2, end, "complete", end)], SCHEMA)
    replay.arrivals(frame, F.col("arrived_at"), parts, str(tmp_path / "in"), last)
    late = replay.lateness(frame.where("audit_id is not null and ts is not null"), F.col("ts"), F.col("arrived_at"))
    return replay.replayed(spark, str(tmp_path / "in"), frame.schema, lambda e: work(e, late), 4).where("audit_id != -1")


@pytest.mark.parametrize("seed, parts", [(1, 3), (2, 1)])
def test_machine(spark, tmp_path, seed, parts):
    rows = made(seed)
    out = streamed(spark, tmp_path, rows, parts, lambda e, late: sessions.session_steps(e, late, 3600, 5 * 86400, 3))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = steps(rows, 3600, 5 * 86400, 3)
    assert got == want
    assert {"start", "wait", "beat", "timeout", "gone", "say", "complete", "fail", "ignored"} <= {r[3] for r in want} and max(r[6] for r in want) == 3


def test_waiting_events_lie_in_blocks(monkeypatch):
    """A value of the state for each block of events, not for each event; in order they come by time, id and kind, and equal ones once."""
    monkeypatch.setattr(sessions, "BLOCK", 4)
    rng = random.Random(2)
    events = [(rng.randrange(-3, 4), rng.randrange(3), rng.randrange(5)) for _ in range(30)]
    values = sessions.packed(sessions.np.array(events, sessions.EVENT))
    assert len(values) == 8 and sessions.unpacked(values).tolist() == events
    assert sessions.in_order(sessions.unpacked(values)).tolist() == sorted(set(events))
    assert not sessions.packed(sessions.unpacked([])) and not len(sessions.in_order(sessions.unpacked([])))


def test_what_one_audit_goes_through(spark, tmp_path):
    """Started, alive, failed by the timer, started again, completed and fetched, gone after seven days; twenty turns of a chat are kept."""
    rows = [row(7, 1, 0, "start"), row(7, 2, 100, "beat"), row(7, 3, 150, "start"), row(7, 4, 400, "start"), row(7, 5, 450, "complete"), row(7, 6, 500, "start"), row(7, 7, 450 + sessions.TTL, "start")]
    rows += [row(7, 100 + k, 460 + k, "say", 30) for k in range(25)]
    out = streamed(spark, tmp_path, rows, 2, sessions.session_steps)
    got = [(r.event_id, int((r.ts - START).total_seconds()), r.action, r.status, r.run, r.chat) for r in out.orderBy("ts", F.col("event_id").asc_nulls_first()).collect()]
    said = [x for x in got if x[2] == "say"]
    assert [x[5] for x in said] == [min(20, k + 1) for k in range(25)]
    assert [x[:5] for x in got if x[2] != "say"][:9] == [
        (1, 0, "start", "processing", 1), (2, 100, "beat", "processing", 1), (3, 150, "wait", "processing", 1), (None, 220, "timeout", "failed", 1), (4, 400, "start", "processing", 2),
        (5, 450, "complete", "completed", 2), (6, 500, "fetch", "completed", 2), (None, 450 + sessions.TTL, "gone", None, 0), (7, 450 + sessions.TTL, "start", "processing", 1),
    ]


def test_a_log_without_rows(spark, tmp_path):
    rows = [(None, 1, START, "start", START)]
    assert streamed(spark, tmp_path, rows, 2, sessions.session_steps).count() == 0


def runs(rows, seconds):
    good = {(a, e, t, k) for a, e, t, k, _ in rows if None not in (a, e, t)}
    out = []
    for a, e, t, k in good:
        if k in tail.STARTS:
            ends = sorted((u, f, x) for b, f, u, x in good if b == a and x in ("complete", "error") and t <= u <= t + timedelta(seconds=seconds))
            out.append((a, e, t, ends[0][0] if ends else None, ends[0][2] if ends else None, len(ends)))
    return sorted(out, key=str)


def test_ends_of_logs(spark, tmp_path):
    rows = [(a, e, t, {"fail": "error"}.get(k, k), x) for a, e, t, k, x in made(3)]
    pairs = streamed(spark, tmp_path, rows, 3, lambda e, late: tail.runs(e, late, 3600))
    got = sorted((tuple(r) for r in tail.first_ends(pairs).collect()), key=str)
    want = runs(rows, 3600)
    assert got == want and any(r[5] == 0 for r in want) and any(r[5] > 0 for r in want)


def test_one_audit_with_many_events_is_dealt_by_time(spark, tmp_path):
    """Ends at the edges of slices and of the time allowed, each once; what meets has its slice in common, not only its audit."""
    edge = 3600 - int(START.timestamp()) % 3600
    rows = [row(1, k, edge + s, "start") for k, s in enumerate((0, -1, 1800, 3599, 7200))] + [row(1, 100 + k, edge + s, "complete") for k, s in enumerate((-1, 0, 3599, 3600, 5400, 5401, 7199, 10800, 10801))]
    seen = []
    pairs = streamed(spark, tmp_path, rows, 1, lambda e, late: seen.append(tail.runs(e, late, 3600)) or seen[0])
    assert sorted((tuple(r) for r in tail.first_ends(pairs).collect()), key=str) == runs(rows, 3600)
    join = next(x for x in seen[0]._jdf.queryExecution().analyzed().toString().splitlines() if "Join LeftOuter" in x)
    assert "_slice" in join and "_of" in join


def test_following_a_log_to_its_end(spark, tmp_path):
    schema = "audit_id long, seq long, kind string"
    folder, seen = str(tmp_path / "log"), []
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    write([(1, 0, "connected"), (2, 0, "connected"), (1, 1, "reasoning_step"), (1, 1, "reasoning_step")])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    write([(1, 3, "complete"), (1, 2, "report_ready"), (1, 4, "delta")])
    assert tail.follow(stream(), 1, 1, lambda rows: seen.extend((r.seq, r.kind) for r in rows), str(tmp_path / "c1"))
    assert seen == [(1, "reasoning_step"), (2, "report_ready"), (3, "complete")]
    assert not tail.follow(stream(), 2, 0, lambda rows: seen.append(len(rows)), str(tmp_path / "c2"), 3.0) and seen[-1] == 1
    kinds = spark.createDataFrame([("delta",), ("start",), ("bogus",), (None,)], "kind string")
    assert sorted(r.kind for r in tail.known(kinds).collect()) == ["delta", "start"]
