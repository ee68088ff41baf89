"""Queries over time: sessions and event logs as streams, and joins by time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.dealing import partitions
from tallyweave.folders import new_folder
from tallyweave.operators import timejoins as J
from tallyweave.plans.catalog import query
from tallyweave.sources import ledger as L
from tallyweave.streaming import replay, sessions, tail

#: Files that a table is replayed in.
PARTS = 4
#: Events to a partition of a stream's state.
EVENTS = 200_000
#: An audit of no customer, whose events only move the watermark on.
NOBODY = -1

# ---------------------------------------------------------------- streams

BEAT, TTL, CHAT = 6 * 3600, sessions.TTL, sessions.CHAT
_KIND = {"signup": "start", "view": "beat", "click": "say", "purchase": "complete", "error": "fail"}


def _clicks(spark, d):
    c = L.table(spark, d, "clicks")
    kind = F.create_map(*(F.lit(x) for kv in _KIND.items() for x in kv))[F.col("kind")]
    return c.select(F.col("client_id").alias("audit_id"), F.col("click_id").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("arrived_at").cast("timestamp").alias("arrived_at"))


def _streamed(spark, rows, kinds, work):
    """What a streaming query makes of rows (audit_id, event_id, ts, kind, arrived_at), replayed in order of arrival; at the end come events of nobody, of
    such kinds, so late that every timer before them fires."""
    folder = new_folder(spark, "arrivals")
    end = rows.agg(F.timestamp_micros(F.unix_micros(F.max("ts")) + 400 * 86_400_000_000).alias("ts"))
    last = end.select(F.lit(NOBODY).cast("long").alias("audit_id"), F.lit(-1).cast("long").alias("event_id"), "ts", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.col("ts").alias("arrived_at"))
    replay.arrivals(rows, F.col("arrived_at"), PARTS, folder, last)
    late = replay.lateness(rows.where("audit_id is not null and ts is not null"), F.col("ts"), F.col("arrived_at"))
    return replay.replayed(spark, folder, spark.read.parquet(folder).schema, lambda events: work(events, late), partitions=partitions(rows, EVENTS)).where(F.col("audit_id") != NOBODY)


_STEPS = f"""e AS (SELECT DISTINCT client_id AS audit_id, click_id AS event_id, epoch_us(ts) AS ts, CASE kind WHEN 'signup' THEN 'start' WHEN 'view' THEN 'beat' WHEN 'click' THEN 'say' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY ts, event_id) AS rn, coalesce(lead(ts) OVER (PARTITION BY audit_id ORDER BY ts, event_id), 9000000000000000) AS nxt FROM e),
st AS (SELECT q.*, CASE WHEN kind = 'start' THEN 'start' WHEN kind = 'say' THEN 'say' ELSE 'ignored' END AS action, CASE WHEN kind = 'start' THEN 'processing' END AS status, CASE WHEN kind = 'start' THEN 1 ELSE 0 END AS run, CASE WHEN kind = 'start' THEN ts ELSE 0 END AS saved, CASE WHEN kind = 'start' THEN ts ELSE 0 END AS beat, CASE WHEN kind = 'say' THEN 1 ELSE 0 END AS chat, CASE WHEN kind = 'say' THEN ts ELSE 0 END AS said FROM q WHERE rn = 1
  UNION ALL SELECT audit_id, event_id, ts, kind, rn, nxt, action, CASE WHEN action = 'start' THEN 'processing' WHEN action = 'complete' THEN 'completed' WHEN action = 'fail' THEN 'failed' ELSE s2 END AS status, CASE WHEN action = 'start' THEN r2 + 1 ELSE r2 END AS run,
    CASE WHEN action IN ('start', 'complete', 'fail') THEN ts ELSE v1 END AS saved, CASE WHEN action IN ('start', 'beat') THEN ts ELSE beat0 END AS beat, CASE WHEN action = 'say' THEN least({CHAT}, c2 + 1) ELSE c2 END AS chat, CASE WHEN action = 'say' THEN ts ELSE said0 END AS said
  FROM (SELECT *, CASE WHEN kind = 'start' THEN CASE s2 WHEN 'completed' THEN 'fetch' WHEN 'processing' THEN 'wait' ELSE 'start' END WHEN kind = 'say' THEN 'say' WHEN s2 = 'processing' THEN kind ELSE 'ignored' END AS action
    FROM (SELECT *, CASE WHEN s1 IS NOT NULL AND v1 + {TTL}000000 <= ts THEN NULL ELSE s1 END AS s2, CASE WHEN s1 IS NULL OR v1 + {TTL}000000 <= ts THEN 0 ELSE run0 END AS r2, CASE WHEN chat0 > 0 AND said0 + {TTL}000000 > ts THEN chat0 ELSE 0 END AS c2
      FROM (SELECT q.*, st.run AS run0, st.beat AS beat0, st.chat AS chat0, st.said AS said0, coalesce(st.status = 'processing' AND st.beat + {BEAT}000000 <= least(st.saved + {TTL}000000, q.ts), false) AS hd, CASE WHEN hd THEN 'failed' ELSE st.status END AS s1, CASE WHEN hd THEN st.beat + {BEAT}000000 ELSE st.saved END AS v1 FROM st JOIN q ON q.audit_id = st.audit_id AND q.rn = st.rn + 1)))),
tm AS (SELECT *, coalesce(status = 'processing' AND beat + {BEAT}000000 <= least(saved + {TTL}000000, nxt), false) AS hd, CASE WHEN hd THEN beat + {BEAT}000000 ELSE saved END AS v1 FROM st),
steps AS (SELECT audit_id, event_id, ts, action, status, run, chat FROM st
  UNION ALL SELECT audit_id, NULL, beat + {BEAT}000000, 'timeout', 'failed', run, CASE WHEN chat > 0 AND said + {TTL}000000 > beat + {BEAT}000000 THEN chat ELSE 0 END FROM tm WHERE hd
  UNION ALL SELECT audit_id, NULL, v1 + {TTL}000000, 'gone', NULL, 0, CASE WHEN chat > 0 AND said > v1 THEN chat ELSE 0 END FROM tm WHERE status IS NOT NULL AND v1 + {TTL}000000 <= nxt)"""


@query(f"WITH RECURSIVE {_STEPS} SELECT audit_id, event_id, ts AS at, action, status, run, chat FROM steps")
def session_machine(spark, d):
    """Clients as audits: sign-ups start a run, views keep it alive for six hours, purchases complete it, errors fail it, and clicks are turns of its chat."""
    out = _streamed(spark, _clicks(spark, d), ["beat"], lambda events, late: sessions.session_steps(events, late, BEAT, TTL, CHAT))
    return out.select("audit_id", "event_id", F.unix_micros("ts").alias("at"), "action", "status", "run", "chat")


@query(
    """WITH e AS (SELECT DISTINCT client_id AS audit_id, click_id AS event_id, epoch_us(ts) AS ts, kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
j AS (SELECT s.audit_id, s.event_id AS start_id, s.ts AS started, x.event_id AS end_id, x.ts AS ended, x.kind FROM e s LEFT JOIN e x ON x.audit_id = s.audit_id AND x.kind IN ('purchase', 'error') AND x.ts >= s.ts AND x.ts <= s.ts + 86400000000 WHERE s.kind = 'signup')
SELECT audit_id, start_id, started, min(ended) AS ended, arg_min(kind, (ended, end_id)) FILTER (ended IS NOT NULL) AS ended_by, count(end_id) AS ends FROM j GROUP BY 1, 2, 3"""
)
def event_tails(spark, d):
    """Each client's sign-ups with the first purchase or error within a day; null for those that have none."""
    kinds = {"start": "start", "complete": "complete", "fail": "error"}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("kind")]
    rows = _clicks(spark, d).withColumn("kind", kind)
    pairs = _streamed(spark, rows, ["start", "complete"], lambda events, late: tail.runs(events, late, 86400))
    first = tail.first_ends(pairs)
    name = F.when(F.col("ended_by") == "complete", "purchase").when(F.col("ended_by") == "error", "error")
    return first.select("audit_id", "start_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), name.alias("ended_by"), "ends")


# ---------------------------------------------------------------- joins by time


@query(
    """WITH r AS (SELECT client_id, sold_at, sale_id, total FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id, sold_at ORDER BY sale_id DESC) = 1),
l AS (SELECT client_id, ts, click_id, value FROM clicks WHERE kind = 'purchase')
SELECT click_id, l.client_id, value, sale_id, total FROM l ASOF LEFT JOIN r ON l.client_id = r.client_id AND l.ts >= r.sold_at"""
)
def last_invoice(spark, d):
    """Each purchase with its client's last sale before it; of sales of one moment, that of the largest number."""
    left = L.table(spark, d, "clicks").where("kind = 'purchase'").select("client_id", "ts", "click_id", "value")
    right = L.table(spark, d, "sales").select("client_id", "sold_at", "sale_id", "total")
    return J.as_of(left, right, "client_id", "ts", "sold_at", ["sale_id"]).select("left.click_id", "left.client_id", "left.value", "right.sale_id", "right.total")


def _periods(spark, d):
    """What a client's record said, and from when to when: until its next change, and for ever after the last."""
    c = L.table(spark, d, "client_changes").where("client_id is not null and valid_at is not null").select("client_id", "change_id", "valid_at", "segment").distinct()
    return c.withColumn("until", F.lead("valid_at").over(Window.partitionBy("client_id").orderBy("valid_at", "change_id")))


_PERIODS = "pd AS (SELECT *, lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at, change_id) AS until FROM (SELECT DISTINCT client_id, change_id, valid_at, segment FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL))"


@query(f"WITH {_PERIODS} SELECT s.sale_id, s.client_id, p.change_id, p.segment FROM sales s JOIN pd p ON s.client_id = p.client_id AND s.sold_at >= p.valid_at AND s.sold_at < coalesce(p.until, TIMESTAMP '9999-01-01')")
def sales_in_periods(spark, d):
    """Sales within the periods of their client's record."""
    s = L.table(spark, d, "sales").select("sale_id", "client_id", "sold_at")
    return J.within(s, _periods(spark, d), "client_id", "sold_at", "valid_at", "until").select("point.sale_id", "point.client_id", "range.change_id", "range.segment")


@query(
    f"""WITH {_PERIODS}, r AS (SELECT *, epoch_us(valid_at) AS f, epoch_us(until) AS t FROM pd WHERE until > valid_at), l AS (SELECT *, CAST(greatest(0, floor(ln(greatest(1, (t - f) / {J.CELL}::DOUBLE)) / ln({J.FACTOR}))) AS INTEGER) AS level FROM r),
w AS (SELECT *, {J.CELL}::HUGEINT * CAST(pow({J.FACTOR}, level) AS BIGINT) AS w FROM l), c AS (SELECT client_id, level, unnest(range(CAST(f // w AS BIGINT), CAST((t - 1) // w AS BIGINT) + 1)) AS cell FROM w),
n AS (SELECT client_id, level, cell, count(*) AS n FROM c GROUP BY ALL) SELECT level, ranges, copies, fullest FROM (SELECT level, count(*) AS ranges FROM l GROUP BY 1) JOIN (SELECT level, CAST(sum(n) AS BIGINT) AS copies, max(n) AS fullest FROM n GROUP BY 1) USING (level)"""
)
def period_cells(spark, d):
    """How many cells the closed periods are dealt to, by size of cell."""
    return J.cells(_periods(spark, d).where("until is not null"), "client_id", "valid_at", "until")
