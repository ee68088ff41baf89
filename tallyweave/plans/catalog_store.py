"""Queries over stores: the full-text index, sketches, documents of mixed shapes; and over levels of totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave import sql as Q
from tallyweave.folders import new_folder
from tallyweave.operators import findings as V
from tallyweave.operators import pairs as P
from tallyweave.plans import catalog as A
from tallyweave.plans.catalog import LEDGER, query
from tallyweave.sources import ledger as L
from tallyweave.sources import postings, sketches, variants, store
from tallyweave.streaming import eventlog

_TOK = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: length(t) BETWEEN 2 AND 64))"

# ---------------------------------------------------------------- full text


@query(f"SELECT doc_id AS key FROM documents WHERE list_has_all({_TOK.format('text')}, ['the', 'that', 'with'])")
def postings_search(spark, d):
    """Documents with all words of a search, out of an index that is written first."""
    path = new_folder(spark, "postings")
    postings.build(L.table(spark, d, "documents"), path, shard=1000)
    return postings.search(spark, path, "With THAT, the a")


@query(
    f"""WITH q AS (SELECT item_id AS query_id, {_TOK.format("text")} AS t FROM benchmark), x AS (SELECT doc_id, {_TOK.format("text")} AS t FROM documents)
SELECT query_id, doc_id AS key FROM q JOIN x ON len(q.t) > 0 AND list_has_all(x.t, q.t)"""
)
def postings_of_questions(spark, d):
    """For every benchmark text, the documents with all of its words, by joins with the index."""
    path = new_folder(spark, "postings")
    postings.build(L.table(spark, d, "documents"), path, shard=1000)
    return postings.search_many(spark.read.parquet(path), L.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


# ---------------------------------------------------------------- levels


@query(
    LEDGER + f""", {A.REFERENCES}, f AS (SELECT 'scope' || (audit_id % 3) AS scope, audit_id, CASE WHEN relative_difference >= 0.05 THEN 'large' ELSE 'small' END AS topic, severity, confidence FROM refm)
SELECT scope, audit_id, topic, severity, CAST(grouping(scope, audit_id, topic, severity) AS BIGINT) AS level, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, round(avg(confidence), 6) AS confidence
FROM f GROUP BY GROUPING SETS ((scope, audit_id, topic, severity), (scope, audit_id, severity), (scope, topic), (scope, severity), (scope), ())"""
)
def finding_levels(spark, d):
    """Findings on all levels from audit to everything, with totals."""
    rows = P.reference_mismatches(L.amounts(spark, d), spark)
    rows = rows.withColumns({"scope": F.concat(F.lit("scope"), (F.col("audit_id") % 3).cast("string")), "topic": F.when(F.col("relative_difference") >= 0.05, "large").otherwise("small")})
    return V.levels(rows)


# ---------------------------------------------------------------- sketches


@query(
    """WITH b AS (SELECT kind, client_id, value FROM clicks WHERE kind IS NOT NULL), a AS (SELECT kind, count(*) AS n, count(DISTINCT client_id) AS clients FROM b GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT client_id) FROM b)
SELECT kind, n, clients, true AS near, true AS ranked FROM a"""
)
def click_sketches(spark, d):
    """Clients and values of clicks: sketches by day and kind, merged by kind and then to one, against exact figures: whether they are within their bounds."""
    c = L.table(spark, d, "clicks").where("kind is not null")
    days = sketches.sketched(c.withColumn("day", F.to_date("ts")), ["day", "kind"], "client_id", "value")
    kinds = sketches.merged(days, ["kind"])
    whole = sketches.merged(kinds.withColumn("kind", F.lit("all")), ["kind"])
    told = sketches.estimates(kinds.unionByName(whole), 0.5, 0.9)
    both = c.select("kind", "client_id", "value").unionByName(c.select(F.lit("all").alias("kind"), "client_id", "value"))
    exact = both.groupBy("kind").agg(F.count_distinct("client_id").alias("clients"))
    below = both.join(F.broadcast(told.select("kind", "quantiles")), "kind").groupBy("kind").agg(*(F.avg(F.when(F.col("value").isNotNull(), (F.col("value") <= F.get("quantiles", F.lit(k))).cast("int"))).alias(f"r{k}") for k in (0, 1)))
    near = F.abs(F.col("different") - F.col("clients")) <= F.greatest(F.lit(1.0), F.col("clients") * sketches.DISTINCT_ERROR)
    ranked = (F.abs(F.col("r0") - 0.5) <= sketches.RANK_ERROR) & (F.abs(F.col("r1") - 0.9) <= sketches.RANK_ERROR)
    return told.join(exact, "kind").join(below, "kind").select("kind", "n", "clients", near.alias("near"), ranked.alias("ranked"))


# ---------------------------------------------------------------- documents of mixed shapes


@query(
    """WITH p AS (SELECT client_id AS key, kind, click_id, ts, try_cast(props AS JSON) AS j FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL AND props IS NOT NULL),
l AS (SELECT key, kind, arg_max(j, (ts, click_id)) AS j, max(ts) AS written_at FROM (SELECT DISTINCT * FROM p WHERE j IS NOT NULL) GROUP BY ALL)
SELECT key, kind, try_cast(json_extract_string(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.device.os') AS os, CASE WHEN json_type(j, '$.items') = 'ARRAY' THEN CAST(json_array_length(j, '$.items') AS INTEGER) END AS items FROM l WHERE kind <> 'view' OR written_at + INTERVAL 7 DAY > (SELECT max(ts) FROM clicks)"""
)
def variant_store(spark, d):
    """The last properties of each client and kind of click, as documents of any shape; those of views are gone after seven days."""
    c = L.table(spark, d, "clicks").where("client_id is not null and ts is not null and kind is not null")
    rows = c.select(F.col("client_id").alias("key"), "kind", F.col("props").alias("document"), F.col("ts").cast("timestamp").alias("written_at"), F.when(F.col("kind") == "view", 7 * 86400).alias("ttl"), F.col("click_id").alias("seq"))
    kept, _ = variants.parsed(rows)
    now = c.agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    last = variants.current(kept, F.lit(now.first().now))
    items = F.try_variant_get("value", "$.items", "array<variant>")
    return last.select("key", "kind", variants.field("$.k", "bigint").alias("k"), variants.field("$.device.os", "string").alias("os"), F.when(items.isNotNull(), F.size(items)).alias("items"))


@query("SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS version FROM orders GROUP BY 1")
def records_upserted(spark, d):
    """Records written in three goes to a table that keeps the last of each key."""
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"))
    path = new_folder(spark, "records")
    write = eventlog.upsert_into(path, ["key"], F.col("version"))
    for k in (2, 0, 1):
        write(o.where(f"version % 3 = {k}"), 0)
    return eventlog.read_upserted(spark, path)


@query("SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS chunk_index FROM conversations WHERE conv_id % 3 <> 0 OR conv_id % 2 = 0")
def chunk_store(spark, d):
    """Chunks stored, some documents' deleted, and some of these stored again."""
    c = L.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("chunk_index"), "text", F.lit(1).alias("version"))
    path = new_folder(spark, "chunks")
    store.store_chunks(c, path)
    store.delete_chunks(c.where("doc_id % 3 = 0"), path)
    store.store_chunks(c.where("doc_id % 6 = 0"), path)
    return store.read_chunks(spark, path).select("doc_id", "chunk_index")


# ---------------------------------------------------------------- SQL


@query(A.ORACLES["finding_gate"])
def sql_finding_gate(spark, d):
    """The gate of findings by SQL text alone."""
    Q.register(spark)
    Q.view("tw_findings", A.findings(spark, d))
    return spark.sql("SELECT audit_id, finding_id, tw_verdict(severity, confidence, size(filter(evidence, e -> trim(e) <> '')), source) AS rejection FROM tw_findings")


@query(LEDGER + f", {A.PAIRS} SELECT audit_id, anchor_id, entity_id1, entity_id2, reason FROM rel")
def sql_contradictions(spark, d):
    """Contradictions by SQL text alone, without the limit of pairs."""
    Q.register(spark)
    Q.view("tw_amounts", L.amounts(spark, d))
    return spark.sql(
        """WITH rows AS (SELECT * FROM tw_amounts LEFT SEMI JOIN tw_role_pairs ON amount_role = role1 WHERE anchor_id IS NOT NULL)
SELECT /*+ BROADCAST(r) */ a.audit_id, a.anchor_id, a.entity_id AS entity_id1, b.entity_id AS entity_id2, r.reason
FROM rows a JOIN rows b ON b.audit_id = a.audit_id AND b.anchor_id = a.anchor_id AND a.entity_id < b.entity_id AND a.doc_id <> b.doc_id JOIN tw_role_pairs r ON a.amount_role = r.role1 AND b.amount_role = r.role2
WHERE tw_same_currency(a.amount_currency, b.amount_currency) AND tw_differ(a.amount_value, b.amount_value)"""
    )


@query()
def sql_dedup_clusters(spark, d):
    """The fold of findings by a table function over partitions, from SQL; tested against one in plain Python."""
    Q.register(spark)
    Q.findings_view("tw_told", A.findings(spark, d))
    return spark.sql("SELECT audit_id, position, finding_id, severity, confidence, topic FROM tw_fold_findings(TABLE(tw_told) PARTITION BY audit_id ORDER BY seq)")
