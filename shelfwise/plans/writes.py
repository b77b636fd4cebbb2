"""Queries that write: each merges changes into a table and returns the table as it then is."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.functions import text as T
from shelfwise.operators import registry as R
from shelfwise.operators import sinks as S
from shelfwise.sources.tables import TODAY, day


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@query("SNK-06_index_rewrite", """, altered AS (SELECT id, list_concat(list_filter(tokens, lambda x: x <> lower(brand_slug)), ['renamed']) AS tokens FROM products WHERE brand_slug LIKE 'Brand#1%' AND status <> 'merged')
SELECT product_id, token FROM product_tokens WHERE product_id NOT IN (SELECT id FROM altered) UNION ALL SELECT DISTINCT id, unnest(tokens) FROM altered""")
def index_rewrite(t):
    p = t.products.where("brand_slug like 'Brand#1%' and status <> 'merged'")
    tokens = F.concat(F.filter("tokens", lambda x: x != F.lower("brand_slug")), F.array(F.lit("renamed")))
    updated = S.patch(t.products, p.select("id", tokens.alias("tokens")), "id", ("tokens", "display_name", "review_flag"))
    return S.rewrite_index(R.token_index(t.products), updated.join(p.select("id"), "id", "left_semi"))


ENRICHED = "held AS (SELECT id, e_name, lower(coalesce(e_name, '')) AS match_text, mint_verdict FROM enrichments), incoming AS (SELECT o.id, CASE WHEN o.size % 7 <> 0 THEN upper(o.name) || ' ' || o.size END AS e_name FROM offers o WHERE o.line IN (3, 6))"


def held(t):
    return t.enrichments.select("id", "e_name", T.normalize_text(F.col("e_name")).alias("match_text"), "mint_verdict")


@query("SNK-08_enrichment_upsert", f", {ENRICHED} SELECT coalesce(n.id, h.id) AS id, CASE WHEN n.id IS NULL THEN h.e_name ELSE n.e_name END AS e_name, CASE WHEN n.id IS NULL THEN h.match_text ELSE lower(coalesce(n.e_name, '')) END AS match_text, CASE WHEN n.id IS NULL THEN h.mint_verdict END AS mint_verdict FROM held h FULL JOIN incoming n ON h.id = n.id")
def enrichment_upsert(t):
    name = F.when(F.col("size") % 7 != 0, F.concat_ws(" ", F.upper("name"), F.col("size").cast("string")))
    new = t.offers.where("line in (3, 6)").select("id", name.alias("e_name"))
    # a new reading brings its own match text and opens the verdict again
    new = new.withColumns({"match_text": T.normalize_text(F.col("e_name")), "mint_verdict": F.lit(None).cast("string")})
    return S.upsert(held(t), new, "id")


@query("SNK-10_verdict_stamp", "SELECT e.id, CASE WHEN s.line = 5 THEN NULL WHEN s.match_band IN ('auto', 'created') THEN 'minted' WHEN s.line = 1 THEN 'low_corroboration' ELSE e.mint_verdict END AS mint_verdict FROM enrichments e JOIN sightings s ON e.id = s.offer_id")
def verdict_stamp(t):
    s = t.sightings.select(F.col("offer_id").alias("id"), "line", "match_band")
    resolved = s.where("match_band in ('auto', 'created')").select("id", F.lit("minted").alias("mint_verdict"))
    weak = s.where("match_band = 'review' and line = 1").select("id", F.lit("low_corroboration").alias("mint_verdict"))
    own = S.patch(t.enrichments.select("id", "mint_verdict"), resolved.unionByName(weak), "id", ("mint_verdict",))
    # readings of line 5 are opened again
    again = s.where("line = 5").select("id", F.lit(None).cast("string").alias("mint_verdict"))
    return S.patch(own, again, "id", ("mint_verdict",))


@query("SNK-11_audit_rows", "SELECT id, action, json_extract_string(detail, '$.enriched')::BIGINT AS enriched, json_extract_string(detail, '$.elapsed_cents')::BIGINT AS elapsed_cents, detail FROM (SELECT id, action, '{' || concat_ws(',', '\"enriched\":' || enriched, '\"elapsed_cents\":' || elapsed_cents) || '}' AS detail FROM (SELECT id, action, enriched, elapsed_cents FROM runs UNION ALL SELECT id + 1000000000, 'verify:' || action, NULL, elapsed_cents FROM runs WHERE NOT ok))")
def audit(t):
    cols = ("id", "action", "enriched", "elapsed_cents")
    new = t.runs.where("not ok").select((F.col("id") + 1_000_000_000).alias("id"), F.concat(F.lit("verify:"), "action").alias("action"), F.lit(None).cast("bigint").alias("enriched"), "elapsed_cents")
    out = S.append_rows(t.runs.select(*cols), new, ["enriched", "elapsed_cents"])
    back = F.from_json("detail", "enriched bigint, elapsed_cents bigint")
    return out.select("id", "action", back["enriched"].alias("enriched"), back["elapsed_cents"].alias("elapsed_cents"), "detail")


JOBS = f"""jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'stopped' END AS state, CASE WHEN o_orderkey % 3 <> 0 THEN 'w' || (o_custkey % 5) END AS owner, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::TIMESTAMP + INTERVAL 8 HOUR END AS lease_until FROM orders),
claims AS (SELECT event_id AS n, 1 + (event_id * 7) % (SELECT max(o_orderkey) FROM orders) AS job, 'w' || (user_id % 9) AS worker, ts::TIMESTAMP AS asked_at FROM events)"""


def jobs(t):
    o = t.read("orders")
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("stopped")
    lease = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 8 hours")
    return o.select(F.col("o_orderkey").alias("id"), state.alias("state"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("w"), (F.col("o_custkey") % 5).cast("string"))).alias("owner"), F.when(F.col("o_orderkey") % 4 != 0, lease).alias("lease_until"))


@query("SNK-13_lease_claim", f", {JOBS}, first_claim AS (SELECT job, arg_min(worker, (asked_at, worker)) AS worker FROM claims GROUP BY job), taken AS (SELECT j.*, c.worker, state = 'running' AND (lease_until IS NULL OR lease_until < TIMESTAMP '{TODAY} 00:00:00') AND c.worker IS NOT NULL AS take FROM jobs j LEFT JOIN first_claim c ON j.id = c.job) SELECT id, state, CASE WHEN take THEN worker ELSE owner END AS owner, CASE WHEN take THEN TIMESTAMP '{TODAY} 00:10:00' ELSE lease_until END AS lease_until FROM taken")
def lease(t):
    last = t.read("orders").agg(F.max("o_orderkey").alias("m"))
    c = t.read("events").join(F.broadcast(last), F.lit(True))
    claims = c.select((1 + F.col("event_id") * 7 % F.col("m")).alias("job"), F.concat(F.lit("w"), (F.col("user_id") % 9).cast("string")).alias("worker"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return S.claim(jobs(t), claims, stamp(f"{TODAY} 00:00:00"), "10 minutes")


@query("SNK-14_backfill", "SELECT id, identity, brand FROM offers WHERE line <= 3 AND (line <> 2 OR size % 2 = 0)")
def backfill(t):
    o = t.offers.where("line <= 3")
    # the stored stamps: those of line 2 are right unless their brand is missing
    old = o.select("id", F.when(F.col("line") == 2, F.col("identity")).alias("identity"), F.when((F.col("line") == 2) & (F.col("size") % 2 != 0), F.col("brand")).alias("brand"))
    return S.changed(old, o.select("id", "identity", "brand"), "id", ("identity", "brand"))


WATCHES = "watches0 AS (SELECT c_custkey AS id, 'watch ' || c_custkey AS label, c_custkey % 50 + 1 AS target, TRUE AS active, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS profile FROM customer WHERE c_custkey % 3 <> 0)"


@query("SNK-17_watch_writes", f""", {WATCHES}, made AS (SELECT c_custkey AS id, 'new ' || c_custkey AS label, 5 AS target, TRUE AS active, NULL AS profile FROM customer WHERE c_custkey % 3 = 0),
written AS (SELECT id, label, CASE WHEN id % 4 = 0 THEN target + 1 ELSE target END AS target, CASE WHEN id % 4 = 0 THEN FALSE ELSE active END AS active, profile FROM watches0 UNION ALL SELECT * FROM made)
SELECT id, label, target, active, coalesce(profile, (SELECT arg_min('p' || user_id, (ts, 'p' || user_id)) FROM events WHERE event_type = 'view')) AS profile FROM written""")
def watch_writes(t):
    c = t.read("customer")
    k = F.col("c_custkey")
    old = c.where("c_custkey % 3 <> 0").select(k.alias("id"), F.concat(F.lit("watch "), k.cast("string")).alias("label"), (k % 50 + 1).alias("target"), F.lit(True).alias("active"), F.when(k % 11 != 0, F.col("c_mktsegment")).alias("profile"))
    new = c.where("c_custkey % 3 = 0").select(k.alias("id"), F.concat(F.lit("new "), k.cast("string")).alias("label"), F.lit(5).cast("bigint").alias("target"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("profile"))
    changes = old.where("id % 4 = 0").select("id", (F.col("target") + 1).alias("target"), F.lit(False).alias("active"))
    rows = S.patch(old, changes, "id", ("target", "active", "label")).unionByName(S.insert_absent(old, new, "id"))
    listers = t.read("events").where("event_type = 'view'").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("profile"), F.col("ts").alias("at"))
    return S.adopt(rows, listers)


@query("SNK-17_alert_writes", f", crossed AS (SELECT * FROM (SELECT *, lag(price <= 3000) OVER (PARTITION BY watch ORDER BY ts, id) AS before FROM (SELECT event_id AS id, user_id AS watch, ts, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END AS price FROM events) WHERE price IS NOT NULL) WHERE price <= 3000 AND NOT coalesce(before, FALSE)) SELECT id, watch, price, CASE WHEN ts < TIMESTAMP '2024-01-20 00:00:00' AND watch % 2 = 0 THEN 1 ELSE 0 END AS seen FROM crossed")
def alert_writes(t):
    from shelfwise.operators import watches as Wt
    from shelfwise.plans.history import evaluations

    found = Wt.crossings(evaluations(t), "watch", ["ts", "id"], "price", F.lit(3000))
    old = found.where(F.col("ts").cast("timestamp_ntz") < stamp("2024-01-20 00:00:00")).select("id", "watch", "price", F.lit(0).alias("seen"))
    # profiles of even watches have read theirs
    read = old.where("watch % 2 = 0").select("id", F.lit(1).alias("seen"))
    rows = S.patch(old, read, "id", ("seen",))
    return rows.unionByName(S.insert_absent(rows, found.select("id", "watch", "price", F.lit(0).alias("seen")), "id"))


@query("SNK-17_job_writes", f", {JOBS} SELECT id, CASE WHEN state = 'running' AND id % 5 = 0 THEN 'stopped' ELSE state END AS state, CASE WHEN state = 'running' AND id % 5 = 0 THEN NULL ELSE owner END AS owner FROM jobs UNION ALL SELECT -o_orderkey, 'running', NULL FROM orders WHERE o_orderkey % 10 = 0 AND -o_orderkey NOT IN (SELECT id FROM jobs)")
def job_writes(t):
    own = jobs(t).drop("lease_until")
    stop = own.where("state = 'running' and id % 5 = 0").select("id", F.lit("stopped").alias("state"), F.lit(None).cast("string").alias("owner"))
    start = own.where("id % 10 = 0").select((-F.col("id")).alias("id"), F.lit("running").alias("state"), F.lit(None).cast("string").alias("owner"))
    rows = S.patch(own, stop, "id", ("state", "owner"))
    return rows.unionByName(S.insert_absent(rows, start, "id"))


@query("SNK-18_reassign", "SELECT s.offer_id, coalesce(q.id, s.product_id) AS product_id, CASE WHEN q.id IS NOT NULL THEN 'review' ELSE s.match_band END AS match_band FROM sightings s LEFT JOIN products p ON s.product_id = p.id LEFT JOIN products q ON p.merged_into = q.id")
def reassign(t):
    # sightings of merged products go to the survivor, where there is one
    to = t.products.where("merged_into is not null").select(F.col("id").alias("product_id"), F.col("merged_into").alias("target"))
    a = t.sightings.select("offer_id", "product_id").join(to, "product_id").select(F.lit("reassign").alias("action"), F.lit(None).cast("string").alias("product_id"), "offer_id", "target")
    return R.reviewed(t.products, t.sightings, a)[1].select("offer_id", "product_id", "match_band")


@query("SNK-18_match_text", "SELECT id, CASE WHEN n <= 400 THEN lower(coalesce(e_name, '')) ELSE match_text END AS match_text FROM (SELECT *, CASE WHEN match_text IS NULL THEN row_number() OVER (PARTITION BY match_text IS NULL ORDER BY id) END AS n FROM (SELECT id, e_name, CASE WHEN corroboration > 0.3 THEN lower(coalesce(e_name, '')) END AS match_text FROM enrichments))")
def match_text(t):
    own = t.enrichments.select("id", "e_name", F.when(F.col("corroboration") > 0.3, T.normalize_text(F.col("e_name"))).alias("match_text"))
    # a pass repairs 400 rows at most, by the repair's own rule
    some = own.where("match_text is null").orderBy("id").limit(400)
    return S.patch(own, some.select("id", T.normalize_text(F.col("e_name")).alias("match_text")), "id", ("match_text",)).select("id", "match_text")


@query("SNK-18_mark_pruned", f"SELECT id, valid_to < DATE '{TODAY}' - 28 AS pruned FROM brochures")
def mark_pruned(t):
    b = t.brochures.select("id", "valid_to", F.lit(False).alias("pruned"))
    gone = b.where(F.col("valid_to") < F.date_sub(day(TODAY), 28)).select("id", F.lit(True).alias("pruned"))
    return S.patch(b, gone, "id", ("pruned",)).select("id", "pruned")


OBJECTS = "SELECT 'pages/' || page_id || '.html' AS key, CASE WHEN page_id % 4 = 0 THEN html || '<!-- again -->' ELSE html END AS body, CASE WHEN page_id % 4 = 0 THEN 'text/html; v=2' ELSE 'text/html' END AS content_type FROM pages WHERE page_id % 7 <> 0"


@query("SRC-15_object_store", f"SELECT k.key, CASE WHEN o.key IS NOT NULL THEN strlen(o.body)::BIGINT END AS length, sha256(o.body) AS checksum, o.content_type FROM (SELECT 'pages/' || page_id || '.html' AS key FROM pages) k LEFT JOIN ({OBJECTS}) o ON k.key = o.key")
def objects(t):
    key = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    p = t.read("pages")
    stored = p.select(key.alias("key"), F.col("html").cast("binary").alias("content"), F.lit("text/html").alias("content_type"))
    again = p.where("page_id % 4 = 0").select(key.alias("key"), F.concat("html", F.lit("<!-- again -->")).cast("binary").alias("content"), F.lit("text/html; v=2").alias("content_type"))
    now = S.without(S.put_objects(stored, again), p.where("page_id % 7 = 0").select(key.alias("key")), "key")
    return S.get_objects(now, stored).select("key", F.length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("checksum"), "content_type")
