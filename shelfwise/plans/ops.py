"""Queries over runs, store health, writes and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.operators import health as H
from shelfwise.operators import sinks as S
from shelfwise.operators.history import first_by
from shelfwise.operators.registry import first_n
from shelfwise.sources.tables import TODAY, day



def now():
    return day(TODAY)

LAST = "runs_by_store AS (SELECT store, max(CASE WHEN ok THEN id END) AS last_ok, max(CASE WHEN NOT ok THEN id END) AS last_fail FROM runs GROUP BY store)"


@query("WIN-06_latest_runs", f", {LAST} SELECT store, last_ok, last_fail, last_fail IS NOT NULL AND (last_ok IS NULL OR last_fail > last_ok) AS failing FROM runs_by_store")
def latest_runs(t):
    return H.latest_runs(t.runs)


@query("WIN-07_last_runs_per_action", "SELECT action, id FROM runs QUALIFY row_number() OVER (PARTITION BY action ORDER BY id DESC) <= 8")
def last_runs(t):
    return first_n(t.runs, ["action"], 8, F.desc("id")).select("action", "id")


ROWS = f"""{LAST}, flyers AS (SELECT store, count(*) AS flyers, max((valid_to IS NULL OR valid_to >= DATE '{TODAY}')::INTEGER) AS fresh, sum(pages) AS pages, sum(least(pages, 7)) AS linked FROM brochures GROUP BY store),
  rows0 AS (SELECT c_custkey AS store, coalesce(f.flyers, 0) AS flyers, coalesce(f.fresh, 0) = 1 AS fresh, CASE WHEN f.pages > 0 THEN floor(f.linked::DOUBLE * 100 / f.pages * 10 + 0.5) / 10 END AS coverage,
    coalesce(last_fail IS NOT NULL AND (last_ok IS NULL OR last_fail > last_ok), FALSE) AS failing FROM customer LEFT JOIN flyers f ON c_custkey = f.store LEFT JOIN runs_by_store r ON c_custkey = r.store),
  store_rows AS (SELECT *, CASE WHEN failing THEN 'FAIL' WHEN flyers = 0 THEN 'NO_FLYER' WHEN NOT fresh THEN 'STALE' WHEN coverage < 90 THEN 'LOW_COVERAGE' ELSE 'OK' END AS status FROM rows0)"""


def rows(t):
    return H.store_rows(t.read("customer").select(F.col("c_custkey").alias("store")), t.brochures, t.runs, now())


@query("HEA-01_store_rows", f", {ROWS} SELECT store, flyers, fresh, coverage, failing, status FROM store_rows")
def store_rows(t):
    return rows(t).select("store", "flyers", "fresh", "coverage", "failing", "status")


@query("AGG-16_status_counts", f", {ROWS} SELECT status, count(*) AS n, sum(flyers)::BIGINT AS flyers FROM store_rows GROUP BY status")
def status_counts(t):
    return rows(t).groupBy("status").agg(F.count("*").alias("n"), F.sum("flyers").alias("flyers"))


@query("RANK-06_status_order", f", {ROWS} SELECT store, status FROM store_rows ORDER BY list_position(['FAIL', 'NO_FLYER', 'STALE', 'LOW_COVERAGE', 'OK'], status), store")
def status_order(t):
    return rows(t).orderBy(H.status_rank(F.col("status")), "store").select("store", "status")


@query("HEA-04_repair_targets", f", {ROWS} SELECT store FROM store_rows WHERE status IN ('FAIL', 'NO_FLYER')")
def repair(t):
    return rows(t).where(F.col("status").isin("FAIL", "NO_FLYER")).select("store")


@query("AGG-17_confidence", f", {ROWS}, parts AS (SELECT floor(avg(fresh::INTEGER) * 1000 + 0.5) / 10 AS a, floor(sum(coverage * 10) / count(coverage) + 0.5) / 10 AS b, NULL::DOUBLE AS c FROM store_rows) SELECT floor((a * 0.3 + b * 0.2) / 0.5 + 0.5)::BIGINT AS score FROM parts")
def confidence(t):
    fresh = H.tenth(F.avg(F.col("fresh").cast("int")) * 100)
    # coverages are tenths: exact sums of them
    coverage = H.tenth(F.sum(F.floor(F.col("coverage") * 10 + 0.5)) / F.count("coverage") / 10)
    g = rows(t).agg(fresh.alias("a"), coverage.alias("b"), F.lit(None).cast("double").alias("c"))
    return g.select(H.weighted_score([(F.col("a"), 0.3), (F.col("b"), 0.2), (F.col("c"), 0.5)]).alias("score"))


@query("AGG-15_run_report", "SELECT action, count(*) AS runs, sum(enriched)::BIGINT AS enriched, sum(elapsed_cents)::BIGINT AS elapsed, count(*) FILTER (NOT ok) AS failed FROM runs GROUP BY action")
def report(t):
    return t.runs.groupBy("action").agg(F.count("*").alias("runs"), F.sum("enriched").alias("enriched"), F.sum("elapsed_cents").alias("elapsed"), F.count_if(~F.col("ok")).alias("failed"))


@query("AGG-18_windowed_rate", "SELECT sum(enriched)::BIGINT AS enriched, floor(sum(enriched) / 24::DOUBLE * 10 + 0.5) / 10 AS per_hour FROM runs WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def rate(t):
    end = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    own = t.runs.where((F.col("ts").cast("timestamp_ntz") > end - F.expr("interval 24 hours")) & (F.col("ts").cast("timestamp_ntz") <= end))
    return own.agg(F.sum("enriched").alias("enriched"), H.tenth(F.sum("enriched") / 24).alias("per_hour"))


@query("AGG-19_latency", "SELECT CASE WHEN action IN ('view', 'click') THEN 'read' WHEN action = 'error' THEN 'failed' ELSE 'write' END AS kind, floor(sum(elapsed_cents)::DOUBLE / count(*) + 0.5)::BIGINT AS avg_cents, count(*) AS n FROM runs GROUP BY 1")
def latency(t):
    kind = F.when(F.col("action").isin("view", "click"), "read").when(F.col("action") == "error", "failed").otherwise("write")
    return t.runs.groupBy(kind.alias("kind")).agg(F.floor(F.sum("elapsed_cents").cast("double") / F.count("*") + 0.5).alias("avg_cents"), F.count("*").alias("n"))


@query("AGG-23_queue_snapshot", "SELECT count(*) FILTER (mint_verdict IS NULL) AS waiting, count(*) FILTER (mint_verdict = 'declined' OR corroboration < 0.3) AS deferred, count(*) FILTER (mint_verdict = 'minted') AS minted FROM enrichments")
def queue(t):
    v = F.col("mint_verdict")
    return t.enrichments.agg(F.count_if(v.isNull()).alias("waiting"), F.count_if(F.coalesce(v == "declined", F.lit(False)) | (F.col("corroboration") < 0.3)).alias("deferred"), F.count_if(v == "minted").alias("minted"))


@query("AGG-25_scheduler_info", "SELECT action, max(id) AS last_id, arg_max(ok, id) AS last_ok, count(*) AS fires FROM runs GROUP BY action")
def scheduler(t):
    return t.runs.groupBy("action").agg(F.max("id").alias("last_id"), F.max_by("ok", "id").alias("last_ok"), F.count("*").alias("fires"))


@query("RANK-05_flyer_ranking", f"SELECT store, id, pages FROM (SELECT * FROM brochures WHERE valid_to >= DATE '{TODAY}' QUALIFY row_number() OVER (PARTITION BY store, lower(title), valid_from, valid_to ORDER BY pages DESC, id DESC) = 1) QUALIFY row_number() OVER (PARTITION BY store ORDER BY (valid_from <= DATE '{TODAY}')::INTEGER DESC, pages DESC, valid_to DESC, id DESC) <= 4")
def flyer_ranking(t):
    one = first_by(t.brochures.where(F.col("valid_to") >= now()).withColumn("campaign", F.lower("title")), ["store", "campaign", "valid_from", "valid_to"], F.desc("pages"), F.desc("id"))
    return first_n(one, ["store"], 4, (F.col("valid_from") <= now()).cast("int").desc(), F.desc("pages"), F.desc("valid_to"), F.desc("id")).select("store", "id", "pages")


SPLIT = "SELECT id, store, price_cents, detected_at, CASE WHEN line % 2 = 0 THEN flyer_ref END AS edition FROM offers"


@query("SNK-01_offer_upsert", f""", old AS ({SPLIT} WHERE line <= 4), new AS (SELECT id, store, price_cents + 5 AS price_cents, detected_at + 1 AS detected_at, CASE WHEN edition % 3 = 0 THEN edition END AS edition FROM ({SPLIT} WHERE line >= 3))
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.store ELSE o.store END AS store, CASE WHEN n.id IS NOT NULL THEN n.price_cents ELSE o.price_cents END AS price_cents,
    CASE WHEN o.id IS NOT NULL THEN o.detected_at ELSE n.detected_at END AS detected_at, coalesce(n.edition, o.edition) AS edition FROM old o FULL JOIN new n ON o.id = n.id""")
def offer_upsert(t):
    df = t.offers.select("id", "store", "price_cents", "detected_at", F.when(F.col("line") % 2 == 0, F.col("flyer_ref")).alias("edition"), "line")
    old = df.where("line <= 4").drop("line")
    new = df.where("line >= 3").select("id", "store", (F.col("price_cents") + 5).alias("price_cents"), F.date_add("detected_at", 1).alias("detected_at"), F.when(F.col("edition") % 3 == 0, F.col("edition")).alias("edition"))
    return S.upsert(old, new, "id", keep=("detected_at",), fill=("edition",))


@query("SNK-03_point_replace", "SELECT identity, week, price_cents FROM (SELECT identity, week, price_cents, 0 AS v FROM points UNION ALL SELECT identity, week, price_cents - 1, 1 FROM points WHERE price_cents % 3 = 0) QUALIFY row_number() OVER (PARTITION BY identity, week ORDER BY v DESC) = 1")
def point_replace(t):
    p = t.points.select("identity", "week", "price_cents", F.lit(0).alias("v"))
    new = t.points.where("price_cents % 3 = 0").select("identity", "week", (F.col("price_cents") - 1).alias("price_cents"), F.lit(1).alias("v"))
    return S.replace_latest(p, new, ["identity", "week"], F.desc("v")).drop("v")


@query("SNK-04_insert_absent", "SELECT offer_id, product_id FROM sightings WHERE line > 4")
def insert_absent(t):
    return S.insert_absent(t.sightings.where("line <= 4"), t.sightings, "offer_id").select("offer_id", "product_id")


@query("SNK-07_tombstone", ", m AS (SELECT id AS loser, min(id) OVER (PARTITION BY display_name) AS survivor FROM products WHERE status <> 'merged'), mm AS (SELECT * FROM m WHERE loser <> survivor) SELECT p.id, CASE WHEN a.loser IS NOT NULL THEN 'merged' ELSE p.status END AS status, coalesce(a.survivor, b.survivor, p.merged_into) AS merged_into FROM products p LEFT JOIN mm a ON p.id = a.loser LEFT JOIN mm b ON p.merged_into = b.loser")
def tombstone(t):
    alive = t.products.where("status <> 'merged'")
    first = alive.groupBy("display_name").agg(F.min("id").alias("survivor"))
    m = alive.join(first, "display_name").where("id <> survivor").select(F.col("id").alias("loser"), "survivor")
    return S.tombstone(t.products, m).select("id", "status", "merged_into")


@query("SNK-09_set_current", ", rows0 AS (SELECT id, pages > 4 AS is_current FROM brochures) SELECT id, id % 4 = 0 AS is_current FROM rows0")
def set_current(t):
    r = t.brochures.select("id", (F.col("pages") > 4).alias("is_current"))
    return S.set_current(r, t.brochures.where("id % 4 = 0").select("id"), "id", True)


@query("SNK-12_deletes", f"SELECT id FROM offers WHERE NOT valid_to < DATE '{TODAY}' - 180")
def deletes(t):
    gone = t.offers.where(F.col("valid_to") < F.date_sub(now(), 180)).select("id")
    return S.without(t.offers.select("id"), gone, "id")


@query("SNK-15_snapshot_verdict", "SELECT id, CASE WHEN o IS NULL AND n = 0 THEN 'skipped' WHEN n = 0 AND o > 0 AND same THEN 'refused-empty' WHEN o = n THEN 'kept' ELSE 'written' END AS verdict FROM (SELECT id, CASE WHEN id % 5 <> 0 THEN pages END AS o, CASE WHEN id % 3 = 0 THEN 0 ELSE pages END AS n, id % 2 = 0 AS same FROM brochures)")
def snapshot(t):
    b = t.brochures
    v = S.snapshot_verdict(F.when(F.col("id") % 5 != 0, F.col("pages")), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("pages")), F.col("id") % 2 == 0)
    return b.select("id", v.alias("verdict"))


@query("SNK-16_checksum_ingest", "SELECT checksum, min(page_id) AS first_id, count(*) AS copies FROM (SELECT page_id, sha256(html) AS checksum FROM pages) GROUP BY checksum")
def checksum(t):
    p = t.read("pages").select("page_id", F.sha2("html", 256).alias("checksum"))
    return p.groupBy("checksum").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))


@query("RET-01_retention", f"SELECT (SELECT count(*) FROM offers WHERE valid_to < DATE '{TODAY}' - 180) AS offers_pruned, (SELECT count(*) FROM identities WHERE last_seen < DATE '{TODAY}' - 365) AS identities_pruned, (SELECT count(*) FROM brochures WHERE valid_to < DATE '{TODAY}' - 28) AS prunable")
def retention(t):
    older = lambda df, c, days: df.agg(F.count_if(F.col(c) < F.date_sub(now(), days)))
    return H.one_row({"offers_pruned": older(t.offers, "valid_to", 180), "identities_pruned": older(t.identities, "last_seen", 365), "prunable": older(t.brochures, "valid_to", 28)})


@query("JSN-01_json_decode", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_decode(t):
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    return t.read("events").select("event_id", F.coalesce(F.from_json(raw, "k bigint")["k"], F.lit(-1)).alias("k"))


@query("ARR-01_array_ops", "SELECT display_name, list_sort(list_distinct(flatten(list(tokens)))) AS tokens, count(*) AS n FROM products GROUP BY display_name")
def array_ops(t):
    return t.products.select("display_name", "id", F.explode("tokens").alias("token")).groupBy("display_name").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.countDistinct("id").alias("n"))


@query("TXT-16_slugs", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_extract(url, 'page=([0-9]+)', 1) AS page FROM pages")
def slugs(t):
    from shelfwise.functions.text import slug

    return t.read("pages").select("page_id", slug(F.col("url")).alias("slug"), F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"))
