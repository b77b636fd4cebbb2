"""Thin queries over the operators, as the contracts name their columns."""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, jpeg, licenses, minhash, packing, quality, secrets, sentencepieces, toxicity
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.written("base")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.written("spans").alias("spans"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jpeg.stored_digests(jpeg.store_texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), PIECE_BPE)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def queries() -> dict:
    made = (
        op1_secret_scans,
        op2_media_columns,
        op3_embedding_dedup,
        op4_toxicity,
        op5_sentencepiece,
        op6_packing,
        op7_minhash_dedup,
        op8_quality,
        op9_license_scans,
        op10_token_counts,
    )
    return {f.__name__: f for f in made}


#: Components by repeated minima over links (a, b) among nodes, for small tables.
COMPONENTS = """
reach(node, other) AS (SELECT n, n FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
comps AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""

VECTORS_SQL = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
valid AS (SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(x.v, lambda p: p * p))) / sqrt(list_sum(list_transform(y.v, lambda p: p * p))) >= 0.98),
nodes AS (SELECT vec_id AS n FROM vectors),{COMPONENTS}
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN comps ON vec_id = node LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) c ON vec_id = a"""

NEAR_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) WHERE 100 * c >= 85 * (na + nb - c)),
nodes AS (SELECT doc_id AS n FROM documents),{COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comps ON doc_id = node"""


def secrets_sql() -> str:
    """``op1_secret_scans`` for DuckDB: matches, their places from the pieces between them, battery and false-discovery limit."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ctes, parts = [], []
    for i, (kind, regex, group, least) in enumerate((*secrets.PATTERNS, ("random", secrets.TOKEN, 0, 0))):
        r = quote(regex)
        ctes.append(f"{kind}0 AS (SELECT r, regexp_extract_all(t, {r}, 0) AS m, regexp_extract_all(t, {r}, {group}) AS g, string_split_regex(t, {r}) AS p FROM docs WHERE regexp_matches(t, {r}))")
        ctes.append(f"""{kind} AS (SELECT r, m[i] AS x, (list_sum(list_transform(m[:i - 1] || p[:i], lambda y: length(y))))::BIGINT AS a, {i} AS kind FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}0) WHERE length(g[i]) >= {least})""")
        if kind != "random":
            parts.append(f"SELECT r, kind, a, a + length(x) AS b FROM {kind}")
    infer = "CASE " + " ".join(f"WHEN regexp_matches(x, {quote(p)}) THEN {quote(a)}" for p, a in secrets.ENCODINGS) + " ELSE '' END"
    ratios = ["[" + ", ".join(f"{math.log(1000 / 26 / n)!r}::DOUBLE" for n in one) + "]" for one in secrets.LETTERS]
    even = ", ".join(f"coalesce(list_sum(list_transform(list_filter(c, lambda z: regexp_matches(z, '[A-Za-z]')), lambda z: ({r})[ascii(lower(z)) - 96])), 0)" for r in ratios)
    cls = "CASE WHEN regexp_matches(c, '[0-9]') THEN 0 WHEN regexp_matches(c, '[A-Z]') THEN 1 ELSE 2 END"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), {", ".join(ctes)},
base AS ({" UNION ALL ".join(parts)}),
e AS (SELECT r, x, a, length(x)::DOUBLE AS n, {infer} AS al, string_split(x, '') AS c FROM random),
v AS (SELECT *, length(al)::DOUBLE AS k, list_transform(c, lambda z: strpos(al, z) - 1.0::DOUBLE) AS s, list_transform(list_filter(c, lambda z: regexp_matches(z, '[A-Za-z0-9]')), lambda c: {cls}) AS f,
  CASE WHEN length(al) IN {secrets.ONE_CASE} THEN least({even}) - ln(2::DOUBLE) ELSE 0 END AS ll,
  list_sum(list_transform(list_distinct(c), lambda d: pow(len(list_filter(c, lambda z: z = d)), 2))) AS q FROM e),
w AS (SELECT *, len(f)::DOUBLE AS m, len(list_filter(s, lambda z: z >= k / 2))::DOUBLE AS h,
  1 + list_sum(list_transform(range(2, len(s) + 1), lambda i: CASE WHEN (s[i] >= k / 2) <> (s[i - 1] >= k / 2) THEN 1.0::DOUBLE ELSE 0 END)) AS runs0,
  list_sum(s) AS s1, list_sum(list_transform(s, lambda z: z * z)) AS s2, list_sum(list_transform(range(2, len(s) + 1), lambda i: s[i] * s[i - 1])) + s[len(s)] * s[1] AS sp,
  list_sum(list_transform(range(2, len(f) + 1), lambda i: CASE WHEN f[i] <> f[i - 1] THEN 1.0::DOUBLE ELSE 0 END)) AS sw FROM v),
z AS (SELECT *, CASE WHEN k > 1 THEN ((k * q / n - n) - (k - 1)) / sqrt(2 * (k - 1) * (1 - 1 / n)) ELSE 99 END AS chi,
  CASE WHEN 2 * h * (n - h) > n THEN (runs0 - 1 - 2 * h * (n - h) / n) / sqrt(2 * h * (n - h) * (2 * h * (n - h) - n) / (n * n * (n - 1))) ELSE 99 END AS runs,
  CASE WHEN n * s2 > s1 * s1 THEN ((n * sp - s1 * s1) / (n * s2 - s1 * s1) + 1 / (n - 1)) * (n - 1) * sqrt(n - 2) / n ELSE 99 END AS serial, greatest(m - 1, 1.0::DOUBLE) AS j, coalesce(sw, 0) / greatest(m - 1, 1.0::DOUBLE) AS f2 FROM w),
y AS (SELECT r, a, n, a + n::BIGINT AS b,
  floor(least(greatest(0, greatest(ll, CASE WHEN f2 > {secrets.SWITCH} THEN j * (f2 * ln(f2 / {secrets.SWITCH}::DOUBLE) + CASE WHEN f2 < 1 THEN (1 - f2) * ln((1 - f2) / {1 - secrets.SWITCH}::DOUBLE) ELSE 0 END) ELSE 0 END)
    - greatest(0, pow(greatest(chi, abs(runs), abs(serial)), 2) / 2 - ln({secrets.TESTS}::DOUBLE))), 200) * 4) / 4 AS evidence FROM z),
u AS (SELECT *, evidence + ln(least(n, 256) / (SELECT avg(least(n, 256)) FROM y)) AS weighted FROM y),
ranked AS (SELECT weighted, count(*) OVER (ORDER BY weighted DESC) AS found FROM u),
lim AS (SELECT min(weighted) AS least FROM ranked WHERE weighted >= ln((SELECT count(*) FROM u)::DOUBLE / (found * {secrets.FDR}))),
more AS (SELECT r, {len(secrets.PATTERNS)} AS kind, a, b FROM u WHERE weighted >= (SELECT least FROM lim) AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = u.r AND base.a < u.b AND base.b > u.a)),
named AS (SELECT *, (['{"', '".join(secrets.KINDS)}'])[kind + 1] || ':' || a || ':' || b AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
joined AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.KINDS[:3]))}, string_agg(s, ',' ORDER BY a, kind) FILTER (kind < {len(secrets.PATTERNS)}) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.KINDS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": secrets_sql(),
        "op3_embedding_dedup": VECTORS_SQL,
        "op7_minhash_dedup": NEAR_SQL,
        "op9_license_scans": licenses.license_sql(),
    }
