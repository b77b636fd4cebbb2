"""Queries over names and texts: normal forms, relevance, sizes, families, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.functions import families as Fm
from shelfwise.functions import sizes as Z
from shelfwise.functions import text as T
from shelfwise.operators import search as Se
from shelfwise.sources.tables import TODAY, day



def now():
    return day(TODAY)

NORM = (
    "trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(coalesce({0}, '')), '"
    + T.AR_DIACRITICS
    + "', '', 'g'), '"
    + T.FOLD_FROM
    + "', '"
    + T.FOLD_TO
    + "'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query("TXT-01_normalize", f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def normalize(t):
    return t.read("documents").select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("norm_md5"))


NAMES = "(SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)"


@query("TXT-05_token_score", f"SELECT p_partkey, CASE WHEN list_contains(w, 'gear') THEN 100 WHEN contains(' ' || p_name, ' gear') THEN 70 ELSE 0 END AS s1, CASE WHEN list_contains(w, 'idget') THEN 100 WHEN contains(' ' || p_name, ' idget') THEN 70 WHEN contains(p_name, 'idget') THEN 40 ELSE 0 END AS s2 FROM {NAMES}")
def token_scores(t):
    df = T.with_words(t.read("part"), "p_name", "x")
    return df.select("p_partkey", *[T.token_score(v, F.col("x_text"), F.col("x_words")).alias(a) for v, a in (("gear", "s1"), ("idget", "s2"))])


@query("TXT-07_name_relevance", f"SELECT p_partkey, CASE WHEN list_contains(w, 'red') AND contains(p_name, 'widge') THEN (100 + CASE WHEN contains(' ' || p_name, ' widge') THEN 70 ELSE 40 END) / 2.0::DOUBLE ELSE 0.0 END AS score FROM {NAMES}")
def relevance(t):
    df = T.with_words(t.read("part"), "p_name", "x")
    return df.select("p_partkey", T.name_relevance(T.Query.of("red widge"), F.col("x_text"), F.col("x_words")).alias("score"))


@query("TXT-10_match_stage", f"SELECT p_partkey, CASE WHEN NOT list_contains(w, 'ring') THEN 0 WHEN w[1] = 'ring' THEN 5 WHEN w[1] = 'new' AND w[2] = 'ring' THEN 5 ELSE 4 END AS stage FROM {NAMES}")
def stage(t):
    df = T.with_stage(t.read("part").withColumn("none", F.lit("")), T.Query.of("ring"), "p_name", "none")
    return df.select("p_partkey", "stage")


@query("TXT-10_match_stage_phrase", f"SELECT p_partkey, CASE WHEN p_name = 'hot gear' THEN 5 WHEN list_contains(w, 'hot') OR list_contains(w, 'gear') THEN 1 ELSE 0 END AS stage FROM {NAMES}")
def stage_phrase(t):
    df = T.with_stage(t.read("part").withColumn("none", F.lit("")), T.Query.of("hot gear"), "p_name", "none")
    return df.select("p_partkey", "stage")


@query("TXT-11_head_word", f"SELECT p_partkey, CASE WHEN w[1] = 'new' THEN w[2] ELSE w[1] END AS head FROM {NAMES}")
def head(t):
    return T.with_words(t.read("part"), "p_name", "x").select("p_partkey", T.head_word(F.col("x_words")).alias("head"))


@query("TXT-14_corroboration", "SELECT id, (CASE WHEN list_contains(string_split(search_text, ' '), split_part(name, ' ', 1)) THEN 1 ELSE 0 END + CASE WHEN contains(brand, '#1') THEN 0 ELSE 1 END) / 2.0::DOUBLE AS share FROM offers")
def corroboration(t):
    # the second word is looked up in a text that holds the name's first word and, for some brands, the second
    first, second = F.split("name", " ")[0], F.split("name", " ")[1]
    hay = F.when(F.contains(F.col("brand"), F.lit("#1")), first).otherwise(F.concat_ws(" ", first, second))
    return t.offers.select("id", T.corroboration(F.col("name"), hay).alias("share"))


@query("TXT-15_evidence_tokens", "SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w: w <> 'new') AS tokens FROM part")
def evidence(t):
    return t.read("part").select("p_partkey", T.evidence_tokens(F.concat_ws(" ", "p_name", F.lit("2 x 500 ml offer 12"))).alias("tokens"))


@query("SIZ-01_parse_size", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN 'pcs' END AS unit, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN p_size * 6.0::DOUBLE WHEN 2 THEN p_size::DOUBLE END AS total FROM part")
def parse_size(t):
    n = F.col("p_size").cast("string")
    label = F.when(F.col("p_partkey") % 4 == 0, F.concat(n, F.lit(" L"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("6 x "), n, F.lit("gm"))).when(F.col("p_partkey") % 4 == 2, F.concat(n, F.lit(" قطعة"))).otherwise(F.lit("plain"))
    df = Z.with_size(t.read("part").withColumn("label", F.concat_ws(" ", "p_name", label)), "label")
    return df.select("p_partkey", "size_read.unit", "size_read.total")


@query("SIZ-02_size_relations", "SELECT p_partkey, abs(p_size - 20)::DOUBLE / greatest(p_size, 20) > 0.03 AS contradicts, abs(p_size - 20)::DOUBLE / greatest(p_size, 20) <= 0.25 AS comparable FROM part")
def size_relations(t):
    df = Z.with_size(t.read("part").withColumn("label", F.concat(F.col("p_size").cast("string"), F.lit(" ml"))), "label")
    want = F.struct(F.lit("ml").alias("unit"), F.lit(20.0).alias("total"))
    return df.select("p_partkey", Z.contradicts(F.col("size_read"), want).alias("contradicts"), Z.comparable(F.col("size_read"), want).alias("comparable"))


LEXICON = {"ring": ["ring", "rod"], "machine": ["gear", "widget", "gizmo"], "plate": ["plate", "anvil"]}
FAMILY = "CASE WHEN w[2] IN ('ring', 'rod') THEN 'ring' WHEN w[2] IN ('gear', 'widget', 'gizmo') THEN 'machine' WHEN w[2] IN ('plate', 'anvil') THEN 'plate' END"


@query("CLS-04_offer_family", f"SELECT p_partkey, coalesce({FAMILY}, CASE WHEN p_type = 'PROMO' THEN 'eggs' END) AS family FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)")
def offer_family(t):
    df = T.with_words(t.read("part"), "p_name", "x")
    return df.select("p_partkey", Fm.offer_family(F.col("x_words"), F.when(F.col("p_type") == "PROMO", "eggs"), base=LEXICON).alias("family"))


BANDED = f"""SELECT *, (CASE WHEN list_contains(string_split(search_text, ' '), 'hot') THEN 2 WHEN contains(' ' || search_text, ' hot') THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(search_text, ' '), 'r') THEN 2 WHEN contains(' ' || search_text, ' r') THEN 1 ELSE 0 END) AS band
  FROM (SELECT * FROM offers WHERE valid_to >= DATE '{TODAY}') WHERE contains(search_text, 'hot') AND contains(search_text, 'r')"""


@query("FLT-06_token_prefilter", f"SELECT id FROM ({BANDED})")
def prefilter(t):
    return Se.retrieve(t.current_offers, T.Query.of("hot r"), "search_text", 1 << 30).select("id")


@query("RANK-02_banded_window", f"SELECT id, band FROM ({BANDED}) ORDER BY band DESC, price_cents, id LIMIT 300")
def banded(t):
    return Se.retrieve(t.current_offers, T.Query.of("hot r"), "search_text").select("id", "band")


@query("RANK-03_search_order", f"SELECT id, CASE WHEN name LIKE 'ring%' OR name = 'new ring' THEN 5 ELSE 4 END AS stage, price_cents FROM (SELECT * FROM offers WHERE valid_to >= DATE '{TODAY}' AND list_contains(string_split(name, ' '), 'ring') ORDER BY price_cents, id LIMIT 120) ORDER BY 2 DESC, price_cents, id LIMIT 40")
def search_order(t):
    df = Se.search(t.current_offers, T.Query.of("ring"), "name", "search_text", "brand", 40)
    return df.select("id", "stage", "price_cents")
