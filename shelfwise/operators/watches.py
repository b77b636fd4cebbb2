"""Price watches: validation, evaluation and the crossing detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def verdict(label: Column, target: Column, kind: Column, least: int, most: float, kinds: tuple[str, ...]) -> Column:
    """ok, or the first rule that a watch breaks."""
    short = F.length(F.trim(F.coalesce(label, F.lit("")))) < least
    return F.when(short, "label-too-short").when((target <= 0) | (target > most), "target-out-of-range").when(~kind.isin(*kinds), "unknown-kind").otherwise("ok")


def crossings(evaluations: DataFrame, key: str, order: list[str], price: str, target: Column) -> DataFrame:
    """Evaluations that raise an alert: at or under the target while the evaluation before, of those with a price, was over it.

    A first hit alerts; an evaluation without a price changes nothing; one over the target re-arms.
    """
    seen = evaluations.where(F.col(price).isNotNull()).withColumn("hit", F.col(price) <= target)
    before = F.lag("hit").over(W.partitionBy(key).orderBy(*order))
    return seen.withColumn("_before", before).where(F.col("hit") & ~F.coalesce("_before", F.lit(False))).drop("_before")


#: Least relevance of a name that a watch acts on.
RELEVANCE_FLOOR = 50


def grocery(watches: DataFrame, market: DataFrame, asked: tuple[str, ...]) -> DataFrame:
    """(watch, price_cents, id, store, candidates): the cheapest offer that each watch (watch, asked, wanted) means.

    ``market`` (id, store, name, size, price_cents) holds flyer and online offers. A candidate's name is relevant to the
    search by ``RELEVANCE_FLOOR`` at least, its size within a quarter of the wanted one, and the ladder of alerts keeps
    it; a pool that the ladder empties stays silent. The texts of all searches, ``asked``, are literals: relevance and
    stage are computed once for each distinct name, and offers are first reduced to the best and the count of each name
    and size, so a watch meets the sizes of the names it means, not offers.
    """
    from functools import reduce

    from shelfwise.functions import families
    from shelfwise.functions import identity as I
    from shelfwise.functions import text as T
    from shelfwise.operators.search import POLICIES, ladder

    sizes = market.groupBy("name", "size").agg(F.min(F.struct("price_cents", "id", "store")).alias("b"), F.count("*").alias("n"))
    names = T.with_words(sizes.select("name").distinct(), "name", "x").withColumn("none", F.lit(None).cast("string"))
    ws = F.col("x_words")
    rows = []
    for text in asked:
        q = T.Query.of(text)
        produce = I.fresh_intent(q)
        df = names.withColumn("relevance", T.name_relevance(q, F.col("x_text"), ws)).where(F.col("relevance") >= RELEVANCE_FLOOR)
        df = T.with_stage(df, q, "name", "none")
        fresh = I.fresh(ws, families.product_type(ws), produce) if produce else F.lit(True)
        of = F.lit(families_named(q)).cast("string")
        rows.append(df.select(F.lit(text).alias("asked"), "name", "stage", families.family(ws).alias("family"), families.product_type(ws).alias("type"), F.lit(len(q.tokens) > 1).alias("multi"), of.alias("q_family"), F.lit(form_named(q)).cast("string").alias("q_type"), F.lit(produce).cast("string").alias("q_fresh"), fresh.alias("fresh")))
    meant = reduce(DataFrame.unionByName, rows)
    near = F.abs(F.col("size") - F.col("wanted")) * 4 <= F.greatest(F.col("size").cast("bigint"), F.col("wanted"))
    pool = watches.join(meant, "asked").join(sizes, "name").where(near)
    pool = ladder(pool, ["watch"], POLICIES["alert"], F.col("multi"), F.col("q_family"), F.col("q_type"), F.col("n"), F.col("q_fresh"), F.col("fresh")).where("excluded is null")
    return pool.groupBy("watch").agg(F.min("b").alias("b"), F.sum("n").alias("candidates")).select("watch", "b.*", "candidates")


def families_named(q) -> str | None:
    """The family that a search names: a compound product's, else a base one, else produce."""
    from shelfwise.functions import families as Fm

    of = lambda lexicon: next((k for w in q.tokens for k, ws in lexicon.items() if w in ws), None)
    return of(Fm.DERIVED_FAMILIES) or of(Fm.BASE_FAMILIES) or of(Fm.PRODUCE_FAMILIES)


def form_named(q) -> str | None:
    from shelfwise.functions import families as Fm

    return next((k for w in q.tokens for k, ws in Fm.PRODUCT_TYPES.items() if w in ws), None)


def products_found(watches: DataFrame, results: DataFrame) -> DataFrame:
    """(watch, price_cents, note) of watches (watch, provider, product) among live results (provider, id, link, place, price_cents).

    A result is the product by its id, else by a link whose path names the id; of several the first place counts. The
    note says priced, no price, or not found.
    """
    named = F.regexp_extract("link", r"/p/(\d+)-", 1)
    keys = F.array(F.struct(F.col("id").alias("k"), F.lit(0).alias("by")), F.struct(F.when(named != "", named).alias("k"), F.lit(1).alias("by")))
    r = results.select("provider", "place", "price_cents", F.explode(keys).alias("x")).select("provider", F.col("x.k").alias("product"), F.struct(F.col("x.by").alias("by"), "place", "price_cents").alias("r")).where("product is not null")
    first = r.groupBy("provider", "product").agg(F.min("r").alias("r"))
    j = watches.join(first, ["provider", "product"], "left")
    price = F.when(F.col("r.price_cents") > 0, F.col("r.price_cents"))
    note = F.when(F.col("r").isNull(), "not found").when(price.isNotNull(), "priced").otherwise("no price")
    return j.select("watch", price.alias("price_cents"), note.alias("note"))


def registry_best(watches: DataFrame, products: DataFrame, sightings: DataFrame, current: DataFrame) -> DataFrame:
    """(watch, product_id, name, price_cents, id): the cheapest current sighting of the product that each watch (its id) names.

    A merged product stands for its survivor, and sightings of merged losers count for it; without a current sighting the
    watch is silent.
    """
    to = products.select("id", F.when(F.col("status") == "merged", F.col("merged_into")).alias("into"))
    alive = products.select(F.col("id").alias("product_id"), F.col("display_name").alias("name"))
    w = watches.join(to, F.col("watch") == F.col("id")).select("watch", F.coalesce("into", "id").alias("product_id")).join(alive, "product_id")
    s = sightings.select(F.col("offer_id"), F.col("product_id").alias("id")).join(to, "id", "left").select(F.col("offer_id").alias("id"), F.coalesce("into", "id").alias("product_id"))
    best = s.join(current.select("id", "price_cents"), "id").groupBy("product_id").agg(F.min(F.struct("price_cents", "id")).alias("b"))
    return w.join(best, "product_id").select("watch", "product_id", "name", "b.price_cents", "b.id")


def notification(label: Column, cents: Column, target: Column) -> Column:
    money = lambda c: F.concat(F.lit("SAR "), F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    return F.concat(F.lit("Watch "), label, F.lit(": now "), money(cents), F.lit(" (target "), money(target), F.lit(")"))
