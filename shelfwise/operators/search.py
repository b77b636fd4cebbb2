"""Ranked search and the gate ladder that decides which candidates are the product a search means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions import text as T


@dataclass(frozen=True)
class Policy:
    """What a journey declares: whether stages 4 and 5 are one band for single words, whether the pool's dominant
    family may stand in for an unnamed one, and whether a gate that would empty the pool is not applied."""

    primary_band: bool
    dominant: bool
    never_empty: bool


POLICIES = {"summary": Policy(False, True, True), "alert": Policy(False, True, False), "history": Policy(True, False, True)}


def band(stage: Column, multi_word: Column, policy: Policy) -> Column:
    single = F.when(stage >= 4, 4).otherwise(stage) if policy.primary_band else stage
    return F.when(multi_word, F.when(stage >= 2, 2).otherwise(stage)).otherwise(single)


def ladder(pool: DataFrame, keys: list[str], policy: Policy, multi_word: Column, query_family: Column, query_type: Column, weight: Column | None = None, fresh_family: Column | None = None, fresh: Column | None = None) -> DataFrame:
    """``pool`` (keys, id, stage, family, type) with ``excluded``: null for kept candidates, else the gate that took them.

    Gates run in turn over each pool of ``keys``: the best stage band; the named or dominant family (candidates without
    a family stay); the named form (without a form stay); where the search means fresh produce (``fresh_family``) and no
    other family is the target, those that may be it (``fresh``). Each gate's pool figures are window aggregates, so a
    pool is never collected. A policy that never empties a pool skips a gate that would. ``weight``: candidates that a row
    stands for.
    """
    weight = F.lit(1) if weight is None else weight
    counted = lambda c: F.sum(F.when(c, weight).otherwise(0))
    w = W.partitionBy(*keys)
    df = pool.withColumn("_band", band(F.col("stage"), multi_word, policy))
    df = df.withColumn("excluded", F.when(F.col("_band") < F.max("_band").over(w), "stage"))
    alive = F.col("excluded").isNull()
    target = query_family
    if policy.dominant:
        own = W.partitionBy(*keys, "family")
        df = df.withColumns({"_same": counted(alive & F.col("family").isNotNull()).over(own), "_known": counted(alive & F.col("family").isNotNull()).over(w)})
        # over half of those with a family, and two at least: no two families can both be dominant
        lead = F.max(F.when(alive & (F.col("_same") >= 2) & (F.col("_same") * 2 > F.col("_known")), F.col("family"))).over(w)
        target = F.coalesce(query_family, lead)
    df = df.withColumn("target_family", target)
    gates = [("family", F.col("family") != F.col("target_family")), ("type", F.col("type") != query_type)]
    if fresh_family is not None:
        meant = fresh_family.isNotNull() & (F.col("target_family").isNull() | (F.col("target_family") == fresh_family))
        gates.append(("fresh", meant & ~fresh))
    for name, other in gates:
        out = F.coalesce(other, F.lit(False))
        left = F.count_if(F.col("excluded").isNull() & ~out).over(w)
        skip = (left == 0) if policy.never_empty else F.lit(False)
        df = df.withColumn("_left", skip)
        df = df.withColumn("excluded", F.when(F.col("excluded").isNull() & out & ~F.col("_left"), name).otherwise(F.col("excluded")))
    return df.drop("_band", "_same", "_known", "_left")


def retrieve(df: DataFrame, q: T.Query, haystack: str, limit: int = 300) -> DataFrame:
    """The banded window: rows that hold every token or a synonym, exact words first, then word starts, then price."""
    df = T.with_words(df, haystack, "_h")
    text, ws = F.col("_h_text"), F.col("_h_words")
    own = []
    for variants in q.variants:
        word = T.strings(variants)
        start = [F.contains(F.concat(F.lit(" "), text), F.lit(" " + v)) for v in variants]
        inside = [F.contains(text, F.lit(v)) for v in variants]
        any_of = lambda cs: F.greatest(*[c.cast("int") for c in cs]) if len(cs) > 1 else cs[0].cast("int")
        df = df.where(any_of(inside) == 1)
        own.append(F.when(F.arrays_overlap(ws, word), 2).when(any_of(start) == 1, 1).otherwise(0))
    rank = sum(own[1:], own[0]) if own else F.lit(0)
    return df.withColumn("band", rank).orderBy(F.desc("band"), "price_cents", "id").limit(limit).drop("_h_text", "_h_words")


def family_rank(ws: Column, family: Column, q: T.Query) -> Column:
    """2 of the family that the search names, 1 of none known (or none named), 0 of another; for fresh produce, forms and
    flavours fall to 0 and processed produce to 1."""
    from shelfwise.functions import families, identity

    of = lambda lexicon: next((k for w in q.tokens for k, ws in lexicon.items() if w in ws), None)
    named = of(families.DERIVED_FAMILIES) or of(families.BASE_FAMILIES) or of(families.PRODUCE_FAMILIES)
    if named is None:
        return F.lit(1)
    rank = F.when(family == named, 2).when(family.isNull(), 1).otherwise(0)
    produce = identity.fresh_intent(q)
    if produce is None:
        return rank
    form = families.product_type(ws)
    flavoured = F.coalesce(identity.produce_presence(ws, tuple(families.PRODUCE_FAMILIES[produce])) == "flavored", F.lit(False))
    return F.when((rank == 2) & form.isNotNull(), 0).when((rank == 2) & identity.is_processed(ws), 1).when((rank == 1) & flavoured, 0).otherwise(rank)


def search(df: DataFrame, q: T.Query, name: str, body: str, brand: str, limit: int = 40, category: Column | None = None) -> DataFrame:
    """Offers for a search: banded window of 3 * limit (120 to 300), relevance, stage; by stage, family rank, score, price, id."""
    from shelfwise.functions import families

    pool = retrieve(df, q, body, min(300, max(120, 3 * limit)))
    pool = T.with_words(T.with_words(pool, name, "_x"), body, "_y")
    score, in_name = T.offer_relevance(q, F.col("_x_text"), F.col("_x_words"), F.col("_y_text"), F.col("_y_words"))
    family = families.offer_family(F.col("_x_words"), F.lit(None).cast("string") if category is None else category)
    pool = T.with_stage(pool.withColumns({"score": score, "name_match": in_name, "fam_rank": family_rank(F.col("_x_words"), family, q)}).where("score > 0"), q, name, brand)
    return pool.orderBy(F.desc("stage"), F.desc("fam_rank"), F.desc("score"), "price_cents", "id").limit(limit)


def with_siblings(found: DataFrame, offers: DataFrame, sightings: DataFrame, most: int = 20) -> DataFrame:
    """Search results (id, brand, price_cents, ...) with the product and band of their sighting, then ``most`` siblings.

    A sibling is another current offer of a product that a trusted sighting (auto or created) of a result names, itself
    trusted, and of a brand that these results have; cheapest first. Both limits are the search's own.
    """
    s = sightings.select(F.col("offer_id").alias("id"), "product_id", "match_band")
    own = found.join(s, "id", "left").withColumn("sibling", F.lit(False))
    trusted = F.col("match_band").isin("auto", "created")
    seeds = own.where(trusted).select("product_id", F.col("brand").alias("_b")).distinct()
    others = s.where(trusted).join(F.broadcast(seeds), "product_id", "left_semi").join(found.select("id"), "id", "left_anti")
    more = offers.select([c for c in found.columns if c in offers.columns]).join(others, "id").join(F.broadcast(seeds), "product_id").where(F.col("brand") == F.col("_b"))
    more = more.orderBy("price_cents", "id").limit(most).withColumn("sibling", F.lit(True))
    return own.unionByName(more.select([c for c in more.columns if c in own.columns]), allowMissingColumns=True)
