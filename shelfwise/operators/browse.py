"""Browsing offers: gates, canonical names, deal signals, sorts, dedupe, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed terms that mark an offer as frozen, as an industrially processed form, and as from a fresh counter.
FROZEN_MARK_TERMS = ("frozen", "مجمد")
PROCESSED_MARK_TERMS = (
    "ناجت", "ناجيت", "nugget",
    "نقانق", "مقانق", "فرانك", "franks", "هوت دوج", "hotdog", "hot dog",
    "برجر", "برغر", "burger",
    "ستربس", "ستريبس", "ستريس", "strips",
    "بوب كورن", "بوبكورن", "popcorn",
    "بقسماط", "breaded", "تمبورا", "tempura",
    "زينج", "زينغ", "زنجز",
    "بروست", "broasted", "كوردون", "cordon",
    "فرايز", "fries", "كرات لحم", "كرات اللحم", "meatball", "meat ball",
    "سيخ كباب",
)
FRESH_GUARD_TERMS = ("طازج", "بوتشر", "butcher")
#: Least corroboration of a reading that may be served.
CORROBORATION_FLOOR = 0.3
#: Least score of an exceptional deal.
EXCEPTIONAL_MIN = 50
MULTIBUY = r"(^|\s)\d\s*\+\s*\d(\s|$)|مجان(?:ا|اً|يه|ية)"
SORTS = ("discount", "price", "newest", "ending")


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def has_term(c: Column, terms) -> Column:
    return c.rlike("(?i)" + "|".join(terms))


def is_frozen(name: Column, name_ar: Column | None = None, frozen=FROZEN_MARK_TERMS, processed=PROCESSED_MARK_TERMS, guard=FRESH_GUARD_TERMS) -> Column:
    """A frozen mark, or a processed form without a fresh-counter word; null names count as empty."""
    s = F.concat_ws(" ", text(name), text(name_ar) if name_ar is not None else F.lit(""))
    return has_term(s, frozen) | (has_term(s, processed) & ~has_term(s, guard))


def is_current(today: Column) -> Column:
    """Still valid; an undated offer is not."""
    return F.coalesce(F.col("valid_to") >= today, F.lit(False))


def has_drop() -> Column:
    return F.col("old_cents").isNotNull() & (F.col("old_cents") > F.col("price_cents"))


def servable() -> Column:
    """A reading with a name and enough corroboration."""
    return F.coalesce(F.col("e_name").isNotNull() & (F.col("corroboration") >= CORROBORATION_FLOOR), F.lit(False))


def canonical(offers: DataFrame, enrichments: DataFrame) -> DataFrame:
    """``offers`` with the reading's name where it may be served, else their own."""
    j = offers.join(enrichments, "id", "left")
    return j.withColumns({"canon_name": F.when(servable(), F.col("e_name")).otherwise(F.col("name")), "servable": servable()})


def include_groups(offers: DataFrame, groups: list[tuple[str, list[str], str]], frozen: Column) -> DataFrame:
    """Offers of any (source, categories, mode) group; mode none, exclude or only says what of frozen offers counts. No groups: no offers."""
    keep = F.lit(False)
    for source, categories, mode in groups:
        own = (F.col("source") == source) & F.coalesce(F.col("category").isin(categories), F.lit(False))
        keep = keep | {"none": own, "exclude": own & ~frozen, "only": own & frozen}[mode]
    return offers.where(keep)


def exclude_mapped(offers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Offers whose (source, category) no row of ``mapping`` names; a null category is never named."""
    return offers.join(mapping.select("source", "category"), ["source", "category"], "left_anti")


def with_history(offers: DataFrame, identities: DataFrame) -> DataFrame:
    """``offers`` with weeks seen, points, lowest price and first week of their identity."""
    return offers.join(identities.select("identity", "weeks_seen", "points", "min_cents", "max_cents", "first_seen"), "identity", "left")


def deal_signals(df: DataFrame, today: Column) -> DataFrame:
    """Adds drop (a share), lowest_ever, return_low, rare, multibuy, ends_in_days, score and exceptional."""
    drop = F.when(has_drop(), (F.col("old_cents") - F.col("price_cents")) / F.col("old_cents")).otherwise(0.0)
    age = F.when(F.col("first_seen").isNotNull(), F.greatest(F.lit(0), F.floor(F.datediff(today, "first_seen") / 7))).otherwise(0)
    weeks = F.coalesce("weeks_seen", F.lit(0))
    df = df.withColumns({"drop": drop, "_age": age, "_weeks": weeks})
    lowest = F.coalesce((F.col("_weeks") >= 4) & (F.col("points") >= 2) & (F.col("price_cents") <= F.col("min_cents")), F.lit(False))
    df = df.withColumn("lowest_ever", lowest)
    df = df.withColumns(
        {
            "return_low": F.col("lowest_ever") & (F.col("points") >= 3),
            # weeks / age <= 0.25 without dividing
            "rare": (F.col("_age") >= 8) & (F.col("_weeks") >= 1) & (F.col("_weeks") * 4 <= F.col("_age")),
            "multibuy": text("name").rlike(MULTIBUY),
            "ends_in_days": F.when(F.col("valid_to").isNotNull(), F.greatest(F.lit(0), F.datediff("valid_to", today))),
        }
    )
    points = [
        F.when(F.col("lowest_ever"), 50).otherwise(0),
        F.when(F.col("drop") >= 0.4, 30).when(F.col("drop") >= 0.25, 15).otherwise(0),
        F.when(F.col("rare"), 20).otherwise(0),
        F.when(F.col("return_low"), 15).otherwise(0),
        F.when(F.col("multibuy"), 10).otherwise(0),
    ]
    df = df.withColumn("score", sum(points[1:], points[0]))
    return df.withColumn("exceptional", F.col("score") >= EXCEPTIONAL_MIN).drop("_age", "_weeks")


def sort_keys(sort: str) -> list[Column]:
    """The order of a listing; the id breaks ties."""
    pct = F.when(has_drop(), (F.col("old_cents") - F.col("price_cents")) / F.col("old_cents")).otherwise(0.0)
    keys = {
        "discount": [pct.desc(), F.asc("price_cents")],
        "price": [F.asc("price_cents")],
        "newest": [F.desc("detected_at")],
        "ending": [F.asc_nulls_last("valid_to")],
    }[sort]
    return [*keys, F.asc("id")]


def deduped(offers: DataFrame, sort: str = "discount") -> DataFrame:
    """One offer of each deal: (store, identity, price), or name where there is no identity.

    The one valid longest stays, the first of the incoming order on a tie; ``_at`` of a deal is the place of its first
    occurrence, expressed by the order's keys, so that the incoming sort survives.
    """
    key = F.coalesce(F.col("identity"), F.col("name"), F.col("id"))
    deal = ["store", "_deal", "price_cents"]
    late = F.coalesce("valid_to", F.lit("0001-01-01").cast("date"))
    df = offers.withColumn("_deal", key)
    longest = W.partitionBy(*deal).orderBy(late.desc(), *sort_keys(sort))
    return df.withColumn("_n", F.row_number().over(longest)).where("_n = 1").drop("_n", "_deal")


def listing(offers: DataFrame, today: Column, sort: str = "discount", limit: int = 48, offset: int = 0, where: Column | None = None) -> DataFrame:
    """A page of the current deals: gate, filter, dedupe, order, page. Limits are clamped to 1..200 and the offset to 0."""
    df = offers.where(is_current(today))
    df = df.where(where) if where is not None else df
    return deduped(df, sort).orderBy(*sort_keys(sort)).offset(max(0, offset)).limit(min(200, max(1, limit)))


def rails(offers: DataFrame, identities: DataFrame, today: Column, size: int = 12) -> DataFrame:
    """The largest drops and the lowest prices ever, ``size`` of each."""
    df = deal_signals(with_history(deduped(offers.where(is_current(today))), identities), today)
    order = [F.desc("drop"), F.asc("price_cents"), F.asc("id")]
    cols = [F.col(c) for c in ("id", "store", "name", "price_cents", "old_cents")]
    drops = df.where(has_drop()).orderBy(*order).limit(size).select(F.lit("drops").alias("rail"), *cols)
    lows = df.where("lowest_ever").orderBy(*order).limit(size).select(F.lit("lowest-ever").alias("rail"), *cols)
    return drops.unionByName(lows)
