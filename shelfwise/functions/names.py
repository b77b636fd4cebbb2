"""Names from flyer text, readings from model replies, and the evidence that a reading is one product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import text as T

#: Fixed scripts and words of the name rules.
OTHER_SCRIPT = r"[ഀ-෿ऀ-ॿ஀-௿ఀ-౿一-鿿぀-ヿ가-힯]"
ARABIC = r"[؀-ۿ]"
UNIT = r"(?i)(\b|\d)(ml|ltr?|l|kg|gm?|gr|pcs?|pack|pkt|صحن|مل|لتر|كجم|كغ|جم|جرام|غرام|حبه|حبات|قطعه|عبوه)\b"
STOP_WORDS = ("hypermarket", "supermarket", "هايبرماركت", "ماركت")
ASSORTMENT = "assort|combo|تشكيل|متنوع|اصناف|selected|مختار"


def clean_line(line: Column, stop: Column) -> Column:
    """Nameable words of a line joined; null for other scripts, under three letters, or banner words alone."""
    kept = F.filter(T.words(T.normalize_text(line)), lambda w: ~w.rlike(r"^\d+([.,]\d+)?$") & ~w.rlike(r"(.)\1{3,}") & ~F.array_contains(stop, w))
    phrase = F.array_join(kept, " ")
    empty = F.length(F.regexp_replace(phrase, r"[\d\s]", "")) < 3
    banner = F.forall(kept, lambda w: F.array_contains(T.strings(T.BANNER_WORDS), w) | w.rlike(r"^\d"))
    return F.when(~line.rlike(OTHER_SCRIPT) & ~empty & ~banner, phrase)


def derive_names(description: Column, store_words: Column | None = None) -> Column:
    """(name, name_ar): the best line of either script.

    A line scores ten a word (eight at most), 25 for a unit, and its place; of equals the first. A single word of
    under five letters is no name, and a long one is cut at a word to 80 characters.
    """
    stop = T.strings(STOP_WORDS)
    if store_words is not None:
        stop = F.concat(stop, F.flatten(F.transform(F.coalesce(store_words, F.array().cast("array<string>")), lambda w: T.words(T.normalize_text(w)))))
    lines = F.split(F.coalesce(description, F.lit("")), "\n")
    made = F.filter(F.transform(lines, lambda x, i: F.struct(clean_line(F.trim(x), stop).alias("p"), i.alias("i"))), lambda s: s["p"].isNotNull())
    # larger is better, and of equal scores the earlier line
    scored = F.transform(made, lambda s: F.struct((F.least(F.size(F.split(s["p"], " ")), F.lit(8)) * 10 + F.when(s["p"].rlike(UNIT), 25).otherwise(0) + s["i"]).alias("score"), (-s["i"]).alias("at"), s["p"].alias("p")))

    def best(own: Column) -> Column:
        p = F.array_max(own)["p"]
        short = ~F.contains(p, F.lit(" ")) & (F.length(p) < 5)
        cut = F.concat(F.regexp_replace(F.substring(p, 1, 79), r"\s+\S*$", ""), F.lit("…"))
        return F.when(short, F.lit(None)).when(F.length(p) > 80, cut).otherwise(p)

    english = F.filter(scored, lambda s: ~s["p"].rlike(ARABIC) & s["p"].rlike("(?i)[a-z]"))
    arabic = F.filter(scored, lambda s: s["p"].rlike(ARABIC))
    return F.struct(best(english).alias("name"), best(arabic).alias("name_ar"))


def strip_prices(c: Column) -> Column:
    """A text without price fragments."""
    p = r"(?i)(?:sar|sr|rs|ر\.?س|ريال)\s*\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s*(?:sar|sr|rs|ر\.?س|ريال)"
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), p, " "), r"\s+", " "))


REPLY = "struct<name:string,name_ar:string,brand:string,size:string,confidence:double>"


def parse_reply(c: Column) -> Column:
    """The outermost object of a model's reply, confidence clamped to 0..1; null if it isn't one."""
    r = F.from_json(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\{.*\})", 1), REPLY)
    keep = [F.when(F.trim(r[k]) != "", F.trim(r[k])).alias(k) for k in ("name", "name_ar", "brand", "size")]
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(r["confidence"], F.lit(0.0))))
    return F.when(r.isNotNull() & F.coalesce(r["name"], r["name_ar"]).isNotNull(), F.struct(*keep, conf.alias("confidence")))


def is_or_deal(name: Column, name_ar: Column) -> Column:
    """Whether a name offers one product or another: two sides at least with two evidence tokens each."""

    def sides(c: Column, splitter: str) -> Column:
        own = F.split(T.normalize_text(c), splitter)
        full = F.filter(own, lambda s: F.size(F.array_distinct(F.filter(T.words(s), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~F.array_contains(T.strings(T.BANNER_WORDS), w)))) >= 2)
        return F.size(full) >= 2

    return sides(name, r"\bor\b") | sides(name_ar, " او ")


def is_assortment(*texts: Column) -> Column:
    return F.concat_ws(" ", *[T.normalize_text(c) for c in texts]).rlike(ASSORTMENT)
