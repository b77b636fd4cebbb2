"""Evidence of identity as column expressions: core tokens, forms, species, brands, produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.functions.families import family as word_family
from shelfwise.functions.families import first_in, product_type, word_map

#: Fixed words that carry no identity: connectors, packaging, promotion.
CONNECTORS = (
    "and", "or", "with", "without", "for", "from", "of", "in", "on", "at", "by",
    "to", "per", "plus", "the", "a", "an",
    "او", "مع", "بدون", "من", "في", "علي", "الي", "لكل", "و",
)
PACKAGING = (
    "pack", "packs", "packet", "packets", "pkt", "bag", "bags", "box", "boxes",
    "bottle", "bottles", "can", "cans", "tin", "tins", "jar", "jars", "piece",
    "pieces", "pcs", "pc", "count", "ct", "tray", "rolls",
    "عبوه", "عبوات", "كيس", "اكياس", "علبه", "علب", "زجاجه", "زجاجات", "حبه",
    "حبات", "قطعه", "قطع", "صحن", "رول",
)
PROMOTIONAL = (
    "fresh", "frozen", "local", "imported", "selected", "assorted", "regular",
    "spicy", "hot", "original", "premium", "classic", "natural", "jumbo", "mini",
    "large", "small", "medium", "astd", "mixed",
    "طازج", "مجمد", "محلي", "مستورد", "مختار", "مشكل", "عادي", "حار", "اصلي",
    "فاخر", "كلاسيك", "طبيعي", "كبير", "صغير", "وسط",
)
#: Fixed words of further forms, of species, and of processed produce.
FORM_TERMS = {
    "corn": ["corn", "sweetcorn", "ذره"],
    "beans": ["bean", "beans", "فاصوليا", "فاصولياء"],
    "butter": ["butter", "زبده"],
    "cake": ["cake", "cakes", "muffin", "muffins", "كيك", "كيكه", "مافن"],
    "broasted": ["broast", "broasted", "بروست", "بروستد"],
    "liver": ["liver", "livers", "كبد", "كبده", "اكباد"],
    "gizzard": ["gizzard", "gizzards", "قوانص", "قانصه"],
    "drumstick": ["drumstick", "drumsticks", "ساق", "سيقان"],
    "thigh": ["thigh", "thighs", "فخذ", "افخاذ"],
    "popcorn": ["popcorn", "بوبكورن"],
    "tender": ["tender", "tenders", "تندر", "مسحب"],
    "sausage": ["frank", "franks"],
}
SPECIES_TERMS = {
    "chicken": ["chicken", "دجاج", "فراخ"],
    "beef": ["beef", "بقري", "بقر"],
    "lamb": ["lamb", "mutton", "غنم", "ضان", "خروف"],
    "camel": ["camel", "hashi", "حاشي", "جمل"],
    "veal": ["veal", "عجل"],
    "goat": ["goat", "تيس", "ماعز"],
    "fish": ["fish", "سمك"],
    "shrimp": ["shrimp", "shrimps", "prawn", "prawns", "روبيان", "جمبري"],
    "turkey": ["turkey", "ديك", "رومي"],
}
PROCESSED_MARKERS = (
    "مجمد", "مجمده", "مجمدات", "frozen",
    "معلب", "معلبه", "معلبات", "canned", "tinned",
    "مقشر", "مقشره", "peeled",
    "مجروش", "مجروشه", "crushed",
    "مطبوخ", "مطبوخه", "cooked",
    "chopped", "diced", "sliced",
    "مغطي", "مغطاه", "coated",
    "dried",
)
#: Fixed words of a whole bird or joint: a form only in the families of meat.
WHOLE_WORDS, WHOLE_FAMILIES = ("whole", "griller", "كامل", "كامله", "شوايه"), ("chicken", "meat", "fish")
#: Fixed pairs of forms, and of families, that agree.
AGREEING_FORMS = ("breast|fillet", "fillet|breast", "breast|tender", "tender|breast", "fillet|tender", "tender|fillet")
AGREEING_FAMILIES = ("cheese|cream", "cream|cheese", "milk|powder", "powder|milk")
PACKAGE_TOKEN = r"^\d+(?:[.,]\d+)?(?:ml|ltr?|l|kg|kgs|g|gm|grm?|pcs?|pc|pack|pkt|ct|s)$"


def core_tokens(ws: Column, brand_words: Column | None = None) -> Column:
    """Distinct canonical words that carry identity: no stop words, numbers, sizes or words of the brand."""
    stop = T.strings(sorted({*T.BANNER_WORDS, *CONNECTORS, *PACKAGING, *PROMOTIONAL}))
    own = F.filter(ws, lambda w: ~F.array_contains(stop, w) & ~w.rlike(PACKAGE_TOKEN) & ~w.rlike(r"^\d+$"))
    return F.array_distinct(F.array_except(own, brand_words) if brand_words is not None else own)


def named(ws: Column, lexicon: dict[str, list[str]]) -> Column:
    """All that the words stand for in a lexicon, distinct."""
    m = word_map(lexicon)
    return F.array_distinct(F.filter(F.transform(ws, lambda w: F.try_element_at(m, w)), lambda x: x.isNotNull()))


def species(ws: Column) -> Column:
    return named(ws, SPECIES_TERMS)


def forms(ws: Column, family: Column | None = None) -> Column:
    """All forms that the words name; "whole" is one in the families of meat only."""
    own = F.concat(F.filter(F.array(product_type(ws)), lambda x: x.isNotNull()), named(ws, FORM_TERMS))
    if family is not None:
        whole = F.coalesce(family.isin(*WHOLE_FAMILIES), F.lit(False)) & F.arrays_overlap(ws, T.strings(WHOLE_WORDS))
        own = F.concat(own, F.when(whole, F.array(F.lit("whole"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(own)


def terms(core: Column) -> Column:
    """Of each core word its synonyms, itself among them, and whether one of these names a species."""
    groups = F.create_map(*[x for w, g in T.SYNONYM_INDEX.items() for x in (F.lit(w), T.strings(g))])
    animal = T.strings(sorted({w for ws in SPECIES_TERMS.values() for w in ws}))
    own = F.transform(core, lambda w: F.coalesce(F.try_element_at(groups, w), F.array(w)))
    return F.transform(own, lambda g: F.struct(g.alias("words"), F.arrays_overlap(g, animal).alias("animal")))


def side(df: DataFrame, words: str, brand: Column, family: Column, category: Column, classes: dict[str, str]) -> DataFrame:
    """Adds what admission reads of a row: core words with their terms, forms, species, family by words, aisle of the category.

    ``classes`` says the aisle of a category; one that it doesn't name is neutral.
    """
    ws = F.col(words)
    aisles = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    df = df.withColumn("core", core_tokens(ws, T.canonical_words(F.coalesce(brand, F.lit("")))))
    return df.withColumns({"terms": terms(F.col("core")), "forms": forms(ws, family), "species": species(ws), "lexical": word_family(ws), "aisle": F.try_element_at(aisles, F.lower(F.coalesce(category, F.lit(""))))})


def brand_letters(c: Column) -> Column:
    return F.regexp_replace(T.canonical_text(c), " ", "")


def related(x: Column, y: Column) -> Column:
    """1 where one brand's letters hold the other's, -1 in a conflict, null where either is unknown."""
    known = (x != "") & (y != "")
    return F.when(known & (F.contains(x, y) | F.contains(y, x)), 1).when(known, -1)


def brand_relation(a: Column, b: Column) -> Column:
    return related(brand_letters(a), brand_letters(b))


def words_compared(a: str, b: str) -> Column:
    """What admission reads of the words of two rows made by ``side``, the same for all rows of these words: see ``admitted``."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    shared = F.filter(x("terms"), lambda t: F.arrays_overlap(t["words"], y("core")))
    plain = F.exists(shared, lambda t: ~t["animal"])
    both = (F.size(x("forms")) > 0) & (F.size(y("forms")) > 0)
    apart = F.exists(x("forms"), lambda f: F.exists(y("forms"), lambda g: (f != g) & ~F.concat(f, F.lit("|"), g).isin(*AGREEING_FORMS)))
    one = (F.size(x("forms")) > 0) != (F.size(y("forms")) > 0)
    other_species = (F.size(x("species")) > 0) & (F.size(y("species")) > 0) & ~F.arrays_overlap(x("species"), y("species"))
    veto = F.when(both & apart, "form-conflict").when(one & ~plain, "form-specificity").when(other_species, "species-conflict")
    return F.struct(veto.alias("veto"), F.size(shared).alias("hits"), (both & ~apart).alias("form"))


def admitted(words: Column, a: str, b: str) -> Column:
    """How a read (columns ``a``.*) is admitted to a product (``b``.*), of which ``words`` compares the words: veto, hits, evidence.

    ``veto`` is the first that applies, null for an admitted pair: forms that disagree; a form on one side alone without
    a shared word other than of a species; species apart; families apart (the words' own family decides where they
    differ); aisles apart; no shared core word and neither a shared form nor family with aisle. ``hits`` counts the read's
    core words of which the product has a synonym, ``evidence`` is that form or family with aisle.
    """
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    clash = F.coalesce(x("family") != y("family"), F.lit(False))
    f = F.when(clash, F.coalesce(x("lexical"), x("family"))).otherwise(x("family"))
    g = F.when(clash, F.coalesce(y("lexical"), y("family"))).otherwise(y("family"))
    other_family = F.coalesce((f != g) & ~F.concat(f, F.lit("|"), g).isin(*AGREEING_FAMILIES), F.lit(False))
    other_aisle = F.coalesce(x("aisle") != y("aisle"), F.lit(False))
    hits = words["hits"]
    evidence = words["form"] | F.coalesce((f == g) & (x("aisle") == y("aisle")), F.lit(False))
    veto = (
        F.when(words["veto"].isNotNull(), words["veto"])
        .when(other_family, "family-conflict")
        .when(other_aisle, "category-conflict")
        .when((hits == 0) & ~evidence, "no-product-core")
    )
    return F.struct(veto.alias("veto"), hits.alias("hits"), evidence.alias("evidence"))


def admission(a: str, b: str) -> Column:
    return admitted(words_compared(a, b), a, b)


def fresh_intent(q: T.Query) -> str | None:
    """The produce that a search names by itself: neither a form nor a processing with it."""
    from shelfwise.functions.families import BASE_FAMILIES, DERIVED_FAMILIES, PRODUCE_FAMILIES, PRODUCT_TYPES

    of = lambda lexicon: next((k for w in q.tokens for k, ws in lexicon.items() if w in ws), None)
    if of(DERIVED_FAMILIES) or of(BASE_FAMILIES) or of(PRODUCT_TYPES) or any(w in PROCESSED_MARKERS or w.removeprefix("و") in PROCESSED_MARKERS for w in q.tokens):
        return None
    return of(PRODUCE_FAMILIES)


def fresh(ws: Column, form: Column, produce: str) -> Column:
    """Whether a name may stand for fresh ``produce``: no form, no processing, and the produce not as a flavour only."""
    from shelfwise.functions.families import PRODUCE_FAMILIES

    flavoured = F.coalesce(produce_presence(ws, tuple(PRODUCE_FAMILIES[produce])) == "flavored", F.lit(False))
    return form.isNull() & ~is_processed(ws) & ~flavoured


def is_processed(ws: Column) -> Column:
    """Whether a name says that produce is processed; a leading conjunction is ignored."""
    return F.exists(ws, lambda w: F.array_contains(T.strings(PROCESSED_MARKERS), w) | F.array_contains(T.strings(PROCESSED_MARKERS), F.regexp_replace(w, "^و", "")))


def produce_presence(ws: Column, words: tuple[str, ...]) -> Column:
    """product where a word stands by itself, flavored where it is only attached or beside a flavour marker."""
    return F.when(T.token_presence(words, ws) == "primary", "product").when(T.token_presence(words, ws) == "secondary", "flavored")


def doubled(w: Column) -> Column:
    return F.regexp_replace(w, r"(.)\1+", r"$1")


#: Fixed words that are a brand's name and ordinary language too.
AMBIGUOUS_BRANDS = ("الكبير", "كبير", "fine", "هنا")


#: Rows of a table of brands that may be sent to every executor after they were counted.
SENT_BRANDS = 100_000


def detect_brand(df: DataFrame, names: list[str], brands: DataFrame, key: str, department: str | None = None, out: str = "brand_found") -> DataFrame:
    """Adds the brand of the earliest word that names one, over ``names`` in their order.

    ``brands`` is a table: word, slug, place (of equal words the first counts), departments (null: all), no_strip, and
    veto_before and veto_after (words that beside the brand's word mean something else; null: none). A word names a brand
    exactly, without its article, or with doubled letters folded from four letters on, the first of these that is
    known; words that are ordinary language name none. A brand whose guards fail is no brand, and the next word is
    asked. ``key`` tells rows apart; rows without a brand get null.
    """
    b = brands.withColumn("w", T.normalize_text(F.col("word"))).withColumn("s", F.when(~F.coalesce("no_strip", F.lit(False)), F.regexp_replace("w", "^(وال|ال)", "")))
    b = b.where((F.length("w") >= 3) & ~F.col("w").isin(*AMBIGUOUS_BRANDS))
    forms = F.array(F.struct(F.col("w").alias("k"), F.lit(0).alias("kind")), F.struct(F.col("s").alias("k"), F.lit(0).alias("kind")), F.struct(doubled(F.col("w")).alias("k"), F.lit(1).alias("kind")), F.struct(doubled(F.col("s")).alias("k"), F.lit(1).alias("kind")))
    entry = F.struct("place", "slug", "departments", "veto_before", "veto_after")
    index = b.select(F.explode(forms).alias("x"), entry.alias("b")).where("length(x.k) >= 3").groupBy("x.k", "x.kind").agg(F.min_by("b", "b.place").alias("b"))
    d = F.col(department) if department else F.lit(None).cast("string")
    listed = F.array(*[F.struct(F.lit(i).alias("name"), T.words(T.normalize_text(F.col(n))).alias("ws")) for i, n in enumerate(names)])
    own = df.select(key, d.alias("_d"), F.explode(listed).alias("l")).select(key, "_d", "l.name", "l.ws", F.posexplode("l.ws").alias("pos", "w"))
    bare = F.regexp_replace("w", "^(وال|ال)", "")
    own = own.where(~F.col("w").isin(*AMBIGUOUS_BRANDS) & ~bare.isin(*AMBIGUOUS_BRANDS))
    tries = F.array(F.struct(F.lit(0).alias("rank"), F.col("w").alias("k"), F.lit(0).alias("kind")), F.struct(F.lit(1).alias("rank"), bare.alias("k"), F.lit(0).alias("kind")), F.struct(F.lit(2).alias("rank"), F.when(F.length("w") >= 4, doubled(F.col("w"))).alias("k"), F.lit(1).alias("kind")))
    own = own.select(key, "_d", "name", "pos", F.get("ws", F.col("pos") - 1).alias("before"), F.get("ws", F.col("pos") + 1).alias("after"), F.explode(tries).alias("x")).select("*", "x.*").drop("x")
    # dealt by the key once, for both minima and the rows that get them
    index = F.broadcast(index) if brands.count() <= SENT_BRANDS else index.hint("merge")
    hit = own.join(index, ["k", "kind"]).repartition(F.col(key)).groupBy(key, "name", "pos").agg(F.min_by(F.struct("b", "_d", "before", "after"), "rank").alias("h"))
    held = lambda words, w: F.coalesce(F.array_contains(F.col(f"h.b.{words}"), F.col(f"h.{w}")), F.lit(False))
    fits = F.col("h.b.departments").isNull() | F.coalesce(F.array_contains("h.b.departments", F.col("h._d")), F.lit(False))
    hit = hit.where(fits & ~held("veto_before", "before") & ~held("veto_after", "after"))
    best = hit.groupBy(key).agg(F.min(F.struct("name", "pos", F.col("h.b.slug").alias("slug")))["slug"].alias(out))
    # there are as many brands found as rows: they are merged, whatever their size is taken for, and none come to the driver
    return df.join(best.hint("merge"), key, "left")


def first_species(ws: Column) -> Column:
    return first_in(ws, SPECIES_TERMS)


#: Fixed start and multiplier of the hash; the multiplier is 2**40 + 435.
FNV_START, FNV_LOW = 0xCBF29CE484222325, 435


def fnv64(c: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's code units, as 16 hexadecimal digits; null for null.

    Halves of 32 bits keep every product within a long; h * (2**40 + 435) is h * 435 plus the low half shifted by 40.
    """
    hi, lo, mask = FNV_START >> 32, FNV_START & 0xFFFFFFFF, 0xFFFFFFFF
    start = F.struct(F.lit(hi).cast("bigint").alias("h"), F.lit(lo).cast("bigint").alias("l"))

    def step(s, unit):
        low = s["l"].bitwiseXOR(unit.cast("bigint"))
        part = low * FNV_LOW
        high = s["h"] * FNV_LOW + F.shiftright(part, 32) + F.shiftleft(low, 8).bitwiseAND(F.lit(mask))
        return F.struct(high.bitwiseAND(F.lit(mask)).alias("h"), part.bitwiseAND(F.lit(mask)).alias("l"))

    units = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    return F.reduce(units, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["h"]), 8, "0"), F.lpad(F.hex(s["l"]), 8, "0"))))
