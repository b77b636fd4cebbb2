"""Bilingual text matching as column expressions: normalisation, tokens, synonyms, scores, head words, phrases."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed character classes and folds of the normal form.
AR_DIACRITICS = "[ً-ٰٟـ]"
FOLD_FROM, FOLD_TO = "أإآٱةىؤئیک٠١٢٣٤٥٦٧٨٩", "ااااهيوييك0123456789"
#: Fixed groups of words that stand for the same staple in both languages.
SYNONYMS = [
    ["milk", "حليب", "لبن"],
    ["eggs", "egg", "بيض", "بيضه"],
    ["chicken", "دجاج", "فراخ"],
    ["rice", "رز", "ارز"],
    ["sugar", "سكر"],
    ["water", "ماء", "مياه", "مويه"],
    ["oil", "زيت"],
    ["bread", "خبز", "عيش"],
    ["cheese", "جبن", "جبنه"],
    ["tea", "شاي"],
    ["coffee", "قهوه"],
    ["yogurt", "yoghurt", "زبادي", "روب"],
    ["juice", "عصير"],
    ["butter", "زبده"],
    ["skimmed", "skim", "منزوع", "خالي"],
    ["squares", "مربعات"],
    ["tuna", "تونه", "تن"],
    ["shampoo", "شامبو"],
    ["tissue", "tissues", "مناديل", "محارم"],
    ["chocolate", "شوكولاته", "شوكولا"],
    ["diapers", "حفاضات", "حفايض"],
    ["pepsi", "بيبسي"],
    ["cola", "كولا"],
    ["tide", "تايد"],
    ["nutella", "نوتيلا"],
    ["arwa", "اروي", "اروا"],
    ["nova", "نوفا"],
    ["berain", "بيرين"],
    ["tomato", "tomatoes", "طماطم"],
    ["potato", "potatoes", "بطاطس", "بطاطا"],
    ["onion", "onions", "بصل"],
    ["garlic", "ثوم"],
    ["cucumber", "خيار"],
    ["carrot", "carrots", "جزر"],
    ["lemon", "ليمون"],
    ["strawberry", "strawberries", "فراوله"],
    ["banana", "bananas", "موز"],
    ["apple", "apples", "تفاح"],
    ["grape", "grapes", "عنب"],
    ["mango", "مانجو", "مانجا"],
    ["watermelon", "بطيخ", "حبحب"],
    ["pineapple", "اناناس"],
    ["pomegranate", "رمان"],
    ["avocado", "افوكادو"],
    ["peach", "خوخ"],
    ["apricot", "مشمش"],
    ["kiwi", "كيوي"],
    ["guava", "جوافه"],
    ["eggplant", "aubergine", "باذنجان"],
    ["zucchini", "courgette", "كوسه"],
    ["cabbage", "ملفوف"],
    ["cauliflower", "قرنبيط"],
    ["broccoli", "بروكلي"],
    ["spinach", "سبانخ"],
    ["okra", "باميه"],
]
#: Fixed words that change the product when they follow a token.
COMPOUND_SHIFTERS = (
    "chocolate", "biscuit", "biscuits", "cookie", "cookies", "powder", "bar", "candy",
    "cereal", "cake", "shake", "flavour", "flavoured", "flavored", "drink", "jam",
    "شوكولاته", "شوكولا", "بسكويت", "بودره", "حلوي", "كيك",
)
#: Fixed flavour markers: before the flavour in Arabic, after it in English.
FLAVOR_BEFORE = ("بنكهه", "نكهه", "نكهات", "بطعم", "طعم", "برائحه", "رائحه", "بديل")
FLAVOR_AFTER = ("flavor", "flavour", "flavored", "flavoured", "flavors", "flavours", "scented", "substitute")
#: Fixed lead-in words that never head a name.
HEAD_SKIP = ("fresh", "new", "organic", "طازج", "طازجه", "جديد", "جديده", "عضوي", "عضويه")
#: Fixed words of flyer banners.
BANNER_WORDS = (
    "offer", "offers", "deal", "deals", "amazing", "exciting", "rewards", "endless",
    "surprises", "save", "free", "price", "prices", "happiness", "special", "promo",
    "promotion", "weekly", "till", "until", "only", "now", "new",
    "عرض", "عروض", "وفر", "توفير", "خصم", "مجانا", "سعر", "سعاده", "حتي", "فقط", "جديد",
)
COMPOUND_FACTOR = 0.45


def strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def normalize_text(c: Column) -> Column:
    """Lower case, Arabic marks and seats folded, digits to ASCII, signs to spaces, white space collapsed; null: empty."""
    s = F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), AR_DIACRITICS, ""), FOLD_FROM, FOLD_TO)
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\s ]", " ")
    return F.trim(F.regexp_replace(s, r"[\s ]+", " "))


def bare(word: Column) -> Column:
    """A word without its leading article, if two letters at least remain."""
    cut = F.regexp_replace(word, "^(وال|ال)", "")
    return F.when(F.length(cut) >= 2, cut).otherwise(word)


def words(c: Column) -> Column:
    """Words of an already normalised text; none of an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def canonical_words(c: Column) -> Column:
    return F.transform(words(normalize_text(c)), bare)


def canonical_text(c: Column) -> Column:
    return F.array_join(canonical_words(c), " ")


@dataclass(frozen=True)
class Query:
    """A search as the driver reads it: canonical tokens (six at most) with their synonyms, and the size it names.

    The text of a search is a literal, so its tokens become literals of the expressions below, and an expression's size
    depends on the search alone.
    """

    tokens: tuple[str, ...]
    variants: tuple[tuple[str, ...], ...]

    @staticmethod
    def of(text: str) -> Query:
        from shelfwise.functions.sizes import stripped

        own = [bare_word(w) for w in stripped(text).split()] or [bare_word(w) for w in normalized(text).split()]
        tokens = tuple(own[:6])
        return Query(tokens, tuple(tuple(SYNONYM_INDEX.get(t, (t,))) for t in tokens))


def normalized(text: str | None) -> str:
    """``normalize_text`` of a literal."""
    s = re.sub(AR_DIACRITICS, "", (text or "").lower()).translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in s).split())


def bare_word(w: str) -> str:
    cut = re.sub("^(وال|ال)", "", w)
    return cut if len(cut) >= 2 else w


SYNONYM_INDEX = {w: tuple(g) for g in SYNONYMS for w in g}


def with_words(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>_text`` and ``<prefix>_words``, the canonical form of a column, computed once for all scores."""
    df = df.withColumn(f"{prefix}_words", canonical_words(F.col(name)))
    return df.withColumn(f"{prefix}_text", F.array_join(f"{prefix}_words", " "))


def query_tokens(c: Column, most: int = 6) -> Column:
    """The tokens of a search as a column: canonical words without its size, or of the whole where nothing else is left."""
    from shelfwise.functions.sizes import strip_sizes

    own = canonical_words(strip_sizes(c))
    return F.slice(F.when(F.size(own) > 0, own).otherwise(canonical_words(c)), 1, most)


def expand_token(word: Column) -> Column:
    """A token with the words that stand for the same, as a column."""
    groups = F.create_map(*[x for w, g in SYNONYM_INDEX.items() for x in (F.lit(w), strings(g))])
    return F.coalesce(F.try_element_at(groups, word), F.array(word))


def token_score(variant: str, text: Column, ws: Column) -> Column:
    """100 for a whole word, 70 for the start of a word (four letters or more), 40 inside a word (five or more), else 0."""
    out = F.when(F.array_contains(ws, variant), 100)
    if len(variant) >= 4:
        out = out.when(F.contains(F.concat(F.lit(" "), text), F.lit(" " + variant)), 70)
    if len(variant) >= 5:
        out = out.when(F.contains(text, F.lit(variant)), 40)
    return out.otherwise(0)


def best_score(variants: tuple[str, ...], text: Column, ws: Column) -> Column:
    scores = [token_score(v, text, ws) for v in variants]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def compound_penalty(q: Query, ws: Column) -> Column:
    """0.45 if a token's variant is followed by a word that changes the product, else 1."""
    own = strings(sorted({v for vs in q.variants for v in vs}))
    after = F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1)))
    pairs = F.arrays_zip(ws.alias("a"), after.alias("b"))
    hit = F.exists(pairs, lambda p: F.coalesce(F.array_contains(own, p["a"]) & F.array_contains(strings(COMPOUND_SHIFTERS), p["b"]), F.lit(False)))
    return F.when(hit, COMPOUND_FACTOR).otherwise(1.0)


def name_relevance(q: Query, text: Column, ws: Column) -> Column:
    """Mean score of the tokens in a name times the compound penalty; 0 if any token is missing."""
    if not q.tokens:
        return F.lit(0.0)
    scores = [best_score(v, text, ws) for v in q.variants]
    every = reduce(lambda a, b: a & b, [s > 0 for s in scores])
    return F.when(every, reduce(lambda a, b: a + b, scores) / F.lit(float(len(scores))) * compound_penalty(q, ws)).otherwise(0.0)


def offer_relevance(q: Query, text: Column, ws: Column, body: Column, body_ws: Column) -> tuple[Column, Column]:
    """(score, name_match): every token in the name or the text; hits in the name count three times."""
    if not q.tokens:
        return F.lit(0.0), F.lit(False)
    n = [best_score(v, text, ws) for v in q.variants]
    b = [best_score(v, body, body_ws) for v in q.variants]
    every = reduce(lambda x, y: x & y, [(x > 0) | (y > 0) for x, y in zip(n, b)])
    total = reduce(lambda x, y: x + y, [F.greatest(x * 3, y) for x, y in zip(n, b)])
    score = F.when(every, total / F.lit(float(len(n))) * compound_penalty(q, ws)).otherwise(0.0)
    return score, reduce(lambda x, y: x & y, [x > 0 for x in n])


def token_presence(variants: tuple[str, ...], ws: Column) -> Column:
    """How a token appears among the words: primary as a word, secondary as a flavour or ingredient only, null not at all."""
    own = strings(variants)
    before, after = strings(FLAVOR_BEFORE), strings(FLAVOR_AFTER + COMPOUND_SHIFTERS)
    last = F.concat(F.array(F.lit("")), ws)
    following = F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1)))
    z = F.arrays_zip(ws.alias("w"), last.alias("l"), following.alias("n"))
    flavoured = lambda x: F.array_contains(before, x["l"]) | F.coalesce(F.array_contains(after, x["n"]), F.lit(False))
    primary = F.exists(z, lambda x: F.coalesce(F.array_contains(own, x["w"]) & ~flavoured(x), F.lit(False)))
    attached = F.exists(ws, lambda w: w.rlike("^(بال|لل)") & F.array_contains(own, F.regexp_replace(w, "^(بال|لل)(ال)?", "")))
    return F.when(primary, "primary").when(F.arrays_overlap(ws, own) | attached, "secondary")


def head_word(ws: Column) -> Column:
    """The first canonical word that is no number and no lead-in; empty if there is none."""
    own = F.filter(ws, lambda w: ~w.rlike(r"^\d+$") & ~F.array_contains(strings(HEAD_SKIP), w))
    return F.coalesce(F.get(own, 0), F.lit(""))


def phrase_in(q: Query, ws: Column) -> Column:
    """Whether the tokens, or synonyms, stand side by side in order."""
    n = len(q.tokens)
    at = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(strings(v), F.get(ws, i + k)), F.lit(False)) for k, v in enumerate(q.variants)]))


def token_tier(variants: tuple[str, ...], text: Column, ws: Column) -> Column:
    """3 whole word, 2 start of a word, 1 inside a word, 0 none."""
    s = best_score(variants, text, ws)
    return F.when(s == 100, 3).when(s == 70, 2).when(s == 40, 1).otherwise(0)


def with_stage(df: DataFrame, q: Query, name: str, brand: str, out: str = "stage", other_family: Column | None = None, contradicts: Column | None = None) -> DataFrame:
    """Adds the stage, 0 to 5, of a name (and brand) for a search.

    One token: 5 heads the name, 4 another primary match, 2 inside a word only, 1 secondary or a known other family,
    0 none. Several: 5 phrase, 4 all whole words, 3 all strong, 2 all, 1 one missing or a known other family, 0 less.
    A size that contradicts the search's caps the stage at 1.
    """
    if not q.tokens:
        return df.withColumn(out, F.lit(0))
    df = with_words(with_words(df, name, "_n"), brand, "_b")
    text, ws, btext, bws = (F.col(c) for c in ("_n_text", "_n_words", "_b_text", "_b_words"))
    other = F.coalesce(other_family, F.lit(False)) if other_family is not None else F.lit(False)
    df = df.withColumn("_t", F.array(*[F.greatest(token_tier(v, text, ws), token_tier(v, btext, bws)) for v in q.variants]))
    if len(q.tokens) == 1:
        df = df.withColumn("_r", token_presence(q.variants[0], ws))
        role, tier = F.col("_r"), F.get("_t", 0)
        stage = (
            F.when(F.coalesce(role == "secondary", F.lit(False)), 1)
            .when((tier == 0) & role.isNull(), 0)
            .when(other, 1)
            .when(role.isNull() & (tier < 2), 2)
            .when(F.array_contains(strings(q.variants[0]), head_word(ws)), 5)
            .otherwise(4)
        )
    else:
        n = len(q.tokens)
        count = lambda k: F.size(F.filter("_t", lambda x: x >= k))
        df = df.withColumn("_m", count(1))
        stage = F.when(F.col("_m") < n - 1, 0).when(F.col("_m") < n, 1).when(other, 1).when(phrase_in(q, ws), 5).when(count(3) == n, 4).when(count(2) == n, 3).otherwise(2)
    df = df.withColumn(out, stage)
    if contradicts is not None:
        df = df.withColumn(out, F.when(contradicts & (F.col(out) > 1), 1).otherwise(F.col(out)))
    return df.drop("_n_words", "_n_text", "_b_words", "_b_text", "_t", "_r", "_m")


def evidence_tokens(c: Column) -> Column:
    """Distinct words of two letters or more without sizes, digits and banner words."""
    from shelfwise.functions.sizes import strip_sizes

    ws = words(normalize_text(strip_sizes(c)))
    return F.array_distinct(F.filter(ws, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~F.array_contains(strings(BANNER_WORDS), w)))


def corroboration(tokens: Column, haystack: Column) -> Column:
    """Share of the words of over two letters that the other text holds; null without such words."""
    own = F.filter(words(normalize_text(tokens)), lambda w: F.length(w) > 2)
    held = words(normalize_text(haystack))
    return F.try_divide(F.size(F.filter(own, lambda w: F.array_contains(held, w))).cast("double"), F.size(own))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
