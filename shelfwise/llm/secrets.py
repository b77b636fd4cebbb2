"""Secret scans in DataFrame expressions alone: fixed patterns plus a randomness test battery on long tokens."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, regular expression, group whose length is bounded from below, that bound.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of the class are maximal either way; the bound in the pattern only spares listing short ones
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = tuple(p[0] for p in PATTERNS) + ("random",)
#: Tokens that the battery tests: maximal runs of the characters of common encodings.
TOKEN, TOKEN_CHARS = r"[A-Za-z0-9+/_-]{20,}", 20
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed encodings, the first that fits is inferred: pattern of the whole token, alphabet.
ENCODINGS = (
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER),
    (r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Tests of the battery: their p-values are combined by Bonferroni's bound.
TESTS = 3
#: Ordinary words and identifiers change between lower case, upper case and digits at most so often a character.
SWITCH = 0.1
#: Letters a to z in a thousand letters of English, German, French and Spanish words, 3 at least.
LETTERS = (
    (82, 15, 28, 43, 127, 22, 20, 61, 70, 3, 8, 40, 24, 67, 75, 19, 3, 60, 63, 91, 28, 10, 24, 3, 20, 3),
    (65, 19, 27, 51, 164, 17, 30, 46, 66, 3, 14, 34, 25, 98, 26, 7, 3, 70, 73, 62, 42, 8, 19, 3, 3, 11),
    (76, 9, 33, 37, 147, 11, 9, 7, 75, 6, 3, 55, 30, 71, 58, 25, 14, 67, 79, 72, 63, 18, 3, 4, 3, 3),
    (115, 22, 40, 50, 122, 7, 18, 7, 62, 5, 3, 50, 32, 67, 87, 25, 9, 69, 80, 46, 29, 11, 3, 3, 10, 5),
)
#: Sizes of the encodings with all letters of one case: a token of theirs need not change class.
ONE_CASE = (26, 32, 36)
#: False discoveries allowed among all tokens called random.
FDR = 0.01
#: Matches whose lengths are summed together when positions are found (keeps that linear in the matches).
CHUNK = 256


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(df: DataFrame, text: str, name: str, regex: str, kept: str | None = None) -> DataFrame:
    """Adds array columns ``name`` (matches) and ``name_at`` (starts in code points, from 0), leftmost, non-overlapping.

    Starts follow from the lengths of the matches and of the pieces between them, as split and extraction find the
    same matches. Lengths are summed by chunks, so that the work stays linear in the matches of a long text.
    """
    r = quoted(regex)
    df = df.withColumn(name, F.expr(f"regexp_extract_all({text}, {r}, 0)"))
    some = f"size({name}) > 0"
    df = df.withColumn("_gap", F.expr(f"case when {some} then split({text}, {r}, -1) end"))
    df = df.withColumn("_len", F.expr(f"case when {some} then transform({name}, (m, i) -> cast(length(m) + length(_gap[i]) as bigint)) end"))
    sums = f"transform(sequence(0, (size(_len) - 1) div {CHUNK}), c -> aggregate(slice(_len, c * {CHUNK} + 1, {CHUNK}), 0L, (s, x) -> s + x))"
    df = df.withColumn("_sum", F.expr(f"case when {some} then {sums} end"))
    df = df.withColumn("_off", F.expr(f"case when {some} then transform(_sum, (x, c) -> aggregate(slice(_sum, 1, c), 0L, (s, y) -> s + y)) end"))
    here = f"_off[cast(i div {CHUNK} as int)] + aggregate(slice(_len, cast(i div {CHUNK} as int) * {CHUNK} + 1, i % {CHUNK} + 1), 0L, (s, x) -> s + x) - length(m)"
    df = df.withColumn(f"{name}_at", F.expr(f"case when {some} then transform({name}, (m, i) -> {here}) else array() end"))
    return df.drop("_gap", "_len", "_sum", "_off")


def battery(df: DataFrame, tokens: str) -> DataFrame:
    """Adds ``stats``: for each token its length, the tests' statistics, and its evidence of being random rather than plain text.

    Tests under the inferred encoding's alphabet of k symbols: chi-squared uniformity (exact mean and variance, as
    expected counts are small), runs above and below the middle symbol, and lag-1 serial correlation. A statistic of z
    standard deviations (chi-squared: above its mean only) has the p-value exp(-z^2 / 2), an upper bound of the normal
    tail, and the battery's is min(1, 3 * the least of them).

    Against plain text there is the Chernoff bound -ln P(as many changes of character class | ordinary text), which grows with the length. Under an
    encoding of one case it is, where that is more, the log-likelihood ratio of even letters against the likeliest of
    the languages of ``LETTERS``, less ln 2 as either bound may be the one that errs. ``evidence`` is that figure plus
    the logarithm of the battery's p-value, 0 at least: exp(-evidence) is a p-value that grows as the tests speak
    against randomness, and it is the one that the false-discovery control ranks.
    """
    infer = "case " + " ".join(f"when x rlike {quoted(p)} then {quoted(a)}" for p, a in ENCODINGS) + " else '' end"
    df = df.withColumn("_e", F.expr(f"transform({tokens}, x -> named_struct('n', length(x), 'a', {infer}, 'c', split(x, '')))"))
    kind = "case when c between '0' and '9' then 0 when c between 'A' and 'Z' then 1 else 2 end"
    # a language's log ratio is summed over the letters of the token
    ratios = ("array(" + ", ".join(f"{math.log(1000 / 26 / n)!r}D" for n in one) + ")" for one in LETTERS)
    sums = ", ".join(f"aggregate(filter(e.c, c -> c rlike '[A-Za-z]'), 0D, (s, c) -> s + {r}[ascii(lower(c)) - 97])" for r in ratios)
    likelihood = f"case when length(e.a) in {ONE_CASE} then least({sums}) - ln(2D) else 0D end"
    df = df.withColumn("_v", F.expr(f"""transform(_e, e -> named_struct('n', cast(e.n as double), 'k', cast(length(e.a) as double),
        'v', transform(e.c, c -> cast(instr(e.a, c) - 1 as double)),
        's', transform(filter(e.c, c -> c rlike '[A-Za-z0-9]'), c -> {kind}),
        'l', {likelihood},
        'q', aggregate(transform(array_distinct(e.c), d -> power(size(filter(e.c, c -> c = d)), 2)), 0D, (s, x) -> s + x)))"""))
    # sums over symbols and over neighbours
    pairs = "transform(slice(x.v, 2, size(x.v)), (b, i) -> {0})"
    df = df.withColumn("_w", F.expr(f"""transform(_v, x -> named_struct('n', x.n, 'k', x.k, 'q', x.q, 'l', x.l,
        'm', cast(size(x.s) as double),
        'h', cast(size(filter(x.v, b -> b >= x.k / 2)) as double),
        'r', 1 + aggregate({pairs.format("case when (b >= x.k / 2) <> (x.v[i] >= x.k / 2) then 1D else 0D end")}, 0D, (s, y) -> s + y),
        's1', aggregate(x.v, 0D, (s, y) -> s + y), 's2', aggregate(x.v, 0D, (s, y) -> s + y * y),
        'sp', aggregate({pairs.format("b * x.v[i]")}, 0D, (s, y) -> s + y) + x.v[size(x.v) - 1] * x.v[0],
        't', aggregate(transform(slice(x.s, 2, size(x.s)), (b, i) -> case when b <> x.s[i] then 1D else 0D end), 0D, (s, y) -> s + y)))"""))
    two = "(2 * w.h * (w.n - w.h))"
    # a degenerate statistic (no variance) rejects
    chi = "case when w.k > 1 then ((w.k * w.q / w.n - w.n) - (w.k - 1)) / sqrt(2 * (w.k - 1) * (1 - 1 / w.n)) else 99D end"
    runs = f"case when {two} > w.n then (w.r - 1 - {two} / w.n) / sqrt({two} * ({two} - w.n) / (w.n * w.n * (w.n - 1))) else 99D end"
    serial = "case when w.n * w.s2 > w.s1 * w.s1 then ((w.n * w.sp - w.s1 * w.s1) / (w.n * w.s2 - w.s1 * w.s1) + 1 / (w.n - 1)) * (w.n - 1) * sqrt(w.n - 2) / w.n else 99D end"
    df = df.withColumn("_z", F.expr(f"transform(_w, w -> named_struct('n', w.n, 'chi', {chi}, 'runs', {runs}, 'serial', {serial}, 'l', w.l, 'j', greatest(w.m - 1, 1D), 'f', w.t / greatest(w.m - 1, 1D)))"))
    kl = f"z.f * ln(z.f / {SWITCH}) + case when z.f < 1 then (1 - z.f) * ln((1 - z.f) / {1 - SWITCH}) else 0D end"
    df = df.withColumn("stats", F.expr(f"""transform(_z, z -> named_struct('n', cast(z.n as int), 'chi', z.chi, 'runs', z.runs, 'serial', z.serial,
        'evidence', greatest(0D, greatest(z.l, case when z.f > {SWITCH} then z.j * ({kl}) else 0D end)
            - greatest(0D, power(greatest(z.chi, abs(z.runs), abs(z.serial)), 2) / 2 - ln({TESTS}D)))))"""))
    return df.drop("_e", "_v", "_w", "_z")


def discovery_limit(df: DataFrame, text_col: str = "text", fdr: float = FDR) -> tuple[float, float]:
    """(least weighted evidence, mean token length) that keep false discoveries among all tokens of ``df`` below ``fdr``.

    Weighted Benjamini-Hochberg over every token of the table: a p-value exp(-evidence) is divided by the token's
    length over the mean length. P-values are counted in bins of length (weights grow up to 256 characters) and
    evidence (quarters up to 200; the limit is at most ln(tokens / fdr), below 70 for 10^28 tokens, so more evidence
    than 200 passes alike), so that what is sorted and sent to the driver is bounded however many tokens there are.
    Without tokens: no limit passes.
    """
    tokens = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).select(F.expr(f"regexp_extract_all(_t, {quoted(TOKEN)}, 0)").alias("x")).where("size(x) > 0")
    one = battery(tokens, "x").select(F.explode("stats").alias("s"))
    bins = one.groupBy(F.least(F.col("s.n"), F.lit(256)).alias("n"), F.floor(F.least(F.col("s.evidence"), F.lit(200.0)) * 4).alias("b")).count().collect()
    m = sum(r["count"] for r in bins)
    if not m:
        return float("inf"), 1.0
    mean = sum(r["n"] * r["count"] for r in bins) / m
    # a token without evidence stays in the family with p = 1
    ranked = sorted((r["b"] / 4 + math.log(r["n"] / mean), r["count"]) for r in bins)[::-1]
    found, limit = 0, float("inf")
    for evidence, n in ranked:
        found += n
        if evidence >= math.log(m / (found * fdr)):
            limit = evidence
    return limit, mean


def found_spans(df: DataFrame, text_col: str, limit: tuple[float, float] | None) -> DataFrame:
    """``_own`` (all columns of ``df`` in a struct, so that no helper column clashes with them), ``base`` and ``spans``."""
    least, mean = limit or discovery_limit(df, text_col)
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    parts: list[Column] = []
    for i, (kind, regex, group, least_chars) in enumerate(PATTERNS):
        out = located(out, "_t", f"_{kind}", regex)
        if group:
            out = out.withColumn("_g", F.expr(f"case when size(_{kind}) > 0 then transform(regexp_extract_all(_t, {quoted(regex)}, {group}), g -> length(g)) else array() end"))
        else:
            out = out.withColumn("_g", F.expr(f"transform(_{kind}, g -> length(g))"))
        made = f"filter(transform(_{kind}, (m, i) -> case when _g[i] >= {least_chars} then named_struct('start', _{kind}_at[i], 'kind', {i}, 'end', _{kind}_at[i] + length(m)) end), s -> s is not null)"
        out = out.withColumn(f"_{kind}_s", F.expr(made)).drop(f"_{kind}", f"_{kind}_at", "_g")
        parts.append(F.col(f"_{kind}_s"))
    out = out.withColumn("base", F.array_sort(reduce(F.concat, parts))).drop(*[f"_{p[0]}_s" for p in PATTERNS])
    out = battery(located(out, "_t", "_x", TOKEN), "_x")
    bound = f"cast('{least!r}' as double)" if least != float("inf") else "cast('Infinity' as double)"
    passes = f"floor(least(stats[i].evidence, 200D) * 4) / 4 + ln(least(stats[i].n, 256) / {mean!r}D) >= {bound}"
    apart = "not exists(base, b -> b.start < _x_at[i] + length(x) and b.end > _x_at[i])"
    more = f"filter(transform(_x, (x, i) -> case when {passes} and {apart} then named_struct('start', _x_at[i], 'kind', {len(PATTERNS)}, 'end', _x_at[i] + length(x)) end), s -> s is not null)"
    out = out.withColumn("spans", F.expr(f"array_sort(concat(base, {more}))"))
    return out.select("_own", "base", "spans")


def secret_spans(df: DataFrame, text_col: str = "text", limit: tuple[float, float] | None = None) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (start, kind, end), by start, then kind; code points, end exclusive.

    Kinds are numbered as in ``KINDS``. Base spans are the matches of ``PATTERNS`` that are long enough. ``spans`` adds
    tokens whose weighted evidence under the randomness battery reaches the false-discovery ``limit``
    (``discovery_limit`` over the whole of ``df`` where none is given), unless they overlap a base span.

    Null and empty texts have no spans; repeated rows have equal ones; an empty table gives an empty one. Rows come
    back one for one with all their columns (a column of the table named ``base`` or ``spans`` is replaced, but its
    values count where it is the text); nothing is shuffled.
    """
    own = [F.col(f"_own.`{c}`") for c in df.columns if c not in ("base", "spans")]
    return found_spans(df, text_col, limit).select(*own, "base", "spans")


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(quoted(k) for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", limit: tuple[float, float] | None = None) -> DataFrame:
    """``df`` with every span of ``secret_spans`` in its text replaced by ``mark``; overlapping spans become one mark.

    Texts without spans, null and empty texts among them, stay as they are, and so do all other columns, whatever their
    names. Repeated rows are masked alike; an empty table gives an empty one.
    """
    out = found_spans(df, text_col, limit)
    t = f"_own.`{text_col}`"
    # the end reached by all spans before each one; a span that starts beyond it opens a new gap
    reach = "transform(spans, (s, i) -> coalesce(array_max(transform(slice(spans, 1, i), p -> p.end)), 0L))"
    out = out.withColumn("_r", F.expr(f"case when size(spans) > 0 then {reach} end"))
    kept = f"filter(transform(spans, (s, i) -> case when i = 0 or s.start > _r[i] then substring({t}, cast(_r[i] + 1 as int), cast(s.start - _r[i] as int)) end), x -> x is not null)"
    tail = f"substring({t}, cast(array_max(transform(spans, s -> s.end)) + 1 as int))"
    text = F.expr(f"case when size(spans) > 0 then array_join(concat({kept}, array({tail})), {quoted(mark)}) else {t} end")
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_own.`{c}`") for c in df.columns])
