"""Quality and toxicity: held-out accuracy, misspellings, degenerate training sets and odd tables."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import quality, queries, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return d, {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}


@pytest.mark.parametrize("query,column,mod,rem,least", [(queries.op8_quality, "quality", 3, 1, 0.95), (queries.op4_toxicity, "toxic", 5, 0, 0.85)])
def test_held_out(spark, labelled, query, column, mod, rem, least):
    d, labels = labelled
    rows = query(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rem) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) >= least


def test_misspellings_share_subwords():
    clean = ["the cat sat on the mat", "a fine day for a walk", "we like the green tea", "reading books at home"] * 5
    bad = ["the utter nincompoop sat", "a fine nincompoop for a walk", "we like the nincompoop tea", "reading nincompoop at home"] * 5
    texts = [f"{t} {i}" for i, t in enumerate(clean + bad)]
    m = toxicity.fit(texts, [0] * 20 + [1] * 20)
    assert m.score("a nincompop came") > 0.5 > m.score("a cat came")
    # a passage of abuse inside a long clean text counts
    assert m.score("the cat sat on the mat " * 300 + "the nincompoop nincompoop " + "a fine day " * 300) > m.score("the cat sat on the mat " * 300 + "a fine day " * 300)


def test_ranking_prefers_clean_text():
    good = [f"plain words in number {i} make a sentence, and another one." for i in range(40)]
    bad = [f"$$$ ### words{i} $$$ ### !!! %%% ###" for i in range(12)]
    m = quality.fit(good + bad, [1] * 40 + [0] * 12)
    s = m.scores(good + bad)
    assert (s[:40] >= 0.5).all() and (s[40:] < 0.5).all()


def test_degenerate_labels():
    assert (quality.fit([], []).scores(["a", ""]) == 1).all() and (quality.fit(["a"], [0]).scores(["b"]) == 0).all()
    assert toxicity.fit([], []).score("a") < 0.5 < toxicity.fit(["a"], [1]).score("b")
    assert quality.fit(["a b"], [1]).scores([]).tolist() == []


def test_odd_tables(spark, odd, empty, docs, labels):
    q, t = quality.train(docs, labels), toxicity.train(docs, labels)
    for df, n in ((odd, odd.count()), (empty, 0)):
        assert quality.score_quality(df, q).count() == n == toxicity.score_toxicity(df, t).count()
    none = spark.createDataFrame([], labels.schema)
    odd_labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (6, 1, 0), (6, 1, 1), (4, 0, 1)], labels.schema)
    for ls in (none, odd_labels):
        assert 0 <= quality.score_quality(odd, quality.train(odd, ls)).first().score <= 1
        assert 0 <= toxicity.score_toxicity(odd, toxicity.train(odd, ls)).first().score <= 1


def test_equal_texts_get_equal_scores(odd, docs, labels):
    for made in (quality.score_quality(odd, quality.train(docs, labels)), toxicity.score_toxicity(odd, toxicity.train(docs, labels))):
        scores = {}
        texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
        for r in made.collect():
            if r.doc_id is not None:
                scores.setdefault(texts[r.doc_id] or "", set()).add(r.score)
        assert all(len(s) == 1 for s in scores.values())


def plain_toxicity(m, text):
    """The score word by word and window by window, from the fitted array alone."""
    logits = []
    words = text.lower().split()
    value = []
    for w in words:
        grams = [f"<{w}>"] + [f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        value.append(sum(float(m.value[zlib.crc32(g.encode()) % len(m.value)]) for g in grams) / len(grams))
    for i in range(max(1, len(value) - 31)):
        window = value[i : i + 32]
        logits.append(sum(window) / len(window) if window else 0.0)
    return 1 / (1 + math.exp(-(max(logits) + m.bias)))


def plain_quality(m, text):
    """The score feature by feature, from the fitted arrays alone."""
    raw = 0.0
    for x, mean, std, w in zip(quality.features(text).tolist(), m.mean.tolist(), m.std.tolist(), m.weight.tolist()):
        raw += min(8.0, max(-8.0, (x - mean) / std)) * w
    return 1 / (1 + math.exp(-(raw - m.threshold) / m.scale))


def test_scores_against_a_plain_scorer(spark, labelled):
    d, _ = labelled
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.limit(150).collect()}
    q, t = quality.train(docs, labels), toxicity.train(docs, labels)
    some = docs.where(F.col("doc_id").isin(list(texts)))
    for r in toxicity.score_toxicity(some, t).collect():
        assert math.isclose(r.score, plain_toxicity(t, texts[r.doc_id]), rel_tol=1e-4, abs_tol=1e-6)
    for r in quality.score_quality(some, q).collect():
        assert math.isclose(r.score, plain_quality(q, texts[r.doc_id]), rel_tol=1e-6, abs_tol=1e-9)


def test_sample_is_bounded(spark):
    from shelfwise.llm.sample import labelled_sample

    # one id many times over, long texts, ties
    rows = [(1, "same text")] * 50 + [(1, f"other {i}") for i in range(50)] + [(i, "x" * 1000 + str(i)) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    texts, y = labelled_sample(docs, labels, "quality", 3, 1, 1000, 10_000)
    assert len(texts) == len(y) == len(set(texts)) and sum(map(len, texts)) <= 10_000
    assert len(labelled_sample(docs, labels, "quality", 3, 1, 7, 10_000)[0]) <= 7
    whole, _ = labelled_sample(docs, labels, "quality", 3, 1, 1000, 1)
    assert len(whole) == 1


def test_best_windows_are_those_of_each_text():
    import numpy as np

    rng = np.random.default_rng(4)
    lens = np.array([1, 5, 31, 32, 33, 200, 32, 7])
    values = rng.normal(size=lens.sum()).round(2)
    top, at = toxicity.best_windows(values, lens, np.minimum(lens, toxicity.WINDOW))
    for i, (s, n) in enumerate(zip(np.cumsum(lens) - lens, lens)):
        means = toxicity.window_means(values[s : s + n])
        assert math.isclose(top[i], means.max(), abs_tol=1e-9) and math.isclose(means[at[i] - s], means.max(), abs_tol=1e-9)
    whole, start = toxicity.best_windows(values, lens, lens)
    assert np.allclose(whole, [values[s : s + n].mean() for s, n in zip(start, lens)])


@pytest.mark.parametrize("model", [quality, toxicity])
def test_models_are_fitted_away_from_the_driver(spark, monkeypatch, model):
    """Texts and arrays of a fit would take memory of the driver, which holds the whole session."""
    import os

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 2 as int) as toxic")
    monkeypatch.setattr(model, "fit", lambda texts, y: (os.getpid(), len(texts)))
    pid, n = model.train(docs, labels)
    assert pid != os.getpid() and 0 < n < 40


def eligible(rows):
    """Texts and labels outside the held-out third; of equal texts the smallest id's label."""
    seen = {}
    for i, t, y in sorted(rows):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            seen.setdefault(t, y)
    return list(seen), list(seen.values())


@pytest.mark.parametrize("bad", [(0, 3, 6), (0,)])
def test_quality_learns_from_every_labelled_row(spark, bad):
    """More rows than a task fits: moments, threshold and scale are those of all, a label rarer than blocks included."""
    import numpy as np

    rare = len(bad) == 1
    rows = [(i, f"$$ ## word{i} !! $$" if (i % 10 in bad if not rare else i % 100 == 0) else f"plain words in number {i} make a sentence, and another.", 0) for i in range(900)]
    rows = [(i, t, int(t[0] == "p")) for i, t, _ in rows] + [(2000 + i, "the same text again", i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    m = quality.train(docs, labels, max_rows=64)
    texts, y = eligible(rows)
    x = np.stack([quality.features(t) for t in texts])
    assert np.allclose(m.mean, x.mean(0), atol=1e-5) and np.allclose(m.std, x.std(0) + 1e-3, atol=1e-4)
    s = m.raw(x)
    assert math.isclose(m.threshold, np.quantile(s, 1 - np.mean(y)), abs_tol=1e-3) and math.isclose(m.scale, s.std() / 4, rel_tol=1e-3)
    sure = [(p, v) for p, v, t in zip(m.scores(texts) >= 0.5, y, texts) if t[0] != "t"]
    assert sum(p == v for p, v in sure) / len(sure) > 0.98


def test_rows_of_a_few_labels_that_have_texts_are_all_used(spark):
    """Ids without a text don't take the place of those with one."""
    import numpy as np

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    texts, _ = eligible([(i, f"text {i} " * (i % 7 + 1), i % 2) for i in range(40)])
    m = quality.train(docs, labels, max_rows=200)
    assert np.allclose(m.mean, np.stack([quality.features(t) for t in texts]).mean(0))


def test_every_row_is_in_a_pair(monkeypatch):
    import numpy as np

    drawn = []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: drawn.append(set(x.tolist())) or count(x, *a, **k))
    quality.pair_weights(np.zeros((500, 2)), np.arange(500) % 5 // 4, pairs=410, steps=1)
    assert drawn[0] | drawn[1] == set(range(500))


def test_quantile_of_all_scores(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality, "FEW_SCORES", 5)
    rng = np.random.default_rng(2)
    for s in (rng.normal(size=400), np.repeat(rng.normal(size=9), 40), np.zeros(30), np.exp(rng.normal(size=300) * 9)):
        df = spark.createDataFrame([(float(v),) for v in s], "s double").cache()
        for q in (0.0, 0.13, 0.5, 1.0):
            assert math.isclose(quality.quantile(df, q), np.quantile(s, q), rel_tol=1e-12, abs_tol=1e-12)


def test_values_of_words_are_made_together(monkeypatch):
    """Of any script, and the same numbers whatever words come with them: one call for all new words of some texts."""
    value = np.random.default_rng(3).normal(size=toxicity.BUCKETS).astype(np.float32)
    words = ["", "a", "ab", "words", "\ud800x", "日本語", "é", "𝒳𝒴𝒵𝒲q", "شاي", "<>", "x" * 300]
    want = [value[toxicity.subwords(w)].astype(np.float64).mean() for w in words]
    got = toxicity.word_values(words, value)
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert [toxicity.word_values([w], value)[0] for w in words] == got.tolist()
    calls, made = [], toxicity.word_values
    monkeypatch.setattr(toxicity, "word_values", lambda ws, v: calls.append(len(ws)) or made(ws, v))
    m = toxicity.ToxicityModel(value, 0.5)
    texts = [" ".join(words[1:]), "", "a ab new"] * 3
    scores = m.scores(texts)
    assert calls == [len(words)] and scores.tolist() == [toxicity.ToxicityModel(value, 0.5).score(t) for t in texts]
