"""Near-duplicates of texts and vectors, and components, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import embeddings, minhash
from shelfwise.llm.common import connected_components


class Union(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)


def shingles(text, k):
    words = bytes(text or "", "utf-8").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets, u = [(i, shingles(t, k)) for i, t in rows], Union()
    for n, (i, a) in enumerate(sets):
        u.root(i)
        for j, b in sets[:n]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                inter = len(a & b)
                if 100 * inter >= percent * (len(a) + len(b) - inter):
                    u.join(i, j)
    return {i: (len(s), u.root(i), u.root(i) == i) for i, s in sets}


def copies(rng, n, groups):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = random.Random(k)
    rows = copies(rng, 6, 40) + [(1000 + i, t) for i, t in enumerate(["", None, "a", "A", "a b", "a b c", "a\x0bb\tc", "a b c", "é b c d"])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    want = brute(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_large_group_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    rows = copies(random.Random(8), 60, 2)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 3, 85)


def test_similarity_exactly_at_the_threshold():
    a, b = np.arange(17, dtype=np.uint64), np.arange(20, dtype=np.uint64)
    assert minhash.linked(a, b, 85) and not minhash.linked(a[:16], b, 85)
    many = [np.arange(17, dtype=np.uint64)] * 4 + [np.arange(20, dtype=np.uint64)] * 4
    assert len(minhash.links_within(list(range(8)), many, [0] * 8, 85)) == 28


def test_recall_of_the_trees():
    rng = np.random.default_rng(2)
    mult, met = minhash.multipliers(), 0
    for _ in range(200):
        both = minhash.mix(rng.integers(0, 2**63, 185, dtype=np.uint64))
        a, b = both[:170], both[15:]  # similarity 155 / 185 = 0.838
        keys = minhash.node_keys(np.stack([minhash.minwise(s, mult) for s in (a, b)]), minhash.trees_for(0.85), minhash.DEPTH)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 198


def test_trees_miss_as_seldom_as_stated():
    from math import comb

    for s in (0.85, 0.8):
        trees = minhash.trees_for(s)
        p = sum(comb(128, k) * s**k * (1 - s) ** (128 - k) * (1 - (k / 128) ** 8) ** trees for k in range(129))
        assert p <= minhash.MISS


def chain(n, words=60, step=3):
    """Documents each of which shares all but ``step`` words with the next."""
    return [(i, " ".join(f"w{j}" for j in range(i * step, i * step + words))) for i in range(n)]


def test_copies_of_a_long_chain_are_bounded(spark):
    rows = chain(1200, step=5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows, 3, 85).items()}
    # all in one family: 1200 documents in 19 blocks would be 19 copies of each; the nodes of 27 trees are fewer
    trees = 27
    mult = minhash.multipliers()
    keys = minhash.node_keys(np.stack([minhash.minwise(minhash.shingle_set(t, 3), mult) for _, t in rows]), trees, minhash.EARLY).view(np.int64)
    members = minhash.members_of(spark.createDataFrame([(i, t, int(k), 58) for i, ks in enumerate(keys) for t, k in enumerate(ks)], "id long, tree int, key long, w long"))
    asked, dense = minhash.early_nodes(members, None)
    assert dense.count() == 0
    copies = minhash.dealt(minhash.gathered(asked)).count()
    assert copies <= min(asked.count(), 19 * len(rows))


def joined_rows(spark, run, like=""):
    """The most rows that a join, or one described like that, made while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, done = 0, store.executionsList()
    for i in range(before, done.size()):
        own = done.apply(i).executionId()
        made, nodes = store.executionMetrics(own), store.planGraph(own).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if "Join" in node.name() and re.search(like, node.desc()) and m.name() == "number of output rows" and made.contains(m.accumulatorId()):
                    most = max(most, int(made.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_families_are_decided_by_node_not_by_row(spark):
    """A group of near copies that meets in every tree: 60 documents of two known components in 40 nodes."""
    rows = spark.createDataFrame([(k, i, 9, i % 2) for k in range(40) for i in range(60)], "key long, id long, w long, comp long")
    out = []
    assert 0 < joined_rows(spark, lambda: out.append(minhash.gathered(rows))) <= 120
    got = [tuple(r) for r in out[0].collect()]
    assert len({r[0] for r in got}) == 1
    assert sorted(r[1:] for r in got) == [(i, 9, i % 2) for i in range(60)]


def test_dense_documents_go_through_deeper_trees(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_DOCS", 3)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 5)
    monkeypatch.setattr(minhash, "NARROW_BLOCKS", 1)
    # sets go to the rows by a shuffle
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    deepened = []
    early_nodes = minhash.early_nodes
    monkeypatch.setattr(minhash, "early_nodes", lambda *a: deepened.append(early_nodes(*a)) or deepened[-1])
    rng = random.Random(3)
    # loosely alike documents (a common half) beside groups of near copies
    half = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(60)]
    rows = [" ".join(half + [f"u{i}-{j}" for j in range(12)]) for i in range(60)] + [t for _, t in copies(rng, 20, 3)] + [t for _, t in chain(40)]
    rows = list(enumerate(rows))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 3, 80)
    assert deepened[0][0].count() > 0 and deepened[0][1].count() > 0


def test_known_components_are_joined_by_document(spark, monkeypatch):
    """Loosely alike documents meet in hundreds of trees: what is known of them is joined before they become rows of each."""
    monkeypatch.setattr(minhash, "SMALL_DOCS", 3)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 5)
    monkeypatch.setattr(minhash, "NARROW_BLOCKS", 1)
    rng = random.Random(3)
    half = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(60)]
    rows = list(enumerate([" ".join(half + [f"u{i}-{j}" for j in range(12)]) for i in range(60)] + [t for _, t in copies(rng, 20, 2)]))
    df, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    assert 0 < joined_rows(spark, lambda: got.extend(minhash.near_duplicates(df, 3, 80).collect()), r"\[id#\d+L?\], \[id#\d+L?\], LeftOuter") <= len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 3, 80)


def test_misses_at_the_threshold_are_as_stated():
    # few trees, so that misses can be counted: the share must be that of the binomial sum
    rng, trees, depth, met, n = np.random.default_rng(11), 6, 4, 0, 1500
    mult = minhash.multipliers()
    for _ in range(n):
        both = minhash.mix(rng.integers(0, 2**63, 200, dtype=np.uint64))
        a, b = both[:185], both[15:]  # similarity 170 / 200 = 0.85
        keys = minhash.node_keys(np.stack([minhash.minwise(s, mult) for s in (a, b)]), trees, depth)
        met += bool((keys[0] == keys[1]).any())
    p = minhash.missed(0.85, trees, depth)
    assert abs((n - met) / n - p) < 4 * (p * (1 - p) / n) ** 0.5


def test_odd_documents(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].component_id == by[7].component_id == 6 and by[8].component_id == 6 and not by[7].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert by[0].n_shingles == by[1].n_shingles == 0 and by[0].kept
    assert minhash.near_duplicates(empty).count() == 0 == minhash.deduplicated(empty).count()
    left = minhash.deduplicated(odd)
    assert left.columns == odd.columns
    # the repeated row stays once, copies go, rows without an id stay
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids and ids.count(None) == 2


def test_texts_of_a_repeated_id_are_judged_each(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [(1, texts["a"]), (2, texts["a"]), (2, texts["b"]), (3, texts["c"]), (3, texts["d"]), (4, texts["e"]), (4, texts["e"] + " more"), (5, ""), (5, "")]
    left = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(t[:2] for _, t in map(tuple, left)) == ["", "a0", "b0", "c0", "d0", "e0"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (None, 3), (900, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    assert got == {x: u.root(x) for x in list(u)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng, n, dim=16):
    base = rng.normal(size=(n // 4, dim))
    own = [base[rng.integers(len(base))] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.05, 0.1]) for _ in range(n)]
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(own)]


def brute_vectors(rows, threshold):
    ok = [(i, np.array(v) / np.linalg.norm(v), l) for i, v, l in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u, n = Union(), {i: 0 for i, _, _ in rows}
    for i, _, _ in rows:
        u.root(i)
    for a, (i, x, l) in enumerate(ok):
        for j, y, m in ok[:a]:
            if l == m and len(x) == len(y) and float(x @ y) >= threshold:
                u.join(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n[i], u.root(i), u.root(i) == i) for i, _, _ in rows}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 25)
    rows = vectors(np.random.default_rng(6), 600)
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, rows[5][1], rows[5][2]), (1007, rows[5][1], rows[5][2]), (1008, [1.0, 2.0], 1), (1009, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit("x")).withColumn("rep", F.lit(1))
    got = embeddings.near_duplicates(df).collect()
    want = brute_vectors(rows, 0.98)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert sum(n for n, _, _ in want.values()) > 100


def test_embeddings_split_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 12)
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    monkeypatch.setattr(embeddings, "FIT_ROWS", 60)
    # well separated groups: cells are split further, down to blocks; two vector lengths are each cut
    rows = []
    for dim, first in ((16, 0), (5, 5000)):
        rng = np.random.default_rng(dim)
        base = rng.normal(size=(40, dim))
        rows += [(first + i, [float(np.float32(v)) for v in base[i % 40] + rng.normal(size=dim) * rng.choice([0, 0.03, 0.1])], 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_vectors(rows, 0.98)


def test_wide_vectors_and_lengths_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 30)
    rng = np.random.default_rng(12)
    rows = []
    for dim, first in ((64, 0), (300, 1000)):
        base = rng.normal(size=(60, dim))
        rows += [(first + i, [float(np.float32(v)) for v in base[i % 60] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2])], int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_vectors(rows, 0.98)


def test_cells_lose_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x = np.repeat(x, 2, axis=0) + rng.normal(size=(800, 8)) * 0.03
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = embeddings.spherical_kmeans(x, 12)
    gaps = np.linalg.norm(c[:, None] - c[None], axis=2)
    cos = x @ c.T
    into = embeddings.reach(cos, gaps, np.sqrt(2 - 2 * 0.98) + 1e-9)
    home = cos.argmax(axis=1)
    for i, j in zip(*np.nonzero(x @ x.T >= 0.98)):
        assert into[i, home[j]]


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_small_tables_are_few_tasks(spark, monkeypatch):
    """Whatever the number of shuffle partitions: what has few rows isn't spread over all of them again and again."""
    parts, cut = [], minhash.cut_lineage
    monkeypatch.setattr(minhash, "cut_lineage", lambda df, *a: parts.append(cut(df, *a)) or parts[-1])
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        words = [f"w{i}" for i in range(60)]
        docs = spark.createDataFrame([(i, " ".join([*words[:50], f"own{i}"] if i % 2 else [f"x{i}y{j}" for j in range(9)])) for i in range(80)], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 1 if i % 2 else i for i in range(80)}
    many = [p.columns for p in parts if p.rdd.getNumPartitions() > 16]
    # links come from the groups' own tasks, the result from the last join
    assert len(parts) > 10 and all(c in (["a", "b"], ["id", "n_shingles", "rep"]) for c in many)
