"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens of word shingles."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, counted, cut_lineage, drop_written, fitted, forest, join_side, map_texts, released, written_table

#: Minwise tokens a document has, and the probability of missing a pair at the threshold.
#: A pair of similarity s agrees in Binomial(MINWISE, s) of the tokens; where it agrees in a share q, a tree keeps it
#: together for d branchings with probability q**d. ``trees_for`` gives the trees that a threshold needs, summed over
#: the shares, as all trees branch by the same tokens.
MINWISE, MISS = 128, 1e-6
#: Branchings after which small nodes are compared, and after which nodes of any size are.
EARLY, DEPTH = 4, 8
#: A small node: at most so many documents and shingles.
SMALL_DOCS, SMALL_SHINGLES = 32, 1 << 17
#: A larger node is narrow where besides its largest known component there are at most so many blocks.
NARROW_BLOCKS = 4
#: A block of a larger node: at most about so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 64, 1 << 16
#: Trees whose larger nodes are first compared with one block each, so that groups of near copies are known early.
STAR_TREES = 6


def missed(similarity: float, trees: int, depth: int = DEPTH) -> float:
    """Probability that a pair of that similarity stays together for ``depth`` branchings in none of the trees."""
    q = [k / MINWISE for k in range(MINWISE + 1)]
    return sum(comb(MINWISE, k) * similarity**k * (1 - similarity) ** (MINWISE - k) * (1 - q[k] ** depth) ** trees for k in range(MINWISE + 1))


def trees_for(similarity: float, depth: int = DEPTH, miss: float = MISS) -> int:
    """Trees needed to miss a pair at the threshold with probability ``miss`` at most."""
    trees = 1
    while missed(similarity, trees, depth) > miss:
        trees += 1
    return trees


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a text of fewer words is one shingle, an empty one none.

    Words are runs without ASCII white space (space, \\t to \\r), with A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    span = min(n, k)
    acc = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        acc = mix(acc + h[j : n - span + 1 + j])
    return np.unique(acc)


def minwise(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over the set, in blocks of bounded size."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 4096):
        low = np.minimum(low, (multipliers[:, None] * shingles[None, s : s + 4096]).min(axis=1))
    return low


def multipliers(n: int = MINWISE) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def node_keys(tokens: np.ndarray, trees: int, depth: int, first: int = 1) -> np.ndarray:
    """For each document (row of ``tokens``) its node in every tree, ``depth`` branchings below the root.

    A node's path chooses the coordinate that the node branches by, and a document follows its minwise token there.
    """
    path = np.broadcast_to(mix(np.arange(first, first + trees, dtype=np.uint64)), (len(tokens), trees)).copy()
    for _ in range(depth):
        chosen = ((path >> np.uint64(40)) % np.uint64(tokens.shape[1])).astype(np.int64)
        path = mix(path + np.take_along_axis(tokens, chosen, axis=1))
    return path


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def links_within(ids: list[int], sets: list[np.ndarray], side: list[int], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between members of two sides, or among all where there is one side, confirmed on full sets.

    Members of one component of ``known`` aren't compared.
    """
    m, one = len(ids), len(set(side)) == 1
    known = known or ids
    if m <= 6:
        return [(ids[i], ids[j]) for i in range(m) for j in range(i) if (one or side[i] != side[j]) and known[i] != known[j] and linked(sets[i], sets[j], percent)]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    new = np.cumsum(shared) - 1
    hit = shared[col]
    owner, col, width = owner[hit], new[col[hit]], int(shared.sum())
    inter = np.zeros((m, m), np.float32)
    for s in range(0, width, 1 << 14):
        part = (col >= s) & (col < s + (1 << 14))
        dense = np.zeros((m, min(1 << 14, width - s)), np.float32)
        dense[owner[part], col[part] - s] = 1
        inter += dense @ dense.T
    inter = np.rint(inter).astype(np.int64)
    known = np.array(known)
    ok = (known[:, None] != known[None, :]) & (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter))
    if not one:
        s = np.array(side)
        ok &= s[:, None] != s[None, :]
    return [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.tril(ok, -1)))]


def with_known(docs: DataFrame, known: DataFrame | None) -> DataFrame:
    """``docs`` with the component (comp) that is known of each id, else the id itself. Rows of ``docs`` are documents,
    not yet their nodes: the join then costs one row a document, however many trees it goes through."""
    if known is None:
        return docs.withColumn("comp", F.col("id"))
    return docs.join(known.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def in_trees(docs: DataFrame, trees: int | None = None) -> DataFrame:
    """A row (tree, key) for the node of each document in each tree, or in the first ``trees``, with the other columns."""
    keys = F.col("keys") if trees is None else F.slice("keys", 1, trees)
    return docs.select(*[c for c in docs.columns if c != "keys"], F.posexplode(keys).alias("tree", "key"))


def members_of(keyed: DataFrame, most: int | None = None) -> DataFrame:
    """The rows (id, tree, key, w, comp) of ``keyed`` (``most`` of them at most) whose node holds others too, not all known to be one component.

    Without a column comp no component is known. Nodes that are done are left before their rows are joined with anything.
    """
    keyed = keyed if "comp" in keyed.columns else with_known(keyed, None)
    # a plain table: adaptive execution can then split a node that a third of all documents share
    nodes = join_side(keyed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key"), rows=most)
    return cut_lineage(keyed.join(nodes, "key").select("id", "tree", "key", "w", "comp"), most)


def gathered(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, w, comp), with nodes that overlap put together where this makes fewer copies of documents.

    Nodes that share documents, or components known already, in whatever trees, form families. A family of N documents
    is one node if its N * blocks(N) copies aren't more than the copies of all its nodes; else each node stays by itself.
    So a pair of near copies that meets in many trees is compared once, while a long chain of loosely alike documents
    never costs more copies than its nodes do. Either way all pairs within a node are compared.
    """
    rows = cut_lineage(rows)
    most = counted(rows)
    low = cut_lineage(rows.groupBy("key").agg(F.min("comp").alias("low"), F.count("*").alias("n")), most)
    # a component is one row a node, however many documents it has there
    edges = rows.select("key", "comp").distinct().join(low.select("key", "low"), "key").where("comp > low").select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct()
    families = cut_lineage(connected_components(edges, rows=most).select(F.col("node").alias("comp"), F.col("component").alias("family")), most)
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK_DOCS)))
    of_node = low.join(families.select(F.col("comp").alias("low"), "family"), "low").groupBy("family").agg(F.sum(F.col("n") * blocks(F.col("n"))).alias("apart"))
    docs = cut_lineage(rows.select("id", "w", "comp").distinct().join(families, "comp"), most)
    n_docs = docs.groupBy("family").agg(F.count("*").alias("n"))
    whole = join_side(n_docs.join(of_node, "family").where(F.col("n") * blocks(F.col("n")) <= F.col("apart")).select("family"), rows=most)
    # a node belongs to one family, that of its smallest component: rows of nodes are joined by nodes, documents of a family once
    inside = join_side(low.join(families.select(F.col("comp").alias("low"), "family"), "low").join(whole, "family", "left_semi").select("key"), rows=most)
    together = docs.join(whole, "family", "left_semi").select(F.xxhash64("family", F.lit("family")).alias("key"), "id", "w", "comp")
    return cut_lineage(rows.join(inside, "key", "left_anti").select("key", "id", "w", "comp").distinct().unionByName(together), 2 * most)


def blocks_of(docs, shingles):
    return F.ceil(F.greatest(docs / F.lit(float(BLOCK_DOCS)), shingles / F.lit(float(BLOCK_SHINGLES)))).cast("int")


def parts_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the known components in each node (key, comp, own), and of each node (key): those that all components
    of one block share, those of larger components, and the most of one of these."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("w").alias("w")).withColumn("own", blocks_of(F.col("c"), F.col("w")))
    big = F.col("own") > 1
    own = F.when(big, F.col("own"))
    node = per.groupBy("key").agg(F.sum(F.when(~big, F.col("c"))).alias("c"), F.sum(F.when(~big, F.col("w"))).alias("w"), F.coalesce(F.sum(own), F.lit(0)).alias("bigs"), F.coalesce(F.max(own), F.lit(0)).alias("most"))
    return per.where(big), node.select("key", F.coalesce(blocks_of(F.col("c"), F.col("w")), F.lit(0)).alias("shared"), "bigs", "most")


def dealt(rows: DataFrame, star: bool = False) -> DataFrame:
    """(key, i, j, block, id, comp): every node's documents by blocks, each pair of blocks that is to be compared a group.

    Components that fill several blocks have blocks of their own, which aren't compared with each other; the other
    documents of the node share blocks. With ``star`` blocks are only compared within and with the first block.
    """
    per, node = parts_of(rows)
    most = counted(rows)
    node = cut_lineage(node.where("shared + bigs > 1").drop("most"), most)
    if node.isEmpty():
        # every node is one block
        one = F.lit(0)
        return rows.select("key", one.alias("i"), one.alias("j"), one.alias("block"), "id", "comp")
    after = F.sum("own").over(W.partitionBy("key").orderBy("comp")) - F.col("own")
    out = rows.join(join_side(node), "key", "left").join(join_side(per.select("key", "comp", "own", after.alias("after")), rows=most), ["key", "comp"], "left")
    out = out.withColumns({"shared": F.coalesce("shared", F.lit(1)), "bigs": F.coalesce("bigs", F.lit(0))})
    spread = F.xxhash64("id", F.lit(5))
    out = out.withColumn("first", F.when(F.col("own").isNotNull(), F.col("shared") + F.col("after")))
    out = out.withColumn("block", F.coalesce(F.col("first") + F.pmod(spread, F.col("own")), F.pmod(spread, F.col("shared"))).cast("int"))
    last = (F.col("shared") + F.col("bigs") - 1).cast("int")
    if star:
        others = F.when((F.col("block") > 0) & F.col("first").isNull(), F.array(F.lit(0), F.col("block"))).when(F.col("block") > 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))
    else:
        others = F.sequence(F.lit(0), last)
    apart = F.filter(others, lambda x: F.col("first").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("own")))
    out = out.withColumn("other", F.explode(apart))
    return out.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp")


def compared(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the documents of each group of ``dealt``, confirmed on full sets; of a group a spanning forest."""
    group = ["key", "i", "j"]
    # few rows go to the sets, so that these are only shuffled where they are compared
    full = sets.select("id", "set").join(join_side(rows, BROADCAST_ROWS // 4), "id").select(*group, "block", "id", "comp", "set")
    full = full.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        key, ids, sets_, side, comps = None, [], [], [], []

        def flush():
            got = forest(links_within(ids, sets_, side, percent, comps)) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = batch.to_pydict()
            for k, i, j, b, n, c, s in zip(*(cols[x] for x in (*group, "block", "id", "comp", "set"))):
                if (k, i, j) != key:
                    if len(ids) > 1:
                        yield flush()
                    key, ids, sets_, side, comps = (k, i, j), [], [], [], []
                ids.append(n)
                sets_.append(np.frombuffer(s, np.uint64))
                side.append(b)
                comps.append(c)
        yield flush()

    return cut_lineage(full.mapInArrow(released(run), "a bigint, b bigint"))


def is_small(docs, shingles):
    return (docs <= SMALL_DOCS) & (shingles <= SMALL_SHINGLES)


def early_nodes(members: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of nodes after ``EARLY`` branchings: the rows (key, id, w, comp) that are to be compared, and the dense documents (id, w).

    Nodes whose members are all known to be one component, by comp or since then by ``known``, are done. The others are
    compared if they are small (of nodes of the same documents, in whatever trees, one) or narrow; the documents of wide
    ones are dense.
    """
    most = counted(members)
    rows = members.select("key", "id", "w", "comp") if known is None else cut_lineage(with_known(members.select("key", "id", "w"), known), most)
    nodes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("comp").alias("a"), F.max("comp").alias("b"), *[F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)])
    nodes = cut_lineage(nodes.where("a < b").withColumn("small", is_small(F.col("n"), F.col("w"))), most)
    once = nodes.where("small").groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("small"))
    keys = join_side(once.unionByName(nodes.where("not small").select("key", "small")), rows=most)
    asked = cut_lineage(rows.join(keys, "key").select("key", "id", "w", "comp", "small"), most)
    small, large = asked.where("small").drop("small"), asked.where("not small").drop("small")
    wide = cut_lineage(parts_of(large)[1].where(F.col("shared") + F.col("bigs") - F.col("most") > NARROW_BLOCKS).select("key"), most)
    if wide.isEmpty():
        return asked.drop("small"), large.limit(0).select("id", "w")
    marked = cut_lineage(large.join(join_side(wide.withColumn("wide", F.lit(True))), "key", "left").select("key", "id", "w", "comp", "wide"), most)
    return small.unionByName(marked.where("wide is null").drop("wide")), cut_lineage(marked.where("wide").select("id", "w").distinct(), most)


def larger_nodes(docs: DataFrame, most: int) -> DataFrame:
    """The rows (key, id, w, comp) of larger nodes of the first trees, no component being known; ``most``: documents at most."""
    some = in_trees(with_known(docs, None), STAR_TREES).select("key", "id", "w", "comp")
    nodes = some.groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("w")).where((F.col("n") > 1) & ~is_small(F.col("n"), F.col("w")))
    return some.join(join_side(nodes.select("key"), rows=most * STAR_TREES), "key", "left_semi")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``df``.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest id reachable over links (itself included), kept says whether it is the row's own id.

    Chosen-path trees branch documents by selected minwise tokens. After ``EARLY`` branchings small nodes are compared
    exhaustively. Larger ones are compared with a block of theirs first: what then is known to be one component needs no
    more comparing, and nodes that so became narrow are compared to the end. The documents of the others are dense, and
    go through further trees of their own, of ``DEPTH`` branchings, whose nodes are compared whatever their size, in
    blocks. Trees of either depth are as many as make the chance that a pair at the threshold never stays together
    ``MISS`` / 2, and a pair that only meets in wide nodes is a pair of dense documents. Every link is confirmed on full
    sets. What is known of components is joined with documents, before these become rows of every tree.

    Copies (equal sets) are represented by their smallest id throughout, so a group of copies of any size costs one
    row a tree. Null or blank texts have an empty set, link with nothing and are kept. Rows with a null id link with
    nothing: component_id null, kept true. Rows that repeat an id are one node and each comes back. An empty table
    gives an empty result; other columns are dropped.
    """
    early, deep = (trees_for(percent / 100, d, MISS / 2) for d in (EARLY, DEPTH))

    def keys_of(sets: list[np.ndarray], trees: int, depth: int, first: int) -> list:
        mult = multipliers()
        keys: list = [None] * len(sets)
        full = [i for i, s in enumerate(sets) if len(s)]
        for at in range(0, len(full), 1024):
            some = full[at : at + 1024]
            found = node_keys(np.stack([minwise(sets[i], mult) for i in some]), trees, depth, first).view(np.int64)
            for i, k in zip(some, found):
                keys[i] = k
        return keys

    def sign(texts: list[str]) -> dict:
        sets = [shingle_set(t, shingle) for t in texts]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return {"n_shingles": [len(s) for s in sets], "digest": digest, "keys": keys_of(sets, early, EARLY, 1)}

    signed = map_texts(df, {id_col: "bigint"}, text_col, sign, {"n_shingles": "bigint", "digest": "binary", "keys": "array<bigint>"})
    sigs = cut_lineage(signed.withColumnRenamed(id_col, "id"))
    # small tables aren't spread over as many tasks as shuffles have
    n = counted(sigs)
    groups = sigs.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = cut_lineage(groups.where("n > 1").select("digest", "first"), n)
    named = sigs.join(copies, "digest", "left").withColumn("rep", F.coalesce("first", "id"))
    reps = named.where("id = rep and digest is not null").select("id", F.col("n_shingles").alias("w"), "keys")

    def components(links: DataFrame) -> DataFrame:
        # links are checkpointed: of as few partitions as their rows need
        rows = counted(links)
        return cut_lineage(connected_components(fitted(links, rows), rows=rows), rows)

    def full_sets(ids: DataFrame) -> DataFrame:
        # only of documents that are to be compared, made anew from their texts
        texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body"))
        texts = texts.join(join_side(ids, rows=n), "id", "left_semi")
        made = map_texts(texts, {"id": "bigint"}, "body", lambda ts: {"set": [shingle_set(t, shingle).tobytes() for t in ts]}, {"set": "binary"})
        return written_table(made.where(F.length("set") > 0), "sets")

    sets, links, known = None, None, None
    large = cut_lineage(larger_nodes(reps, n), n * STAR_TREES)
    if not large.isEmpty():
        in_large = cut_lineage(large.select("id").distinct(), n)
        sets = full_sets(in_large)
        links = compared(dealt(large, star=True), sets, percent)
        known = components(links)
    asked, dense = early_nodes(members_of(in_trees(with_known(reps, known)), n * early))
    ids = asked.select("id").unionByName(dense.select("id")).distinct()
    sets = full_sets(ids) if sets is None else sets.unionByName(full_sets(ids.join(in_large, "id", "left_anti")))
    found = compared(dealt(gathered(asked)), sets, percent)
    links = found if links is None else links.unionByName(found)
    known = components(links)
    if not dense.isEmpty():

        def branch(batches):
            for b in batches:
                keys = keys_of([np.frombuffer(s, np.uint64) for s in b.column("set").to_pylist()], deep, DEPTH, early + 1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("w"), pa.array(keys, pa.list_(pa.int64()))], names=["id", "w", "keys"])

        some = sets.join(join_side(dense), "id").select("id", "w", "set")
        keyed = cut_lineage(some.mapInArrow(released(branch), "id bigint, w bigint, keys array<bigint>"))
        links = links.unionByName(compared(dealt(members_of(in_trees(with_known(keyed, known), STAR_TREES), n * STAR_TREES), star=True), sets, percent))
        known = components(links)
        links = links.unionByName(compared(dealt(gathered(members_of(in_trees(with_known(keyed, known)), n * deep))), sets, percent))
        known = components(links)
    linked_to = known.select(F.col("node").alias("rep"), "component")
    slim = sigs.drop("keys").join(copies, "digest", "left").withColumn("rep", F.coalesce("first", "id"))
    out = cut_lineage(slim.select("id", "n_shingles", "rep")).join(linked_to, "rep", "left")
    drop_written(sets)
    label = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), "n_shingles", label.alias("component_id"), F.coalesce(label == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all columns, that represent their group of near-duplicates: one row of each group.

    Rows with a null id and rows without words are groups by themselves; of rows that repeat an id and a text one
    stays, and different texts of one id are judged each by itself.
    """
    own, key = df.columns, id_col
    if not df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        # rows get numbers of their own, in the order of ids; written, so that they stay the same
        key = "_row"
        while key in own:
            key += "_"
        some = df.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).orderBy(id_col).withColumn(key, F.monotonically_increasing_id())
        df = written_table(some.unionByName(df.where(F.col(id_col).isNull()).withColumn(key, F.lit(None).cast("bigint"))), "rows")
    found = cut_lineage(near_duplicates(df, shingle, percent, key, text_col).select(key, "kept"))
    out = df.join(join_side(found.where(~F.col("kept")).select(key).distinct()), key, "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in own])
