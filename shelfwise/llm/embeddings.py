"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut_lineage, forest, sized_broadcast

#: Home vectors wanted in a cell, most cells that a cell is split into, levels of splits, rows of a block.
CELL, MAX_CELLS, LEVELS, BLOCK = 2048, 64, 8, 32_768
#: Vectors of a cell that its centroids are fitted on (expected, chosen by hash), and rows that a task places at a time.
FIT_ROWS, SALT_ROWS = 8192, 65_536
#: Bytes of double components that a block, and the vectors of a fit, may take.
MOST_BYTES = 64 << 20
PLACE = ["label", "dim", "cell"]


def marked_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, str]:
    """id, label, dim, vec (the components as stored) and digest, which is null for rows that link with nothing; and numpy's name of a component."""
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    kind, spark_kind = ("<f4", "float") if single else ("<f8", "double")
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).cast(f"array<{spark_kind}>").alias("v"))

    def run(batches):
        for b in batches:
            raw, digests, dims = [], [], []
            for label, v in zip(b.column("label").to_pylist(), b.column("v")):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and label is not None else np.zeros(0, kind)
                top = np.abs(x).max() if len(x) else 0.0
                ok = np.isfinite(top) and top > 0
                # adding zero makes a negative zero a zero
                data = (x + x.dtype.type(0)).tobytes() if ok else None
                raw.append(data)
                digests.append(xxhash.xxh3_128_digest(data) if ok else None)
                dims.append(len(x))
            cols = [b.column("id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "dim", "vec", "digest"])

    return own.mapInArrow(run, "id bigint, label bigint, dim int, vec binary, digest binary"), kind


def units(vecs: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Unit rows in double precision; the largest component is divided out first, so that no norm overflows."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k unit centroids of the unit rows of ``x``; an emptied cell takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cos = x @ c.T
        cell = cos.argmax(axis=1)
        total = (cell[None, :] == np.arange(k)[:, None]).astype(np.float64) @ x
        norm = np.linalg.norm(total, axis=1)
        far = np.argsort(cos.max(axis=1))
        for i, j in enumerate(np.flatnonzero(norm == 0)):
            total[j], norm[j] = x[far[i]], 1.0
        c = total / norm[:, None]
    return c


def reach(cos: np.ndarray, gaps: np.ndarray, chord: float) -> np.ndarray:
    """For rows of cosines to the centroids: the cells in which a vector within ``chord`` of the row can be at home.

    The home of y is its nearest centroid c_j, so (c_i - c_j) . y <= 0 for x's own c_i; y is at most ``chord`` from x,
    so (c_i - c_j) . x <= chord * |c_i - c_j|. No pair is lost whatever the centroids are.
    """
    home = cos.argmax(axis=1)
    return cos[np.arange(len(cos)), home][:, None] - cos <= chord * gaps[home] + 1e-9


def met(home: np.ndarray, cells: int) -> np.ndarray:
    """For homes of rows: in which of the cells a pair of two homes meets, their own or, turn about, the lower or the higher of the two."""
    to = np.arange(cells)[None, :]
    own = home[:, None]
    return (to == own) | ((to < own) == ((to + own) % 2 == 0))


def gaps_of(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) + 1e-7


def fitted_cells(x: np.ndarray, n: int, chord: float, cell: int, most: float) -> np.ndarray | None:
    """Centroids that split a cell of ``n`` home vectors, of which ``x`` are a sample; None where no split pays.

    Wanted are n / ``cell`` cells; there are fewer where the vectors have so little structure that a row would have over
    ``most`` copies, itself included.
    """
    k = min(MAX_CELLS, math.ceil(n / cell), len(x) // 2)
    while k >= 2:
        c = spherical_kmeans(x, k)
        cos = x @ c.T
        home = cos.argmax(axis=1)
        copies = (reach(cos, gaps_of(c), chord) & met(home, k)).sum(axis=1).mean()
        if copies <= most and np.bincount(home, minlength=k).max() < 0.9 * len(x):
            return c
        k //= 2
    return None


def split_cells(placed: DataFrame, wide: DataFrame, kind: str, chord: float, level: int) -> DataFrame | None:
    """``placed`` after one level of splits of the cells ``wide`` (place, homes, most); None where none of them is worth it.

    Centroids are fitted on executors, cell by cell, on a sample of bounded expected size. They travel to the rows of
    their cell by a shuffle, a cell being salted by its size; nothing is broadcast that grows with the cells.
    """
    cell, most = CELL, FIT_ROWS
    cells = sized_broadcast(wide, wide.count())
    fit = F.greatest(F.lit(16), F.least(F.lit(most), F.floor(F.lit(MOST_BYTES) / (8 * F.col("dim")))))
    chosen = F.pmod(F.xxhash64("rep", F.lit(100 + level)), F.lit(1 << 30)) < fit / F.col("homes") * (1 << 30)
    sample = placed.where("home").join(cells, PLACE).where(chosen).select(*PLACE, "homes", "most", "rep", "vec")

    def fit_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, n = int(pdf["dim"].iloc[0]), int(pdf["homes"].iloc[0])
        x = units(pdf.sort_values("rep")["vec"].tolist(), kind, dim)
        c = fitted_cells(x, n, chord, cell, float(pdf["most"].iloc[0]))
        out = pdf.iloc[: 0 if c is None else 1][[*PLACE, "homes"]].copy()
        out["vec"] = [] if c is None else [c.tobytes()]
        return out

    centres = cut_lineage(sample.groupBy(*PLACE).applyInPandas(fit_cell, "label bigint, dim int, cell bigint, homes bigint, vec binary"))
    many = centres.count()
    if not many:
        return None
    salted = sized_broadcast(centres.select(*PLACE, F.ceil(F.col("homes") / SALT_ROWS).cast("int").alias("salts")), many)
    rows = placed.join(salted, PLACE).select(*PLACE, F.pmod(F.xxhash64("rep", F.lit(7)), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("row"), "rep", "n", "vec", "home")
    heads = centres.select(*PLACE, F.explode(F.sequence(F.lit(0), F.ceil(F.col("homes") / SALT_ROWS).cast("int") - 1)).alias("salt"), F.lit(0).alias("row"), F.lit(0).cast("bigint").alias("rep"), F.lit(0).cast("bigint").alias("n"), "vec", F.lit(True).alias("home"))
    group = [*PLACE, "salt"]
    both = heads.unionByName(rows).repartition(*group).sortWithinPartitions(*group, "row")

    def assign(batches):
        c = gaps = None
        for b in batches:
            first = b.column("row").to_numpy(zero_copy_only=False) == 0
            edges = sorted({0, b.num_rows, *np.flatnonzero(first).tolist(), *(np.flatnonzero(first) + 1).tolist()})
            for s, e in zip(edges, edges[1:]):
                part = b.slice(s, e - s)
                dim = part.column("dim")[0].as_py()
                if first[s]:
                    c = np.frombuffer(part.column("vec")[0].as_py()).reshape(-1, dim)
                    gaps = gaps_of(c)
                    continue
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    cos = units(some.column("vec").to_pylist(), kind, dim) @ c.T
                    near = cos.argmax(axis=1)
                    lives = some.column("home").to_numpy(zero_copy_only=False)
                    into = reach(cos, gaps, chord) & (~lives[:, None] | met(near, len(c)))
                    row, to = np.nonzero(into)
                    t = pa.array(row, pa.int64())
                    old = some.column("cell").to_numpy(zero_copy_only=False)[row]
                    cols = [some.column(x).take(t) for x in ("label", "dim", "rep", "n", "vec")]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(old * (MAX_CELLS + 1) + 1 + to, pa.int64()), pa.array(lives[row] & (to == near[row]), pa.bool_())], names=["label", "dim", "rep", "n", "vec", "cell", "home"])

    cols = ["label", "dim", "rep", "n", "vec", "cell", "home"]
    moved = both.mapInArrow(assign, "label bigint, dim int, rep bigint, n bigint, vec binary, cell bigint, home boolean")
    rest = placed.join(salted, PLACE, "left_anti").select(*cols)
    return cut_lineage(rest.unionByName(moved))


def tiles(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """(row offset, column offset, links) of blocked products of unit rows; of one set with itself only row < column."""
    for i in range(0, len(x), 512):
        for j in range(i if same else 0, len(y), 8192):
            near = x[i : i + 512] @ y[j : j + 8192].T >= threshold
            if same:
                near &= np.arange(i, i + near.shape[0])[:, None] < np.arange(j, j + near.shape[1])[None, :]
            if near.any():
                yield i, j, near


def block_links(x: np.ndarray, rep: np.ndarray, n: np.ndarray, home: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links that each row has with the others (copies counted), and a spanning forest, for one pair of blocks.

    Rows of two sides are compared across, those of one among themselves; two guests never are.
    """
    count = np.zeros(len(rep), np.int64)
    links: list[tuple[int, int]] = []
    first = side == side[0]
    here = [np.flatnonzero(first & home), np.flatnonzero(first & ~home)]
    there = here if first.all() else [np.flatnonzero(~first & home), np.flatnonzero(~first & ~home)]
    meet = [(here[0], there[0]), (here[0], there[1])]
    if there is not here:
        meet.append((here[1], there[0]))
    for a, b in meet:
        for i, j, near in tiles(x[a], x[b], threshold, a is b):
            p, q = a[i : i + near.shape[0]], b[j : j + near.shape[1]]
            count[p] += near @ n[q]
            count[q] += n[p] @ near
            links += forest([(int(rep[p[r]]), int(rep[q[s]])) for r, s in spanning(near)])
    return count, forest(links)


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept (the group's representative) for every row of ``df``.

    Vectors are linked when their labels are equal and not null and their cosine in double precision reaches the
    threshold. Spherical k-means, fitted label by label and vector length by vector length on bounded samples
    (``FIT_ROWS``), cuts the space into cells, and cells that are still wide into further cells. Every vector is at home
    in one cell and a guest in those of the others (of each two cells, one takes guests from the other) that can be home
    to a vector linked with it, so all links are found, each once. Homes are compared with homes and guests of their cell in blocks of at most ``BLOCK`` rows, each pair of
    blocks a task's group; a group returns counts and a spanning forest of its links, not all pairs. A row is copied at
    most about max(2, rows of its label / ``BLOCK``) times, whatever the vectors are like.

    Copies (equal vectors of a label) are one class with a count. Null, empty or zero vectors, vectors that hold null
    or non-finite components, and rows with a null label or id link with nothing: n_links 0, own component, kept.
    Vectors of different lengths aren't linked. Repeated rows count as other vectors. An empty table gives an empty
    result; other columns are dropped.
    """
    made, kind = marked_rows(df, id_col, vec_col, label_col)
    rows = cut_lineage(made)
    valid = rows.where("digest is not null and id is not null")
    key = ["label", "dim", "digest"]
    classes = valid.groupBy(*key).agg(F.min(F.struct("id", "vec")).alias("m"), F.count("*").alias("n"))
    classes = cut_lineage(classes.select(*key, F.col("m.id").alias("rep"), F.col("m.vec").alias("vec"), "n"))
    chord = math.sqrt(2 - 2 * threshold) + 1e-9
    placed = classes.select("label", "dim", "rep", "n", "vec", F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("home"))
    block = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(MOST_BYTES) / (8 * F.col("dim")))))
    for level in range(LEVELS):
        homes = placed.groupBy(*PLACE).agg(F.sum(F.col("home").cast("bigint")).alias("homes"), F.count("*").alias("all"))
        # copies that comparing an unsplit cell block by block takes; a further level costs a shuffle more
        unsplit = F.col("all") / block
        homes = homes.withColumn("most", unsplit - 1 if level else F.greatest(F.lit(2.0), unsplit))
        wide = cut_lineage(homes.where((F.col("homes") > CELL) & (F.col("most") > 1)).select(*PLACE, "homes", "most"))
        deeper = None if wide.isEmpty() else split_cells(placed, wide, kind, chord, level)
        if deeper is None:
            break
        placed = deeper
    sizes = placed.groupBy(*PLACE).agg(F.ceil(F.count("*") / F.first(block)).cast("int").alias("blocks"))
    large = cut_lineage(sizes.where("blocks > 1"))
    dealt = placed.join(sized_broadcast(large, large.count()), PLACE, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*PLACE, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "vec", "home")
    group = [*PLACE, "i", "j"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        now, parts = None, []

        def flush():
            x, rep, n, home, side = (np.concatenate(p) for p in zip(*parts))
            count, tree = block_links(x, rep, n, home, side, threshold)
            some = count > 0
            a = rep[some].tolist() + [u for u, _ in tree]
            b = [None] * int(some.sum()) + [v for _, v in tree]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count[some].tolist() + [0] * len(tree), pa.int64())], names=["a", "b", "n"])

        for b in batches:
            keys = np.stack([b.column(g).to_numpy(zero_copy_only=False).astype(np.int64) for g in group], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if tuple(keys[s]) != now:
                    if parts and sum(len(p[1]) for p in parts) > 1:
                        yield flush()
                    now, parts = tuple(keys[s]), []
                part = b.slice(s, e - s)
                cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "home", "block")]
                parts.append((units(part.column("vec").to_pylist(), kind, int(now[1])), *cols))
        if parts:
            yield flush()

    found = cut_lineage(dealt.mapInArrow(compare, "a bigint, b bigint, n bigint"))
    counts = cut_lineage(found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked")))
    groups = cut_lineage(connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component"))
    named = classes.select(*key, "rep", F.col("n").alias("copies")).join(counts, "rep", "left").join(groups, "rep", "left")
    named = cut_lineage(named.select(*key, "rep", "copies", "linked", "component"))
    out = rows.select("id", *key).join(named, key, "left")
    own = F.coalesce("component", "rep", "id")
    links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))
    lone = F.col("id").isNull()
    return out.select(F.col("id").alias(id_col), F.when(lone, 0).otherwise(links).cast("bigint").alias("n_links"), F.when(~lone, own).alias("component_id"), (lone | (own == F.col("id"))).alias("kept"))


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of a boolean matrix that connect whatever all its links connect.

    Each column keeps the link to its first row, which gathers columns into classes; each row keeps one link to every
    class that it reaches.
    """
    if not near.any():
        return []
    first = np.where(near.any(axis=0), near.argmax(axis=0), -1)
    kept = {(int(i), j) for j, i in enumerate(first) if i >= 0}
    for i in np.flatnonzero(near.any(axis=1)):
        cols = np.flatnonzero(near[i])
        kept.update((int(i), int(cols[j])) for j in np.unique(first[cols], return_index=True)[1])
    return list(kept)
