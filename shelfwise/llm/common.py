"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handed to a Python function at a time; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows of a side that may be broadcast after they were counted (ids and a few numbers each).
BROADCAST_ROWS = 500_000
#: Links that one task may join into components (some 16 bytes each, in arrays); more of them go through rounds of shuffles.
TASK_LINKS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster shares (``spark.checkpoint.dir``); where ``df`` is known to have
    at most ``rows`` rows, in as many partitions as these need."""
    shared_folder(df.sparkSession)
    return (df if rows is None else fitted(df, rows)).checkpoint(eager=True)


def slices(batches: Iterable[pa.RecordBatch], text: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def release() -> None:
    """Gives the memory that a worker has freed back to the machine: workers outlive their tasks, and executors are held to a limit."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` of a task's batches, after which the worker's freed memory is given back."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return own


def map_texts(df: DataFrame, keep: dict[str, str], text: str, fn: Callable[[list[str]], dict], out: dict[str, str]) -> DataFrame:
    """``df`` reduced to the columns ``keep`` (name -> Spark type) plus what ``fn`` computes from whole texts.

    ``fn`` gets a list of texts (null: empty) and returns a dict of equally long columns, named and typed by ``out``.
    Only the kept columns and the text travel to Python, so other columns of any name cannot clash.
    """
    keep_cols = [F.col(k).cast(t).alias(f"_k{i}") for i, (k, t) in enumerate(keep.items())]
    narrow = df.select(*keep_cols, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    types = ", ".join([f"`_k{i}` {t}" for i, t in enumerate(keep.values())] + [f"`{k}` {t}" for k, t in out.items()])

    def run(batches):
        for b in slices(batches, "_text"):
            made = fn(b.column("_text").to_pylist())
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(made[k], ARROW[t]) for k, t in out.items()]
            yield pa.RecordBatch.from_arrays(cols, names=[f"_k{i}" for i in range(len(keep))] + list(out))

    made = narrow.mapInArrow(released(run), types)
    return made.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], *out)


def filter_texts(df: DataFrame, text: str, fn: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows of ``df``, with all their columns as they are, for which ``fn`` of whole texts (null: empty) is true."""
    at = df.columns.index(text)

    def run(batches):
        for b in slices(batches, at):
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(fn(texts), pa.bool_()))

    return df.mapInArrow(released(run), df.schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of a cluster share. A session of one machine that names none, as in tests, gets one;
    on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a ``written_table`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Remembered(dict):
    """A dict of computed values in two generations: at ``most`` entries the young one becomes the old one.

    Values asked for again move back into the young one, so common keys are computed once and rare ones are forgotten;
    what is returned never depends on it.
    """

    def __init__(self, most: int, compute: Callable):
        super().__init__()
        self.most, self.compute, self.old = most, compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
}


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % m


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast where its counted rows are few, else as it is: the join then shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def few_tasks(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` read by a sixteenth of its partitions as tasks, eight at least: for counts and broadcasts."""
    return df.coalesce(max(8, df.rdd.getNumPartitions() // 16))


def counted(df: DataFrame) -> int:
    """Rows of a checkpointed ``df``."""
    return few_tasks(df).count()


def join_side(df: DataFrame, most: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` checkpointed (of at most ``rows`` rows, where that is known), counted, and marked for broadcast where its
    rows are ``most`` at most; else the join shuffles."""
    df = cut_lineage(df, rows)
    few = few_tasks(df)
    return F.broadcast(few) if few.count() <= most else df


def fitted(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df`` in as many partitions as its counted rows need (eight at least), never more than it has: small tables
    aren't spread over hundreds of tasks, large ones stay as they are."""
    return df.coalesce(max(8, -(-rows // per_task)))


def unsettled_nodes(e: DataFrame) -> tuple[int, int]:
    """Rows of (u, v), and nodes that hang on several others or both hang and are hung on; none in a forest of stars."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("held"))
    ends = ends.unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("held")))
    g = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("held").alias("held"))
    r = g.agg(F.coalesce(F.sum("hangs"), F.lit(0)), F.count_if((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("held") > 0)))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Up to ``TASK_LINKS`` counted links are joined in one task. Beyond: alternating large-star and small-star rounds over (node, smaller neighbour) rows. A round's intermediate tables
    are cut by reliable checkpoints: both sides of every join are then plain shuffles, which adaptive execution can
    split where one node holds a third of all rows, and minima are combined before they are shuffled. Only two counts
    a round come to the driver; rounds end once every node hangs on one root. Null ids and self loops are ignored; no edges: no rows.
    ``rows``: most rows of ``edges``, where that is known.
    """
    e = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    e = e.where("u is not null and v is not null and u <> v")
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    if few_tasks(e).count() <= TASK_LINKS:
        return e.coalesce(1).mapInArrow(joined, "node bigint, component bigint")
    while True:
        rows, unsettled = unsettled_nodes(e)
        if not unsettled:
            break
        # large star: a node's larger neighbours move to the smallest node of its neighbourhood, as does the node
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(fitted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows))
        # (u, v) of e has v below u: seen from v, u is a larger neighbour
        moved = e.select(F.col("v").alias("w"), F.col("u").alias("n")).join(low.withColumnRenamed("u", "w"), "w").select(F.col("n").alias("u"), F.col("m").alias("v"))
        big = cut_lineage(fitted(moved.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), 2 * rows))
        # small star: a node's smaller neighbours move to the smallest of them, as does the node
        least = cut_lineage(fitted(big.groupBy("u").agg(F.min("v").alias("m")), rows))
        small = big.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(fitted(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), 2 * rows))
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of ``links`` as (node, smallest node of its tree) rows."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in links:
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in up if root(x) != x]


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all nodes of the links in ``batches``: the larger root of a link hangs on the smaller, until none differ."""
    links = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in batches if b.num_rows]
    if not links:
        return
    nodes, at = np.unique(np.concatenate(links, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while (up[a] != up[b]).any():
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    for s in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + 10_000]), pa.array(nodes[up[s : s + 10_000]])], names=["node", "component"])
