"""The labelled rows that classifiers are fitted on: all of them, or a bounded sample."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, join_side, released


def own_labels(labels: DataFrame, label: str, held_mod: int, held_rem: int, id_col: str) -> DataFrame:
    """(_id, _y) of the labelled ids outside the held-out remainder; of repeated ids the largest label counts."""
    own = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label).cast("int").alias("_y"))
    own = own.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (crc_mod(F.col("_id"), held_mod) != held_rem))
    return own.groupBy("_id").agg(F.max("_y").alias("_y"))


def own_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _t) of the texts that aren't null."""
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.col("_t").isNotNull())


def all_labelled_rows(docs: DataFrame, labels: DataFrame, label: str, held_mod: int, held_rem: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _y, _t) of every labelled row outside the held-out remainder. Rows with a null id, label or text are left out."""
    return own_texts(docs, id_col, text_col).join(join_side(own_labels(labels, label, held_mod, held_rem, id_col)), "_id").select("_id", "_y", "_t")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, held_mod: int, held_rem: int, max_rows: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(_id, _y, _t): ids, labels (0 or 1) and texts of at most ``max_rows`` labelled rows outside the held-out remainder.

    The rows are those with the smallest hashes of their ids, so the choice does not depend on partitioning, and as many
    of them as hold ``max_chars`` characters in all (the first one whatever its length); every text is whole. Of repeated
    ids the largest label counts. Rows with a null id, label or text are left out; None where no row is left. Only
    lengths and hashes of at most ``max_rows`` rows come to the driver.
    """
    chosen = own_labels(labels, label, held_mod, held_rem, id_col).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = own_texts(docs, id_col, text_col)
    texts = texts.select("_id", "_t", F.xxhash64("_t").alias("_k")).join(F.broadcast(chosen), "_id")
    sizes = texts.select("_id", "_k", F.length("_t").alias("_n")).orderBy(F.xxhash64("_id"), "_id", "_k").limit(max_rows).collect()
    keys, held = [], 0
    for r in sizes:
        held += r["_n"]
        if held > max_chars and keys:
            break
        keys.append((r["_id"], r["_k"]))
    if not keys:
        return None
    some = docs.sparkSession.createDataFrame(sorted(set(keys)), "_id bigint, _k bigint")
    return texts.join(F.broadcast(some), ["_id", "_k"]).dropDuplicates(["_id", "_k"]).select("_id", "_y", "_t")


def once(rows: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    """Texts and labels of rows (id, label, text), in their order; of equal texts the smallest id's label counts."""
    seen: dict[str, int] = {}
    for _, y, t in sorted(rows, key=lambda r: (r[0], r[2])):
        seen.setdefault(t, y)
    return list(seen), list(seen.values())


def labelled_sample(*args, **kwargs) -> tuple[list[str], list[int]]:
    """The bounded ``labelled_rows``, at the driver; equal texts come once."""
    rows = labelled_rows(*args, **kwargs)
    return once([tuple(r) for r in rows.collect()] if rows is not None else [])


def fitted_model(fit: Callable[[list[str], list[int]], Any], *args, **kwargs) -> Any:
    """What ``fit`` makes of the texts and labels of ``labelled_sample``."""
    rows = labelled_rows(*args, **kwargs)
    return fit([], []) if rows is None else fitted_on(rows, fit)


def fitted_on(rows: DataFrame, fit: Callable[[list[str], list[int]], Any]) -> Any:
    """What ``fit`` makes of some ``rows`` (_id, _y, _t): in one task, so that neither the texts nor the arrays of the fit
    take memory of the driver, which gets the model alone."""

    def run(batches):
        own = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*once(own)))], pa.binary())], names=["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(released(run), "model binary").collect()[0]["model"])
