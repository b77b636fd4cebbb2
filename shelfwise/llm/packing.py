"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import math
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import crc32, cut_lineage, map_texts

#: Pieces that are partitioned together; the work per group is bounded by this whatever the input.
GROUP_PIECES = 512


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Indices of ``lengths`` in at most k near-equal subsets: Karmarkar-Karp, largest differencing first.

    A partial partition is its occupied subsets, largest sum first, the others being empty; sums are relative to the
    smallest of all k. The two partitions with the widest spread are merged with opposing order (largest sum with
    smallest) until one is left.
    """
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    fresh, size = len(lengths), itemgetter(0)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = len(a) + len(b) - k
        if meet > 0:
            # the smallest of one meet the smallest of the other, the rest meet empty subsets
            x, y = len(a) - meet, len(b) - meet
            both = [(m + n, g + h) for (m, g), (n, h) in zip(a[x:], reversed(b[y:]))]
            merged = a[:x] + both + b[:y]
        else:
            merged = a + b
        merged.sort(key=size, reverse=True)
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(n - low, g) for n, g in merged]
        fresh += 1
        heapq.heappush(heap, (-merged[0][0], fresh, merged))
    return [g for _, g in heap[0][2]] if heap else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their count starts at the least possible and rises until all fit."""
    if not lengths:
        return []
    k = max(1, math.ceil(sum(lengths) / capacity))
    while True:
        found = difference(lengths, k)
        if all(sum(lengths[i] for i in g) <= capacity for g in found):
            return found
        k += 1


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids: whole windows first, then what is left in thirds of a window.

    Finer pieces balance better: with whole remainders about 2.7 % of all windows is padding, with thirds 0.8 %.
    """
    left = n - n % capacity
    return [*range(0, left, capacity), *range(left, n, max(1, capacity // 3))]


def pieces(df: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each text's ids plus ``end_id``, cut by ``cuts``."""

    def run(texts: list[str]) -> dict:
        enc = encoder(vocab)
        out: dict = {"total": [], "starts": [], "crcs": []}
        for t in texts:
            ids = np.append(enc(t), end_id).astype("<u4")
            at = cuts(len(ids), capacity)
            out["total"].append(len(ids))
            out["starts"].append([*at, len(ids)])
            out["crcs"].append([crc32(ids[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(ids)])])
        return out

    rows = map_texts(df, {id_col: "bigint"}, text_col, run, {"total": "bigint", "starts": "array<bigint>", "crcs": "array<bigint>"})
    rows = rows.select(id_col, F.col("total").alias("doc_tokens"), "starts", F.posexplode("crcs").alias("nth", "ids_crc32"))
    start, end = F.get("starts", F.col("nth")), F.get("starts", F.col("nth") + 1)
    return rows.select(id_col, start.alias("start"), (end - start).alias("length"), "ids_crc32", "doc_tokens")


def pack(df: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece with sequence_id and offset; each sequence holds at most ``capacity`` ids, gapless from 0.

    Texts are tokenised once; only piece descriptions (a few numbers) are checkpointed and shuffled. Pieces of full
    length are sequences by themselves. The others are dealt into groups of about ``group_pieces`` by a hash of
    id and start plus a salt per row, so that repeated ids spread too, and every group is partitioned by
    Karmarkar-Karp differencing; its window count rises whenever a window exceeds the capacity.

    Null text: empty, one piece with the end id alone. Null ids are packed like others. Repeated rows are packed
    each by itself. An empty table gives no rows. A text of any length is cut, never truncated.
    """
    cut = cut_lineage(pieces(df, vocab, capacity, end_id, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    part = cut.where(F.col("length") < capacity)
    n = part.count()
    groups = max(1, math.ceil(n / group_pieces))
    full = cut.where(F.col("length") >= capacity).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if not n:
        return full
    dealt = part.withColumn("_group", F.pmod(F.xxhash64(id_col, "start", "_row"), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        lengths = pdf["length"].tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for w, members in enumerate(windows(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = w, at
                at += lengths[i]
        # even ids: group in the upper bits, window in the lower ones
        pdf["sequence_id"] = ((pdf["_group"].to_numpy(np.int64) << 24) + seq) * 2
        pdf["offset"] = off
        return pdf.drop(columns=["_row", "_group"])

    schema = f"`{id_col}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    # groups are costly and their rows few: spread them over tasks instead of by bytes
    tasks = min(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "_row", "_group").repartition(tasks, "_group")
    packed = dealt.groupBy("_group").applyInPandas(one, schema)
    return full.unionByName(packed)
