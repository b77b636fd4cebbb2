"""Quality: Bradley-Terry pairwise ranking on text features, thresholded at a score quantile."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut_lineage, drop_written, map_texts, written_table
from .sample import all_labelled_rows, fitted_on

#: Classes of bytes between which transitions are counted.
CLASSES = ("space", "line end", "lower", "upper", "digit", "stop or comma", "other sign", "beyond ASCII")


def byte_classes() -> np.ndarray:
    out = np.full(256, 6, np.uint8)
    out[128:] = 7
    out[[9, 11, 12, 13, 32]] = 0
    out[10] = 1
    for lo, hi, c in (("a", "z", 2), ("A", "Z", 3), ("0", "9", 4)):
        out[ord(lo) : ord(hi) + 1] = c
    out[[ord(x) for x in ".,;:?'\"-()"]] = 5
    return out


CLASS = byte_classes()
SIGN_BYTES = [b for b in range(33, 127) if CLASS[b] in (5, 6)]
#: Rows of the rarer label that a block of a fit has at least, as expected.
RARE = 32
#: Scores that the driver may sort.
FEW_SCORES = 20_000
RUN = re.compile(rb"([^\sa-zA-Z0-9])\1{1,}")


def features(text: str) -> np.ndarray:
    """Shares of byte classes, their transitions and signs, and word, repetition and line figures of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    raw = np.frombuffer(data, np.uint8)
    kinds = CLASS[raw]
    k = len(CLASSES)
    own = np.bincount(kinds, minlength=k) / n
    pairs = np.bincount(kinds[:-1].astype(np.int64) * k + kinds[1:], minlength=k * k) / n if len(raw) > 1 else np.zeros(k * k)
    signs = np.bincount(raw, minlength=256)[SIGN_BYTES] / n
    words = data.split()
    m = max(1, len(words))
    counts = Counter(words)
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = data.split(b"\n")
    seen = Counter(lines)
    more = [
        np.log1p(len(words)) / 10,
        lens.mean() / 10,
        lens.std() / 10,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(w.isupper() for w in words) / m,
        sum(not w[-1:].isalnum() for w in words) / m,
        np.log1p(len(lines)) / 10,
        sum(c - 1 for c in seen.values()) / len(lines),
        sum(len(g.group()) for g in RUN.finditer(data)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(a == b for a, b in zip(lines, lines[1:])) / len(lines),
        float(len(words) == 0),
    ]
    # square roots lift small shares
    return np.concatenate([np.sqrt(own), np.sqrt(pairs), np.sqrt(signs), more])


@dataclass
class QualityModel:
    """score = logistic((w . standardised features - threshold) / scale): 0.5 at the chosen score quantile."""

    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray
    threshold: float
    scale: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return standardised(x, self.mean, self.std) @ self.weight

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        x = np.stack([features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.scale, -500, 500)))


def pair_weights(z: np.ndarray, t: np.ndarray, pairs: int = 60_000, steps: int = 400, penalty: float = 1e-4, seed: int = 11) -> np.ndarray:
    """Weights by logistic loss on differences of standardised features of (label 1, label 0) pairs.

    Every row is in a pair, and rows of a label are in equally many (but for one): each label's rows are dealt again and
    again in a random order of a fixed seed.
    """
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    pairs = max(pairs, len(good), len(bad))
    a, b = (np.concatenate([rng.permutation(own) for _ in range(-(-pairs // len(own)))])[:pairs] for own in (good, bad))
    w = np.zeros(z.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        s = z @ w
        # d loss / d score of each row, gathered over its pairs
        g = -1 / (1 + np.exp(np.clip(s[a] - s[b], -50, 50))) / pairs
        per_row = np.bincount(a, g, len(z)) - np.bincount(b, g, len(z))
        grad = z.T @ per_row + penalty * w
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def standardised(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / std, -8, 8)


def fit(texts: list[str], y: list[int]) -> QualityModel:
    """Weights of ``pair_weights``, threshold at a quantile of the training scores.

    The quantile is that at the share of label 0, so that as many rows lie above it as carry label 1. Without both labels
    every text scores as the label seen (1 where there is none: nothing is rejected).
    """
    if len(set(y)) < 2:
        return QualityModel(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 1.0, 0.0 if y and y[0] == 0 else 1.0)
    x, t = np.stack([features(s) for s in texts]), np.asarray(y)
    mean, std = x.mean(0), x.std(0) + 1e-3
    z = standardised(x, mean, std)
    w = pair_weights(z, t)
    s = z @ w
    return QualityModel(mean, std, w, float(np.quantile(s, (t == 0).mean())), float(max(s.std() / 4, 1e-6)))


def matrix(column: pa.Array) -> np.ndarray:
    """Features of rows from their bytes."""
    return np.stack([np.frombuffer(f, np.float32) for f in column.to_pylist()]).astype(np.float64)


def quantile(scores: DataFrame, share: float) -> float:
    """The quantile of the column s of a checkpointed ``scores``, between two neighbours as numpy takes it, of all rows.

    The lower neighbour is found by counts of ever narrower ranges of scores; only counts and at most ``FEW_SCORES``
    scores come to the driver.
    """
    n = scores.count()
    at = share * (n - 1)
    k = int(at)
    left, some = k, scores
    while True:
        c, low, high = some.agg(F.count("*"), F.min("s"), F.max("s")).first()
        if low == high:
            lower = low
            break
        if c <= FEW_SCORES:
            lower = sorted(r.s for r in some.collect())[left]
            break
        # rounded subtraction and division keep the order, so a range holds neighbours only
        binned = some.withColumn("bin", F.floor((F.col("s") - low) / F.lit((high - low) / 1024)))
        for own, c in sorted(map(tuple, binned.groupBy("bin").count().collect())):
            if left < c:
                break
            left -= c
        some = binned.where(F.col("bin") == own).select("s")
    upto, upper = scores.agg(F.count_if(F.col("s") <= lower), F.min(F.when(F.col("s") > lower, F.col("s")))).first()
    upper = lower if upto > k + 1 or upper is None else upper
    return float(lower + (upper - lower) * (at - k))


def fit_in_blocks(rows: DataFrame, block_rows: int) -> QualityModel:
    """The model of all ``rows`` (_id, _y, _t), however many: of equal texts the smallest id's label counts.

    Features are standardised by the moments of all rows. Rows are dealt by hashes of their texts into blocks of about
    ``block_rows``; a task fits the weights of each block, and the model has their mean, by rows. Rows of a label so rare
    that a block would have fewer than ``RARE`` of it go to several blocks, so that every row of either label is in some
    pair. Threshold and scale are those of the scores of all rows.
    """
    spark = rows.sparkSession
    made = map_texts(
        rows,
        {"_id": "bigint", "_y": "int"},
        "_t",
        lambda ts: {"k": [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in ts], "f": [features(t).astype(np.float32).tobytes() for t in ts]},
        {"k": "binary", "f": "binary"},
    )
    table = written_table(made.groupBy("k").agg(F.min(F.struct("_id", "_y", "f")).alias("r")).select("k", F.col("r._y").alias("y"), "r.f"), "features")

    def moments(batches):
        n, total = np.zeros(2), 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                n += np.bincount(b.column(0).to_numpy(), minlength=2)
                total = total + np.stack([x.sum(0), (x * x).sum(0)])
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    got = table.select("y", "f").mapInArrow(moments, "n binary, total binary").collect()
    bad, good = sum(np.frombuffer(r.n) for r in got).astype(int).tolist()
    if not bad or not good:
        drop_written(table)
        return fit([""], [int(good > 0)])
    n = bad + good
    mean, square = sum(np.frombuffer(r.total).reshape(2, -1) for r in got) / n
    std = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3
    blocks = -(-n // block_rows)
    rare = min(bad, good)
    times = min(blocks, -(-RARE * blocks // rare))
    first = F.xxhash64("k")
    turns = F.sequence(F.lit(0), F.when(F.col("y") == int(good < bad), F.lit(times - 1)).otherwise(F.lit(0)))
    dealt = table.select("k", "y", "f", first.alias("first"), F.explode(turns).alias("turn")) if times > 1 else table.select("k", "y", "f", first.alias("first"), F.lit(0).alias("turn"))
    dealt = dealt.withColumn("block", F.pmod(F.pmod("first", F.lit(blocks)) + F.col("turn") * F.lit(blocks // times), F.lit(blocks)).cast("int"))
    # more partitions than blocks, so that two of these seldom wait for each other
    dealt = dealt.select("block", "y", "k", "f").repartition(4 * blocks, "block").sortWithinPartitions("block", "k")

    def weights(batches):
        block, ys, xs = None, [], []

        def flush():
            t = np.concatenate(ys)
            if len(set(t.tolist())) < 2:
                return
            w = pair_weights(standardised(np.concatenate(xs), mean, std), t)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(t)], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["block", "n", "w"])

        for b in batches:
            own = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
            for i, j in zip(cuts, cuts[1:]):
                if own[i] != block and ys:
                    yield from flush()
                    ys, xs = [], []
                block = int(own[i])
                ys.append(b.column(1).slice(i, j - i).to_numpy())
                xs.append(matrix(b.column(3).slice(i, j - i)))
        if ys:
            yield from flush()

    found = sorted(map(tuple, dealt.mapInArrow(weights, "block int, n bigint, w binary").collect()))
    w = sum(c * np.frombuffer(x) for _, c, x in found) / sum(c for _, c, _ in found)
    model = QualityModel(mean, std, w, 0.0, 1.0)
    sent = spark.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.raw(matrix(b.column(0))))], names=["s"])

    scores = cut_lineage(table.select("f").mapInArrow(score, "s double"))
    drop_written(table)
    model.threshold = quantile(scores, bad / n)
    model.scale = float(max(scores.agg(F.stddev_pop("s")).first()[0] / 4, 1e-6))
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model fitted on every labelled row whose crc32(id as text) mod 3 is not 1.

    Up to ``max_rows`` rows of ``max_chars`` characters are fitted in one task, more of them in blocks of ``max_rows``.
    """
    rows = all_labelled_rows(docs, labels, "quality", 3, 1, id_col, text_col)
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("_t")), F.lit(0))).first()
    if not n:
        return fit([], [])
    return fitted_on(rows, fit) if n <= max_rows and chars <= max_chars else fit_in_blocks(rows, max_rows)


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 if score >= 0.5, else 0) of every whole text.

    A null or empty text has the features of no words. Rows come back one for one, repeated and null ids included;
    an empty table gives an empty result. Other columns come back only if named in ``keep`` (name -> type).
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict:
        s = sent.value.scores(texts)
        return {"score": s, "predicted": (s >= 0.5).astype(int)}

    out = map_texts(df, {id_col: "bigint"} | (keep or {}), text_col, run, {"score": "double", "predicted": "int"})
    return out.withColumn("held_out", crc_mod(F.col(id_col), 3) == 1)
