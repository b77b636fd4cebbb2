"""Toxicity: character n-gram bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, crc_mod, map_texts
from .sample import fitted_model

#: Fixed sizes of the model: buckets of subwords, width of their vectors, n-gram lengths, words averaged at a time.
BUCKETS, WIDTH, GRAMS, WINDOW = 1 << 17, 12, (3, 4, 5), 32
#: Texts that a subword must occur in to be learned.
MIN_TEXTS = 5
#: Words of the training texts that are taken at a time.
RUN_WORDS = 200_000
#: Characters of new words whose values are made together (some 80 bytes each); a longer word is taken alone.
NEW_CHARS = 1 << 17
#: Words whose values a worker remembers in each of two generations (results do not change).
CACHE_WORDS = 200_000


def subwords(word: str) -> list[int]:
    """Buckets of the word in angle brackets and of its character n-grams."""
    w = f"<{word}>"
    crc = zlib.crc32
    out = [crc(w.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in GRAMS:
        out += [crc(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(w) - n + 1)]
    return out


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


CRC_TABLE = crc_table()


def word_values(words: list[str], value: np.ndarray) -> np.ndarray:
    """The mean of ``value`` over the ``subwords`` of each word, made of all words at once.

    The checksum of an n-gram continues that of the shorter one at the same character, so each character is taken in once
    a length. Sums are of double precision and of one word's numbers alone, whatever words come with it.
    """
    marked = [f"<{w}>" for w in words]
    data = np.frombuffer("".join(marked).encode("utf-8", "surrogatepass"), np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(heads, append=len(data))
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    start, chars = np.cumsum(lens) - lens, len(heads)
    # characters from each to the end of its word
    left = np.repeat(start + lens, lens) - np.arange(chars)
    crc = np.full(chars, 0xFFFFFFFF, np.uint32)
    adds = np.zeros(chars)
    for n in range(1, max(GRAMS) + 1):
        # the n-th character from each; a gram that would leave its word doesn't count
        reach = chars - n + 1
        if reach < 1:
            break
        state, at, bytes_ = crc[:reach], heads[n - 1 :], width[n - 1 :]
        state = CRC_TABLE[(state ^ data[at]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        for j in range(1, int(bytes_.max())):
            more = np.flatnonzero(bytes_ > j)
            own = state[more]
            state[more] = CRC_TABLE[(own ^ data[at[more] + j]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
        crc[:reach] = state
        if n in GRAMS:
            adds[:reach] += np.where(left[:reach] >= n, value[(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)], 0.0)
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in marked), np.int64, len(marked))
    count = 1 + sum(np.maximum(lens - n + 1, 0) for n in GRAMS)
    return (value[whole] + np.add.reduceat(adds, start)) / count


def window_means(values: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Mean of every run of ``width`` values, or of all where there are fewer; one zero for none."""
    n = len(values)
    if n <= width:
        return np.array([values.mean() if n else 0.0])
    c = np.concatenate(([0.0], np.cumsum(values)))
    return (c[width:] - c[:-width]) / width


def best_windows(values: np.ndarray, lens: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie one after another: the highest mean of ``span`` values in a row, and where it starts (the first of equals)."""
    c = np.concatenate(([0.0], np.cumsum(values)))
    start = np.cumsum(lens) - lens
    if (span == lens).all():
        return (c[start + lens] - c[start]) / lens, start
    # a window that would leave its text doesn't count
    place = np.arange(len(values))
    end = place + np.repeat(span, lens)
    means = np.where(end <= np.repeat(start + lens, lens), c[np.minimum(end, len(values))] - c[:-1], -np.inf) / np.repeat(span, lens)
    top = np.maximum.reduceat(means, start)
    first = np.where(means == np.repeat(top, lens), place, len(values))
    return top, np.minimum.reduceat(first, start)


@dataclass
class ToxicityModel:
    """In a linear softmax over averaged vectors each subword adds a fixed amount to the logit; ``value`` holds it.

    The logit of a text is the highest of its windows' logits, so a passage of abuse inside a long clean text counts
    as much as the passage alone.
    """

    value: np.ndarray
    bias: float
    known: Remembered | None = field(default=None, repr=False)

    def __post_init__(self):
        self.known = Remembered(CACHE_WORDS, self.word)

    def word(self, w: str) -> float:
        return float(word_values([w], self.value)[0])

    def learn(self, words: set[str]) -> None:
        """Remembers the values of those ``words`` that aren't remembered yet."""
        some, held = [], 0
        for w in [w for w in words if w not in self.known and w not in self.known.old] + [None]:
            n = 0 if w is None else len(w)
            if some and (w is None or held + n > NEW_CHARS):
                for x, v in zip(some, word_values(some, self.value).tolist()):
                    self.known.put(x, v)
                some, held = [], 0
            some.append(w)
            held += n

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of every text the logit of its highest window."""
        out = np.empty(len(texts))
        for s in range(0, len(texts), 256):
            own = [t.lower().split() for t in texts[s : s + 256]]
            self.learn(set(chain.from_iterable(own)))
            for i, words in enumerate(own, s):
                out[i] = window_means(np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))).max()
        return out + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))

    def logit(self, text: str) -> float:
        return float(self.logits([text])[0])

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])

    def __reduce__(self):
        return ToxicityModel, (self.value, self.bias)


def fit(texts: list[str], y: list[int], steps: int = 120, warm: int = 40, rate: float = 0.05, decay: float = 3e-5, seed: int = 7) -> ToxicityModel:
    """Subword vectors and softmax weights learned jointly by Adam on the loss of each text's highest window.

    For the first ``warm`` steps the loss is that of the average over all words of a text. Subwords found in fewer
    than ``MIN_TEXTS`` texts are not learned, and the weights decay.

    Without both labels among the rows the model gives every text the label seen (label 0 where there is none).
    """
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 20.0 if y and y[0] == 1 else -20.0)
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    # flat arrays throughout: lists of numbers would take several times the memory
    ids, lens, grams, sizes = array("i"), array("i"), array("i"), array("i")
    for t in texts:
        own = t.lower().split() or [""]
        lens.append(len(own))
        for w in own:
            if w not in vocab:
                vocab[w] = len(vocab)
                g = subwords(w)
                grams.extend(g)
                sizes.append(len(g))
            ids.append(vocab[w])
    del vocab
    tokens, lens, flat, sizes = (np.frombuffer(a, np.int32) for a in (ids, lens, grams, sizes))
    heads = np.cumsum(sizes) - sizes
    at = np.concatenate(([0], np.cumsum(lens)))
    # in how many texts each bucket occurs: the words of each text once, then their buckets once
    freq = np.zeros(BUCKETS, np.int32)
    for a, b in zip(at, at[1:]):
        u = np.unique(tokens[a:b])
        n = sizes[u]
        freq[np.unique(flat[np.repeat(heads[u] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    # a bucket too rare shares one slot that always adds nothing
    used = np.concatenate(([-1], np.flatnonzero(freq >= MIN_TEXTS)))
    slot = np.zeros(BUCKETS, np.int32)
    slot[used[1:]] = np.arange(1, len(used))
    flat = slot[flat]
    width = np.minimum(lens, WINDOW)
    turn = at[:-1] // RUN_WORDS
    heads_of = np.concatenate((np.flatnonzero(np.diff(turn, prepend=-1)), [len(lens)]))
    runs = list(zip(heads_of.tolist(), heads_of[1:].tolist()))
    target = np.asarray(y, np.float64)
    weight = np.where(target == 1, 0.5 / target.sum(), 0.5 / (1 - target).sum())
    # two classes: the softmax depends on the difference of their weight vectors alone
    vec = rng.normal(0, 0.3, (len(used), WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.3, WIDTH).astype(np.float32)
    bias = 0.0
    state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in (("vec", vec), ("out", out))}
    state["bias"] = (np.zeros(1), np.zeros(1))

    def adam(name: str, p, g, step: int):
        m, v = state[name]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        return p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    for step in range(1, steps + 1):
        add = vec @ out
        add[0] = 0
        word = np.add.reduceat(add[flat], heads) / sizes
        per_word = np.zeros(len(sizes))
        span = lens if step <= warm else width
        top = np.empty(len(lens))
        begin = np.empty(len(lens), np.int64)
        # a bounded run of texts at a time: no array as long as all windows of the sample
        for d, e in runs:
            top[d:e], best = best_windows(word[tokens[at[d] : at[e]]], lens[d:e], span[d:e])
            begin[d:e] = at[d] + best
        p = 1 / (1 + np.exp(-np.clip(top + bias, -50, 50)))
        err = (p - target) * weight
        # back through the windows to words, then to subwords
        for s in range(0, len(lens), 1024):
            n, b, e = span[s : s + 1024], begin[s : s + 1024], (err / span)[s : s + 1024]
            places = np.repeat(b - np.cumsum(n) + n, n) + np.arange(n.sum())
            per_word += np.bincount(tokens[places], np.repeat(e, n), minlength=len(sizes))
        per_gram = np.bincount(flat, np.repeat(per_word / sizes, sizes), minlength=len(used)).astype(np.float32)
        per_gram[0] = 0
        g_out = vec.T @ per_gram + decay * out
        vec = adam("vec", vec, per_gram[:, None] * out + decay * vec, step).astype(np.float32)
        out = adam("out", out, g_out, step).astype(np.float32)
        bias = float(adam("bias", np.array([bias]), np.array([err.sum()]), step)[0])
    value = np.zeros(BUCKETS, np.float32)
    # buckets not trained on add nothing
    value[used[1:]] = (vec @ out)[1:]
    return ToxicityModel(value, bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model fitted on at most ``max_rows`` labelled rows whose crc32(id as text) mod 5 is not 0."""
    return fitted_model(fit, docs, labels, "toxic", 5, 0, max_rows, max_chars, id_col, text_col)


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 if score >= 0.5, else 0) of every whole text.

    A null or empty text has the score of no words. Rows come back one for one, repeated and null ids included;
    an empty table gives an empty result. Other columns come back only if named in ``keep`` (name -> type).
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict:
        s = sent.value.scores(texts)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    out = map_texts(df, {id_col: "bigint"} | (keep or {}), text_col, run, {"score": "double", "predicted": "int"})
    return out.withColumn("held_out", crc_mod(F.col(id_col), 5) == 0)
