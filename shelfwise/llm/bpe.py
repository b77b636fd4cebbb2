"""Token counts by heap-and-linked-list byte-pair merging, and fast ids for the same vocabulary."""

from __future__ import annotations

import functools
import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, map_texts

#: Distinct pieces whose counts a worker remembers in each of two generations (results do not change).
CACHE_PIECES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeCounter:
    """Counts tokens of a byte-level BPE file: initial symbols minus merges, no ids are made.

    A special string inside a text counts as one token and splits the text, as the library does by default.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        to_byte = byte_alphabet()
        vocab = {bytes(to_byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in to_byte for c in k)}
        self.first = [vocab[bytes([b])] for b in range(256)]
        self.rank: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            x, y = (bytes(to_byte[c] for c in part) for part in (m if isinstance(m, list) else m.split(" ")))
            self.rank.setdefault(vocab[x] << 32 | vocab[y], (r, vocab[x + y]))
        self.vocab = vocab
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # fixed pattern of byte-level pre-tokenizers
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.known = Remembered(CACHE_PIECES, self.piece)

    def merges(self, data: bytes) -> int:
        """Merges done on one piece: the lowest-rank adjacent pair is popped until none is left.

        Symbols form a doubly linked list over positions; a popped pair is stale when either symbol has changed
        since, which its recorded pair key shows.
        """
        n, rank = len(data), self.rank
        sym = [self.first[b] for b in data]
        heap = []
        for i in range(n - 1):
            got = rank.get(sym[i] << 32 | sym[i + 1])
            if got:
                heap.append((got[0], i, got[1]))
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            r, i, new = pop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] << 32 | sym[j], (-1,))[0] != r:
                continue
            sym[i], sym[j] = new, -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                got = rank.get(new << 32 | sym[k])
                if got:
                    push(heap, (got[0], i, got[1]))
            p = before[i]
            if p >= 0:
                got = rank.get(sym[p] << 32 | new)
                if got:
                    push(heap, (got[0], p, got[1]))
        return done

    def piece(self, p: str) -> int:
        data = p.encode("utf-8", "surrogatepass")
        return len(data) - self.merges(data)

    def plain(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.pattern.findall(text)))

    def count(self, text: str) -> int:
        if self.split is None or not any(s in text for s in self.specials):
            return self.plain(text)
        return sum(map(self.plain, self.split.split(text))) + len(self.split.findall(text))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> BpeCounter:
    return BpeCounter(path)


def token_counts(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text is empty: 0 bytes, 0 tokens. Rows come back one for one, repeated ids and null ids included;
    an empty table gives an empty result; other columns are dropped. ``vocab`` is a file that every worker can open.
    """

    def run(texts: list[str]) -> dict:
        c = counter(vocab)
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [c.count(t) for t in texts]}

    out = map_texts(df, {id_col: "bigint"}, text_col, run, {"n_bytes": "bigint", "n_tokens": "bigint"})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> numpy ids, as the tokenizers library gives them without added begin or end tokens.

    Byte-level files whose ids follow the order of their merges go through the faster ranked encoder, which gives the
    same ids; whatever text it fails on (its pattern matcher gives up on very long runs of white space), and any other
    file, goes through the library itself.
    """
    import numpy as np
    from tokenizers import Tokenizer

    c = counter(path)
    library = Tokenizer.from_file(path)

    def by_library(text: str):
        return np.asarray(library.encode(text, add_special_tokens=False).ids, np.uint32)

    ids = sorted(c.vocab.items(), key=lambda kv: kv[1])
    ordered = [i for _, (_, i) in sorted(c.rank.items(), key=lambda kv: kv[1][0])]
    if ordered != sorted(ordered) or len(ids) != 256 + len(c.rank):
        return by_library
    import tiktoken

    ranked = tiktoken.Encoding("byte_level", pat_str=c.pattern.pattern, mergeable_ranks=dict(ids), special_tokens=c.specials)
    allowed = set(c.specials)

    def encode(text: str):
        try:
            return ranked.encode_to_numpy(text, allowed_special=allowed)
        except Exception:  # any failure of the shortcut; the library decides
            return by_library(text)

    return encode
