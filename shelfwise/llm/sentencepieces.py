"""SentencePiece encoding and decoding by streaming Viterbi."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import Remembered, crc32, map_texts

SPACE = "▁"
#: Distinct stretches of text, and pairs of pieces, that a worker remembers in each of two generations (results do not change).
CACHE_STRETCHES, CACHE_PAIRS = 600_000, 400_000
#: Longer stretches aren't remembered.
LONG = 64


class Pieces:
    """A SentencePiece model with merges (piece scores give their order), encoded by Viterbi.

    The lattice has a node per position and an edge per piece. A path is allowed when each two neighbouring pieces
    stay apart in the model's own merging of just these two: merges of a whole text, restricted to two neighbouring
    pieces, are the merges of the two alone as long as none crosses their boundary, so exactly one path through the
    text is allowed everywhere, the model's encoding. Each position so keeps one surviving edge.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, spec = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.model_type != pb.TrainerSpec.BPE or not spec.byte_fallback:
            raise ValueError("only models with merges, byte fallback and no text normalisation are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        # piece types of the format: 1 normal, 4 user-defined, 5 unused, 6 byte
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte[b] = i
                self.surface.append(bytes([b]))
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"")
        self.longest = max(map(len, self.ids))
        self.pairs = Remembered(CACHE_PAIRS, lambda ab: self.merged(ab[0] + ab[1]) == [*ab])
        self.known = Remembered(CACHE_STRETCHES, lambda s: self.packed(self.stream(s)))
        # a piece that its own merging doesn't give can't be in an encoding
        self.usable = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.stretches = self.closed()

    def closed(self) -> re.Pattern:
        """A pattern that cuts a text only where no piece lies across: all paths converge there.

        Stretches are spaces with the letters, or with the other signs, after them, and single line ends. A word
        character inside a piece of signs counts as a sign; where pieces still lie across, a text is one stretch.
        """
        signs = ""
        for _ in range(3):
            letter = rf"[^\W\d_{signs}]"
            stretch = rf"{SPACE}*(?:{letter}+|(?:(?!{letter})[^{SPACE}\n])+)|{SPACE}+|\n"
            across = [p for p in self.ids if not re.fullmatch(stretch, p)]
            if not across:
                return re.compile(stretch)
            signs += "".join({c for p in across for c in p if c.isnumeric() and c not in signs})
        return re.compile(r"(?s).+")

    def merged(self, text: str) -> list[str]:
        """Merging of a short text: the neighbours that make the best-scored piece join first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """Pieces of a stream of characters, each as soon as all surviving paths share it.

        Kept are the surviving edges (start, piece) of the positions since the last commit. Any edge to come starts at
        one of the last ``longest`` positions; where the paths back from these meet, all before is committed. A stream that
        ends sooner than a window is committed at its end, where one path is left.
        """
        window = ""  # characters since the last commit
        edges: list[tuple[int, str] | None] = [None]  # by position in the window; None: no path ends here
        before = ""  # piece committed last
        usable, longest, pairs = self.usable, self.longest, self.pairs
        alive = [True]
        for ch in chars:
            window += ch
            i = len(window)
            edges.append(None)
            alive.append(False)
            for j in range(max(0, i - longest), i):
                if not alive[j]:
                    continue
                piece = window[j:i]
                if i - j > 1 and piece not in usable:
                    continue
                last = edges[j][1] if j else before
                if not last or pairs[last, piece]:
                    edges[i], alive[i] = (j, piece), True
                    break
            if i >= 4 * longest:
                heads = {p for p in range(i - longest + 1, i + 1) if alive[p]}
                while len(heads) > 1:
                    top = max(heads)
                    heads.remove(top)
                    heads.add(edges[top][0])
                meet = heads.pop()
                if meet > 0:
                    path = self.back(edges, meet)
                    yield from path
                    before = path[-1]
                    window = window[meet:]
                    edges = [None] + [e and (e[0] - meet, e[1]) for e in edges[meet + 1 :]]
                    # paths that do not run through the meeting point have died out
                    alive = [True] + [e is not None and e[0] >= 0 for e in edges[1:]]
                    edges = [e if a else None for e, a in zip(edges, alive)]
        if window:
            yield from self.back(edges, len(window))

    @staticmethod
    def back(edges: list, at: int) -> list[str]:
        out = []
        while at:
            at, piece = edges[at]
            out.append(piece)
        return out[::-1]

    def packed(self, pieces: Iterable[str]) -> bytes:
        """Ids of pieces as little-endian 32-bit numbers; a character without a piece becomes its bytes."""
        ids: list[int] = []
        for p in pieces:
            got = self.ids.get(p)
            ids += [got] if got is not None else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: stretches between which all paths meet, each by the streaming pass; short ones are remembered."""
        if not text:
            return np.zeros(0, "<u4")
        parts = self.stretches.findall(self.prefix + text.replace(" ", SPACE))
        known = self.known
        if max(map(len, parts)) <= LONG:
            return np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4")
        return np.frombuffer(b"".join(known[p] if len(p) <= LONG else self.packed(self.stream(p)) for p in parts), "<u4")

    def decode(self, ids) -> str:
        """Text of ids: surfaces joined, bytes put together, the space that encoding put first taken away.

        An id outside the model raises a ValueError."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if len(ids) and not (0 <= min(ids) and max(ids) < len(self.surface)):
            raise ValueError(f"ids must be 0 to {len(self.surface) - 1}")
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array) of every whole text. Null and empty texts have no ids; rows come back one for one."""

    def run(texts: list[str]) -> dict:
        m = pieces(model)
        return {"ids": [m.encode(t).astype(np.int32) for t in texts]}

    return map_texts(df, {id_col: "bigint"}, text_col, run, {"ids": "array<int>"})


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids. No or null ids give an empty text; ids outside the model fail."""
    import pyarrow as pa

    own = df.selectExpr(f"cast(`{id_col}` as bigint) as k", f"cast(`{ids_col}` as array<int>) as ids")

    def run(batches):
        m = pieces(model)
        for b in batches:
            texts = [m.decode([i for i in ids or [] if i is not None]) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string())], names=["k", "text"])

    return own.mapInArrow(run, "k bigint, text string").withColumnRenamed("k", id_col)


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 and exact (decoding gives the text).

    Null texts are empty. Rows come back one for one, repeated and null ids included; an empty table gives none.
    """

    def run(texts: list[str]) -> dict:
        m = pieces(model)
        out: dict = {"n_bytes": [], "n_ids": [], "ids_crc32": [], "decoded_sha256": [], "exact": []}
        for t in texts:
            ids = m.encode(t)
            back = m.decode(ids)
            out["n_bytes"].append(len(t.encode("utf-8", "surrogatepass")))
            out["n_ids"].append(len(ids))
            out["ids_crc32"].append(crc32(ids.tobytes()))
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            out["exact"].append(back == t)
        return out

    return map_texts(df, {id_col: "bigint"}, text_col, run, {"n_bytes": "bigint", "n_ids": "bigint", "ids_crc32": "bigint", "decoded_sha256": "string", "exact": "boolean"})
