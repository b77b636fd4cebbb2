"""Token counts, SentencePiece and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import bpe, packing, sentencepieces

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_counts_match_library(docs, odd, library):
    for df in (docs, odd):
        want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        got = bpe.token_counts(df, JSON).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_heap_merging_of_random_pieces(library):
    rng = random.Random(1)
    c = bpe.counter(JSON)
    for _ in range(300):
        t = "".join(rng.choice("aeinorst \n'12é") for _ in range(rng.randrange(1, 60)))
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_counts_do_not_depend_on_memory(docs, library, monkeypatch):
    c = bpe.BpeCounter(JSON)
    c.known.most = 3
    t = docs.first().text
    assert c.count(t) == c.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_encoder_gives_library_ids(docs, odd_texts, library):
    enc = bpe.encoder(JSON)
    for t in [r.text for r in docs.limit(40).collect()] + [t for _, t in odd_texts if t is not None]:
        assert enc(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts_of_empty_table(empty):
    assert bpe.token_counts(empty, JSON).count() == 0


def test_sentencepiece_ids_match_library(docs, odd_texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    m = sentencepieces.pieces(MODEL)
    rng = random.Random(2)
    more = ["".join(rng.choice("thequickbrown▁ é日") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    for t in [r.text for r in docs.limit(60).collect()] + [t for _, t in odd_texts if t is not None and len(t) < 100_000] + more:
        ids = m.encode(t)
        assert ids.tolist() == lib.encode(t), t[:80]
        if sentencepieces.SPACE not in t:
            assert m.decode(ids) == t


def test_streaming_commits_early():
    m = sentencepieces.pieces(MODEL)
    text = "internationalisation" * 200
    fed = 0

    def feed():
        nonlocal fed
        for ch in text:
            fed += 1
            yield ch

    first = next(m.stream(feed()))
    # the window holds a few times the longest piece, not the text
    assert fed <= 5 * m.longest and text.startswith(first)
    assert "".join(m.stream(text)) == text
    assert list(m.stream(text[:300])) == m.merged(text[:300])


def test_sentencepiece_ids_of_very_long_texts():
    import sentencepiece

    lib, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.pieces(MODEL)
    rng = random.Random(21)
    long = [
        "".join(rng.choice("abcdefghij") for _ in range(120_000)),
        " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 12))) for _ in range(30_000)),
        "internationalisation" * 6_000,
        " " * 110_000 + "end",
        "=" * 105_000,
    ]
    for t in long:
        ids = m.encode(t)
        assert len(t) > 100_000 and ids.tolist() == lib.encode(t) and m.decode(ids) == t


def test_ids_outside_the_model_are_refused():
    import pytest

    m = sentencepieces.pieces(MODEL)
    for ids in ([-1], [0, len(m.surface)], np.array([5, -3], np.int32)):
        with pytest.raises(ValueError):
            m.decode(ids)
    assert m.decode([]) == ""


def test_sentencepiece_frames(odd, empty):
    ids = sentencepieces.encode(odd, MODEL)
    back = {(r.doc_id, r.text) for r in sentencepieces.decode(ids, MODEL).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()}
    assert all(r.exact for r in sentencepieces.round_trip(odd, MODEL).collect())
    assert sentencepieces.round_trip(empty, MODEL).count() == sentencepieces.decode(sentencepieces.encode(empty, MODEL), MODEL).count() == 0


def check_packing(df, library, capacity=2048):
    ids = {}
    for n, r in enumerate(df.select("doc_id", "text").collect()):
        ids.setdefault(r.doc_id, []).append(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))
    rows = packing.pack(df, JSON, capacity).collect()
    sequences = {}
    for r in rows:
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(len(x) for own in ids.values() for x in own)
    assert sum(r.length for r in rows) == total
    return total, len(sequences)


def test_packing(docs, odd, empty, library):
    total, n = check_packing(docs, library)
    assert total / (n * 2048) > 0.93
    check_packing(odd, library)
    assert packing.pack(empty, JSON).count() == 0


def test_texts_that_the_ranked_encoder_gives_up_on(spark, library):
    from shelfwise.llm.bpe import encoder

    for t in (" " * 1_500_000, "\n" * 400_000 + "x", "a" * 300_000):
        assert encoder(JSON)(t).tolist() == library.encode(t, add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame([(1, " " * 1_500_000), (2, "short")], "doc_id long, text string"), JSON).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1_500_001


def test_cuts_cover_every_id():
    for n in (1, 681, 682, 683, 2047, 2048, 2049, 10_000):
        at = packing.cuts(n, 2048)
        ends = [*at[1:], n]
        assert at[0] == 0 and all(0 < b - a <= 2048 for a, b in zip(at, ends)) and sum(b - a == 2048 for a, b in zip(at, ends)) == n // 2048


def test_differencing_is_near_equal():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 2048) for _ in range(200)]
    groups = packing.difference(lengths, 10)
    assert sorted(i for g in groups for i in g) == list(range(200))
    sums = [sum(lengths[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 5
    assert packing.difference([8, 7, 6, 5, 4], 2) and packing.windows([], 10) == []
    # capacity exceeded: the window count rises
    assert len(packing.windows([6, 6, 6], 10)) == 3
