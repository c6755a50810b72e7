"""Byte-level BPE against the public library, by its parts and as a query."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import bytebpe, common

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
ODD = ["", " ", "\n\n  x", "don't I'LL we've 's''s", "ÉCOLE naïve — 日本語 \U0001f600‍\U0001f9d1 x", "a" * 5000, "ab" * 3000, " " * 4000 + "x", "é" * 2001, "0123456789" * 50, "é̖ x\x00y\x1c\x85z\xa0", "<|endoftext|> a", "\r\n\t 　 tail   "]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(PATH)


def whole(ranks):
    return bytebpe.PerfectHash(common.hash_words(list(ranks)), np.fromiter(ranks.values(), np.int32, len(ranks)))


def test_perfect_hash(ranks):
    """Each key has a slot of its own and no slot is empty; other keys are told from them."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 1000):
        keys = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        h = bytebpe.PerfectHash(keys, np.arange(len(keys), dtype=np.int32)) if n else None
        if h:
            assert h.get(keys).tolist() == list(range(len(keys))) and sorted(h.values.tolist()) == list(range(len(keys))) and (h.get(keys + np.uint64(1)) < 0).all()
    h = whole(ranks)
    assert h.n == len(ranks) and (h.get(common.hash_words(list(ranks))) == list(ranks.values())).all() and len(set(h.values.tolist())) == h.n


def test_merging(ranks, library):
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"abeinst h"), int(rng.integers(1, 40))).astype(np.uint8)) for _ in range(500)] + [rng.integers(0, 256, 30).astype(np.uint8).tobytes() for _ in range(200)]
    for w in words:
        assert b"".join(library.decode_single_token_bytes(i) for i in bytebpe.merged(w, ranks)) == w
        if w in ranks:
            assert bytebpe.merged(w, ranks) == [ranks[w]] or len(w) > 1
        want = plain_merge(w, ranks)
        assert bytebpe.merged(w, ranks) == want


def plain_merge(word, ranks):
    """The lowest pair, the leftmost of equals, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if best[0] == 1 << 30:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("table_words", [1 << 20, 40])
def test_codec(ranks, library, texts, table_words):
    all_texts = [*ODD, None, *texts.values()]
    codec = bytebpe.Codec(ranks, PATTERN, whole(ranks), table_words)
    at = 0
    for ids, n in codec.encode(pa.array(all_texts)):
        ends = np.cumsum(n)
        for k, (a, b) in enumerate(zip(ends - n, ends, strict=True)):
            text = all_texts[at + k] or ""
            assert ids[a:b].tolist() == library.encode_ordinary(text)
            assert codec.decode(ids[a:b]).tobytes() == text.encode()
        at += len(n)
    assert at == len(all_texts)
    with pytest.raises(ValueError, match="lacks"):
        codec.decode(np.array([60_000], np.uint32))


def test_tiers(ranks):
    """A token's text is answered by the perfect hash alone; only the rest are merged, each once."""
    codec = bytebpe.Codec(ranks, PATTERN, whole(ranks))
    known = next(t for t in sorted(ranks, key=ranks.get, reverse=True) if t.isalpha() and t.isascii())
    list(codec.encode(pa.array([known.decode()] * 50)))
    assert codec.words == 0
    list(codec.encode(pa.array(["qqxzv qqxzv"] * 50)))
    assert codec.words == 2


def test_query(spark, sf, texts, library):
    rows = bytebpe.op12_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_edges(spark, edges, nothing, library):
    more = edges.withColumnsRenamed({"node": "ids", "size": "a.b"})
    ids = bytebpe.encode(more, PATH, PATTERN)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in ids.collect()}
    assert ids.count() == edges.count() and got[0] == got[1] == [] and got[5] == library.encode_ordinary("ÉCOLE naïve — 日本語 \U0001f600 x") and len(got[6]) >= 30_000
    bodies = {r.doc_id: bytes(r.body).decode() for r in bytebpe.decode(ids, PATH).collect()}
    assert bodies == {r.doc_id: r.text or "" for r in edges.collect()}
    sums = {r.doc_id: r for r in bytebpe.round_trip(edges, PATH, PATTERN).collect()}
    assert sums[0].n_tokens == 0 and sums[0].ids_sha256 == sums[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    for f in (bytebpe.encode(nothing, PATH, PATTERN), bytebpe.decode(ids.limit(0), PATH), bytebpe.round_trip(nothing, PATH, PATTERN)):
        assert f.count() == 0


def test_vocabularies_that_lack_a_byte(tmp_path):
    (tmp_path / "v").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="lacks a byte"):
        bytebpe.read_ranks(str(tmp_path / "v"))
