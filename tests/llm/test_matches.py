"""The matches of op10: every place with words before it asks all training texts."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.llm import lm, mixer


def texts(seed, n=60, words=9):
    r = np.random.default_rng(seed)
    return [r.integers(0, words, r.integers(1, 40)).astype(np.int32) for _ in range(n)], r.random(n) < 0.7


def brute(all_ids, learn):
    seen = defaultdict(Counter)
    for ids, on in zip(all_ids, learn, strict=True):
        for p in range(lm.WORDS, len(ids)):
            seen[tuple(ids[p - lm.WORDS : p])][int(ids[p])] += int(on)
    out = []
    for ids, on in zip(all_ids, learn, strict=True):
        for p in range(len(ids)):
            rest = Counter(seen[tuple(ids[p - lm.WORDS : p])]) if p >= lm.WORDS else Counter()
            rest[int(ids[p])] -= int(on)
            out.append(min((-n, w) for w, n in rest.items())[1] if max(rest.values()) > 0 else mixer.NONE)
    return out


@pytest.mark.parametrize("words", [2, 4, 30])
def test_every_place_is_predicted_by_all_texts(spark, words):
    """As a count over all places, whatever the buckets, parts and ranges."""
    all_ids, learn = texts(words, words=words)
    rows = [(k % 3, k, k, bool(on), bytearray(mixer.packed(ids).tobytes())) for k, (ids, on) in enumerate(zip(all_ids, learn, strict=True))]
    df = spark.createDataFrame(rows, "bucket int, h long, uid long, learn boolean, ids binary")
    told = defaultdict(dict)
    for r in lm.matched(lm.ordered(df, 3, "h", "uid"), 3, 200).collect():
        told[r.bucket, r.part][r.place] = lm._unplaned(r.data, "<u4").astype(np.int32)
    order = sorted(range(len(rows)), key=lambda k: rows[k][:3])
    got = {}
    for some in lm._parts_of(((rows[k][0], all_ids[k], rows[k][3], k) for k in order), lambda bucket, uid, _: (bucket, uid) in told):
        ids, first = lm._laid(some)
        flat = lm._Asked(ids, first, np.array([r[2] for r in some]), 1).predicted(len(ids), told[some[0][0], some[0][3]])
        got |= {r[3]: flat[a:b].tolist() for r, a, b in zip(some, first[:-1], first[1:], strict=True)}
    assert [x for k in range(len(rows)) for x in got[k]] == brute(all_ids, learn)


def test_contexts_of_all_places():
    ids = np.arange(300, dtype=np.int32)
    h, place = lm._contexts(ids, np.array([0, 3, 100, 300]))
    assert place.tolist() == [*range(7, 100), *range(104, 300)] and len(set(h.tolist())) == len(place)


def test_words_of_a_context_are_together():
    """Also where their hashes share the 16 bits that contexts leave room for."""
    r = np.random.default_rng(5)
    context, word = r.integers(0, 3, 9000).astype(np.uint64), r.integers(0, 4000, 9000).astype(np.uint64)
    order, c, w = lm._in_order(context, word)
    assert (c == context[order]).all() and (w == word[order]).all() and (np.diff(c.astype(int)) >= 0).all()
    assert 1 + int(((c[1:] != c[:-1]) | (w[1:] != w[:-1])).sum()) == len(set(zip(c.tolist(), w.tolist(), strict=True)))


def test_counts_take_the_bytes_they_need():
    for top in (0, 255, 256, 1 << 31, 1 << 40):
        table = np.array([0, 1, top], np.int64)
        assert lm._unpacked(lm._packed(table)).tolist() == table.tolist()


def test_common_bits_are_computed_once(monkeypatch):
    """Of words that are predicted from the same; scores are those of every word by itself."""
    r = np.random.default_rng(6)
    n = 300
    m = mixer.Model(mixer.Codes(np.append(np.sort(r.integers(2, 900, n))[::-1], [30, 50])), r.integers(0, 1 << 16, (2, 1 << 10)).astype(np.uint16)).ready()
    m.hit, m.seen = r.random((2, *m.hit.shape)).cumsum(axis=0) * 9
    ids = r.integers(0, n + 2, 5000).astype(np.int32)
    ids[::2] %= 3
    ids = np.where(ids == m.escape, ids + mixer.RARE, ids).astype(np.int32)
    guess = np.where(r.random(5000) < 0.5, ids, r.integers(0, n, 5000)).astype(np.int32)
    guess[r.random(5000) < 0.5] = mixer.NONE
    first, learned = np.arange(0, 5000, 50), r.integers(0, 2, 5000).astype(np.int8)
    costs = np.full(int((ids >= mixer.RARE).sum()), -3.0, np.float32)
    bits, inputs = [], m.inputs
    monkeypatch.setattr(m, "inputs", lambda *a: (bits.append(int(sum(inputs(*a)[3]))), inputs(*a))[1])
    alone = m.log10(mixer.Tokens(ids, first, guess, learned, m.escape), costs)
    monkeypatch.setattr(mixer, "BLOCK", 700)
    together = m.log10(mixer.Tokens(ids, first, guess, learned, m.escape, m.codes), costs)
    assert (alone == together).all() and sum(bits[1:]) < 0.95 * bits[0]
