"""Byte-level byte-pair encoding and decoding by a two-tier lookup.

A text is split by the vocabulary's pattern. A pre-token that is a token itself is found in a minimal perfect hash of the vocabulary: one slot for each token, no empty ones. Any other is
merged pair by pair, the lowest rank first and of equal ranks the leftmost: its bytes are a linked list, and a heap holds the pairs that may be merged, so a pre-token of n
bytes takes n log n steps. A worker keeps the ids of what it has merged in a table of bounded size.

Pre-tokens are compared by 64-bit hashes. A null or empty text has no ids, and decodes to nothing; rows are encoded each on its own, repeated or not. An id that the vocabulary lacks is an error, and
so is a vocabulary that lacks one of the 256 bytes. No documents: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import vectors

#: Merged pre-tokens that a worker's table holds before it starts afresh.
TABLE_WORDS = 1 << 20
#: Keys of a bucket of the perfect hash, on average.
BUCKET_KEYS = 4
_U = np.uint64


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, of a file of lines: a token in base64, its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    return ranks


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by buckets and displacements: a key's bucket tells by how much its hash is displaced, and n keys fill n slots."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // BUCKET_KEYS)
        #: Not negative: the displacement; else the slot itself, -1 - slot, of a bucket's only key.
        self.moves = np.zeros(self.buckets, np.int64)
        self.keys, self.values = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        free = np.ones(n, bool)
        left: list[int] = []
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] == 0:
                break
            own = order[starts[b] : starts[b] + sizes[b]]
            if sizes[b] == 1:
                left.append(b)
                continue
            at = 0
            while True:
                tries = np.arange(at, at + 64)
                slots = self._slot(keys[own][None, :], tries[:, None])
                rows = np.sort(slots, axis=1)
                good = np.flatnonzero(free[slots].all(axis=1) & (rows[:, 1:] != rows[:, :-1]).all(axis=1))
                if len(good):
                    break
                at += 64
            self.moves[b] = tries[good[0]]
            self._fill(slots[good[0]], own, keys, values, free)
        for b, slot in zip(left, np.flatnonzero(free).tolist(), strict=True):
            self.moves[b] = -1 - slot
            self._fill(np.array([slot]), order[starts[b] : starts[b] + 1], keys, values, free)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> _U(33)) % _U(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, moves: np.ndarray) -> np.ndarray:
        return (C.splitmix(keys + (moves.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)) % _U(self.n)).astype(np.int64)

    def _fill(self, slots, own, keys, values, free) -> None:
        self.keys[slots], self.values[slots], free[slots] = keys[own], values[own], False

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value, or -1."""
        move = self.moves[self._bucket(keys)]
        slot = np.where(move < 0, -1 - move, self._slot(keys, np.maximum(move, 0)))
        return np.where(self.keys[slot] == keys, self.values[slot], np.int32(-1))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token, by merging its bytes."""
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(word[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)  # the last part has none after it
    heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFFFF
        if pair[i] != top >> 40:
            continue  # one of its parts has been merged since
        j = after[i]
        end = after[i] = after[j]
        pair[j] = pair[i] = -1
        if end < n:
            before[end] = i
            r = get(word[i : after[end]], -1)
            if r >= 0:
                pair[i] = r
                heappush(heap, r << 40 | i)
        p = before[i]
        if p >= 0:
            r = pair[p] = get(word[p:end], -1)
            if r >= 0:
                heappush(heap, r << 40 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes columns of texts and ids; made once in a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash, table_words: int = TABLE_WORDS):
        import regex

        self.ranks, self.whole, self.table_words = ranks, whole, table_words
        self.split = regex.compile(pattern).findall
        tokens = sorted(ranks, key=ranks.get)
        self.size = np.full(ranks[tokens[-1]] + 1, -1, np.int64)
        self.size[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self._fresh()

    def _fresh(self) -> None:
        self.table = C.HashTable(16)
        self.arena, self.first, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.words = 0

    def _merge(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Puts the ids of new pre-tokens into the worker's table."""
        ids = [merged(w, self.ranks) for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        n, m = self.words + len(ids), self.used + int(counts.sum())
        for name, need in (("arena", m), ("first", n), ("count", n)):
            a = getattr(self, name)
            if need > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(need - len(a), len(a)), a.dtype)]))
        self.arena[self.used : m] = np.fromiter((i for x in ids for i in x), np.int32, m - self.used)
        self.count[self.words : n], self.first[self.words : n] = counts, self.used + np.cumsum(counts) - counts
        self.table.add(hashes, np.arange(self.words, n, dtype=np.int32))
        self.words, self.used = n, m

    def encode(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk of texts: all ids in a row, and how many each text has."""
        for lo, hi, data, offs in C.chunks(col):
            pieces = [self.split(t) if t else () for t in col.slice(lo, hi - lo).to_pylist()]
            per = np.fromiter(map(len, pieces), np.int64, len(pieces))
            letters = np.fromiter((len(p) for x in pieces for p in x), np.int64, int(per.sum()))
            places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character starts
            ends = np.cumsum(letters)
            if len(places) - 1 != (ends[-1] if len(ends) else 0):
                raise ValueError("the pattern leaves out a part of a text")
            s, e = places[ends - letters], places[ends]
            h = C.word_hashes(data, s, e)
            whole = self.whole.get(h)
            rest = np.flatnonzero(whole < 0)
            row = self.table.get(h[rest])
            new = np.flatnonzero(row < 0)
            if len(new):
                if self.words + len(new) > self.table_words:
                    self._fresh()
                    new = np.arange(len(rest))
                hs, at = np.unique(h[rest[new]], return_index=True)
                raw, at = data.tobytes(), rest[new[at]]
                self._merge(hs, [raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
                row[new] = self.table.get(h[rest[new]])
            n = np.ones(len(h), np.int64)
            n[rest] = self.count[row]
            upto = np.concatenate([[0], np.cumsum(n)])
            ids = np.empty(int(upto[-1]), np.uint32)
            ids[upto[:-1][whole >= 0]] = whole[whole >= 0]
            m = n[rest]
            steps = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            ids[np.repeat(upto[rest], m) + steps] = self.arena[np.repeat(self.first[row], m) + steps]
            docs = np.concatenate([[0], np.cumsum(per)])
            yield ids, upto[docs[1:]] - upto[docs[:-1]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids in a row."""
        if len(ids) and (ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id that the vocabulary lacks")
        n = self.size[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


_codecs: dict[str, Codec] = {}


class Vocabulary:
    """A rank file and its perfect hash, as broadcast; a worker makes one codec of it."""

    def __init__(self, spark, path: str, pattern: str):
        ranks = read_ranks(path)
        tokens = list(ranks)
        self.pattern, self.name = pattern, uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast((ranks, PerfectHash(C.hash_words(tokens), np.fromiter(ranks.values(), np.int32, len(ranks)))))  # as large as the file

    def __getstate__(self):
        return {"pattern": self.pattern, "name": self.name, "sent": self.sent}

    def codec(self) -> Codec:
        if self.name not in _codecs:
            _codecs.clear()
            ranks, whole = self.sent.value
            _codecs[self.name] = Codec(ranks, self.pattern, whole)
        return _codecs[self.name]


def _slim(df: DataFrame, key: str, col: str, out: list[str]) -> tuple[DataFrame, T.StructType]:
    slim = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{col}`"))
    return slim, T.StructType([slim.schema[0], *T._parse_datatype_string(", ".join(out)).fields])


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids: a text's ids as little-endian unsigned 32-bit integers."""
    slim, schema = _slim(docs, key, text, ["ids binary"])
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            at = 0
            for ids, n in codec.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), vectors.packed(ids, n).cast(pa.binary())], names=schema.names)
                at += len(n)

    return C.map_arrow(slim, run, schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and body: the bytes of each row's ids. Ids need not end where a character does, so they are no text as such."""
    slim, schema = _slim(encoded, key, ids, ["body binary"])
    vocabulary = Vocabulary(encoded.sparkSession, path, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for lo, hi, data, offs in C.chunks(batch.column(1)):
                own = np.frombuffer(data.tobytes(), np.uint32)
                sizes = np.concatenate([[0], np.cumsum(codec.size[own])])
                body = codec.decode(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), vectors.packed(body, np.diff(sizes[offs // 4])).cast(pa.binary())], names=schema.names)

    return C.map_arrow(slim, run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded, in one pass; ids and bodies go no further than their task."""
    slim, schema = _slim(docs, key, text, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"])
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = vocabulary.codec(), hashlib.sha256
        for batch in batches:
            at = 0
            for ids, n in codec.encode(batch.column(1)):
                to = np.concatenate([[0], np.cumsum(n)])
                upto = np.concatenate([[0], np.cumsum(codec.size[ids])])[to].tolist()
                raw, body, to = ids.astype("<u4").tobytes(), codec.decode(ids).tobytes(), to.tolist()
                digests = [[sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(to[:-1], to[1:], strict=True)], [sha(body[a:b]).hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n), *map(pa.array, digests)], names=schema.names)
                at += len(n)

    return C.map_arrow(slim, run, schema)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(C.table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
