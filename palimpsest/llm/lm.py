"""Language-model scores by logistic context mixing over the bits of a text's words, beside a unigram base score.

The model reads words, lower-cased, and an end. Each bit of a word's code is predicted by counters found by hashes of its contexts and by a match with the rest of the corpus; their
log-odds are combined by weights that a gate chooses, and the result is refined by a table of what came of such predictions (``mixer``). Bits add up to a proper probability of the text.

1. Words are counted in each task and summed by a shuffle; the ``COMMON`` most frequent have codes, others are an escape and letters. Texts are written as numbers of words.
2. Counters of all training texts are summed in tables of fixed size: in each task first, then by ranges of slots, so that no row is shuffled for a word or bit.
3. Matches take memory as the corpus does, so they are shuffled, not broadcast. Every place with four words before it in its text asks for the word that comes after these most often in the training texts, its own
   sighting taken off. A part of a bucket asks once for each context and word, in arrays by ranges of the contexts' hashes (48 bits); so a hot context is asked for once in each part, and no row is made for a token.
4. All training texts, dealt in buckets by a hash of key and words, teach the weights: a learner for each bucket, whose curvature weighs it when all are averaged, and tables summed over all. What is
   added are whole numbers, so that neither the order nor the number of tasks changes a score.
5. All texts are scored by that model, which stays as it is.

A training text is learned and scored as if each of its sightings was taken off: counters lose one, and a text doesn't match itself. So a text that occurs nowhere else scores alike whether it was learned from or not, and one that occurs twice
is told from it.

Base scores need every word's count: common words are broadcast, the rest are looked up by a join on the word's hash, in which no key is frequent. Words are known by 64-bit hashes, rare ones within a text and its matches by 30 bits of it.

A null or empty text is its end alone. Null keys count as training. Repeated rows are scored, and learned, each on its own. No training: every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import mixer as M

COMMON, END = 1 << 17, 0
#: Words of a match's context; tokens of texts whose contexts are asked for at once.
WORDS, PART_TOKENS = 4, 1 << 19
#: Tokens of a bucket; slots of a table for each token, and the most and least bits of its size.
BUCKET, SLOTS, LEAST_BITS, MOST_BITS = 1 << 21, 4, 12, 22
#: Ranges of a table that are summed apart, and ways in which tasks' parts are summed first.
RANGES, WAYS = 16, 16
ROWS = 1 << 16
#: Pairs of a context and a word that a task gathers before it counts their bits.
PAIRS = 1 << 21
_U = np.uint64


# words


def read_words(col: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk of texts: word hashes, each text's first, the bytes and the words' starts and ends in them."""
    for _, _, data, offs in C.chunks(col):
        data = C.LOWER[data]
        s, e, first = C.word_bounds(data, offs, C.BLANK_WORD)
        yield C.word_hashes(data, s, e), first, data, s, e


class _Words:
    """Counts of words."""

    def __init__(self) -> None:
        self.table, self.size, self.n, self.words, self.wide, self.hashes = C.HashTable(18), 0, np.zeros(ROWS, np.int64), [], [], []

    def add(self, h: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        row = self.table.get(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            u, first = np.unique(h[new], return_index=True)
            self.table.add(u, np.arange(self.size, self.size + len(u), dtype=np.int32))
            row[new] = self.table.get(h[new])
            self.size += len(u)
            if self.size > len(self.n):
                self.n = np.concatenate([self.n, np.zeros(max(len(self.n), self.size), np.int64)])
            at = s[new[first]]
            wide = e[new[first]] - at
            ends = np.cumsum(wide)
            self.words.append(data[np.repeat(at - ends + wide, wide) + np.arange(ends[-1])])
            self.wide.append(wide)
            self.hashes.append(u)
        np.add.at(self.n, row, 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        h, words, ends = np.concatenate(self.hashes), np.concatenate(self.words), np.concatenate([[0], np.cumsum(np.concatenate(self.wide))])
        for lo in range(0, self.size, ROWS):
            hi = min(lo + ROWS, self.size)
            word = _blobs(words[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
            yield pa.RecordBatch.from_arrays([word, pa.array(h[lo:hi].view(np.int64)), pa.array(self.n[lo:hi])], names=["word", "key", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> word, key (its hash), n. Given out whenever many have gathered."""
    words, ends = _Words(), 0
    for batch in batches:
        ends += batch.num_rows
        for h, _, data, s, e in read_words(batch.column(0)):
            words.add(h, data, s, e)
        if words.size > 1 << 20:
            yield from words.rows()
            words = _Words()
    yield from words.rows()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([END], pa.int64()), pa.array([ends], pa.int64())], names=["word", "key", "n"])


def gather(docs: DataFrame) -> DataFrame:
    """word, key, n over all texts of docs: a row for each distinct word, and one of no letters for the ends."""
    return C.map_arrow(docs.select(F.col("text").cast("binary").alias("text")), _gather, "word binary, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


# tables, summed by ranges

PART = "place int, way int, data binary"


def _packed(table: np.ndarray) -> bytes:
    """Counts, none below zero, in as many bytes each as the largest needs; how many comes first."""
    kind = np.min_scalar_type(int(table.max(initial=0)))
    return bytes([kind.itemsize]) + _planes(table.astype(kind))


def _unpacked(data: bytes) -> np.ndarray:
    return _unplaned(memoryview(data)[1:], f"<u{data[0]}")


def _parts(*tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's tables, each in ranges."""
    way = TaskContext.get().partitionId() % WAYS
    for k, part in enumerate(part for table in tables for part in np.array_split(table, RANGES)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([way], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["place", "way", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of the same range and way, which come in order."""
    key, total = None, np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["place", "way", "data"])

    for batch in batches:
        for place, way, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (place, way):
                if key is not None:
                    yield out()
                key, total = (place, way), _unpacked(data).astype(np.int64)
            else:
                np.add(total, _unpacked(data), out=total, casting="unsafe")
    if key is not None:
        yield out()


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' tables, of a fixed size: within ways, then of those."""
    once = C.map_arrow(parts.repartition("place", "way").sortWithinPartitions("place", "way"), _added, PART)
    twice = C.map_arrow(once.withColumn("way", F.lit(0)).repartition("place").sortWithinPartitions("place"), _added, PART)
    held = {r.place: _unpacked(r.data).astype(np.int64) for r in twice.collect()}  # RANGES rows for each table
    return np.concatenate([held[k] for k in sorted(held)]) if held else np.zeros(size, np.int64)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word -> the counts of letters, each word once."""
    size = M.CLASSES * M.CLASSES * 256
    total = np.zeros(size, np.int64)
    for batch in batches:
        for _, _, data, offs in C.chunks(batch.column(0)):
            total += np.bincount(M.spelling(data, offs[:-1], offs[1:])[0], minlength=size)
    yield from _parts(total)


# texts as numbers of words

CODED = "uid long, h long, bucket int, learn boolean, n_tokens long, n_known long, logs double, n_bytes long, ids binary, costs binary, rare array<long>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of an array as binary values."""
    wide = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * wide).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def coded(docs: DataFrame, learn: Column, key: str, model, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """key, and each text as ids, with costs of its rare words' letters, their hashes, and what the base score needs."""
    slim = docs.select(F.struct(F.col(key).alias("key")).alias("key"), F.col("text").cast("binary").alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"), F.xxhash64(F.col(key), "text").alias("h"))
    schema = T.StructType([slim.schema["key"], *T._parse_datatype_string(CODED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hashes, counts), m = common, model.value
        words = hashes != END
        table = C.HashTable(18)
        table.add(hashes[words], np.arange(int(words.sum()), dtype=np.int32))
        ends_seen = int(counts[~words].sum())
        log = np.append(np.log10(counts[words] + 1.0), 0.0)  # the last for words that aren't there
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            got: list[list[np.ndarray]] = [[] for _ in range(8)]
            for h, first, data, s, e in read_words(batch.column(1)):
                row = table.get(h)
                rare = np.flatnonzero(row < 0)
                at = first + np.arange(len(first))
                ids = np.empty(len(h) + len(first) - 1, np.uint32)
                place = np.arange(len(h)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
                ids[place] = np.where(row < 0, (h >> _U(34)).astype(np.uint32) | np.uint32(M.RARE), row.astype(np.uint32))
                ids[at[1:] - 1] = m.escape + 1
                cell, begin = M.spelling(data, s[rare], e[rare])
                costs = np.add.reduceat(m.letters[cell], begin) if len(rare) else np.zeros(0)
                n_rare = np.searchsorted(rare, first)
                upto = np.concatenate([[0.0], np.cumsum(log[row])])
                size = np.concatenate([[0], np.cumsum(e - s)])
                n = np.diff(first)
                parts = (ids, costs.astype(np.float32), h[rare].view(np.int64), n + 1, n - np.diff(n_rare) + (ends_seen > 0), np.diff(upto[first]) + np.log10(ends_seen + 1.0), np.diff(size[first]) + n + 1, np.diff(n_rare))
                for x, v in zip(got, parts, strict=True):
                    x.append(v)
            kinds = (np.uint32, np.float32, np.int64, np.int64, np.int64, float, np.int64, np.int64)
            ids, costs, rare_h, n_tokens, n_known, logs, n_bytes, n_rare = (np.concatenate(x).astype(k) if x else np.zeros(0, k) for x, k in zip(got, kinds, strict=True))
            ends, rare_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (n_tokens, n_rare))
            own = batch.column(3)
            bucket = np.asarray(own).astype(np.int64).view(np.uint64) % _U(buckets)
            cols = [batch.column(0), pa.array(uid + np.arange(batch.num_rows)), own, pa.array(bucket.astype(np.int32)), batch.column(2), pa.array(n_tokens), pa.array(n_known), pa.array(logs), pa.array(n_bytes)]
            uid += batch.num_rows
            yield pa.RecordBatch.from_arrays([*cols, _blobs(M.packed(ids), 4 * ends), _blobs(costs, rare_ends), _lists(rare_h, rare_ends)], names=schema.names)

    return C.map_arrow(slim, run, schema)


def _texts(batch: pa.RecordBatch, col: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch's texts in a row, and each text's first, one more than texts."""
    data, offs = C.flat(batch.column(col))
    return M.unpacked(data), offs // 4


def _grouped(ids: np.ndarray, first: np.ndarray, most: int = M.GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Groups of pieces of texts: ids, each piece's first, and the ids' places."""
    starts, bounds = M.groups(first, most)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield ids[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], slice(int(starts[lo]), int(starts[hi]))


def _contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the last WORDS words before each place that has so many in its text, and those places."""
    within = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    place = np.flatnonzero(within >= WORDS)
    h = np.zeros(len(place), np.uint64)
    for k in range(WORDS, 0, -1):
        h = h * _U(0x9E3779B97F4A7C15) + ids[place - k].astype(np.uint64)
    return C.splitmix(h), place


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its n."""
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.add.reduceat(n[order], head)


def _counted(shared):
    """ids of training texts -> the task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.ready()
        size = 2 * m.tables.shape[1]
        total = np.zeros((2, size), np.int32)  # of a task, so not beyond 32 bits
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # words after contexts, and how often

        def told(least: int) -> None:
            for k, held in enumerate(seen):
                if sum(len(pair) for pair, _ in held) > least:
                    pair, times = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held[:] = [(pair, times)]
                    if 2 * len(pair) > least:
                        m.counted(pair >> 11, M.contexts(pair & 2047, pair & 2047)[k], times.astype(np.int32), total[k])
                        held.clear()

        for batch in batches:
            for ids, first, _ in _grouped(*_texts(batch, 0)):
                symbol = np.where(ids >= M.RARE, m.escape, ids).astype(np.int64)
                _, topic, previous = M.pairs(symbol, first[:-1])
                for held, x in zip(seen, (topic, previous), strict=True):
                    held.append(np.unique((symbol << 11) | x, return_counts=True))
                told(PAIRS)
        told(0)
        yield from _parts(*total)

    return run


# matches

#: What tasks ask of a range of contexts, and are told.
ASKS = "bucket int, part long, place int, data binary"


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers compressed by their bytes of equal weight."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).reshape(-1).view(kind)


def _joined(*blobs: bytes) -> bytes:
    return b"".join(x for b in blobs for x in (len(b).to_bytes(4, "little"), b))


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _in_order(context: np.ndarray, word: np.ndarray, merged: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which equal contexts (48 bits), and equal words of each, are together, and both in it. It depends on nothing but them, equal pairs aside. merged: they are runs in that order already."""
    key = (context << _U(16)) | (C.splitmix(word.astype(np.uint64)) >> _U(48))
    order = np.argsort(key, kind="stable" if merged else None)
    key, word = key[order], word[order]
    clash = np.unique(key[1:][(key[1:] == key[:-1]) & (word[1:] != word[:-1])])  # words of one context that share 16 bits of their hash
    if len(clash):
        lo = np.searchsorted(key, clash)
        n = np.searchsorted(key, clash, "right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        fix = at[np.lexsort((word[at], key[at]))]
        order[at], word[at] = order[fix], word[fix]
    return order, key >> _U(16), word


class _Asked:
    """Sightings of a part of a bucket: each context with the word after it and whether it is learned from, equal ones once, in the order of contexts."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, learn: np.ndarray, ranges: int):
        h, self.place = _contexts(ids, first)
        word = ids[self.place].astype(np.uint64) << _U(1) | np.repeat(learn, np.diff(first))[self.place].astype(np.uint64)
        order, context, word = _in_order(h >> _U(16), word)
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        head = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.context, self.word, self.times = context[head], word[head], np.diff(np.append(head, len(order))).astype(np.uint32)
        self.bounds = np.searchsorted(self.context, np.arange(ranges + 1, dtype=np.uint64) * _U((1 << 48) // ranges))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for k, (lo, hi) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            if hi > lo:
                step = np.diff(self.context[lo:hi], prepend=_U(0))
                yield k, _joined(_planes(step), _planes(self.word[lo:hi].astype(np.uint32)), _planes(self.times[lo:hi]))

    def predicted(self, n: int, told: dict[int, np.ndarray]) -> np.ndarray:
        """The word that each of n places is predicted to have, of the answers by range."""
        out = np.full(n, M.NONE, np.int32)
        if len(self.place):
            out[self.place] = np.concatenate([told[k] for k in sorted(told)])[self.of]
        return out


def _parts_of(texts: Iterator[tuple], starts) -> Iterator[list[tuple]]:
    """Rows of parts of a bucket. texts: (bucket, ids, learn, uid, ..) in order; starts(bucket, uid, tokens so far): whether a text is the first of a part."""
    some, held = [], 0
    for row in texts:
        if some and (row[0] != some[0][0] or starts(row[0], row[3], held)):
            yield some
            some, held = [], 0
        some.append(row)
        held += len(row[1])
    if some:
        yield some


def _laid(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([r[1] for r in rows]), np.cumsum([0, *(len(r[1]) for r in rows)])


def _asks(ranges: int, most: int):
    """bucket, learn, ids, uid of texts in order -> what each part, known by its first text, asks of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((b, M.unpacked(np.frombuffer(x.as_buffer(), np.uint8)), learn, uid) for batch in batches for b, learn, x, uid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True))
        for rows in _parts_of(texts, lambda _bucket, _uid, held: held >= most):
            asked = list(_Asked(*_laid(rows), np.array([r[2] for r in rows]), ranges).rows())
            if asked:
                cols = [pa.array([x] * len(asked), kind) for x, kind in ((rows[0][0], pa.int32()), (rows[0][3], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([k for k, _ in asked], pa.int32()), pa.array([d for _, d in asked], pa.binary())], names=["bucket", "part", "place", "data"])

    return run


def most_frequent(context: np.ndarray, word: np.ndarray, times: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Of each sighting the word that its context has most often in training texts, its own sighting taken off; NONE where there is none. Ties go to the smaller word."""
    if not len(context):
        return np.zeros(0, np.int64)
    order, context, word = _in_order(context, word, True)
    other = np.concatenate([[True], context[1:] != context[:-1]])
    lone = other & np.append(other[1:], True) & (times[order] == 1)  # nobody else has its context
    out = np.full(len(order), M.NONE, np.int64)
    some = np.flatnonzero(~lone)
    if not len(some):
        return out
    order, context, word, other = order[some], context[some], word[some], other[some]
    learn, n = learn[order], np.where(learn, times, 0)[order].astype(np.int64)
    new = other.copy()
    new[1:] |= word[1:] != word[:-1]
    head = np.flatnonzero(new)
    n, w, start = np.add.reduceat(n, head), word[head].astype(np.int64), np.flatnonzero(other[head])
    wide = np.diff(np.append(start, len(head)))

    def most() -> tuple[np.ndarray, np.ndarray]:
        most_n = np.maximum.reduceat(n, start)
        return most_n, np.minimum.reduceat(np.where(n == np.repeat(most_n, wide), w, np.iinfo(np.int64).max), start)

    n1, w1 = most()
    n[w == np.repeat(w1, wide)] = 0
    n2, w2 = most()
    one = np.where(n1 > 0, w1, M.NONE)
    passed = (n1 - 1 < n2) | ((n1 - 1 == n2) & (n2 > 0) & (w2 < w1))
    own = np.where(passed, w2, np.where(n1 > 1, w1, M.NONE))
    of = np.cumsum(other) - 1
    out[order] = np.where(learn & (word == w1[of]), own[of], one[of])
    return out


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asks of a range, which come together -> an answer to each, in its order."""
    names, place, held = ["bucket", "part", "place", "data"], None, []

    def answers() -> Iterator[pa.RecordBatch]:
        steps, words, times = zip(*(_split(d) for *_, d in held), strict=True)
        steps = [_unplaned(x, "<u8") for x in steps]
        size = [len(x) for x in steps]
        context = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps])
        word = np.concatenate([_unplaned(x, "<u4") for x in words])
        predicted = most_frequent(context, (word >> 1).astype(np.int64), np.concatenate([_unplaned(x, "<u4") for x in times]), (word & 1).astype(bool))
        for (bucket, part, _), x in zip(held, np.split(predicted.astype(np.uint32), np.cumsum(size)[:-1]), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int64()), pa.array([place], pa.int32()), pa.array([_planes(x)], pa.binary())], names=names)

    for batch in batches:
        for bucket, part, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and at != place:
                yield from answers()
                held.clear()
            place = at
            held.append((bucket, part, data))
    if held:
        yield from answers()


def ordered(texts: DataFrame, buckets: int, *more: str) -> DataFrame:
    """Texts dealt by bucket, each bucket's together and in order."""
    return texts.repartition(buckets, "bucket").sortWithinPartitions("bucket", *more)


def matched(texts: DataFrame, buckets: int, most: int = PART_TOKENS) -> DataFrame:
    """bucket, part (its first text's uid), place and data, of texts that are written in the order of bucket, h and uid: for all contexts of a part's texts, the word that comes after them most often elsewhere in training texts. A bucket has two to four ranges of contexts."""
    ranges = 2 << int(buckets - 1).bit_length()
    asks = C.map_arrow(texts.select("bucket", "learn", "ids", "uid"), _asks(ranges, most), ASKS)
    return C.map_arrow(asks.repartition(ranges, "place").sortWithinPartitions("place", "bucket", "part"), _told, ASKS)


def _assembled(shared, schema: T.StructType):
    """A bucket's answers before its texts -> predicted ids of texts that have some, and what a bucket taught."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.ready()
        told: dict[tuple[int, int], dict[int, np.ndarray]] = {}

        def texts() -> Iterator[tuple]:
            for batch in batches:
                for bucket, uid, learn, text, part, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if text is None:
                        told.setdefault((bucket, part), {})[place] = data
                    else:
                        yield bucket, M.unpacked(np.frombuffer(text, np.uint8)), learn, uid

        def done(lesson) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([lesson.sums()], pa.list_(pa.int64()))], names=schema.names)

        last, lesson, learned = None, None, False
        held: list[tuple[np.ndarray, ...]] = []  # training texts that aren't learned yet

        def teach() -> None:
            ids, size, guess = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for some, begin, at in _grouped(ids, np.concatenate([[0], np.cumsum(size)]), 2 * M.GROUP):
                lesson.learn(M.Tokens(some, begin[:-1], guess[at], np.ones(len(some), np.int8), m.escape, m.codes, True))

        for rows in _parts_of(texts(), lambda bucket, uid, _held: (bucket, uid) in told):
            bucket = rows[0][0]
            if bucket != last:
                if held:
                    teach()
                if learned:
                    yield done(lesson)
                last, lesson, learned = bucket, M.Lesson(m), False
            ids, first = _laid(rows)
            learn = np.array([r[2] for r in rows])
            blobs = told.pop((bucket, rows[0][3]), {})
            asked = _Asked(ids, first, learn, 1)
            predicted = asked.predicted(len(ids), {k: _unplaned(v, "<u4").astype(np.int32) for k, v in blobs.items()})
            del asked
            on = np.repeat(learn, np.diff(first))
            if on.any():
                learned = True
                held.append((ids[on], np.diff(first)[learn], predicted[on]))
                if 4 * sum(len(x) for x, *_ in held) > 6 * M.GROUP:
                    teach()
            blob = [(r[3], M.packed(predicted[a:b]).tobytes()) for r, a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True) if (predicted[a:b] != M.NONE).any()]
            for lo in range(0, len(blob), 2000):
                uids, some = zip(*blob[lo : lo + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(some, pa.binary()), pa.nulls(len(some), pa.list_(pa.int64()))], names=schema.names)
        if held:
            teach()
        if learned:
            yield done(lesson)

    return run


def _scored(shared, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.ready()
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            ids, first = _texts(batch, batch.schema.get_field_index("ids"))
            predicted = np.full(len(ids), M.NONE, np.int32)
            for i in np.flatnonzero(np.asarray(of["predicted"].is_valid())).tolist():
                predicted[first[i] : first[i + 1]] = M.unpacked(np.frombuffer(of["predicted"][i].as_buffer(), np.uint8))
            costs = np.frombuffer(C.flat(of["costs"])[0].tobytes(), np.float32)
            learned = np.repeat(np.asarray(of["learn"]).astype(np.int8), np.diff(first))
            logs, rare = np.zeros(len(ids), np.float32), 0
            for part, starts, at in _grouped(ids, first, 2 * M.GROUP):
                t = M.Tokens(part, starts[:-1], predicted[at], learned[at], m.escape, m.codes)
                logs[at] = m.log10(t, costs[rare : rare + len(t.rare)])
                rare += len(t.rare)
            score = np.add.reduceat(logs, first[:-1], dtype=float) if len(logs) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(of[c] for c in schema.names[:-1]), pa.array(score)], names=schema.names)

    return run


# the operator


def vocabulary(sums: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
    """Hashes and counts of the common words (those seen once are rare, as they are unknown to the rest of the corpus), and the tokens and distinct words of a written table of gather()."""
    total, distinct = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sums.where(F.col("n") > 1).select("key", "n").orderBy(F.col("n").desc(), "key").limit(COMMON).toArrow()  # COMMON rows at most
    return (top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()), total, distinct


def lm_scores(docs: DataFrame, learn: Column, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each document, learned from those where learn holds."""
    sc = docs.sparkSession.sparkContext
    sums = C.staged(gather(docs.where(F.coalesce(learn, F.lit(True)))), "sums")
    common, total, distinct = vocabulary(sums)
    words = common[0] != END
    counts = np.concatenate([common[1][words], [max(1, total - int(common[1].sum())), max(1, int(common[1][~words].sum()))]])  # an escape, and the end
    bits = int(np.clip(np.ceil(np.log2(SLOTS * max(total, 1))), LEAST_BITS, MOST_BITS))
    model = M.Model(M.Codes(counts), np.zeros((2, 1 << bits), np.uint16))
    cube = summed(C.map_arrow(sums.where(F.col("key") != END).select("word"), _letters, PART), M.CLASSES * M.CLASSES * 256)
    model.letters = M.letter_costs(cube).ravel()
    shared = sc.broadcast(model)
    buckets = max(1, total // BUCKET)
    texts = C.staged(ordered(coded(docs, learn, key, shared, common, buckets), buckets, "h", "uid"), "coded", "zstd")
    tables = summed(C.map_arrow(texts.where("learn").select("ids"), _counted(shared), PART), 4 << bits)
    counters = M.in_bytes(tables.reshape(2, -1, 2)).astype(np.uint16)
    model.tables = (counters[:, :, 0] << 8) | counters[:, :, 1]
    shared.destroy()
    shared = sc.broadcast(model)
    plain = texts.select("uid", "key", "n_tokens", "n_known", "logs", "n_bytes", "rare")
    matches = C.staged(matched(texts, buckets), "matches", "zstd")
    rows = texts.select("bucket", "h", "uid", "learn", "ids", *[F.lit(None).cast(matches.schema[c].dataType).alias(c) for c in ("part", "place", "data")], F.lit(1).alias("kind"))
    found = matches.select("bucket", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("h", "uid", "learn", "ids")], "part", "place", "data", F.lit(0).alias("kind"))
    order = ordered(rows.union(found), buckets, "kind", "h", "uid")
    schema = T._parse_datatype_string("uid long, predicted binary, taught array<long>")
    ready = C.staged(C.map_arrow(order.select("bucket", "uid", "learn", "ids", "part", "place", "data"), _assembled(shared, schema), schema), "ready", "zstd")
    taught = ready.where("taught IS NOT NULL").select(F.posexplode("taught")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").toArrow()
    if taught.num_rows:
        M.Lesson.taught(model, taught.column(1).to_numpy())
    shared.destroy()
    final = sc.broadcast(model)
    C.drop_staged(matches)
    slim = T.StructType([schema["uid"], T.StructField("score", T.DoubleType())])
    scores = C.staged(C.map_arrow(texts.select("uid", "ids", "costs", "learn").join(ready.where("taught IS NULL").select("uid", "predicted").hint("merge"), "uid", "left").select("uid", "ids", "costs", "learn", "predicted"), _scored(final, slim), slim), "scores")
    C.drop_staged(ready)
    lone = plain.select("uid", F.explode("rare").alias("word"))
    more = lone.join(sums.select(F.col("key").alias("word"), "n"), "word").groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("more_logs"))
    out = plain.drop("rare").join(scores, "uid").join(more, "uid", "left")
    per_token = float(np.log10(total + distinct + 1))
    return out.select(
        F.col("key.key").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op10_context_mixing(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = C.fold("doc_id", 7) == 2
    return lm_scores(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
