"""What the operators share: tables, the shared folder, and vectorised kernels over UTF-8 bytes.

The kernels work on whole Arrow batches in bounded chunks of documents: no Python object is made for a word.
A word is known by a 64-bit hash of its bytes; two different words of one corpus of 10^13 words share a hash with
a chance of about one in a million for each word compared, and every operator that depends on equality says so.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_place, release_memory, ship

#: Bytes of text that one pass of a kernel takes; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19
WHITE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: `[^\x20\x09-\x0D]+`
BLANK_WORD = ~WHITE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
LETTER_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors. What its shuffles left is deleted when it is written."""
    spark, place = df.sparkSession, new_place(df.sparkSession, name)
    if _own is not None:
        _own.append(place)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(place, compression=codec)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(place)


#: What the stage that runs now has staged, and what each stage has left by run (application and tables): its name and places.
_own: list[str] | None = None
_left: dict[tuple[str, str], list[tuple[str, list[str]]]] = {}


def stage(f):
    """For the stages of a pipeline, f(spark, docs, sf_dir), whose result is to be written before the next stage of the same run is asked for.

    A stage that starts on what is written deletes what the stages before it staged for the same tables: their results aren't needed any more. It deletes nothing of another run or of
    its own kind, so two results of one stage can both be read, and nothing at all if docs itself is still to be computed from staged tables.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _own
        left = _left.setdefault((spark.sparkContext.applicationId, sf_dir), [])
        before = [x for x in left if x[0] != f.__name__]
        held = [os.path.basename(place) for _, places in before for place in places]
        if held and not any(name in file for file in docs.inputFiles() for name in held):
            for x in before:
                left.remove(x)
                for place in x[1]:
                    _delete(spark, place)
        outer, _own = _own, []
        try:
            return f(spark, docs, sf_dir)
        finally:
            left.append((f.__name__, _own))
            _own = outer

    return run


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*dfs: DataFrame) -> None:
    """Deletes the staged tables under these frames now; nothing may read them afterwards."""
    for df in dfs:
        for top in {os.path.dirname(f) for f in df.inputFiles()}:
            _delete(df.sparkSession, top)


def fold(key: str, n: int):
    """crc32 of the key as text, modulo n; a null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return splitmix((np.arange(1, n + 1, dtype=np.uint64) + _U(salt << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE = seeds(256, 1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.cast(pa.binary()).fill_null(b"")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows lo..hi with their bytes and offsets, of at most so many bytes where a row allows it."""
    data, offs = flat(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray, word: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (one entry more than documents). cuts: positions where a word ends and the next begins."""
    n = len(data)
    is_word = word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    if cuts is not None:
        edge[cuts] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | edge[1:n]
    end = is_word
    end[:-1] &= ~is_word[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[s:e], never 0, from one prefix sum over the bytes."""
    h, lo = np.empty(len(s), np.uint64), 0
    while lo < len(s):  # in pieces, so that a very long text needs no more memory than its words do
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + 2 * CHUNK_BYTES, "right")))
        base = s[lo]
        part = data[base : e[hi - 1]]
        up, down = _power_tables(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        h[lo:hi] = (total[e[lo:hi] - base] - total[s[lo:hi] - base]) * down[s[lo:hi] - base]
        lo = hi
    h ^= (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    splitmix(h)
    h[h == 0] = 1
    return h


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hash of given words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


class HashTable:
    """Open addressing over 64-bit keys, looked up and filled for whole arrays at once. Values are row numbers."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Each key's row, or -1."""
        mask = (1 << self.bits) - 1
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        k = self.keys[at]
        out = np.where(k == h, self.rows[at], np.int32(-1))
        left = np.flatnonzero((k != h) & (k != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            k = self.keys[at[left]]
            same = k == h[left]
            out[left[same]] = self.rows[at[left[same]]]
            left = left[~same & (k != 0)]
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if 2 * (self.size + len(h)) > 1 << self.bits:
            held = self.keys != 0
            old_h, old_rows = self.keys[held], self.rows[held]
            bits = self.bits
            while 2 * (self.size + len(h)) > 1 << bits:
                bits += 1
            self.__init__(bits)
            self.add(old_h, old_rows)
        mask = (1 << self.bits) - 1
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        self.size += len(h)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[at[left]] == 0
            _, first = np.unique(at[left], return_index=True)
            first = first[free[first]]
            put = left[first]
            self.keys[at[put]], self.rows[at[put]] = h[put], rows[put]
            done = np.zeros(len(left), bool)
            done[first] = True
            left = left[~done]
            at[left] = (at[left] + 1) & mask


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package on the executors, whose workers keep no more memory than they need between tasks."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)
