"""Language by rank-order profiles: a text's most frequent letter n-grams against each language's, by out-of-place distance.

N-grams are of one to three lower-cased letters within a word, blanks at a word's ends counting as letters of two- and three-grams. The
``PROFILE`` most frequent of a language, by its training texts, are its profile; a text's own most frequent are ranked alike. Each of these
adds the difference of its ranks, or ``PROFILE`` where the language's profile lacks it; the least sum wins, ties going to the first language.

Profiles are broadcast in blocks of at most ``LANGUAGES`` languages, so of a fixed size; more languages take further passes
beside the best so far. Counting sums n-grams in a task before they are shuffled, so that a language's share of the rows doesn't matter.

A text that is null or without letters is ``und`` with score 0, and so is every text when nothing was learned. Null languages aren't learned.
Repeated rows are predicted each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

PROFILE, LANGUAGES = 400, 2000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Of each code point its lower-case letter, 0 where it is none."""
    if not _letters:
        _letters.append(np.array([ord(ch.lower()[0]) if (ch := chr(c)).isalpha() else 0 for c in range(0x110000)], np.uint32))
    return _letters[0]


def grams(col: pa.Array) -> Iterator[np.ndarray]:
    """Each text's n-grams as numbers, sorted."""
    table = _letter_table()
    for _, _, data, offs in C.chunks(col):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        if len(points) != starts[-1]:  # not UTF-8: text by text
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        letters = table[points]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            c = np.zeros(b - a + 2, np.uint64)
            c[1:-1] = letters[a:b]
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
            if len(c) < 3:
                yield c[:0]
                continue
            two = (c[:-1] << np.uint64(21)) | c[1:] | np.uint64(1 << 63)
            three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[c[1:-1] != 0]
            out = np.concatenate([c[c != 0], two, three])
            out.sort()
            yield out


def counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[head], np.diff(np.append(head, len(sorted_keys)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, gram, n: a task's sums, given out when they grow large."""
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
        u, back = np.unique(keys, return_inverse=True)
        return u, np.bincount(back, weights=n).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in sums.items():
            u, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, g in zip(batch.column(0).to_pylist(), grams(batch.column(1)), strict=True):
            if len(g):
                by.setdefault(lang, []).append(g)
                if len(by[lang]) >= 256:
                    by[lang] = [np.concatenate(by[lang])]
                    sums.setdefault(lang, []).append(counted(np.sort(by.pop(lang)[0])))
        for lang, parts in by.items():
            sums.setdefault(lang, []).append(counted(np.sort(np.concatenate(parts))))
        for lang, parts in sums.items():
            sums[lang] = [merged(parts)]
        size = sum(len(p[0][0]) for p in sums.values())
        if size > 2_000_000:
            yield from out()
            sums.clear()
    yield from out()


def profiles(docs: DataFrame) -> DataFrame:
    """lang, gram, place: the first PROFILE n-grams of each language of lang, text."""
    train = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    sums = C.map_arrow(train, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram") < 0, "gram")  # n-grams are unsigned numbers
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PROFILE).select("lang", "gram", (F.col("rank") - 1).alias("place"))


class Profiles:
    """Places of a block's languages by n-gram, PROFILE where a profile lacks it."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        keys = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        self.keys = np.unique(keys)
        at = np.searchsorted(self.keys, keys)
        lang = np.array([number[r[0]] for r in rows], np.int64)
        order = np.lexsort((lang, at))
        self.lang, self.place = lang[order], np.array([r[2] for r in rows], np.int64)[order]
        self.begin = np.searchsorted(at[order], np.arange(len(self.keys) + 1))

    def distances(self, sorted_keys: np.ndarray) -> tuple[np.ndarray, int]:
        """From each language, and the most that it could be."""
        u, n = counted(sorted_keys)
        order = np.argsort(-n, kind="stable")  # ties by the number, as in the profiles
        if len(order) > PROFILE:
            order = order[:PROFILE]
        u = u[order]
        at = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == u)
        lo, hi = self.begin[at[known]], self.begin[at[known] + 1]
        size = hi - lo
        upto = np.cumsum(size)
        flat = np.repeat(lo - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        gain = PROFILE - np.abs(self.place[flat] - np.repeat(known, size))
        most = len(u) * PROFILE
        return most - np.bincount(self.lang[flat], weights=gain, minlength=len(self.langs)), most


def predict(docs: DataFrame, model: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score (how much nearer than a profile without any of the text's n-grams)."""
    model = C.staged(model, "profiles")
    langs = model.select("lang").distinct()
    n = langs.count()
    out = docs.select(F.col(key), F.col("text").cast("binary").alias("text"), F.lit("und").alias("lang_pred"), F.lit(float("inf")).alias("distance"), F.lit(0).cast("long").alias("most"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    block = langs.withColumn("block", F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / LANGUAGES))
    passes = -(-n // LANGUAGES)
    for k in range(passes):
        rows = model.join(block.where(F.col("block") == k).select("lang"), "lang").collect()  # LANGUAGES x PROFILE at most
        shared = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in rows]))

        if k == passes - 1:  # no later pass needs the texts
            schema = T.StructType([f for f in schema.fields if f.name != "text"])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for batch in batches:
                lang, distance, most = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for i, g in enumerate(grams(batch.column(1))):
                    if len(g):
                        d, top = p.distances(g)
                        j = int(d.argmin())
                        if d[j] < distance[i]:
                            lang[i], distance[i], most[i] = p.langs[j], float(d[j]), top
                texts = [batch.column(1)] if "text" in schema.names[1:] else []
                yield pa.RecordBatch.from_arrays([batch.column(0), *texts, pa.array(lang, pa.string()), pa.array(distance, pa.float64()), pa.array(most, pa.int64())], names=schema.names)

        out = C.map_arrow(out, run, schema)
    return out.select(key, "lang_pred", F.when(F.col("most") > 0, 1 - F.col("distance") / F.col("most")).otherwise(F.lit(0.0)).alias("score"))


def language_id(docs: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """Predictions for all documents, learned from those where train holds."""
    return predict(docs, profiles(docs.where(train)), key)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = C.fold("doc_id", 4) == 2
    return language_id(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
