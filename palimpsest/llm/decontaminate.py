"""Benchmark decontamination: a generalised suffix automaton of the test items' words, through which training words stream.

A match is an occurrence of ``window`` consecutive words of an item, or of a whole item that has fewer. The automaton
keeps the longest suffix of the words read so far that occurs in some item; the window that ends here is found in the
state on whose suffix links the length ``window`` lies. Unknown words reset it, so only runs of known words are walked.

Items are dealt in shards of ``shard_words`` words, so that what is broadcast is bounded; a larger benchmark takes one
pass over the documents for each shard, and the hits of all shards are merged by row before anything is decided.

Null or empty texts have no words and no match. Items without words match nothing. Items of null id match, but aren't
listed. Rows that repeat are matched each on its own.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SHARD_WORDS = 200_000


class Automaton:
    """States: 0 is the root. Words are numbers of the shard's own vocabulary."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        words = sorted({w for _, ws in items for w in ws})
        number = {w: i for i, w in enumerate(words)}
        h = C.hash_words(words)
        order = np.argsort(h, kind="stable")
        self.hashes, self.numbers = h[order], order.astype(np.int64)
        seqs = [(k, [number[w] for w in ws]) for k, ws in items if ws]
        self.shortest = min([window, *(len(ws) for _, ws in seqs)], default=window)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: Of a state that is at least a window long: the state of its last window words.
        self.home = [0] * len(self.link)
        for s in by_length:
            if self.length[s] >= window:
                self.home[s] = s if self.length[self.link[s]] < window else self.home[self.link[s]]
        self.items: dict[int, set[str | None]] = {}
        own: dict[int, list[tuple[int, str | None]]] = {}
        for k, seq in seqs:
            s = 0
            for p, w in enumerate(seq, 1):
                s = self.next[s][w]
                if p >= window:
                    self.items.setdefault(self.home[s], set()).add(k)
            if len(seq) < window:
                own.setdefault(s, []).append((len(seq), k))
        #: Short items that end wherever this state does.
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * len(self.link)
        for s in by_length:
            self.short[s] = (*self.short[self.link[s]], *own.get(s, ()))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def known(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for words in no item."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    def walk(self, run: list[int]) -> tuple[list[tuple[int, int]], set[str | None], int]:
        """Hit intervals of word positions, merged; the items; the longest match."""
        nxt, link, length, home, short, window = self.next, self.link, self.length, self.home, self.short, self.window
        hits: list[tuple[int, int]] = []
        found: set[str | None] = set()
        s = n = most = 0
        for p, w in enumerate(run, 1):
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                n += 1
            most = max(most, n)
            back = 0
            if n >= window:
                found |= self.items[home[s]]
                back = window
            for m, k in short[s]:
                if m <= n:
                    found.add(k)
                    back = max(back, m)
            if back:
                if hits and hits[-1][1] >= p - back:
                    lo = p - back
                    while hits and hits[-1][1] >= lo:
                        lo = min(lo, hits.pop()[0])
                    hits.append((lo, p))
                else:
                    hits.append((p - back, p))
        return hits, found, most


def _shards(benchmark: DataFrame, window: int, shard_words: int) -> Iterator[bytes]:
    """Pickled automata, the items in order of their ids; no more than a shard's words are held at once."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("text is not null").orderBy("item_id", "text")
    held: list[tuple[str | None, list[bytes]]] = []
    n = 0
    lower = bytes(C.LOWER)
    blank = bytes(b if C.LETTER_WORD[b] else 32 for b in range(256))
    for k, text in rows.toLocalIterator():
        words = bytes(text).translate(lower).translate(blank).split()
        if held and n + len(words) > shard_words:
            yield pickle.dumps(Automaton(held, window))
            held, n = [], 0
        held.append((k, words))
        n += len(words)
    yield pickle.dumps(Automaton(held, window))


_loaded: dict[str, Automaton] = {}


def _load(shared: tuple) -> Automaton:
    """One automaton at a time in a worker, kept between tasks."""
    name, pickled = shared
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = pickle.loads(pickled.value)
    return _loaded[name]


class Matched:
    """One document's matches. words: hit intervals of word numbers; bytes: the same as byte offsets of the text."""

    __slots__ = ("bytes", "items", "longest", "n_words", "words")

    def __init__(self, n_words: int):
        self.n_words, self.words, self.bytes, self.items, self.longest = n_words, [], [], set(), 0


def match_texts(auto: Automaton, col: pa.Array) -> Iterator[Matched]:
    for lo, hi, data, offs in C.chunks(col):
        data = C.LOWER[data]
        s, e, first = C.word_bounds(data, offs, C.LETTER_WORD)
        number = auto.known(C.word_hashes(data, s, e))
        out = [Matched(int(n)) for n in np.diff(first)]
        # runs of known words within a document
        ok = np.zeros(len(number) + 2, bool)
        ok[1:-1] = number >= 0
        begin = ok[1:-1] & ~ok[:-2]
        stop = ok[1:-1] & ~ok[2:]
        heads = first[(first > 0) & (first < len(number))]
        begin[heads] = ok[1:-1][heads]
        stop[heads - 1] = ok[1:-1][heads - 1]
        a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = b - a >= auto.shortest
        for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
            hits, items, most = auto.walk(number[x:y].tolist())
            d = int(np.searchsorted(first, x, "right")) - 1
            m = out[d]
            m.longest = max(m.longest, most)
            if hits:
                m.items |= items
                base, top = x - int(first[d]), int(offs[d])
                m.words += [(base + p, base + q) for p, q in hits]
                m.bytes += [(int(s[x + p]) - top, int(e[x + q - 1]) - top) for p, q in hits]
        yield from out


MATCHES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int) -> Iterator:
    """The shards as broadcast, one at a time, and whether there is only one. A shard goes when the next is asked for, so what is found with it is to be written by then."""
    shards = _shards(benchmark, window, shard_words)
    shard, following = next(shards), next(shards, None)
    only = following is None
    while shard is not None:
        sent = docs.sparkSession.sparkContext.broadcast(shard)
        yield (uuid.uuid4().hex, sent), only
        if not only:
            sent.unpersist()
        shard, following = following, next(shards, None)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, key: str = "doc_id") -> DataFrame:
    """key, n_words, longest match, items (sorted, no null) and words (hit intervals) of each document."""
    slim = docs.select(F.lit(0).cast("long").alias("row"), F.col(key).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    schema = T.StructType([slim.schema["row"], slim.schema["doc_id"], *MATCHES.fields])
    out = None
    for shared, only in _passes(docs, benchmark, window, shard_words):
        if not only and out is None:  # written, so that a row has the same number in every pass
            slim = C.staged(slim.withColumn("row", F.monotonically_increasing_id()), "rows")

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = _load(shared)
            for batch in batches:
                found = list(match_texts(auto, batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("doc_id"),
                        pa.array([m.n_words for m in found], pa.int64()),
                        pa.array([m.longest for m in found], pa.int64()),
                        pa.array([sorted(k for k in m.items if k is not None) for m in found], pa.list_(pa.string())),
                        pa.array([[list(x) for x in m.words] for m in found], pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=["row", "doc_id", "n_words", "longest", "items", "words"],
                )

        one = C.map_arrow(slim, run, schema)
        one = one if only else C.staged(one, "found")
        out = (1, one) if out is None else (out[0] + 1, out[1].unionByName(one))
    n, df = out
    if n > 1:  # every pass has each row once
        df = df.groupBy("row", "doc_id", "n_words").agg(
            F.max("longest").alias("longest"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"),
        )
    assert kind == dict(df.dtypes)["doc_id"]
    return df.drop("row").withColumnRenamed("doc_id", key)


def n_hit(words):
    """Words in any of the sorted intervals, which may overlap when they come from several shards."""
    return F.aggregate(
        words,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x[1] - F.greatest(x[0], acc["end"]))).alias("n"), F.greatest(acc["end"], x[1]).alias("end")),
        lambda acc: acc["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int = 10, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents without benchmark passages, all columns kept and n_chars, where there is one, brought up to date.

    A span of hit words of at least ``max_span`` words, or of a whole short item, is cut out of the text; a document of whose words
    more than ``max_coverage`` are hit is dropped whole. A cut leaves a line break, so that the words beside it don't become
    neighbours; where a cut would still bring a new match about, it is cut again. More than one shard gives the same.
    """
    schema = docs.schema
    passes = lambda: _passes(docs, benchmark, window, shard_words)
    for shared, only in passes():
        if not only:
            return _cut_by_all(docs, passes, window, max_span, max_coverage)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = _load(shared)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                col = batch.column(at)
                found = list(match_texts(auto, col))
                keep = [True] * len(found)
                new: dict[int, str | None] = {}
                for i, m in enumerate(found):
                    n = sum(q - p for p, q in m.words)
                    if n and n > max_coverage * m.n_words:
                        keep[i] = False
                    elif n:
                        text = _cut(col[i].as_py(), m, max_span, window)
                        while (more := next(match_texts(auto, pa.array([text])))).bytes and (left := _cut(text, more, max_span, window)) != text:
                            text = left
                        new[i] = text
                if new:
                    texts = col.to_pylist()
                    for i, text in new.items():
                        texts[i] = text
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                    if (k := batch.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(batch.schema.field(k).type):
                        chars = batch.column(k).to_pylist()
                        for i, text in new.items():
                            chars[i] = len(text)
                        batch = batch.set_column(k, batch.schema.field(k), pa.array(chars, batch.schema.field(k).type))
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = C.map_arrow(docs, run, schema)
    return docs


HITS = "_row_number long, n_words long, hits array<struct<p:long,q:long,lo:long,hi:long>>"
CUT = "_row_number long, _new string, _gone boolean"


def _merged(hits: list[dict]) -> Matched:
    """The union of hit intervals; those that touch are one, as within one automaton."""
    m = Matched(0)
    for h in sorted(hits, key=lambda h: (h["p"], h["q"])):
        if m.words and m.words[-1][1] >= h["p"]:
            if h["q"] > m.words[-1][1]:
                m.words[-1], m.bytes[-1] = (m.words[-1][0], h["q"]), (m.bytes[-1][0], h["hi"])
        else:
            m.words.append((h["p"], h["q"]))
            m.bytes.append((h["lo"], h["hi"]))
    return m


def _cut_by_all(docs: DataFrame, passes, window: int, max_span: int, max_coverage: float) -> DataFrame:
    """decontaminate() by several shards: each round merges all shards' hits in the same texts, then cuts, until none has any. Only the first round drops."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # whatever its columns are called
    docs_ = C.staged(docs.select(whole, F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row_number")), "rows")
    active, cuts = docs_.select("_row_number", F.col("_text").alias("text")), None
    while True:
        found = None
        for shared, _ in passes():

            def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                auto = _load(shared)
                for batch in batches:
                    out = [(k, m) for k, m in zip(batch.column(0).to_pylist(), match_texts(auto, batch.column(1)), strict=True) if m.words]
                    hits = [[{"p": p, "q": q, "lo": lo, "hi": hi} for (p, q), (lo, hi) in zip(m.words, m.bytes, strict=True)] for _, m in out]
                    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("p", "q", "lo", "hi")]))
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([m.n_words for _, m in out], pa.int64()), pa.array(hits, kind)], names=["_row_number", "n_words", "hits"])

            one = C.staged(C.map_arrow(active, find, HITS), "hits")
            found = one if found is None else found.union(one)
        hits = found.groupBy("_row_number").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
        drops = cuts is None

        def cut(batches: Iterator[pa.RecordBatch], drops=drops) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new, gone = [], []
                for text, n_words, hit in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    m = _merged(hit)
                    gone.append(drops and sum(q - p for p, q in m.words) > max_coverage * n_words)
                    new.append(None if gone[-1] else _cut(text, m, max_span, window))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(gone, pa.bool_())], names=["_row_number", "_new", "_gone"])

        now = C.staged(C.map_arrow(active.join(hits, "_row_number").select("_row_number", "text", "n_words", "hits"), cut, CUT), "cut")
        if not now.limit(1).count():
            break
        cuts = now if cuts is None else C.staged(cuts.join(now.select("_row_number"), "_row_number", "left_anti").union(now), "cuts")
        active = now.where("NOT _gone").select("_row_number", F.col("_new").alias("text"))
    row = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    if cuts is None:
        return docs_.select(*[v.alias(c) for c, v in row.items()])
    out = docs_.join(cuts, "_row_number", "left").where("_gone IS NULL OR NOT _gone")
    row["text"] = F.coalesce("_new", "_text")
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType):
        row["n_chars"] = F.coalesce(F.length("_new").cast(docs.schema["n_chars"].dataType), row["n_chars"])
    return out.select(*[v.alias(c) for c, v in row.items()])


def _cut(text: str, m: Matched, max_span: int, window: int) -> str:
    raw, out, at = text.encode(), [], 0
    for (p, q), (lo, hi) in zip(m.words, m.bytes, strict=True):
        if q - p >= min(max_span, window) or q - p < window:
            out += [raw[at:lo], b"\n"]
            at = hi
    return b"".join([*out, raw[at:]]).decode()


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("words"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
