"""Near duplicates by MinHash bands whose candidates odd sketches verify, confirmed on full shingle sets.

1. A document's set: distinct hashes of five consecutive words (of all its words where it has fewer). Documents of equal sets are
   one text from here on. Each gets MinHash samples in bands of 5 of them, and an odd sketch: 120 samples folded into
   512 parity bits. There are as many bands as let fewer than one in a million pairs at the threshold share none: 24 at 0.85, 35 at 0.8.
2. Within a band's bucket, the exclusive or of two sketches has as many bits as samples differ, so that its population count
   estimates high similarities closely. Buckets are covered by canopies: each leader takes all that it estimates at 0.25 below the threshold or more,
   and those at 0.9 or more lead no canopy of their own. Two texts at the threshold meet in one canopy at least, whichever of them is taken first.
   A bucket too large for one task is one canopy.
3. Canopies that share texts form a region, which no link leaves. A region's texts meet in one task, where an
   inverted index of their shingles gives the size of every intersection, and the links. A large region is dealt in blocks: each is
   solved by itself, then a text of each block's largest component visits the other blocks, and then every text that is outside the region's
   largest component visits all blocks. What isn't compared is in one component already, so that no component is lost.

Words, and sets, are known by 64-bit hashes. Null ids, and texts that are null or without words, are linked with nothing. Repeated rows are equal
texts. Rows of one id but other texts are documents of their own; a component's id is the smallest of its rows. No documents: no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import components

WORDS, BANDS, ROWS, BITS = 5, 24, 5, 512
SAMPLES = BANDS * ROWS
#: The most texts of a bucket whose canopies are formed in one task; and of a block, with its most shingles.
BUCKET, BLOCK, BLOCK_SHINGLES = 4096, 2048, 4_000_000
_PLACE = C.seeds(WORDS, 11) | np.uint64(1)
_ROW = C.seeds(ROWS, 15) | np.uint64(1)
_BIT = (C.seeds(SAMPLES, 16) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(col: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, _, data, offs in C.chunks(col):
        data = C.LOWER[data]
        s, e, first = C.word_bounds(data, offs, C.BLANK_WORD)
        h = C.word_hashes(data, s, e)
        del data, s, e
        n = len(h) - words + 1
        if n > 0:
            sh = h[:n] * _PLACE[0]
            for i in range(1, words):
                sh += h[i : i + n] * _PLACE[i]
            C.splitmix(sh)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                u = np.sort(sh[a : b - words + 1])
                yield u[np.concatenate([[True], u[1:] != u[:-1]])]
            elif b > a:
                yield C.splitmix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield h[:0]


def band_count(percent: int) -> int:
    """The least number of bands of which a pair at the threshold shares none with a chance below one in a million."""
    p = (percent / 100) ** ROWS
    return 1 if p >= 1 else math.ceil(math.log(1e-6) / math.log1p(-p))


@functools.cache
def _sampling(samples: int) -> tuple[np.ndarray, np.ndarray]:
    flip, times = ((C.seeds(samples, salt) >> np.uint64(32)).astype(np.uint32) for salt in (12, 13))
    return flip[:, None], times[:, None] | np.uint32(1)


def min_samples(u: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    x = (u >> np.uint64(32)).astype(np.uint32)
    flip, times = _sampling(samples)
    out = np.full(samples, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, ((x[None, at : at + 4096] ^ flip) * times).min(axis=1), out=out)
    return out


def bands(m: np.ndarray) -> np.ndarray:
    keys = (m.reshape(-1, ROWS).astype(np.uint64) * _ROW).sum(axis=1) ^ C.seeds(len(m) // ROWS, 14)
    return C.splitmix(keys).view(np.int64)


def odd_sketch(m: np.ndarray) -> bytes:
    """Of the first samples, SAMPLES of them."""
    where = (m[:SAMPLES] * _BIT) >> np.uint32(32 - BITS.bit_length() + 1)
    return np.packbits((np.bincount(where, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def differing_bits(similarity: float) -> int:
    """Bits in which sketches are expected to differ at a similarity."""
    return round(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - similarity))))


LEADS, TAKES = differing_bits(0.9), differing_bits(0.6)  # at 0.85

SIGNATURE = "text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary"


def signatures(docs: DataFrame, key: str = "doc_id", percent: int = 85) -> DataFrame:
    samples = max(SAMPLES, band_count(percent) * ROWS)
    slim = docs.select(F.col(key).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(SIGNATURE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, band, sketch = [], [], [], []
            for u in shingle_sets(batch.column(2)):
                n.append(len(u))
                if len(u):
                    m = min_samples(u, samples)
                    digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    band.append(bands(m))
                    sketch.append(odd_sketch(m))
                else:
                    digest.append(None)
                    band.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=schema.names
            )

    return C.map_arrow(slim, run, schema)


def _canopies(batches: Iterator[pa.RecordBatch], takes: int = TAKES) -> Iterator[pa.RecordBatch]:
    """bkey, rep, sketch in the order of bkey -> edges a, b. All buckets of a batch take their leaders at once.

    Only what holds a bucket's canopies together is given out, so fewer edges than the bucket has texts.
    """
    held: pa.RecordBatch | None = None

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, rep = t.column(0).to_numpy(), t.column(1).to_numpy()
        sk = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint64).reshape(len(rep), -1)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bucket = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        waits = np.ones(len(rep), bool)
        part = np.arange(len(rep))  # the first row of each row's canopies so far
        live = np.arange(len(rep))
        while len(live):
            at = live[waits[live]]
            _, first = np.unique(bucket[at], return_index=True)
            lead = np.full(len(start), -1)
            lead[bucket[at[first]]] = at[first]
            live = live[lead[bucket[live]] >= 0]
            if not len(live):
                break
            far = np.bitwise_count(sk[live] ^ sk[lead[bucket[live]]]).sum(axis=1, dtype=np.int64)
            near = live[far <= takes]
            low = np.full(len(start), len(rep))
            np.minimum.at(low, bucket[near], part[near])
            to = np.arange(len(rep))
            to[part[near]] = low[bucket[near]]
            part = to[part]
            waits[live[far <= LEADS]] = False
        tied = np.flatnonzero(part != np.arange(len(rep)))
        pairs = np.unique(np.stack([rep[part[tied]], rep[tied]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([held, batch] if held is not None else [batch])
        key = t.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
        if last:
            yield solve(t.slice(0, last))
        held = t.slice(last).combine_chunks().to_batches()[0]
    if held is not None:
        yield solve(pa.Table.from_batches([held]))


def candidates(reps: DataFrame, percent: int = 85) -> DataFrame:
    """Edges a, b between texts of one canopy. reps: rep, bands, sketch."""
    takes = differing_bits(max(0.0, percent / 100 - 0.25))
    rows = reps.select("rep", F.explode("bands").alias("bkey"))
    buckets = rows.groupBy("bkey").agg(F.count("*").alias("c"), F.min("rep").alias("lead")).where("c > 1")
    shared = C.staged(rows.join(buckets, "bkey"), "buckets")
    small = shared.where(F.col("c") <= BUCKET).select("bkey", "rep").join(reps.select("rep", "sketch"), "rep").select("bkey", "rep", "sketch")
    edges = C.map_arrow(small.repartition("bkey").sortWithinPartitions("bkey", "rep"), functools.partial(_canopies, takes=takes), "a long, b long")
    return edges.union(shared.where((F.col("c") > BUCKET) & (F.col("rep") != F.col("lead"))).select("lead", "rep"))


class Roots:
    """Union-find over 0..n-1, the smallest as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def links(sets: list[np.ndarray], percent: int, queries: range | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each query: the other sets with 100 * intersection >= percent * union."""
    n = np.array([len(u) for u in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (n[0] + n[1] - both):
            yield 1, np.array([0])
        return
    owner = np.repeat(np.arange(len(sets)), n)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    ids = np.empty(len(flat), np.int64)
    head = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    ids[order] = np.cumsum(head) - 1
    posting = owner[order]
    begin = np.append(np.flatnonzero(head), len(flat))
    ends = np.cumsum(n)
    for i in queries if queries is not None else range(len(sets)):
        own = ids[ends[i] - n[i] : ends[i]]
        both = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), 1024):  # in steps, so that a common shingle doesn't fill the memory
            lo, hi = begin[own[at : at + 1024]], begin[own[at : at + 1024] + 1]
            size = hi - lo
            upto = np.cumsum(size)
            both += np.bincount(posting[np.repeat(lo - upto + size, size) + np.arange(upto[-1])], minlength=len(sets))
        hit = 100 * both >= percent * (n[i] + n - both)
        hit[i] = False
        found = np.flatnonzero(hit)
        if len(found):
            yield i, found


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple], list[np.ndarray]]]:
    """Runs of rows of the same first two columns; the last column is the text."""
    key, rows, sets = None, [], []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns[: width - 1]]
        for row, u in zip(zip(*cols, strict=True), shingle_sets(batch.column(width - 1)), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows, sets
                key, rows, sets = row[:2], [], []
            if not rows or rows[-1][2] != row[2]:  # repeated rows of a document are one
                rows.append(row)
                sets.append(u)
    if rows:
        yield key, rows, sets


def _solve(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """region, block, node, text -> node, root; the nodes of a block in order."""
        nodes, roots = [], []
        for _, rows, sets in _groups(batches, 4):
            r = Roots(len(rows))
            if len(rows) > 1:
                for i, found in links(sets, percent):
                    for j in found.tolist():
                        r.join(i, j)
            nodes += [x[2] for x in rows]
            roots += [rows[r.find(i)][2] for i in range(len(rows))]
            if len(nodes) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])
                nodes, roots = [], []
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])

    return run


def _visit(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """region, block, guest, node, root, text -> edges between roots. Guests come after the block's own."""
        for _, rows, sets in _visited(batches):
            guests = [i for i, x in enumerate(rows) if x[2]]
            a, b = [], []
            if guests and len(rows) > 1:
                root = np.array([x[4] for x in rows])
                for i, found in links(sets, percent, guests if len(rows) > 2 else None):
                    for j in np.unique(root[found]).tolist():
                        if j != root[i]:
                            a.append(int(root[i]))
                            b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], list[np.ndarray]]]:
    key, rows, sets = None, [], []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns[:5]]
        for row, u in zip(zip(*cols, strict=True), shingle_sets(batch.column(5)), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows, sets
                key, rows, sets = row[:2], [], []
            if not rows or rows[-1][2:4] != row[2:4]:
                rows.append(row)
                sets.append(u)
    if rows:
        yield key, rows, sets


def _large(dealt: DataFrame, solved: DataFrame, percent: int) -> DataFrame:
    """node and root over whole regions. dealt: region, blocks, block, node, text of the large regions; solved: node and root within blocks."""
    held = C.staged(dealt.join(solved, "node"), "large")
    schema = "a long, b long"

    def tour(guests: DataFrame, own: DataFrame) -> DataFrame:
        sent = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("region", "block", F.lit(True).alias("guest"), "node", "root", "text")
        rows = own.select("region", "block", F.lit(False).alias("guest"), "node", "root", "text").union(sent)
        return C.staged(C.map_arrow(rows.repartition("region", "block").sortWithinPartitions("region", "block", "guest", "node"), _visit(percent), schema), "links")

    def renamed(df: DataFrame, edges: DataFrame) -> DataFrame:
        to = components(edges).select(F.col("node").alias("_from"), F.col("root").alias("_to"))
        return df.join(to, F.col("root") == F.col("_from"), "left").withColumn("root", F.coalesce("_to", "root")).drop("_from", "_to")

    sizes = held.groupBy("region", "block", "root").agg(F.count("*").alias("c"))
    hubs = sizes.groupBy("region", "block").agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("hub")).select(F.col("hub").alias("node"))
    first = C.staged(renamed(held, tour(held.join(hubs, "node", "left_semi"), held)), "toured")
    sizes = first.groupBy("region", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("region").agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("main"))
    guests = first.join(main, "region").where("root <> main").drop("main")
    # regions of a single component by now need no further look
    open_ = first.join(guests.select("region").distinct(), "region", "left_semi")
    return renamed(first.select("node", "root"), tour(guests, open_))


def _components(docs: DataFrame, percent: int, key: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and first (whether the row is its component's: the smallest id and, of its texts, the smallest hash) of each document."""
    sig = C.staged(signatures(docs, key, percent), "signatures")
    first = F.struct("doc_id", "text_hash")
    reps = sig.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(first).alias("first"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("n"))
    reps = C.staged(reps.withColumn("rep", F.xxhash64("digest")), "texts")
    region = components(candidates(reps.select("rep", "bands", "sketch"), percent)).select("node", F.col("root").alias("region"))
    region = C.staged(region.join(reps.select(F.col("rep").alias("node"), "n", "first"), "node"), "regions")
    sizes = region.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = region.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(key).alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").cast("binary").alias("text"))
    on = (F.col("_id") == F.col("first.doc_id")) & (F.col("_hash") == F.col("first.text_hash"))
    full = texts.join(dealt.hint("merge"), on)  # one plan at every size: the texts are shuffled once, by id and hash
    solved = C.staged(C.map_arrow(full.select("region", "block", "node", "text").repartition("region", "block").sortWithinPartitions("region", "block", "node"), _solve(percent), "node long, root long"), "solved")
    large = sizes.where("blocks > 1")
    if large.limit(1).count():
        of_large = dealt.join(large.select("region"), "region", "left_semi").select("node")
        wide = _large(full.join(of_large, "node", "left_semi"), solved, percent).select("node", "root").distinct()
        solved = C.staged(solved.join(wide.select("node"), "node", "left_anti").union(wide), "solved")
    named = reps.select("digest", "rep", "first").join(solved.where("node <> root"), F.col("rep") == F.col("node"), "left").select("digest", "first", F.coalesce("root", "rep").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = C.staged(named.join(least, "root").select("digest", "least"), "named")
    out = sig.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    own = F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")), F.lit(True)) | F.col("doc_id").isNull()
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), own.alias("first"))


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept of each document. The key is a long."""
    out = _components(docs, percent, key)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """One document of each component, of the smallest id; all columns kept. A row is known by its id and its text's hash: rows of one id and unlike texts stay, equal rows are one."""
    gone = _components(docs, percent, key).where("NOT first").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.xxhash64("text").alias("_hash"))
    left = rows.join(gone.hint("merge"), (F.col("_key") == F.col("_gone")) & (F.col("_hash") == F.col("_gone_hash")), "left_anti")
    named = left.where("_key IS NOT NULL").groupBy("_key", "_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return named.select("_row.*").unionByName(left.where("_key IS NULL").select("_row.*"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
