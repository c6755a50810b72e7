"""Bodies by their digests: put, get, verify and export."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..session import release_memory, ship

PLAIN, ZSTD = 0, 1
#: The address of a batch's manifest record.
MANIFEST = "urn:batch:manifest"


#: Bytes of bodies that a worker gives back at once.
PIECE = 1 << 22


def _bodies(col: pa.Array) -> Iterator[memoryview | None]:
    """Values of a binary column, in place."""
    for x in col:
        yield None if not x.is_valid else memoryview(x.as_buffer())


def _pieces(values: Iterator, size, kind: pa.DataType) -> Iterator[pa.Array]:
    """Arrays of values, of about PIECE bytes each; size: of a value."""
    some, held = [], 0
    for v in values:
        some.append(v)
        held += size(v)
        if held >= PIECE:
            yield pa.array(some, kind)
            some, held = [], 0
    if some:
        yield pa.array(some, kind)


@F.arrow_udf(BinaryType())
def blake2b_256(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The digest by which a body is known."""
    try:
        for col in batches:
            yield pa.array([None if b is None else hashlib.blake2b(b, digest_size=32).digest() for b in _bodies(col)], pa.binary())
            release_memory()
    finally:
        release_memory()


#: So that Spark doesn't compute a digest once more for each "is not null" that it infers of a key, in a second worker beside the first.
blake2b_256 = blake2b_256.asNondeterministic()


@F.arrow_udf(StructType([StructField("format", IntegerType()), StructField("data", BinaryType())]))
def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compressed at level 3 where that is smaller."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    kind = pa.struct([("format", pa.int32()), ("data", pa.binary())])

    def one(b):
        small = z.compress(b)
        return {"format": ZSTD, "data": small} if len(small) < len(b) else {"format": PLAIN, "data": bytes(b)}

    try:
        for col in batches:
            yield from _pieces(map(one, _bodies(col)), lambda v: len(v["data"]), kind)
            release_memory()
    finally:
        release_memory()


@F.arrow_udf(BinaryType())
def decode(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The body again; an error if its size isn't what it should be."""
    import zstandard

    z = zstandard.ZstdDecompressor()

    def one(f, d, n):
        out = bytes(d) if f == PLAIN else z.decompress(d, max_output_size=n)
        if len(out) != n:
            raise ValueError(f"stored object has {len(out)} bytes, not {n}")
        return out

    try:
        for fmt, data, raw_bytes in batches:
            yield from _pieces(map(one, fmt.to_pylist(), _bodies(data), raw_bytes.to_pylist()), len, pa.binary())
            release_memory()
    finally:
        release_memory()


def put(store: DataFrame, bodies: DataFrame) -> DataFrame:
    """The store with new bodies (a column body): each digest once. Bodies of one digest that aren't equal, among the new ones or with one that is stored, are an error.

    New bodies are shuffled once, by digest; equal ones meet there, and what the store has of that digest.
    """
    ship(bodies.sparkSession)
    keyed = bodies.select(blake2b_256("body").alias("blake2b_256"), "body").withColumn("_sum", F.sha2("body", 256))
    once = keyed.groupBy("blake2b_256").agg(F.min_by("body", "_sum").alias("body"), (F.min("_sum") != F.max("_sum")).alias("_differ"))
    both = once.join(store.select("blake2b_256", F.col("raw_bytes").alias("_n"), F.col("format").alias("_format"), F.col("data").alias("_data")), "blake2b_256", "left")
    known = F.col("_n").isNotNull()
    both = both.withColumn("_stored", F.when(known, decode(F.coalesce("_format", F.lit(PLAIN)), F.coalesce("_data", F.lit(b"")), F.coalesce("_n", F.lit(0)))))
    clash = F.col("_differ") | (known & (F.col("_stored") != F.col("body")))
    new = both.where(F.when(clash, F.raise_error(F.concat(F.lit("digest collision: "), F.lower(F.hex("blake2b_256")))).cast("boolean")).otherwise(~known))
    new = new.select("blake2b_256", F.length("body").cast("long").alias("raw_bytes"), encode("body").alias("e"))
    return store.unionByName(new.select("blake2b_256", "raw_bytes", "e.format", "e.data"))


def get_many(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """position, blake2b_256, body for each wanted row (position, blake2b_256, raw_bytes), repeats included. A body that the store lacks, or has in another size, is an error, and so are two sizes wanted of one."""
    ship(store.sparkSession)
    hashes = wanted.select("blake2b_256").distinct()
    found = store.join(hashes, "blake2b_256", "left_semi").select("blake2b_256", F.col("raw_bytes").alias("_n"), decode("format", "data", "raw_bytes").alias("body"))
    rows = wanted.join(found, "blake2b_256", "left")
    fault = F.when(F.col("_n").isNull(), "unavailable object").when(F.col("_n") != F.col("raw_bytes"), "object of another size")
    failed = F.raise_error(F.concat(fault, F.lit(" "), F.lower(F.hex("blake2b_256"))))
    return rows.select("position", "blake2b_256", F.when(fault.isNotNull(), failed.cast("binary")).otherwise(F.col("body")).alias("body"))


def verified(bodies: DataFrame) -> DataFrame:
    """bodies (blake2b_256, body, ..) as they are; one whose digest isn't its own is an error."""
    ship(bodies.sparkSession)
    wrong = F.col("_own") != F.col("blake2b_256")
    body = F.when(wrong, F.raise_error(F.concat(F.lit("body disagrees with its digest "), F.lower(F.hex("blake2b_256")))).cast("binary")).otherwise(F.col("body"))
    return bodies.withColumn("_own", blake2b_256("body")).withColumn("body", body).drop("_own")


def exists(store: DataFrame, wanted: DataFrame, digest: str = "blake2b_256") -> DataFrame:
    """wanted with present: whether the store has the digest."""
    return wanted.join(store.select(digest).distinct().withColumn("_in", F.lit(True)), digest, "left").withColumn("present", F.coalesce("_in", F.lit(False))).drop("_in")


def warc_record(target: str, body: bytes, millis: int, record: uuid.UUID | None = None) -> bytes:
    """A WARC/1.0 resource record. A target with a line break is refused."""
    if "\r" in target or "\n" in target:
        raise ValueError("invalid WARC target")
    date = datetime.fromtimestamp(millis // 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = {"WARC-Type": "resource", "WARC-Target-URI": target, "WARC-Date": date, "WARC-Record-ID": f"<urn:uuid:{record or uuid.uuid4()}>", "Content-Type": "application/octet-stream", "Content-Length": str(len(body))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def warc_batch(rows: DataFrame, document: DataFrame) -> DataFrame:
    """One row: data, a batch as one zstd stream: its manifest, dated by the final row, then the bodies that it includes, in their order.

    rows: a batch's rows (url, body, body_state, committed_ms, crawl_result_id), whose bodies are BATCH_BYTES at most; document: its manifest (feed.batch_document).
    """
    ship(rows.sparkSession)
    bodies = rows.where("body_state = 'included'").select(F.lit(1).alias("place"), "committed_ms", "crawl_result_id", "url", "body")
    first = document.select(F.lit(0).alias("place"), "committed_ms", F.lit(0).cast("long").alias("crawl_result_id"), F.lit(MANIFEST).alias("url"), F.encode("json", "UTF-8").alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        stream, some = _Stream(zstandard.ZstdCompressor(level=3).compressobj()), False
        for pdf in batches:
            for u, b, t in zip(pdf.url, pdf.body, pdf.committed_ms, strict=True):
                stream.write(warc_record(u.split("#")[0], bytes(b), int(t)))
                some = True
        if some:
            yield pd.DataFrame({"data": [stream.flush()]})

    ordered = first.unionByName(bodies).repartition(1).sortWithinPartitions("place", "committed_ms", "crawl_result_id")  # a batch: bounded rows and bytes
    return ordered.select("url", "body", "committed_ms").mapInPandas(run, "data binary")


class _Stream:
    """Records compressed as they come."""

    def __init__(self, z):
        self.z, self.out = z, []

    def write(self, record: bytes) -> None:
        self.out.append(self.z.compress(record))

    def flush(self) -> bytes:
        return b"".join([*self.out, self.z.flush()])
