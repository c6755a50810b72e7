"""Token counts by a two-tier lookup on the map side.

Each task tells its ``TOLD`` most frequent pre-tokens; of those summed, the ``FREQUENT`` most frequent are encoded once and broadcast as a compact
hash table. Other pre-tokens are encoded where they are met, and kept in a table of the worker's own, of bounded size. No
pre-token of the texts is shuffled, and no count depends on what a table happens to hold.

A null or empty text has no bytes and no tokens. Repeated rows are counted each on its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import tokens


TOLD, FREQUENT = 1 << 13, 1 << 16


def frequent(docs: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids and counts of ids of the pre-tokens that are frequent in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tokens.common_in(batches, path, TOLD)

    told = C.map_arrow(docs.select(F.col("text").cast("binary").alias("text")), run, "word binary, n long")
    top = told.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    return tokens.encoded(path, top.column(0).to_pylist())


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of each document. path: the vocabulary's file, at the same place on every machine."""
    slim = docs.select(F.col(key), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([slim.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    ready, name = docs.sparkSession.sparkContext.broadcast(frequent(docs, path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, name, ready.value)
        for batch in batches:
            n = enc.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(C.flat(batch.column(1))[1])), pa.array(n), pa.array(n > limit)], names=schema.names)

    return C.map_arrow(slim, run, schema)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(C.table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
