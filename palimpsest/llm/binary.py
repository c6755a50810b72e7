"""Token ids in flat files of unsigned integers, with 64-bit offsets, in ascending order of the documents' keys.

A dataset is a folder. Each part has ``part-N.bin`` (ids, little-endian, as narrow as the vocabulary allows: 16 or 32 bits),
``part-N.off`` (64-bit offsets of its documents in that file, in ids, one more than documents) and ``part-N.key`` (64-bit keys).
``manifest.json`` names the parts with their documents, ids and base: the ids of all parts before, a prefix sum. A document's start in the
whole dataset is its part's base and its offset. Parts are mapped into memory to be read.

A part is written under a name of its own attempt and then renamed, so a task that runs again after an executor was lost
leaves the same files. Folders are opened through Arrow, so they can be on any store it knows.

A null or empty text has the end id alone. Null keys come first. Rows of equal keys are ordered by their texts. No documents: no parts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tokens

NO_KEY = -(1 << 63)
PART = "part long, docs long, ids long"


def write(docs: DataFrame, place: str, path: str, end: int, key: str = "doc_id") -> dict:
    """Writes the dataset and returns its manifest. path: the vocabulary's file, at the same place on every machine."""
    ready = docs.sparkSession.sparkContext.broadcast(tokens.frequent(path))
    top = max(end, tokens.Encoder(path).most)
    kind = "<u2" if top < 1 << 16 else "<u4"
    store, folder = fs.FileSystem.from_uri(place)
    store.create_dir(folder, recursive=True)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col("text").cast("binary").alias("text"))
    ordered = slim.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, "vocabulary", ready.value)
        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(place)
        name, out = f"{folder}/part-{task.partitionId():06d}", None
        own = f"{folder}/attempt-{task.taskAttemptId()}"
        counts, keys, total = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{own}.bin")
            keys.append(batch.column(0).fill_null(NO_KEY).to_numpy(zero_copy_only=False))
            for ids, n in enc.ids(batch.column(1), end):
                out.write(ids.astype(kind).tobytes())
                counts.append(n)
                total += len(ids)
        if out is None:
            return
        out.close()
        counts, keys = np.concatenate(counts), np.concatenate(keys)
        for end_, data in (("off", np.concatenate([[0], np.cumsum(counts)]).astype("<i8")), ("key", keys.astype("<i8"))):
            with store.open_output_stream(f"{own}.{end_}") as f:
                f.write(data.tobytes())
        for end_ in ("bin", "off", "key"):
            if store.get_file_info(f"{name}.{end_}").type != fs.FileType.NotFound:
                store.delete_file(f"{name}.{end_}")
            store.move(f"{own}.{end_}", f"{name}.{end_}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([total], pa.int64())], names=["part", "docs", "ids"])

    parts = sorted(C.map_arrow(ordered, run, PART).collect())  # a row for each file
    bases = np.concatenate([[0], np.cumsum([p.ids for p in parts])]).tolist()
    manifest = {"dtype": kind, "end": end, "parts": [{"name": f"part-{p.part:06d}", "docs": p.docs, "ids": p.ids, "base": int(b)} for p, b in zip(parts, bases, strict=False)]}
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _opened(store: fs.FileSystem, name: str):
    return pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)


def part_arrays(place: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and keys of a part."""
    store, folder = fs.FileSystem.from_uri(place)
    with _opened(store, f"{folder}/{name}.off") as a, _opened(store, f"{folder}/{name}.key") as b:
        return np.frombuffer(a.read(), "<i8"), np.frombuffer(b.read(), "<i8")


def read_ids(place: str, name: str, dtype: str, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of each document of a part, in order, from mapped memory."""
    store, folder = fs.FileSystem.from_uri(place)
    width = np.dtype(dtype).itemsize
    with _opened(store, f"{folder}/{name}.bin") as f:
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            f.seek(a * width)
            yield np.frombuffer(f.read_buffer((b - a) * width), dtype)


def digest(spark, place: str, manifest: dict, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of each document, read from the files."""
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"
    dtype = manifest["dtype"]
    parts = spark.createDataFrame([(p["name"], p["base"]) for p in manifest["parts"]], "name string, base long")
    parts = parts.repartition(max(1, len(manifest["parts"])), F.col("name")) if manifest["parts"] else parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                offsets, keys = part_arrays(place, name)
                crc = np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in read_ids(place, name, dtype, offsets)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=keys == NO_KEY), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc)], names=[key, "start", "n_tokens", "ids_crc32"]
                )

    return C.map_arrow(parts, run, schema)


def round_trip(docs: DataFrame, path: str, end: int = 2, key: str = "doc_id") -> DataFrame:
    """Writes the documents into a new folder of the shared one, and reads their digests back."""
    spark = docs.sparkSession
    place = C.new_place(spark, "ids")
    if "://" not in place:
        place = "file://" + place if place.startswith("/") else place
    return digest(spark, place, write(docs, place, path, end, key), key)


def op7_binary_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(C.table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
