"""WARC files as a source and sink of Spark: ``df.write.format("warc")``, ``spark.read.format("warc")``.

Each task writes one zstd stream of resource records, compressed as they come, in an attempt file of its own; when all tasks are done, the driver puts these in place and writes the manifest, a record
dated by the final row of all, which lists the parts. A task that fails deletes its file, and so does a job; attempts that nobody heard of again are deleted when the job is done. The
manifest is the first of the files by name, so the files one after another are one stream.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.objects import MANIFEST, warc_record

SCHEMA = "url string, body binary, committed_ms long, crawl_result_id long"
END = ".warc.zst"
_PENDING = ".attempt-"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file, how many records and bytes of bodies, and its last row."""

    file: str
    part: int
    records: int
    raw_bytes: int
    last: tuple[int, int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, mode: str, overwrite: bool):
        self.path, self.mode, self.overwrite = path, mode, overwrite
        store, folder = _place(path)
        #: Where attempts write; a task that outlives its job finds it gone.
        self.attempts = f"{folder}/{_PENDING}{uuid.uuid4().hex}"
        store.create_dir(self.attempts, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        store, _ = _place(self.path)
        file = f"{self.attempts}/{task.taskAttemptId()}"
        out, records, size, last = None, 0, 0, (0, 0)
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "body", "committed_ms", "crawl_result_id")]
                for url, body, at, i in zip(*columns, strict=True):
                    last = max(last, (at, i))
                    if body is None:
                        continue
                    if out is None:
                        out = store.open_output_stream(file, compression=None)
                        z = zstandard.ZstdCompressor(level=3).compressobj()
                    out.write(z.compress(warc_record(url.split("#")[0], body, at)))
                    records, size = records + 1, size + len(body)
            if out is not None:
                out.write(z.flush())
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(file)
            raise
        return Part(file if records else "", task.partitionId(), records, size, last)

    def commit(self, messages: list[Part | None]) -> None:
        import zstandard

        store, folder = _place(self.path)
        job = self.attempts[-32:]
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(folder)):
                if x.base_name.endswith(END):
                    store.delete_file(x.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        told, final = [], max((m.last for m in parts), default=(0, 0))
        for m in parts:
            if m.file:
                name = f"part-{m.part:06d}-{job}{END}"
                store.move(m.file, f"{folder}/{name}")
                told.append({"name": name, "records": m.records, "raw_bytes": m.raw_bytes, "last": {"committed_at_unix_millis": m.last[0], "crawl_result_id": m.last[1]}})
        text = json.dumps({"format": "palimpsest-warc-export-1", "mode": self.mode, "parts": told, "records": sum(m.records for m in parts)}, sort_keys=True)
        with store.open_output_stream(f"{self.attempts}/manifest", compression=None) as f:
            f.write(zstandard.ZstdCompressor(level=3).compress(warc_record(MANIFEST, text.encode(), final[0])))
        store.move(f"{self.attempts}/manifest", f"{folder}/manifest-{job}{END}")
        store.delete_dir(self.attempts)

    def abort(self, messages: list[Part | None]) -> None:
        _place(self.path)[0].delete_dir(self.attempts)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and bodies of a stream of WARC records, one at a time."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.0":
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        body = stream.read(int(headers["Content-Length"]))
        if len(body) != int(headers["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        yield headers, body


class WarcReader(DataSourceReader):
    """A task for each file; manifests are left out. committed_ms is to the second, and a record doesn't tell crawl_result_id."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, folder = _place(self.path)
        files = [folder] if folder.endswith(END) else sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.endswith(END))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import io
        from datetime import datetime

        import zstandard

        store, _ = _place(self.path)
        with store.open_input_stream(partition.value, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as plain:
            for headers, body in records(io.BufferedReader(plain, 1 << 20)):
                if headers["WARC-Target-URI"] != MANIFEST:
                    yield headers["WARC-Target-URI"], body, int(datetime.fromisoformat(headers["WARC-Date"]).timestamp()) * 1000, None


class Warc(DataSource):
    """Options: path, and mode (the audience, told in the manifest). Columns: url, body (without one a row only counts for the time), committed_ms, crawl_result_id."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("mode", "archive"), overwrite)


def register(spark) -> None:
    """Makes the format known to a session and its executors."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(Warc)
