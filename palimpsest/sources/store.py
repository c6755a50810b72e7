"""Several Parquet tables that change together: an atomic commit over files.

A commit writes new files first, which nobody reads yet, and then renames one manifest into place: it says which files are which table's. Readers follow a manifest, so they see all of
a commit or nothing of it, and a version that was read once stays as it is. Two writers that start from the same version can't both win, as a manifest of a number is made once; the loser
gets a Conflict and may try again. A writer numbers its batches: one that was committed already is not committed again.

Tables that only grow are lists of folders. Keyed tables are split in buckets by a hash of the key; a commit rewrites the buckets that its keys are in, and no others. Files that no kept manifest
names (of commits that died, or of old versions) are deleted by ``vacuum``. Folders may be in any file system that Spark reads; a rename must be atomic there, as HDFS's is.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since."""


@dataclass
class Append:
    """Rows to add to a table that only grows; order: columns by whose ranges files are made, so that their statistics tell readers what to skip. by: a column by whose hash rows are
    dealt to buckets instead, in that order within each, so that the rows of one value are found in one bucket (``Store.look_up``)."""

    rows: DataFrame
    order: tuple[str, ...] = ()
    by: str | None = None


@dataclass
class Merge:
    """Rows to put in a keyed table in place of those of equal keys, and keys to take out. A key is in one of them, once."""

    rows: DataFrame
    gone: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, place: str, keys: dict[str, str], buckets: int = BUCKETS, blooms: dict[str, tuple[str, ...]] | None = None, row_group_bytes: int = 16 << 20):
        """keys: the key column of each keyed table; any other table only grows. blooms: columns of tables that rows are looked up by besides, which get a Bloom filter for each row group."""
        self.spark, self.place, self.keys, self.buckets, self.blooms, self.row_group_bytes = spark, place.rstrip("/"), keys, buckets, blooms or {}, row_group_bytes
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.place).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._plain = spark.sparkContext._gateway.new_array(rename, 1)
        self._plain[0] = rename.NONE  # fails where there is a file already

    # manifests

    def versions(self) -> list[int]:
        top = self._path(f"{self.place}/_manifests")
        if not self._fs.exists(top):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in self._fs.listStatus(top) if x.getPath().getName().endswith(".json") and not x.getPath().getName().startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """What a version is made of; the last one's, if none is given."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "writers": {}, "facts": {}}
        stream = self._fs.open(self._path(self._named(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _named(self, version: int) -> str:
        return f"{self.place}/_manifests/{version:012d}.json"

    def _publish(self, manifest: dict) -> None:
        temporary = self._path(f"{self.place}/_manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        try:
            self._files.rename(temporary, self._path(self._named(manifest["version"])), self._plain)
        except Exception as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} was committed by another writer") from e
            raise

    # readers

    def read(self, table: str, version: int | None = None, of: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table as of a version; None before its first commit. of: the buckets to read alone."""
        entry = (manifest or self.manifest(version))["tables"].get(table)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.place}/{p}" for b, ps in entry["parts"].items() if of is None or int(b or 0) in of for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        m = self.manifest(version)
        return {t: self.read(t, manifest=m) for t in m["tables"]}

    def look_up(self, table: str, value) -> DataFrame:
        """The rows of a key (or of a value of the column that a growing table's buckets go by), from their one bucket. Files are in that order, so few row groups are read."""
        m = self.manifest()
        column = self.keys.get(table) or m["tables"][table]["by"]
        lit = F.lit(value).cast(StructType.fromJson(m["tables"][table]["schema"])[column].dataType)
        bucket = self.spark.range(1).select(self._bucket(lit)).first()[0]
        return self.read(table, of=[bucket], manifest=m).where(F.col(column) == lit)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # the writer

    def commit(self, changes: dict[str, Append | Merge], writer: str | None = None, batch: int | None = None, facts: dict | None = None, base: int | None = None) -> int:
        """Makes the changes (to any tables) as one version, and returns it. base: the version that they were made from, else the last.

        A batch of a writer whose number isn't above its last one's was committed before: nothing happens. facts: small values kept with the version. Whatever fails before the manifest is in
        place leaves readers with the version before.
        """
        old = self.manifest(base)
        if batch is not None and batch <= old["writers"].get(writer, -1):
            return old["version"]
        tables = dict(old["tables"])
        for name, change in changes.items():
            tables[name] = self._merged(name, change, old) if isinstance(change, Merge) else self._appended(name, change, old)
        writers = old["writers"] | ({writer: batch} if batch is not None else {})
        self._publish({"version": old["version"] + 1, "tables": tables, "writers": writers, "facts": old["facts"] | (facts or {})})
        return old["version"] + 1

    def _new_folder(self, name: str) -> str:
        return f"data/{name}/{uuid.uuid4().hex}"

    def _writer(self, name: str, rows: DataFrame):
        out = rows.write.option("parquet.block.size", self.row_group_bytes)
        for c in self.blooms.get(name, ()):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        return out

    def _dealt(self, name: str, folder: str, rows: DataFrame, by: str, order: tuple[str, ...], buckets: list[int]) -> dict[str, str]:
        """Writes rows by buckets of a column; each bucket's folder. One that has no rows has none."""
        self._writer(name, rows.withColumn("_bucket", self._bucket(F.col(by))).repartition(max(1, len(buckets)), "_bucket").sortWithinPartitions("_bucket", *order)).partitionBy("_bucket").parquet(f"{self.place}/{folder}")
        return {str(b): f"{folder}/_bucket={b}" for b in buckets if self._fs.exists(self._path(f"{self.place}/{folder}/_bucket={b}"))}

    def _touched(self, keys: DataFrame, column: str) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(F.col(column)).alias("b")).distinct().collect())  # as many as there are buckets, at most

    def _appended(self, name: str, change: Append, old: dict) -> dict:
        entry, folder = old["tables"].get(name), self._new_folder(name)
        rows = change.rows if entry is None else change.rows.select([f.name for f in StructType.fromJson(entry["schema"])])
        parts = {b: list(ps) for b, ps in entry["parts"].items()} if entry else {}
        if change.by:
            for b, p in self._dealt(name, folder, rows, change.by, change.order, self._touched(rows, change.by)).items():
                parts[b] = [*parts.get(b, []), p]
        else:
            if change.order:
                rows = rows.repartitionByRange(*change.order).sortWithinPartitions(*change.order)
            self._writer(name, rows).parquet(f"{self.place}/{folder}")
            parts[""] = [*parts.get("", []), folder]
        return {"schema": entry["schema"] if entry else rows.schema.jsonValue(), "parts": parts, "by": change.by}

    def _merged(self, name: str, change: Merge, old: dict) -> dict:
        entry, folder, key = old["tables"].get(name), self._new_folder(name), self.keys[name]
        rows = change.rows if entry is None else change.rows.select([f.name for f in StructType.fromJson(entry["schema"])])
        asked = rows.select(key) if change.gone is None else rows.select(key).union(change.gone.select(key))
        touched = self._touched(asked, key)
        stays = self.read(name, of=touched, manifest=old)
        if stays is not None:
            rows = stays.join(asked, key, "left_anti").select(rows.columns).unionByName(rows)
        written = self._dealt(name, folder, rows, key, (key,), touched)
        kept = {b: p for b, p in (entry["parts"] if entry else {}).items() if int(b) not in touched}
        return {"schema": entry["schema"] if entry else change.rows.schema.jsonValue(), "parts": kept | {b: [p] for b, p in written.items()}}

    def compact(self, name: str, order: tuple[str, ...] = ()) -> int:
        """A growing table's folders as one (for each bucket, where it has them), as a version of its own."""
        old = self.manifest()
        folder, rows, by = self._new_folder(name), self.read(name, manifest=old), old["tables"][name].get("by")
        if by:
            parts = {b: [p] for b, p in self._dealt(name, folder, rows, by, order or (by,), sorted(map(int, old["tables"][name]["parts"]))).items()}
        else:
            self._writer(name, rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).parquet(f"{self.place}/{folder}")
            parts = {"": [folder]}
        tables = old["tables"] | {name: old["tables"][name] | {"parts": parts}}
        self._publish(old | {"version": old["version"] + 1, "tables": tables})
        return old["version"] + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the last few versions don't name, and older manifests; how many folders went. No other writer may be at work."""
        versions = self.versions()
        named = {p.split("/")[2] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for ps in t["parts"].values() for p in ps}
        gone = 0
        data = self._path(f"{self.place}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(table.getPath()):
                if folder.getPath().getName() not in named:
                    self._fs.delete(folder.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._named(v)), False)
        return gone
