"""Session helpers: a local session with the settings that the engine expects, and the package on every executor."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_held = threading.local()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; conf: further settings, with _ for a dot."""
    b = SparkSession.builder.master(f"local[{cores}]")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_place(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, on one machine alone, a new temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_place, "own"):
        shared_place.own = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return shared_place.own


def new_place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver's JVM ends."""
    place = f"{shared_place(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    if getattr(_held, "places", None) is not None:
        _held.places.append(place)
    return place


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what this thread has put into new places meanwhile: for work whose result is written elsewhere by then."""
    outer, _held.places = getattr(_held, "places", None), []
    try:
        yield
    finally:
        places, _held.places = _held.places, outer
        for place in places:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark, place = df.sparkSession, new_place(df.sparkSession, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def release_memory() -> None:
    """Gives what a task has freed back to the machine; workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors' Python path, once for each application, so that they needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest.zip")
    with zipfile.ZipFile(place, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("palimpsest", os.path.relpath(full, root)))
    sc.addPyFile(place)
    _shipped.add(sc.applicationId)
