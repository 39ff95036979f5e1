"""Helpers shared by the operators: shared folder, written intermediate tables, tokens."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_caches: dict = {}

#: White space of the contracts: space and U+0009 to U+000D. bytes.split() without arguments cuts at exactly these.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """A folder of the application's in the one that driver and executors share, spark.checkpoint.dir; it goes when the driver ends.

    A temporary one only where that is unset and all run on one machine."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _own:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        _own[app] = f"{named.rstrip('/')}/sedge-{app}" if named else "file://" + tempfile.mkdtemp(prefix="sedge-shared-")
        path = context._jvm.org.apache.hadoop.fs.Path(_own[app])
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _own[app]


#: Whether Spark deletes the shuffle files of a command as it ends; else they stay until the driver happens to collect its garbage.
DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the table to the shared folder and read it again, so that a lost executor costs no recomputation.

    The shuffle files of the write go with it: the disk of an operator is that of its largest step, not of all its steps."""
    conf = df.sparkSession.conf
    path, before = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", conf.get(DROPS, None)
    conf.set(DROPS, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(DROPS) if before is None else conf.set(DROPS, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(key, make: Callable):
    """What a Python worker keeps from task to task, of one operator at a time: another key drops it and gives the memory back."""
    if key not in _caches:
        _caches.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _caches[key] = make()
    return _caches[key]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches of long texts stay small in the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(doc_id.cast("string")) % n


def words(text: str | None) -> list[bytes]:
    """ASCII-lowered words between white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python tuples of the named columns, batch by batch."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
