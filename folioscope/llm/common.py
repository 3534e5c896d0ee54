"""Helpers shared by the training-data operators: shared storage, word rules, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python at once, so that the objects of one slice stay small.
SLICE_BYTES = 2 << 20

_local_dir: str | None = None

_caches: dict[str, Callable[[], None]] = {}
_inside: str | None = None


def cache(name: str, clear: Callable[[], None]) -> None:
    """Announces what a Python worker keeps between tasks for operator name, and how to drop it."""
    _caches[name] = clear


def enter(name: str) -> None:
    """Called where a task of operator name begins: workers live on, so the other operators' caches go."""
    global _inside
    if _inside == name:
        return
    _inside = name
    for other, clear in _caches.items():
        if other != name:
            clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Only where that is unset and the session is local
    (as in tests) a temporary folder is made.
    """
    global _local_dir
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(_local_dir)
    return _local_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back; removed when the driver ends.

    Asks for the driver's garbage, so that the shuffle files of finished plans do not stay on the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what written() has written, once nothing reads it any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, if it can."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is only scratch
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each slice holds about SLICE_BYTES of data (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        per_row = max(1, batch.nbytes // n)
        step = max(1, SLICE_BYTES // per_row)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, name: str) -> DataFrame:
    """mapInArrow over slices of bounded size, for operator name; fn maps one slice to one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(name)
        for part in slices(batches):
            yield fn(part)

    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only and splits at ASCII white space; both are what bytes methods do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
