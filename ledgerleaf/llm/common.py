"""Shared storage, documents input and small helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()
_own: list[str] = []
_shipped: set[str] = set()
#: In a Python worker: the operator that ran last, and what empties the caches that operators keep there.
_at_work: list[str] = []
forgets: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="ledgerleaf-"))
    return _own[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/ledgerleaf/{tag}-{next(_serial)}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder and read again. Survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing lazy refers to any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    release(spark)


def release(spark: SparkSession | None = None) -> None:
    """Let Spark's cleaner see that finished jobs' shuffle files are unreferenced, rather than wait for a full heap."""
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def shipped(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="ledgerleaf-src-")) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at.resolve()))
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch of whole texts holds; Python workers stay within their memory."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def at_work(operator: str) -> None:
    """In a Python worker, which Spark uses again: another operator's caches go, and their memory back to the system."""
    if _at_work == [operator]:
        return
    if _at_work:
        for forget in forgets:
            forget()
        rested()
    _at_work[:] = [operator]


def rested() -> None:
    """At a task's end in a Python worker, which may stay idle: what is free goes back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that does not clash, in any case, with one of the input's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
