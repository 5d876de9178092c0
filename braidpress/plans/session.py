"""Session-level helpers: shipping the package, shared scratch tables, adaptive partition counts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Arrow batches between the JVM and workers, by rows and bytes: texts are long, and each side holds a batch or two.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("64MB", "4MB")}


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session has Spark's own defaults."""
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(name, default) in (default, "67108864", "67108864b", "64m"):
            spark.conf.set(name, ours)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so workers need no shared install."""
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def tidy(run):
    """A worker's Arrow function that gives memory back when its partition ends.

    Workers serve many stages. Without this, freed arrays stay with the allocators: glibc raises its threshold
    for separate mappings with each large block, and Arrow's pool keeps what it had at most. The thresholds are
    fixed above the usual size of an array, or each one would be mapped, and its pages zeroed, anew.
    """

    def wrapped(batches):
        import pyarrow

        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD: what may stay free at the top while the partition runs
        except (OSError, AttributeError):
            libc = None
        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)

    return wrapped


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only in local mode, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {master} has several machines")
        found = f"file://{tempfile.mkdtemp(prefix='braidpress-')}"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive lost executors, carry exact sizes for adaptive execution, and are compressed.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._braidpress_path = path
    return out


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows by columns over a fixed number of partitions, ahead of a step that costs much for each row.

    A stated number keeps adaptive execution from merging partitions that are small in bytes but not in work.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing lazily reads any more."""
    path = getattr(df, "_braidpress_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
