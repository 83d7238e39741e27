"""Session helpers shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark application, and bound the rows of an Arrow batch.

    The archive is served by the driver's file server, so executors need no
    shared folder and no installation.
    """
    # texts are long: Spark's 10,000 rows in an Arrow batch would take too much of an executor
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"{_ROOT.name}/{p.relative_to(_ROOT)}")
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")
    path = os.path.join(folder, f"{_ROOT.name}.zip")
    Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def give_back() -> None:
    """Return the freed memory of this process to the system, where its allocator can.

    Python workers outlive their tasks, and an idle one counts towards its executor's memory as it was left.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run):
    """A function of batches that gives its memory back when it has ended."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, from ``spark.checkpoint.dir``; a temporary one in local mode where it is unset, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: With it, Spark removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df):
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder; the files of its shuffles go when it is written."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    once = df.select("*")  # a query of its own takes the setting
    spark.conf.set(_CLEANUP, before)
    return once.checkpoint(eager=True)


def shuffles_of(rdd) -> list[int]:
    """The numbers of the shuffles that an RDD reads directly."""
    out, todo = [], [rdd._jrdd.rdd()]
    while todo:
        deps = todo.pop().dependencies()
        for k in range(deps.size()):
            dep = deps.apply(k)
            if dep.getClass().getSimpleName() == "ShuffleDependency":
                out.append(dep.shuffleId())
            else:
                todo.append(dep.rdd())
    return out


def forget(spark: SparkSession, shuffles: list[int]) -> None:
    """Remove the files of shuffles whose results are checkpointed, so that nothing will read them again."""
    cleaner = spark.sparkContext._jsc.sc().cleaner()
    if cleaner.isDefined():
        for k in shuffles:
            cleaner.get().doCleanupShuffle(k, False)
