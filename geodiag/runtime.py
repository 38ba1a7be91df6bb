"""Session plumbing: shared scratch tables and shipping of the package to Python workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_CLEARED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the setting is absent and the master local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = own.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="geodiag-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, in a folder of the application that goes when its driver ends."""
    root = f"{shared_dir(spark)}/geodiag/{spark.sparkContext.applicationId}"
    if root not in _CLEARED:
        _CLEARED.add(root)
        atexit.register(_clear, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def _clear(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back (all executors see it)."""
    path = scratch_path(df.sparkSession, tag)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written go when it is written, and not when the driver's collector comes by."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(df: DataFrame | None) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that worker imports don't depend on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "geodiag_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
