"""Session-level helpers: shared scratch tables and shipping the package to workers."""

from __future__ import annotations

import atexit
import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the cluster names it in spark.checkpoint.dir.

    A folder of our own is used only where the setting is absent and the master is local, as in tests.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"/tmp/larder-{os.getpid()}"
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str = "t") -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/larder/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and read them back.

    The copy survives the loss of any executor and keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larder_path = path
    return out


def spread(df: DataFrame, *keys: str, parts: int = 0) -> DataFrame:
    """The rows in enough partitions for all cores, `parts` at least, by the keys where there are any.

    Narrow rows of a small file are one task, and what a shuffle leaves of compressible rows is few, however much work each row stands for;
    the number is given, so that nothing puts them together again by their bytes. It shuffles the rows, so it stands before they are widened.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, parts)
    return df.repartition(n, *keys)


def forget(df: DataFrame) -> None:
    """Remove a table made by materialize() that nothing will read again."""
    path = getattr(df, "_larder_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    """Remove what was written; where one path can't be, the others still are."""
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: S112  the JVM may have gone; its shared folder is the cluster's to clean
            continue


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through the file system that the path names."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was not started from its folder.

    The package goes as an archive to the shared folder, through its own file system, and from there to the workers.
    """
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if _ROOT in (os.path.abspath(p) for p in known if p):
        return
    if _ROOT not in sys.path:
        sys.path.insert(0, _ROOT)
    if getattr(spark, "_larder_shipped", False):
        return
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in Path(_ROOT, "larder").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    path = f"{shared_dir(spark)}/larder/src-{uuid.uuid4().hex}.zip"
    _write(spark, path, data.getvalue())
    _written.append((spark, path))
    spark.sparkContext.addPyFile(path)
    spark._larder_shipped = True
