"""What depends on the cluster: shipping this package to Python workers, and tables in the folder that all executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[str] = []  # by materialize, in order


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it came from an archive that the workers have already
        with tempfile.TemporaryDirectory() as d:
            copy = Path(d, "code", package.name)
            shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
            own = tempfile.mkdtemp(prefix="seriesmill-code-")
            context.addPyFile(shutil.make_archive(f"{own}/{package.name}", "zip", copy.parent))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; local sessions without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seriesmill-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seriesmill_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the files behind a materialised table that nothing will read again."""
    if path := getattr(df, "_seriesmill_path", None):
        _delete(df.sparkSession, path)


def mark() -> int:
    """A point in the order of materialised tables, for sweep."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: Sequence[DataFrame] = ()) -> None:
    """Deletes all tables materialised since a mark, but those to keep: what they fed has been written."""
    kept = {getattr(df, "_seriesmill_path", None) for df in keep}
    for path in _written[since:]:
        if path not in kept:
            _delete(spark, path)
    _written[since:] = [path for path in _written[since:] if path in kept]
