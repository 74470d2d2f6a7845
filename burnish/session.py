"""Session settings, and the shared folder for tables written on the way."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Where the cluster names no folder, a session may be given one under this name.
OWN_DIR = "burnish.scratch.dir"

# The JVM leaves methods above 8000 bytes uncompiled. Past this limit Spark cuts a
# long projection into small methods instead of running one long one interpreted;
# its own default is far higher.
_METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")

_SHIPPED: set[str] = set()

# Paths written since each open ``scratch`` began, innermost last.
_OPEN: list[list[str]] = []


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, which need not find it where the driver does."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED and package.is_dir():
        folder = tempfile.mkdtemp(prefix="burnish-code-")  # the driver serves the file; executors fetch it
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)
    return spark


def tuned(spark: SparkSession) -> SparkSession:
    """Session settings that suit wide projections with many rules."""
    spark.conf.set(*_METHOD_LIMIT)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it, or as the session was given one.

    There is no default: a folder of one machine would be lost on a cluster.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(OWN_DIR, None)
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_DIR} (or {OWN_DIR} in the session) to a folder all executors share")
    return named.rstrip("/")


def use_folder(spark: SparkSession, folder: str) -> SparkSession:
    """Give the session a folder, unless the cluster has named one."""
    if not spark.conf.get(CHECKPOINT_DIR, None):
        spark.conf.set(OWN_DIR, folder)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path under the shared folder for a table written on the way; dropped with the open ``scratch``."""
    path = f"{shared_folder(spark)}/burnish/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A job: what it writes on the way is dropped when it ends.

    Write or collect the result inside; a DataFrame that reads such tables is
    of no use afterwards. Without this the tables stay until the folder's owner
    removes them.
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and go on from the files.

    For jobs that read their input several times and need the same rows each
    time, whatever executor is lost in between. Unlike a checkpoint the files
    are columnar: a later pass reads only the columns and row groups it needs.
    Columns whose names differ in case only are written by place.
    """
    path = scratch_path(df.sparkSession, name)
    headers = df.columns
    plain = df if len({h.lower() for h in headers}) == len(headers) else df.toDF(*(f"c{i}" for i in range(len(headers))))
    plain.write.parquet(path)
    read = df.sparkSession.read.schema(plain.schema).parquet(path)
    return read if plain is df else read.toDF(*headers)
