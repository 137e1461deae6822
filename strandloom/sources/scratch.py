"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made and set, but only on a local
    master (tests, one machine): on a cluster each executor would write to a
    disk of its own, so that is an error.
    """
    path = spark.conf.get(_SETTING, None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"{_SETTING} has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set(_SETTING, path)
    return path.rstrip("/")


def checkpointing(spark: SparkSession) -> None:
    """DataFrame.checkpoint() writes to the shared folder too."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files at its end; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and keeps the rows safe when an executor is lost; a later plan
    reads the columns it needs instead of computing them again.
    """
    return save_parts([df], tag)


def save_parts(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """:func:`save` of all rows of ``parts``, one after the other, so that only one of them has shuffle files at a time."""
    path = None
    for df in parts:
        path = path or new_path(df.sparkSession, tag)
        with _shuffles_removed(df.sparkSession):
            df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables from :func:`save` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_saved_at", None):
            _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all saved tables of this application; results that read them have to be written first."""
    _delete(spark, _folder(spark))
