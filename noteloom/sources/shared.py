"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder of our own only where it is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="noteloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


_made: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, which goes with the session at the latest."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_forget)
    _made.append(path)
    return path


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends there, and what several branches of a plan read is computed once.

    by: a column of few values whose rows get folders of their own, so that a question about one value reads its files only.

    The tables a session has made go with it, at the latest when Python ends; drop() deletes one before.
    """
    path, conf, name = folder(df.sparkSession, tag), df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    try:
        if by:  # a task keeps a file open for each of the few values, and doesn't sort its rows by them
            conf.set(name, "64")
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        if by:
            conf.set(name, before) if before is not None else conf.unset(name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._noteloom_path = path
    return out


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), path)


def drop(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing reads any more."""
    path = getattr(df, "_noteloom_path", None)
    if path:
        delete(df.sparkSession, path)
        _made.remove(path)


def _forget() -> None:
    sc = SparkContext._active_spark_context
    if sc is not None:
        for path in _made:
            _delete(sc._jvm, sc._jsc.hadoopConfiguration(), path)
