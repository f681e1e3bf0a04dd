"""The folder that the driver and all executors share, for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; it goes when the driver ends. Where that is unset a local session (tests) gets one of our own; a cluster an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_folder, "own", None)
        if base is None:
            base = shared_folder.own = tempfile.mkdtemp(prefix="promptscreen-core-")
            atexit.register(shutil.rmtree, base, True)
    path = f"{base}/promptscreen-core-{sc.applicationId}"
    if path not in _ours:
        _ours.add(path)
        atexit.register(deleted, spark, path)
    return path


_ours: set[str] = set()


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, on whatever store it is; does nothing if the session has ended."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the driver is ending, or the folder has gone already
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: files that outlive any executor, and the same rows each time."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing to come reads."""
    for t in tables:
        if path := getattr(t, "stored", None):
            deleted(t.sparkSession, path)
