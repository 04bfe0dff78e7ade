"""Cutting lineage: a plan's rows as a Parquet table in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else, on one machine alone (as in tests), a temporary one.

    On a cluster a machine's own folder would be another one for each executor, so there a shared one must be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="latticeweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back. Survives the loss of executors; the plan starts anew from the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/latticeweave-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at_exit() -> None:
    """Tables of a session that is still there at the end of the program are deleted with it."""
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone, and with it the means to delete
            return


_WRITTEN: list[tuple[SparkSession, str]] = []
atexit.register(_at_exit)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialise() that no plan reads any longer."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/latticeweave-" in path:
            _delete(spark, path)
