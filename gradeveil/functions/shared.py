"""The folder that driver and executors share, and working folders in it that end with the program."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a folder of this machine, which is then set; on a
    cluster that would be another folder on each machine, so it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/gradeveil-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def working_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, with its scheme, until the program ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/gradeveil-{uuid.uuid4().hex}")
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    _made.append(folder)
    return folder


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders whose files nothing reads any more."""
    for folder in folders:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    folders.clear()


@atexit.register
def _clean_up() -> None:
    """Where Spark has stopped before, only local folders can still be deleted."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        discard(spark, list(_made))
    for folder in _made:
        if folder.startswith("file:"):
            shutil.rmtree("/" + folder[5:].lstrip("/"), ignore_errors=True)
