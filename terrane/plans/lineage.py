"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the session's ``spark.checkpoint.dir``.

    Only a local master, whose threads share one disk, may do without the setting
    (a temporary folder then); on a cluster each executor would write its own.
    The folder is deleted when the driver ends: tables in it serve plans that are
    evaluated later, so nothing in it is known to be done with before.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _own:
        at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if at:
            _own[app] = f"{at.rstrip('/')}/terrane-{app}"
            path = sc._jvm.org.apache.hadoop.fs.Path(_own[app])
            fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        elif sc.master == "local" or sc.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="terrane-")
            atexit.register(shutil.rmtree, folder, True)
            _own[app] = "file://" + folder
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own[app]


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that is not taken."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The copy outlives any executor, so a lost one costs only the tasks it was
    running; the columnar files are smaller than a serialized checkpoint.
    """
    spark = df.sparkSession
    path = fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
