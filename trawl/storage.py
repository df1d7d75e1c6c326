"""Where intermediate tables live: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and the session runs on this machine alone (tests), an own temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="trawl-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def _folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; the driver removes it when it ends."""
    key = f"{spark.sparkContext.applicationId}@{shared_dir(spark)}"
    if key not in _FOLDERS:
        path = f"{shared_dir(spark)}/trawl-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
        _FOLDERS[key] = path
    return _FOLDERS[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the files, and a lost executor costs only a new read.

    Unlike ``checkpoint()`` this runs the plan once. An empty frame keeps its schema.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settings(df: DataFrame, most: int) -> list:
    """The rows of a small table of settings; more than ``most`` is an error, so nothing is ever left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of settings has more than {most} rows")
    return rows
