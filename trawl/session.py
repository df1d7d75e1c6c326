"""Local session used by tests, bench and the command line; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with UTC time, adaptive execution and as many shuffle partitions as cores."""
    n = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trawl")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRAWL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package (as spark-submit --py-files would), once per application."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_trawl_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="trawl-")) / "trawl_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path("trawl") / p.relative_to(here)))
    sc.addPyFile(str(to))
    sc._trawl_shipped = True
    return spark
