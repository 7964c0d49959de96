"""Session helpers: a local session with the settings the operators expect."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "minespark", cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster, pass the operators the session the cluster gives."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{n}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "spark.checkpoint.dir" not in conf:  # one machine: any folder of its own is shared
        conf["spark.checkpoint.dir"] = folder = tempfile.mkdtemp(prefix="minespark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
