"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # whole texts go to Python in batches: a bound on rows is a bound on a worker's memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # vendor files in regional code pages (cp949) are decoded by the JVM charset table
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the SQL settings this library relies on; they are all runtime-settable."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per Spark context.

    Functions run by Arrow are pickled by name, so the workers must be able to import it, wherever
    the driver was started and whatever its own search path.
    """
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as staging:
        copy = Path(staging) / "package"
        shutil.copytree(home, copy / home.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-')}/{home.name}", "zip", copy)
    context.addPyFile(archive)
    context._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Where it is unset a temporary folder is made for a local session, as in tests. Any other
    master needs the setting: executors would not see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder, never used before."""
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and go on from the written copy.

    Cuts a lineage that later steps would repeat, survives the loss of executors, and gives
    the planner the true size for its choice of join.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
