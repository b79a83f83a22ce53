"""Session helpers: a session for tests and benches, and the package for Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable by Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_skein_shipped", False):
        return spark
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        if context.master.startswith("local[") or context.master == "local":
            context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, context.environment.get("PYTHONPATH", "")) if x)
        else:
            archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "skein"), "zip", ROOT, "skein")
            context.addPyFile(archive)
    context._skein_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where none is set and all run in one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(context, "_skein_folder"):
        context._skein_folder = f"file://{tempfile.mkdtemp(prefix='skein-')}"
    return context._skein_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so what it costs is paid once and lost executors are made good from files. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
