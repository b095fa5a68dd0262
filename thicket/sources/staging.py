"""Tables written once in the cluster's shared folder, in place of cached blocks that die with their executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine, a local folder, chosen once."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="thicket-"))
    return sc.getCheckpointDir().rstrip("/")


#: With it Spark removes a query's shuffle files when the query ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str, files: int | None = None, release: bool = False) -> DataFrame:
    """df, written as Parquet and read back: cuts lineage, keeps column pruning, outlives lost executors.  The files
    go when the driver's JVM ends; release: shuffle files of the writing go with its end."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/staged-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        if release:
            spark.conf.set(CLEANUP, "true")
        (df if files is None else df.coalesce(files)).write.parquet(path)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
