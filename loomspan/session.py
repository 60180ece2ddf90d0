"""Session builder with the settings the engine is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster pass the cluster's master and let its configuration win."""
    b = SparkSession.builder.master(master).appName("loomspan").config("spark.driver.memory", memory)
    for k, v in CONF.items():
        b = b.config(k, v)
    return b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where it is unset an own folder is set, which only a local master can share; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints/loomspan")
        base = "file:///tmp/checkpoints/loomspan"
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """path as a full URI: what has no scheme lies in the cluster's default file system, as Hadoop resolves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
