"""Session helpers: sensible defaults for tests, shared checkpoint folders, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests) does it fall back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cordwood-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/cordwood-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, partition_by: list[str] | None = None) -> str:
    """Writes df as Parquet below the shared folder; returns the path."""
    path = scratch(df.sparkSession)
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a written table, which survives the loss of executors; it is computed once, where a
    checkpoint would compute its last stage twice."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table name of folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
