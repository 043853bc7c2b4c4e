"""Session construction and cluster-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quotelens", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with adaptive execution on and UTC time; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master or cores:
        builder = builder.master(master or f"local[{cores}]")
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores:
        # local runs only: one JVM holds the driver and all executor threads
        builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a scratch folder only where Spark runs in one process and none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder, so that lost executors do not replay the whole plan."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, read again: for wide tables that a query reads several times. Removed when the application ends."""
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
