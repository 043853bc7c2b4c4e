"""Shared helpers: whole input tables and tables kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents as (doc_id long, text string); further columns, whatever their names, are left aside."""
    return ids_and_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, removed when the application ends. A folder of its own only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base}/llm/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _made.append(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage is cut and a lost executor loses nothing."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _folders[out] = folder
    return out


def release(*tables: DataFrame) -> None:
    """Deletes kept tables that only served to make other kept tables, and whose rows nothing reads any more."""
    for df in tables:
        if df in _folders:
            remove(df.sparkSession, [_folders.pop(df)])


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made(since: int = 0) -> list[str]:
    """Folders made in this process, from a number of them on."""
    return _made[since:]
