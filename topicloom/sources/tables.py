"""Tables: test inputs, intermediate results, corpora and models as folders of Parquet and JSON."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and Spark runs locally, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"topicloom-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage with a table that no
    lost executor takes along. Removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than cores (a small file) dealt out to all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that written() made and nothing needs any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def save_corpus(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
