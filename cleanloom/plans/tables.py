"""Tables in the folder that all executors share, which cut the lineage of long pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, /tmp/checkpoints for local masters, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = "file:///tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read again, and its path."""
    df.write.option("compression", "zstd").parquet(path := folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
