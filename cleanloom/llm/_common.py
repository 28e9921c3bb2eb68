"""Helpers shared by the corpus operators: durable cuts of the lineage and column hygiene."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between two calls of the collectors, which small tables don't wait for.
FREE_EVERY = 4


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where the setting is absent, local masters use /tmp/checkpoints and clusters the
    warehouse, which every executor reaches.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables written to the shared folder, dropped when no longer needed.

    A lost executor costs at most the work since the last table, and shuffle files of
    finished steps can be freed because nothing refers to them any longer.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.freed = time.monotonic()

    def cut(self, frame: DataFrame, label: str = "t") -> DataFrame:
        """Write ``frame`` as Parquet and return the table that was written."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        frame.write.option("compression", "zstd").parquet(path)
        schema = frame.schema
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        if time.monotonic() - self.freed > FREE_EVERY:
            self.free()
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def free(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        self.freed = time.monotonic()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that their Python objects need little memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_of(frame: DataFrame, inside: str | None = None, new: dict[str, Column] | None = None) -> Column:
    """All columns of ``frame`` as one struct, so that names chosen inside an operator never meet those of its user.

    With ``inside``, they are taken from the struct column of that name; ``new`` replaces some.
    """
    of = (lambda c: F.col(inside).getField(c)) if inside else (lambda c: F.col(f"`{c.replace('`', '``')}`"))
    return F.struct(*((new or {}).get(c, of(c)).alias(c) for c in frame.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
