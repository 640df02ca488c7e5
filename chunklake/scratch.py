"""Tables on the way: written to the folder that driver and executors share, read back, and deleted once nothing reads them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all runs on this machine; on a cluster that would lose rows, and is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='chunklake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df from its Parquet files: lineage is cut, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of written()."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
