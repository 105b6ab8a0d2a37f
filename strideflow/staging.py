"""Tables written once to the folder that the cluster shares, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on this machine."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="strideflow-")
    return _own_folder


def clear(spark: SparkSession) -> None:
    """Remove all staged tables of this and other sessions; for when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/strideflow")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage: what follows survives lost executors without running the
    earlier stages again, and several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strideflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(table: DataFrame) -> None:
    """Remove a table that ``staged`` returned, once everything that is made of it has been written."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
