"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder; where that is unset, a temporary one in local mode (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, folder: str):
    """(file system, path) of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def whole_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables below a folder whose writing has ended, sorted; none if there is no such folder."""
    files, path = files_of(spark, folder)
    found = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(p.getName() for p in found if files.exists(files_of(spark, f"{p}/_SUCCESS")[1]))


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df, computed once, written to a fresh folder and read back: the lineage ends there."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
