"""Tables in the folder that driver and executors share: they cut lineage, so that a lost executor costs one step."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stellagrid-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame, name: str = "cut", by: tuple = ()) -> DataFrame:
    """df, written to the shared folder and read back; rows that differ in the columns `by` lie in different files."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut_lineage made. What was derived from them and not yet computed is lost with them."""
    for t in tables:
        if path := getattr(t, "cut_path", None):
            _delete(t.sparkSession, path)


def kept(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table `key` of a folder, and whether it was there. If not, it is made and written, and appears when it is whole.

    A table is whole if Spark's writer has marked it so. Two sessions that make the same one at a time both may; one stays.
    """
    path = f"{folder.rstrip('/')}/{key}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    place = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(place(f"{path}/_SUCCESS")):
        return spark.read.parquet(path), True
    draft = f"{path}.{uuid.uuid4().hex}"
    made = make()
    made.write.parquet(draft)
    if not fs.exists(place(f"{path}/_SUCCESS")):
        _delete(spark, path)  # what was left unfinished there
        fs.rename(place(draft), place(path))
    for rest in (draft, f"{path}/{draft.rsplit('/', 1)[-1]}"):  # where another session was faster
        _delete(spark, rest)
    return spark.read.schema(made.schema).parquet(path), False


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has cut: call it when the results are written."""
    _delete(spark, _own_dir(spark))
