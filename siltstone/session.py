"""What a session needs: the package in its Python workers, and a folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_written: list[str] = []


def prepare(spark: SparkSession, batch_mb: int = 8) -> None:
    """Local workers get the package's folder on their path; a cluster gets the package as a zip.  Arrow
    batches are limited by bytes, so that long rows do not gather in one batch."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(PACKAGE.parent) not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(PACKAGE.parent), *paths])
    if not sc.master.startswith("local[") and sc.master != "local" and sc.applicationId not in _shipped:
        folder = tempfile.mkdtemp()
        sc.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_mb << 20))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder if that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, and what was
    computed survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` has made in this process; results that still read them are lost."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
