"""Session helpers: shipping the package to Python workers and the folder all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every Python worker this package, whatever its working folder or PYTHONPATH is."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    staged = os.path.join(folder, "stage", os.path.basename(here))
    shutil.copytree(here, staged, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "gradeloom_pkg"), "zip", os.path.dirname(staged)))
    _SHIPPED.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, the warehouse on a cluster, a temp folder in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master.startswith("local[") or sc.master == "local":
        named = tempfile.mkdtemp(prefix="gradeloom-")
    else:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/gradeloom/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and reread: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a run's folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
