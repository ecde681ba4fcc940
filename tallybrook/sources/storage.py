"""Shared storage: lineage cuts and atomically written caches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed but lies beside the driver's program."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a scratch folder on a local master and an error elsewhere."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tallybrook-")
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


FILE_ROWS = 50_000


def kept(df: DataFrame) -> DataFrame:
    """df from shared storage, for steps that pass over it many times: derived once, and read in pieces of few rows.

    Files are small, so that a task that decodes several of them holds some hundred thousand rows; nothing is cached.
    """
    path = scratch(df.sparkSession, "kept")
    df.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there: Spark's committer adds _SUCCESS last."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, built and written first if it isn't there or force is set."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared storage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
