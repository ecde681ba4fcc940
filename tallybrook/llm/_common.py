"""Shared plumbing of the training-data operators: table access, shared storage, worker set-up."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a scratch folder on a local master, and an error elsewhere."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tallybrook-")
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that this library wrote, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and reread."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def aside(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """The used columns under their names, and all columns under names that no operator uses, with the way back."""
    back = {f"kept_{k}__": c for k, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in back.items()), *(F.col(f"`{c}`") for c in used)), back


def restored(df: DataFrame, back: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(k).alias(c) for k, c in back.items()))
