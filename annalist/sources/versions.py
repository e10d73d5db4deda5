"""Versioned tables: several Parquet tables replaced as one.

A version is a folder; a marker file, written last, names the one that is
current. Readers never see half a version, and a job never overwrites what it
reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def publish(root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables to a new version, then make it the current one."""
    version = uuid.uuid4().hex
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(f"{root}/versions/{version}/{name}")
    fs, jvm = _fs(spark, root)
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.{version}")
    out = fs.create(draft, True)
    out.writeBytes(version)
    out.close()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{_next(fs, jvm, root):012d}")
    fs.mkdirs(pointer.getParent())
    # a rename onto a new name either happens or does not
    if not fs.rename(draft, pointer):
        raise RuntimeError("another job published at the same time")
    return version


def _next(fs, jvm, root: str) -> int:
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    return len(fs.listStatus(folder)) if fs.exists(folder) else 0


def current(spark: SparkSession, root: str) -> str | None:
    """Name of the current version, none before the first."""
    fs, jvm = _fs(spark, root)
    number = _next(fs, jvm, root)
    if number == 0:
        return None
    return spark.read.text(f"{root}/pointers/{number - 1:012d}").first()["value"]


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/versions/{version}/{name}")
