"""File scans and sinks: JSON lines, nested JSON, CSV, snapshots, raw bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, as are rows
    where a required field is absent or empty."""
    rows = spark.read.schema(schema).json(path)
    for name in required:
        rows = rows.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return rows


def read_nested(spark: SparkSession, path: str, schema: T.StructType | str, child: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Curated JSON document with a child array: parent and child tables."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    children = rows.select(F.col(key).alias(f"parent_{key}"), F.explode(child).alias("c")).select(f"parent_{key}", "c.*")
    return rows.drop(child), children


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with keys in name order."""
    df.select(*sorted(df.columns)).write.json(path)


def write_warnings(df: DataFrame, path: str, lists: Sequence[str] = (), separator: str = "; ") -> None:
    """CSV with header, every field quoted, quotes doubled; list columns joined."""
    flat = df.select(*[F.array_join(F.col(c), separator).alias(c) if c in lists else F.col(c) for c in df.columns])
    flat.write.options(header=True, quoteAll=True, escape='"').csv(path)


def write_report(candidates: DataFrame, path: str) -> None:
    """Review report: the rows as JSON and as a table."""
    candidates.write.json(f"{path}/json")
    candidates.write.options(header=True, quoteAll=True, escape='"').csv(f"{path}/table")


def snapshot(pages: DataFrame, parser: str, version: str, body: str = "html", url: str = "url", fetched_at: Column | None = None) -> DataFrame:
    """Snapshot rows of page bodies: content hash, and an id made of the parser
    name and the hash's first 12 characters."""
    digest = F.sha2(F.col(body), 256)
    return pages.select(
        F.concat(F.lit(f"source-{parser}-"), F.substr(digest, F.lit(1), F.lit(12))).alias("id"), F.col(url).alias("source_url"),
        (fetched_at if fetched_at is not None else F.current_timestamp()).alias("fetched_at"), digest.alias("content_hash"),
        F.lit(parser).alias("parser"), F.lit(version).alias("parser_version"),
        F.when(F.length(body) > 0, "parsed").otherwise("failed").alias("status"))


def charset_of(header: Column, body: Column, default: str = "iso-8859-2") -> Column:
    """Charset from the content type, else from the body's meta tag, wherever
    it stands, else the default."""
    head = F.decode(body, "ISO-8859-1")
    named = lambda text: F.nullif(F.regexp_extract(text, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1), F.lit(""))
    return F.lower(F.coalesce(named(F.coalesce(header, F.lit(""))), named(head), F.lit(default)))


def decode_bytes(pages: DataFrame, body: str, charset: str, out: str = "html") -> DataFrame:
    """Bytes to text by each row's charset; what cannot be decoded is replaced."""

    @F.pandas_udf("string")
    def decode(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, names in frames:
            yield pd.Series([_decode(b, n) for b, n in zip(bodies, names)])

    return pages.withColumn(out, decode(F.col(body), F.col(charset)))


def _decode(body: bytes, name: str) -> str | None:
    if body is None:
        return None
    try:
        return bytes(body).decode(name, errors="replace")
    except LookupError:
        return bytes(body).decode("utf-8", errors="replace")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Raw files: path, modification time, length and content."""
    return spark.read.format("binaryFile").load(path)
