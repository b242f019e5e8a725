"""Catalogue scans, required inputs, file inventories, digests and checksum lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.operators.joins import DataError
from skyframe.session import spread


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Open named Parquet inputs; a missing one is an error that names it."""
    opened = {}
    for name, path in paths.items():
        try:
            opened[name] = spark.read.parquet(path)
        except AnalysisException as error:
            raise DataError(f"missing input {name} at {path}") from error
    return opened


def input_statuses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, status, rows) of named Parquet inputs: present with the number of rows, or missing."""
    found = []
    for name, path in paths.items():
        try:
            rows = require_inputs(spark, {name: path})[name].agg(F.lit("present").alias("status"), F.count(F.lit(1)).alias("rows"))
        except DataError:
            rows = spark.range(1).select(F.lit("missing").alias("status"), F.lit(None).cast("long").alias("rows"))
        found.append(rows.select(F.lit(name).alias("name"), "status", "rows"))
    return reduce(DataFrame.unionByName, found)


def scan_catalogue(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None,
                   renames: dict[str, str] | None = None) -> DataFrame:
    """Named columns of a catalogue under an optional row condition, both pushed into the scan.

    `renames` maps published names to those that `columns` and `where` use.
    """
    df = require_inputs(spark, {"catalogue": path})["catalogue"].withColumnsRenamed(renames or {})
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise DataError(f"{path} has no columns {absent}")
    return (df if where is None else df.filter(where)).select(*columns)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table with a header and a fixed schema; only the columns asked for are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def inventory(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Status of each file from (path, length) and (path, expected_bytes).

    present, wrong_size (too long), partial (too short), missing, or unexpected.
    """
    joined = actual.select("path", "length").join(expected.select("path", "expected_bytes"), "path", "full_outer")
    status = (F.when(F.col("length").isNull(), "missing").when(F.col("expected_bytes").isNull(), "unexpected")
              .when(F.col("length") < F.col("expected_bytes"), "partial")
              .when(F.col("length") > F.col("expected_bytes"), "wrong_size").otherwise("present"))
    return joined.select("path", "length", "expected_bytes", status.alias("status"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
            .load(folder).select("path", "length"))


def ids_in_names(files: DataFrame, pattern: str = r"(\d+)\.fits$") -> DataFrame:
    """Target ids spelled by file names."""
    return (files.select(F.regexp_extract("path", pattern, 1).alias("_id")).filter("_id <> ''")
            .select(F.col("_id").cast("long").alias("targetid")))


def content_digests(files: DataFrame, content: str) -> DataFrame:
    """md5 and sha256 of a content column."""
    return files.withColumns({"md5": F.md5(content), "sha256": F.sha2(content, 256)})


def verify_digests(files: DataFrame, expected: DataFrame, content: str) -> DataFrame:
    """Compare each file's md5 with the one listed for its path."""
    got = files.select("path", F.md5(F.col(content)).alias("got"))
    return got.join(expected.select("path", F.col("md5").alias("want")), "path").withColumn(
        "matches", F.col("got") == F.lower("want"))


def file_digests(paths: DataFrame, chunk_bytes: int = 1 << 22) -> DataFrame:
    """Digest whole files in a shared file system, one task row per path, streaming in chunks."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                hashes = [hashlib.md5(), hashlib.sha256()]
                size = 0
                with open(path.removeprefix("file:"), "rb") as handle:
                    while block := handle.read(chunk_bytes):
                        size += len(block)
                        for h in hashes:
                            h.update(block)
                rows.append((path, size, hashes[0].hexdigest(), hashes[1].hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "length", "md5", "sha256"])

    return spread(paths.select("path")).mapInPandas(digest, "path string, length long, md5 string, sha256 string")


def sidecar_digests(lines: DataFrame, column: str = "value") -> DataFrame:
    """(filename, sha256) from lines of a checksum list; directories and the binary mark are removed."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    name = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"^\*", ""), r"^.*/", "")
    return (lines.filter(F.size(parts) >= 2)
            .select(name.alias("filename"), F.lower(F.element_at(parts, 1)).alias("sha256")))
