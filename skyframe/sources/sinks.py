"""Writers: sorted Parquet, CSV, shards by key, staged splits, ledgers, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.functions.core import is_finite
from skyframe.operators.joins import DataError
from skyframe.operators.ledger import LEDGER_SCHEMA
from skyframe.operators.spectra import SHARD_KEYS


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet sorted by key across files, so readers can skip row groups by key range."""
    df.orderBy(*keys).write.mode("overwrite").parquet(path)


def read_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows of Parquet files with their 0-based place in them: files in the order of their names, rows as they are stored.

    Only one row per file is numbered in one task; every other row's place is its index in its file plus the rows of the files before.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_index")).drop("_file", "_index", "_start")


def live_version(spark: SparkSession, path: str) -> int:
    """The version that readers of a replaceable table see; 0 before the first."""
    from pyspark.errors import AnalysisException
    try:
        log = spark.read.schema("version long").json(f"{path}/log")
    except AnalysisException:
        return 0
    return log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def replace_table(df: DataFrame, path: str) -> int:
    """Write `df` as the next version of the table at `path` and return its number. One writer at a time.

    Readers follow a log, to which a version is added when all of its rows are written: a write that fails half way leaves the version before
    it in place, and the next write replaces what the failed one left. `df` may read the live version.
    """
    version = live_version(df.sparkSession, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{path}/log")
    return version


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version that was written to its end."""
    version = live_version(spark, path)
    if version == 0:
        raise DataError(f"no version has been written to {path}")
    return spark.read.parquet(f"{path}/version={version}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array and map columns are left out."""
    flat = [name for name, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary"))]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_shards(spectra: DataFrame, path: str) -> None:
    """One folder per (survey, program, healpix); rerunning replaces only the groups it holds."""
    (spectra.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*SHARD_KEYS).parquet(path))


def write_staged(staged: DataFrame, path: str, rows_per_file: int = 2048) -> None:
    """One folder per split, rows in `source_row` order inside files of bounded size.

    Rows are spread by range of (split, source_row), so the large split is shared by many tasks.
    """
    (staged.repartitionByRange("split", "source_row").sortWithinPartitions("split", "source_row")
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd")
     .partitionBy("split").parquet(path))


def write_ledger(record: DataFrame, path: str) -> None:
    """One JSON record."""
    record.coalesce(1).write.mode("overwrite").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The previous record of a step, or None where there is none."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(LEDGER_SCHEMA).json(path)
    except AnalysisException:
        return None


def json_safe(df: DataFrame) -> Column:
    """The row as JSON with non-finite numbers, also inside arrays, written as null."""
    def safe(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            return F.when(is_finite(c), c).alias(name)
        if kind in ("array<double>", "array<float>"):
            return F.transform(c, lambda x: F.when(is_finite(x), x)).alias(name)
        return c
    return F.to_json(F.struct(*[safe(n, k) for n, k in df.dtypes]), {"ignoreNullFields": "false"})


def markdown_rows(df: DataFrame, order: str, columns: list[str], digits: int = 3) -> DataFrame:
    """(ord, line) of a Markdown table: header, rule, then one line per row; missing numbers are blank."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        text = F.format_string(f"%.{digits}f", F.col(name)) if kinds[name] in ("double", "float") else F.col(name).cast("string")
        return F.coalesce(F.when(F.col(name).isNotNull(), text), F.lit(""))

    body = df.select((F.col(order) + 2).cast("int").alias("ord"),
                     F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))]
    return df.sparkSession.createDataFrame(head, "ord int, line string").unionByName(body)


def write_text(lines: DataFrame, path: str) -> None:
    """Write a small ordered table of lines as one text file."""
    lines.orderBy("ord").coalesce(1).select("line").write.mode("overwrite").text(path)
