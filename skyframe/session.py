"""Session helpers: where stage tables go, and how rows are spread before costly steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

STAGE_SETTING = "skyframe.stage.run"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for stage tables: spark.checkpoint.dir, else a folder in the session's warehouse. The same rule for every master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages").rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's stage tables below `checkpoint_folder`."""
    run = spark.conf.get(STAGE_SETTING, None)
    if not run:
        run = uuid.uuid4().hex
        spark.conf.set(STAGE_SETTING, run)
    return f"{checkpoint_folder(spark)}/tables-{run}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a stage table."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"


def drop_stages(spark: SparkSession) -> bool:
    """Delete the stage tables of this session's run. Call it when no DataFrame that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once as a stage table in the shared folder and read it from there afterwards.

    Row numbers derived from partition positions stay the same however often tasks are retried, and each
    reader scans only the columns it needs.
    """
    path = stage_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the session's shuffle partitions before a step that costs far more than moving them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
