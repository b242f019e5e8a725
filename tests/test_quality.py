"""Each corruption of a staged table must fail exactly the checks it breaks."""

import pytest
from pyspark.sql import functions as F

from skyframe.operators import quality as q
from skyframe.operators import sample as sm
from skyframe.operators.joins import DataError
from skyframe.params import Grid
from skyframe.plans import quality as pq

GRID = Grid(3600.0, 0.8, 4)


@pytest.fixture(scope="module")
def tables(spark):
    base = spark.range(60).select(
        F.col("id").alias("targetid"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("ero_detuid"), F.lit(True).alias("in_sample"),
        (F.col("id") / 10.0 - 0.2).alias("z"), F.when(F.col("id") % 7 == 0, 4).otherwise(0).alias("zwarn"), (F.col("id") % 3 == 0).alias("has_wise"))
    base = base.withColumn("has_z", (F.col("z") > 0) & (F.col("zwarn") == 0))
    manifest = sm.assign_split(base).persist()
    f = lambda *v: F.array(*[F.lit(x).cast("float") for x in v])
    staged = manifest.select("targetid", "split", F.col("targetid").alias("source_row"), f(1, 2, 3, 4).alias("spectra"), f(1, 0, 1, 1).alias("spectra_ivar"),
                             F.col("z").cast("float").alias("redshift"), *[F.lit(1.0).cast("float").alias(f"flux_w{i}") for i in (1, 2, 3)],
                             f(*range(16)).alias("image_flux"), "has_z", "has_wise").persist()
    labels = manifest.select("targetid", F.lit(1.0).alias("log_flux_1"), F.lit(1.0).alias("log_sfr"))
    return staged, manifest, labels


def failed(tables, staged=None, manifest=None, labels=None, files=None):
    s, m, l = tables
    checks = pq.validate(s if staged is None else staged, m if manifest is None else manifest, m.select("targetid", "split"), l if labels is None else labels,
                         GRID, 2, files=files, required=["log_flux_1", "log_sfr"])
    return q.overall(checks).first()["failed"]


def nan_at(c, i):
    return F.transform(c, lambda x, k: F.when((F.col("targetid") == 9) & (k == i), F.lit(float("nan"))).otherwise(x).cast("float"))


def test_clean_tables_pass(tables):
    assert failed(tables) == []
    pq.require_valid(pq.validate(tables[0], tables[1], tables[1], tables[2], GRID, 2, required=["log_sfr"]))


@pytest.mark.parametrize("change,want", [
    (lambda s: s.drop("flux_w2"), ["schema"]),
    (lambda s: s.withColumn("redshift", F.col("redshift").cast("double")), ["schema"]),
    (lambda s: s.withColumn("spectra", F.slice("spectra", 1, 3)), ["schema"]),
    (lambda s: s.unionByName(s.filter("targetid = 3")), ["targetids"]),
    (lambda s: s.filter("targetid <> 3"), ["targetids"]),
    (lambda s: s.withColumn("has_wise", F.when(F.col("targetid") == 5, ~F.col("has_wise")).otherwise(F.col("has_wise"))), ["manifest_agreement"]),
    (lambda s: s.withColumn("image_flux", nan_at("image_flux", 1)), ["content"]),
    (lambda s: s.withColumn("spectra", nan_at("spectra", 0)), ["content"]),
    (lambda s: s.withColumn("spectra", nan_at("spectra", 1)), []),
    (lambda s: s.withColumn("spectra_ivar", F.transform("spectra_ivar", lambda x: (x - 0.5).cast("float"))), ["content"]),
    (lambda s: s.withColumn("has_z", F.when(F.col("targetid") == 30, ~F.col("has_z")).otherwise(F.col("has_z"))), ["content", "manifest_agreement"]),
])
def test_corruption(tables, change, want):
    assert failed(tables, staged=change(tables[0])) == want


def test_all_in_one_split(tables):
    moved = tables[0].withColumn("split", F.lit("train"))
    assert failed(tables, staged=moved) == ["manifest_agreement", "split_sizes", "targetids"]


def test_detection_in_two_splits(tables):
    assert failed(tables, manifest=tables[1].withColumn("ero_detuid", F.lit("D1"))) == ["detections_in_one_split"]


def test_labels_and_files(tables, spark):
    assert failed(tables, labels=tables[2].filter("targetid <> 8")) == ["labels"]
    assert failed(tables, labels=tables[2].drop("log_sfr")) == ["labels"]
    files = spark.createDataFrame([("train", "present"), ("val", "missing")], "path string, status string")
    assert failed(tables, files=files) == ["files_present"]
    with pytest.raises(DataError, match="files_present"):
        pq.require_valid(q.check_files(files))
