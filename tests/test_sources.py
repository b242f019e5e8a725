import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.operators import ledger as lg
from skyframe.operators.joins import DataError
from skyframe.sources import catalog, fits, sinks


def card(key, value):
    text = f"'{value}'" if isinstance(value, str) else ("T" if value is True else str(value))
    return f"{key:<8}= {text:>20}".ljust(80)


def block(cards):
    text = "".join(cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def write_table(path, rows):
    record = np.dtype([("ID", ">i8"), ("NAME", "S6"), ("FLAG", "S1"), ("CTS", ">i2"), ("FLUX", ">f4"), ("POS", ">f8", (2,)), ("N", ">i4")])
    data = np.zeros(rows, record)
    data["ID"] = (9010 << 42) + np.arange(rows)
    data["NAME"] = [f"n{i % 5}".ljust(6) for i in range(rows)]
    data["FLAG"] = np.where(np.arange(rows) % 2 == 0, b"T", b"F")
    data["CTS"], data["FLUX"], data["N"] = -np.arange(rows) % 100, np.arange(rows) / 4, np.arange(rows)
    data["POS"] = np.column_stack([np.arange(rows), -np.arange(rows)])
    forms = [("ID", "K"), ("NAME", "6A"), ("FLAG", "L"), ("CTS", "I"), ("FLUX", "E"), ("POS", "2D"), ("N", "1J")]
    head = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", record.itemsize), card("NAXIS2", rows), card("PCOUNT", 0),
            card("GCOUNT", 1), card("TFIELDS", len(forms))]
    for i, (n, f) in enumerate(forms, 1):
        head += [card(f"TTYPE{i}", n), card(f"TFORM{i}", f)]
    body = data.tobytes()
    primary = block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)])
    path.write_bytes(primary + block(head) + body.ljust(-(-len(body) // 2880) * 2880, b"\0"))
    return data


def test_fits_table(spark, tmp_path):
    data = write_table(tmp_path / "t.fits", 1234)
    fits.register(spark)
    df = spark.read.format("fits_table").option("path", str(tmp_path / "t.fits")).option("rows_per_partition", 500).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 1234
    r = df.filter("N = 1001").first()
    assert (r["ID"], r["NAME"], r["FLAG"], r["CTS"], r["FLUX"], r["POS"]) == (int(data["ID"][1001]), "n1", False, int(data["CTS"][1001]), 250.25, [1001.0, -1001.0])
    some = spark.read.format("fits_table").option("path", str(tmp_path / "t.fits")).option("columns", "N,FLAG").load()
    assert some.columns == ["N", "FLAG"] and some.filter("FLAG").agg(F.sum("N")).first()[0] == sum(range(0, 1234, 2))
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("fits_table").option("path", str(tmp_path / "t.fits")).option("columns", "NOPE").load()


def test_scan_pushes_filter_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).write.parquet(path)
    df = catalog.scan_catalogue(spark, path, ["b"], F.col("id") > 90)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan and df.count() == 9
    with pytest.raises(DataError, match="no columns"):
        catalog.scan_catalogue(spark, path, ["zz"])
    with pytest.raises(DataError, match="missing input main"):
        catalog.require_inputs(spark, {"main": str(tmp_path / "none")})


def test_digests_and_listing(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.fits").write_bytes(bytes([i]) * (i * 1000 + 1))
    files = catalog.listing(spark, str(tmp_path), "*.fits")
    assert sorted(r["targetid"] for r in catalog.ids_in_names(files).collect()) == [0, 1, 2, 3, 4]
    got = {r["path"].rsplit("/", 1)[1]: r for r in catalog.file_digests(files, 256).collect()}
    for i in range(5):
        body = bytes([i]) * (i * 1000 + 1)
        r = got[f"{i}.fits"]
        assert (r["length"], r["md5"], r["sha256"]) == (len(body), hashlib.md5(body).hexdigest(), hashlib.sha256(body).hexdigest())


def test_sidecar(spark):
    df = spark.createDataFrame([("ABC  *dir/a.fits",), ("  def  b.fits ",), ("",)], "value string")
    assert sorted(tuple(r) for r in catalog.sidecar_digests(df).collect()) == [("a.fits", "abc"), ("b.fits", "def")]


def test_inventory(spark):
    have = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 5)], "path string, length long")
    want = spark.createDataFrame([("a", 5), ("b", 6), ("c", 4), ("e", 5)], "path string, expected_bytes long")
    assert {r["path"]: r["status"] for r in catalog.inventory(have, want).collect()} == {
        "a": "present", "b": "partial", "c": "wrong_size", "d": "unexpected", "e": "missing"}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, [2.0])], "k int, s string, v array<double>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert catalog.csv_header(spark, str(tmp_path / "c")) == ["k", "s"]
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.StringType())])
    assert sorted(tuple(r) for r in catalog.scan_csv(spark, str(tmp_path / "c"), schema, ["k"]).collect()) == [(1,), (2,)]


def test_ledger(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0), (4, 0.5)], "k int, v double")
    ledger = lg.cut_ledger(df, [("known", F.col("v").isNotNull()), ("large", F.col("v") > 0.7)], {"large": "above 0.7"})
    assert [tuple(r) for r in ledger.orderBy("ord").collect()] == [(1, "known", 3, 1, None), (2, "large", 2, 1, "above 0.7")]
    record = lg.ledger_record("step", lg.named_counts(df.agg(F.count(F.lit(1)).alias("n"))), ledger, {"in": "x"}, {"seed": "1"}, "abc")
    assert sinks.read_ledger(spark, str(tmp_path / "none")) is None
    sinks.write_ledger(record, str(tmp_path / "l"))
    r = sinks.read_ledger(spark, str(tmp_path / "l")).first()
    assert r["step"] == "step" and r["counts"] == {"n": 4} and r["filters"][1]["note"] == "above 0.7" and r["inputs"] == {"in": "x"}


def test_staged_files_keep_order(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"), F.col("id").alias("source_row")).orderBy(F.rand(1))
    sinks.write_staged(df, str(tmp_path / "s"), 100)
    files = sorted((tmp_path / "s" / "split=train").glob("*.parquet"))
    assert len(files) >= 8
    for f in files:
        rows = [r[0] for r in spark.read.parquet(str(f)).select("source_row").collect()]
        assert rows == sorted(rows) and len(rows) <= 100


def test_stage_tables_of_a_run_can_be_dropped(spark):
    import os

    from skyframe import session

    other = spark.newSession()
    written = session.settle(other.range(10).toDF("n"))
    folder = session.run_folder(other)
    assert written.count() == 10 and os.path.isdir(folder) and folder != session.run_folder(spark)
    assert session.drop_stages(other) and not os.path.isdir(folder)


def test_positions_follow_the_sorted_files(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v int").repartition(4)
    sinks.write_sorted(df, f"{tmp_path}/sorted", "k")
    assert sorted((r["position"], r["k"]) for r in sinks.read_positions(spark, f"{tmp_path}/sorted").collect()) == [(k, k) for k in range(101)]


def fits_at(spark, path, **options):
    return spark.read.format("fits_table").option("path", str(path)).options(**options).load()


def test_fits_round_trip(spark, tmp_path):
    fits.register(spark)
    df = spark.createDataFrame([(i, i % 7, float(i) / 4, None if i % 5 == 0 else float(i), i % 2 == 0, "" if i % 3 == 0 else f"n{i}") for i in range(500)],
                               "k long, n int, e double, x float, b boolean, s string")
    df.repartition(3).write.format("fits_table").option("path", str(tmp_path / "f")).option("rows_per_file", 60).mode("append").save()
    assert len(list((tmp_path / "f").glob("*.fits"))) >= 9 and not list((tmp_path / "f").glob("_*"))
    back = fits_at(spark, tmp_path / "f", rows_per_partition=25)
    assert back.dtypes == df.dtypes
    want = {r["k"]: tuple("nan" if v is None else v for v in r) for r in df.collect()}
    got = {r["k"]: tuple("nan" if v != v else v for v in r) for r in back.collect()}
    assert got == want
    df.limit(10).write.format("fits_table").option("path", str(tmp_path / "f")).mode("overwrite").save()
    assert fits_at(spark, tmp_path / "f").count() == 10


def test_fits_filters_reach_the_records(spark, tmp_path):
    write_table(tmp_path / "t.fits", 1234)
    fits.register(spark)
    layout = fits.read_layout(str(tmp_path / "t.fits"), 1)
    reader = fits.FitsReader(str(tmp_path / "t.fits"), layout, 1, "ID", 500)
    kept = list(reader.pushFilters([fits.ds.GreaterThan(("N",), 1200), fits.ds.EqualTo(("NAME",), "n1"), fits.ds.IsNotNull(("N",)), fits.ds.LessThan(("POS",), 3),
                                    fits.ds.GreaterThan(("FLUX",), float("nan"))]))
    assert [type(f).__name__ for f in kept] == ["EqualTo", "LessThan", "GreaterThan"] and reader.tests == [("N", fits.ds.GreaterThan, 1200)]
    assert sum(b.num_rows for s in reader.partitions() for b in reader.read(s)) == 33
    df = fits_at(spark, tmp_path / "t.fits")
    assert df.filter("N >= 1200 AND FLUX < 305 AND NAME = 'n1' AND CTS = 99").select("ID").count() == 1
    nan = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, 1.0)], "k long, x double")
    nan.coalesce(1).write.format("fits_table").option("path", str(tmp_path / "n")).mode("append").save()
    assert sorted(r["k"] for r in fits_at(spark, tmp_path / "n").filter("x > 2").collect()) == [1, 2]


def test_a_failed_fits_write_leaves_nothing(spark, tmp_path):
    fits.register(spark)
    good = spark.range(50).select(F.col("id").alias("k"))
    good.write.format("fits_table").option("path", str(tmp_path / "f")).mode("append").save()
    before = sorted(p.name for p in (tmp_path / "f").iterdir())
    broken = good.select(F.when(F.col("k") != 49, F.col("k")).alias("k")).repartition(4)
    with pytest.raises(Exception, match="holds NULL"):
        broken.write.format("fits_table").option("path", str(tmp_path / "f")).option("rows_per_file", 5).mode("overwrite").save()
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == before and fits_at(spark, tmp_path / "f").count() == 50


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    path, rows = str(tmp_path / "live"), spark.range(20)
    with pytest.raises(DataError, match="no version"):
        sinks.read_live(spark, path)
    assert sinks.live_version(spark, path) == 0 and sinks.replace_table(rows, path) == 1
    assert sinks.replace_table(sinks.read_live(spark, path).filter("id < 5"), path) == 2
    with pytest.raises(Exception, match="planted"):
        sinks.replace_table(rows.select(F.when(F.col("id") == 19, F.raise_error(F.lit("planted")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert sinks.read_live(spark, path).count() == 5
    assert sinks.replace_table(rows.limit(3), path) == 3 and sinks.read_live(spark, path).count() == 3


def test_statuses_and_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(9).select(F.col("id").alias("TARGETID"), (F.col("id") * 2.0).alias("Z")).write.parquet(path)
    found = catalog.input_statuses(spark, {"here": path, "gone": str(tmp_path / "none")})
    assert {tuple(r) for r in found.collect()} == {("here", "present", 9), ("gone", "missing", None)}
    df = catalog.scan_catalogue(spark, path, ["targetid"], F.col("z") > 10, {"TARGETID": "targetid", "Z": "z"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Z,10.0)" in plan and sorted(r["targetid"] for r in df.collect()) == [6, 7, 8]
