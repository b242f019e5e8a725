"""Sources, sinks and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.operators import ledger as lg
from skyframe.operators import quality as q
from skyframe.operators import sample as sm
from skyframe.operators import scoring as sc
from skyframe.params import Grid, SplitParams
from skyframe.plans import quality as pq
from skyframe.plans import spectra as ps
from skyframe.registry.base import query
from skyframe.registry.sampling import SHUFFLE
from skyframe.registry.scoring import SCORES, scores
from skyframe.session import stage_path
from skyframe.sources import catalog, fits, sinks

GRID = Grid(3600.0, 0.8, 64)


# ---- sources

@query("src_file_inventory", """
SELECT coalesce(a.path, b.path) AS path, length, expected_bytes, CASE WHEN length IS NULL THEN 'missing' WHEN expected_bytes IS NULL THEN 'unexpected'
  WHEN length < expected_bytes THEN 'partial' WHEN length > expected_bytes THEN 'wrong_size' ELSE 'present' END AS status
FROM v_files a FULL JOIN v_expected b ON a.path = b.path""")
def src_file_inventory(v):
    return catalog.inventory(v.files, v.expected)


@query("src_digest_verify", """
SELECT f.path, md5(html) AS got, e.md5 AS want, md5(html) = e.md5 AS matches FROM v_files f JOIN v_expected e ON f.path = e.path""")
def src_digest_verify(v):
    return catalog.verify_digests(v.files, v.expected, "html")


@query("src_content_digest", "SELECT path, md5(html) AS md5, sha256(html) AS sha256 FROM v_files")
def src_content_digest(v):
    return catalog.content_digests(v.files, "html").select("path", "md5", "sha256")


@query("src_sidecar_lookup", """
SELECT concat(CAST(doc_id AS VARCHAR), '.fits') AS filename, sha256(text) AS sha256 FROM documents""")
def src_sidecar_lookup(v):
    d = v.table("documents")
    digest = F.upper(F.sha2(F.col("text"), 256))
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "*").otherwise(""), F.lit("some/folder/"), F.col("doc_id").cast("string"), F.lit(".fits"))
    lines = d.select(F.concat(F.lit("  "), digest, F.lit("   "), name).alias("value"))
    return catalog.sidecar_digests(lines)


@query("src_ids_from_names", "SELECT page_id AS targetid FROM pages")
def src_ids_from_names(v):
    return catalog.ids_in_names(v.files)


@query("src_csv_scan", "SELECT s_suppkey, s_acctbal FROM supplier")
def src_csv_scan(v):
    path = stage_path(v.spark, "supplier")
    table = v.table("supplier")
    sinks.write_csv(table, path)
    schema = T.StructType([f for f in table.schema])
    return catalog.scan_csv(v.spark, path, schema, ["s_suppkey", "s_acctbal"])


@query("src_listing", "SELECT TRUE AS known, count(*) > 0 AS any_file FROM region")
def src_listing(v):
    path = stage_path(v.spark, "region")
    v.table("region").write.parquet(path)
    files = catalog.listing(v.spark, path, "*.parquet")
    return files.agg(F.every(F.col("length") > 0).alias("known"), (F.count(F.lit(1)) > 0).alias("any_file"))


@query("src_input_statuses", """
SELECT 'orders' AS name, 'present' AS status, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', 'present', count(*) FROM lineitem
UNION ALL SELECT 'documents', 'present', count(*) FROM documents UNION ALL SELECT 'not_there', 'missing', NULL""")
def src_input_statuses(v):
    return catalog.input_statuses(v.spark, {n: f"{v.folder}/{n}.parquet" for n in ("orders", "lineitem", "documents", "not_there")})


@query("src_fits_table", """
SELECT l_orderkey, l_extendedprice, l_returnflag FROM lineitem WHERE l_quantity >= 30 AND l_partkey < 900""")
def src_fits_table(v):
    """Rows written as FITS tables and read back: three columns under a filter on two others that the reader applies to the records."""
    fits.register(v.spark)
    path = stage_path(v.spark, "lineitem_fits")
    rows = v.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    rows.write.format("fits_table").option("path", path).option("rows_per_file", 50_000).mode("append").save()
    back = v.spark.read.format("fits_table").option("path", path).option("rows_per_partition", 20_000).load()
    return back.filter("l_quantity >= 30 AND l_partkey < 900").select("l_orderkey", "l_extendedprice", "l_returnflag")


# ---- sinks

@query("snk_atomic_replace", """
SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, 2 AS version FROM orders WHERE o_orderkey % 3 <> 1""")
def snk_atomic_replace(v):
    """A table written, replaced by one made from it, and replaced by a write that fails half way: the second version stays in place."""
    path, price = stage_path(v.spark, "live"), F.col("o_totalprice")
    sinks.replace_table(v.table("orders").select("o_orderkey", "o_totalprice"), path)
    sinks.replace_table(sinks.read_live(v.spark, path).filter("o_orderkey % 3 <> 1").withColumn("o_totalprice", price * 2), path)
    broken = F.when(F.col("o_orderkey") % 5 == 3, F.raise_error(F.lit("planted fault")).cast("double")).otherwise(price)
    try:
        sinks.replace_table(sinks.read_live(v.spark, path).withColumn("o_totalprice", broken), path)
    except Exception as error:
        if "planted fault" not in str(error):
            raise
    return sinks.read_live(v.spark, path).withColumn("version", F.lit(sinks.live_version(v.spark, path)))


@query("snk_sorted_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def snk_sorted_parquet(v):
    path = stage_path(v.spark, "orders")
    sinks.write_sorted(v.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_custkey", "o_orderkey")
    return v.spark.read.parquet(path)


@query("snk_sorted_positions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 AS position
FROM lineitem""")
def snk_sorted_positions(v):
    """Where each row stands in the sorted files."""
    path, keys = stage_path(v.spark, "lineitem"), ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    sinks.write_sorted(v.table("lineitem").select(*keys), path, *keys)
    return sinks.read_positions(v.spark, path)


@query("src_listing_values", "SELECT n_regionkey, 1 AS files, count(*) AS rows FROM nation GROUP BY n_regionkey")
def src_listing_values(v):
    """The folders of a partitioned table as its listing shows them, beside the rows that are read from the listed files."""
    path = stage_path(v.spark, "nation")
    v.table("nation").repartition("n_regionkey").write.partitionBy("n_regionkey").parquet(path)
    folder = F.regexp_extract("path", r"n_regionkey=(-?\d+)/", 1).cast("int")
    files = catalog.listing(v.spark, path, "*.parquet").filter("length > 0")
    listed = files.groupBy(folder.alias("n_regionkey")).agg(F.count(F.lit(1)).cast("int").alias("files"))
    return listed.join(v.spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("rows")), "n_regionkey")


@query("snk_csv", "SELECT targetid, split_source, has_z, spectype, redshift FROM v_sample")
def snk_csv(v):
    path = stage_path(v.spark, "sample")
    rows = v.sample.select("targetid", "split_source", "has_z", "spectype", "redshift")
    sinks.write_csv(rows, path)
    return catalog.scan_csv(v.spark, path, rows.schema)


@query("snk_ledger", """
SELECT 'sample' AS step, 1 AS ord, 'split_source_pairs_excluded' AS filter, count_if(NOT split_source) AS kept, count(*) AS rows_in FROM v_sample""")
def snk_ledger(v):
    path = stage_path(v.spark, "ledger")
    counts = lg.named_counts(v.sample.agg(F.count(F.lit(1)).alias("rows_in")))
    record = lg.ledger_record("sample", counts, lg.cut_ledger(v.sample, sm.sample_cuts()), {"sample": "given"}, {"seed": "42"})
    sinks.write_ledger(record, path)
    back = sinks.read_ledger(v.spark, path)
    return back.select("step", F.explode("filters").alias("f"), F.col("counts")["rows_in"].alias("rows_in")).filter("f.ord = 1").select(
        "step", "f.ord", "f.filter", "f.kept", "rows_in")


@query("src_ledger_read", "SELECT 'sample' AS step, 'has_image' AS filter, count_if(NOT split_source AND has_spectrum AND has_image) AS kept FROM v_sample")
def src_ledger_read(v):
    path = stage_path(v.spark, "ledger")
    counts = lg.named_counts(v.sample.agg(F.count(F.lit(1)).alias("rows_in")))
    sinks.write_ledger(lg.ledger_record("sample", counts, lg.cut_ledger(v.sample, sm.sample_cuts())), path)
    return sinks.read_ledger(v.spark, path).select("step", F.explode("filters").alias("f")).filter("f.filter = 'has_image'").select("step", "f.filter", "f.kept")


@query("snk_json_safe", """
SELECT vec_id, concat('{"vec_id":', CAST(vec_id AS VARCHAR), ',"x":', CASE WHEN vec_id % 3 = 0 THEN 'null' ELSE CAST(vec_id AS VARCHAR) || '.5' END, ',"a":[1.0,null]}') AS json FROM embeddings""")
def snk_json_safe(v):
    e = v.table("embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, float("nan")).otherwise(F.col("vec_id") + 0.5).alias("x"),
                                     F.array(F.lit(1.0), F.lit(float("inf"))).alias("a"))
    return e.select("vec_id", sinks.json_safe(e).alias("json"))


@query("snk_markdown_table", f"""
WITH {SCORES}, g AS (SELECT subset, ordinal, head, avg(ll - prior) AS ig FROM scores WHERE common GROUP BY subset, ordinal, head),
w AS (SELECT subset, ordinal, max(CASE WHEN head = 'flux' THEN ig END) AS f, max(CASE WHEN head = 'lx' THEN ig END) AS l FROM g GROUP BY subset, ordinal)
SELECT 0 AS ord, '| subset | flux_information_gain | lx_information_gain |' AS line UNION ALL SELECT 1, '|---|---|---|'
UNION ALL SELECT ordinal + 2, concat('| ', subset, ' | ', printf('%.3f', f), ' | ', printf('%.3f', l), ' |') FROM w""")
def snk_markdown_table(v):
    grid = sc.score_grid(sc.information_gain(scores(v)), ["flux", "lx"])
    path = stage_path(v.spark, "table")
    lines = sinks.markdown_rows(grid, "ordinal", ["subset", "flux_information_gain", "lx_information_gain"])
    sinks.write_text(lines, path)
    back = v.spark.read.text(path)  # one small file
    return back.select(F.monotonically_increasing_id().cast("int").alias("ord"), F.col("value").alias("line"))


# ---- staged rows with planted faults

def manifest(v):
    rows = v.images.select("targetid", F.concat(F.lit("D"), (F.col("targetid") - F.col("targetid") % 2 * (F.col("targetid") % 40 == 1).cast("int")).cast("string")).alias("ero_detuid"),
                           (F.col("targetid") % 9 != 4).alias("in_sample"), ((F.col("targetid") % 70) / 10.0).alias("z"),
                           F.when(F.col("targetid") % 19 == 0, 4).otherwise(0).alias("zwarn"), (F.col("targetid") % 6 != 1).alias("has_wise"))
    rows = rows.withColumn("has_z", (F.col("z") > 0) & (F.col("zwarn") == 0))
    drawn = sm.assign_split(rows.filter("in_sample").select("targetid"))
    return rows.join(drawn, "targetid", "left")


def staged(v, clean: bool = False):
    k = F.col("targetid")
    m = manifest(v).filter("in_sample")
    e = v.table("embeddings").select(F.col("vec_id").alias("targetid"), "embedding")
    j = m.join(e, "targetid").join(v.images.select("targetid", "image"), "targetid")
    fault = F.lit(not clean)
    return j.select(
        "targetid", F.when(fault & (k % 97 == 5), "val").otherwise(F.col("split")).alias("split"), k.alias("source_row"),
        F.transform("embedding", lambda x, i: F.when(fault & (k % 83 == 7) & (i == 4), F.lit(float("nan"))).otherwise(x).cast("float")).alias("spectra"),
        F.transform("embedding", lambda x, i: F.when(fault & (k % 89 == 3) & (i == 0), -1.0).otherwise(i % 3).cast("float")).alias("spectra_ivar"),
        F.when(fault & (k % 71 == 9), 11.0).otherwise(F.col("z")).cast("float").alias("redshift"),
        *[F.lit(1.0).cast("float").alias(f"flux_{b}") for b in ("w1", "w2", "w3")],
        (F.col("embedding") if clean else F.col("image")).alias("image_flux"),
        F.when(fault & (k % 61 == 8), ~F.col("has_z")).otherwise(F.col("has_z")).alias("has_z"), "has_wise")


M_SQL = f"""
base AS (SELECT targetid, image, concat('D', CAST(targetid - CASE WHEN targetid % 40 = 1 THEN 1 ELSE 0 END AS VARCHAR)) AS ero_detuid,
  targetid % 9 <> 4 AS in_sample, (targetid % 70) / 10.0e0 AS z, CASE WHEN targetid % 19 = 0 THEN 4 ELSE 0 END AS zwarn, targetid % 6 <> 1 AS has_wise FROM v_images),
chosen AS (SELECT *, z > 0 AND zwarn = 0 AS has_z FROM base WHERE in_sample), {SHUFFLE},
m AS (SELECT *, CASE WHEN rank < round_even(0.8e0 * total, 0) THEN 'train' WHEN rank < round_even(0.9e0 * total, 0) THEN 'val' ELSE 'test' END AS split FROM ranked),
st AS (SELECT targetid, image, CASE WHEN targetid % 97 = 5 THEN 'val' ELSE split END AS split, CASE WHEN targetid % 71 = 9 THEN 11 ELSE z END AS redshift,
  CASE WHEN targetid % 61 = 8 THEN NOT has_z ELSE has_z END AS has_z, zwarn, split AS m_split, z, has_z AS m_has_z FROM m)"""


def _text(*pairs: tuple[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {expr} > 0 THEN concat('{name}: ', CAST({expr} AS VARCHAR)) END" for name, expr in pairs)
    return f"concat_ws('; ', {parts})"


def _check(name: str, source: str, *pairs: tuple[str, str]) -> str:
    return f"SELECT '{name}' AS \"check\", d = '' AS passed, CASE WHEN d = '' THEN 'ok' ELSE d END AS detail FROM (SELECT {_text(*pairs)} AS d FROM {source})"


NAN = "list_contains(list_transform(image, lambda x: isnan(x)), TRUE)"
SCHEMA_SQL = _check("schema", "st", ("spectra_shape", "count_if(FALSE)"), ("ivar_shape", "count_if(FALSE)"), ("image_shape", "count_if(len(image) <> 64)"))
IDS_SQL = _check("targetids", "st", ("duplicates", "count_if(FALSE)"), ("in_two_splits", "count_if(FALSE)"), ("differ_from_split_table", "2 * count_if(split <> m_split)"))
SIZES_SQL = _check("split_sizes", "st", *[(s, f"CASE WHEN abs(count_if(split = '{s}') - ({e})) > 1 THEN 1 ELSE 0 END") for s, e in (
    ("train", "round_even(0.8e0 * count(*), 0)"), ("val", "round_even(0.9e0 * count(*), 0) - round_even(0.8e0 * count(*), 0)"), ("test", "count(*) - round_even(0.9e0 * count(*), 0)"))])
AGREE_SQL = _check("manifest_agreement", "st", ("absent", "count_if(FALSE)"), ("split", "count_if(split <> m_split)"), ("has_z", "count_if(has_z <> m_has_z)"),
                   ("has_wise", "count_if(FALSE)"), ("redshift", "count_if(redshift <> z)"))
DET_SQL = _check("detections_in_one_split", "(SELECT ero_detuid, count(DISTINCT split) AS n FROM m GROUP BY ero_detuid)", ("detections", "count_if(n > 1)"))
CONTENT_SQL = _check("content", "st", ("image_not_finite", f"count_if({NAN})"), ("image_all_zero", "count_if(len(list_filter(image, lambda x: x <> 0)) = 0)"),
                     ("bad_ivar", "count_if(targetid % 89 = 3)"), ("bad_flux", "count_if(targetid % 83 = 7)"),
                     ("has_z_rule", "count_if((redshift > 0 AND zwarn = 0) <> has_z)"), ("implausible_redshift", "count_if(abs(redshift) >= 10)"))
LABELS_SQL = _check("labels", "st", ("without_label", "count_if(targetid % 7 = 2)"))


@query("dq_files", _check("files_present", """(SELECT CASE WHEN length IS NULL THEN 'missing' WHEN expected_bytes IS NULL THEN 'unexpected' WHEN length < expected_bytes THEN 'partial'
  WHEN length > expected_bytes THEN 'wrong_size' ELSE 'present' END AS s FROM v_files a FULL JOIN v_expected b ON a.path = b.path)""",
                          *[(k, f"count_if(s = '{k}')") for k in ("missing", "partial", "wrong_size", "unexpected")]))
def dq_files(v):
    return q.check_files(catalog.inventory(v.files, v.expected))


@query("dq_schema", f"WITH {M_SQL} {SCHEMA_SQL}")
def dq_schema(v):
    return q.check_schema(staged(v), GRID, 4)


@query("dq_targetids", f"WITH {M_SQL} {IDS_SQL}")
def dq_targetids(v):
    return q.check_targetids(staged(v), manifest(v).filter("in_sample"))


@query("dq_split_sizes", f"WITH {M_SQL} {SIZES_SQL}")
def dq_split_sizes(v):
    return q.check_split_sizes(staged(v))


@query("dq_manifest_agreement", f"WITH {M_SQL} {AGREE_SQL}")
def dq_manifest_agreement(v):
    return q.check_manifest_agreement(staged(v), manifest(v))


@query("dq_detections", f"WITH {M_SQL} {DET_SQL}")
def dq_detections(v):
    return q.check_detections(manifest(v))


@query("dq_content", f"WITH {M_SQL} {CONTENT_SQL}")
def dq_content(v):
    return q.check_content(staged(v), manifest(v))


def labels(v):
    return v.images.filter("targetid % 7 <> 2").select("targetid", F.lit(1.0).alias("log_flux_1"), F.when(F.col("targetid") % 3 != 0, 2.0).alias("log_sfr"))


@query("dq_labels", f"WITH {M_SQL} {LABELS_SQL}")
def dq_labels(v):
    return q.check_labels(staged(v), labels(v), ["log_flux_1", "log_sfr"])


@query("dq_staged_label_counts", f"""
WITH {M_SQL} SELECT 'log_flux_1' AS label, count_if(targetid % 7 <> 2) AS finite FROM st UNION ALL SELECT 'log_sfr', count_if(targetid % 7 <> 2 AND targetid % 3 <> 0) FROM st""")
def dq_staged_label_counts(v):
    return q.staged_label_counts(staged(v), labels(v), ["log_flux_1", "log_sfr"])


@query("dq_report", f"""
WITH {M_SQL}, c AS ({AGREE_SQL} UNION ALL {DET_SQL} UNION ALL {SIZES_SQL})
SELECT bool_and(passed) AS passed, string_agg(CASE WHEN NOT passed THEN "check" END, ',' ORDER BY "check") AS failed FROM c""")
def dq_report(v):
    checks = q.report([q.check_manifest_agreement(staged(v), manifest(v)), q.check_detections(manifest(v)), q.check_split_sizes(staged(v))])
    return q.overall(checks).withColumn("failed", F.concat_ws(",", "failed"))


@query("job_validate", f"""
WITH {M_SQL} SELECT 'schema' AS "check", TRUE AS passed, 'ok' AS detail UNION ALL SELECT 'targetids', TRUE, 'ok' UNION ALL SELECT 'split_sizes', TRUE, 'ok'
UNION ALL SELECT 'manifest_agreement', TRUE, 'ok' UNION ALL {DET_SQL} UNION ALL SELECT 'content', TRUE, 'ok' UNION ALL {LABELS_SQL}""")
def job_validate(v):
    m = manifest(v)
    return pq.validate(staged(v, clean=True), m, m.filter("in_sample"), labels(v), GRID, 4, SplitParams(), None, ["log_flux_1", "log_sfr"])


def all_there(v):
    """The files beside a list that agrees with them."""
    return catalog.inventory(v.files, v.files.select("path", F.col("length").alias("expected_bytes")))


FILES_OK = "SELECT 'files_present' AS \"check\", TRUE AS passed, 'ok' AS detail"


@query("job_validate_faults", f"""
WITH {M_SQL} {FILES_OK} UNION ALL SELECT 'schema', TRUE, 'ok' UNION ALL {IDS_SQL} UNION ALL {SIZES_SQL} UNION ALL {AGREE_SQL} UNION ALL {DET_SQL}
UNION ALL {CONTENT_SQL} UNION ALL {LABELS_SQL}""")
def job_validate_faults(v):
    """Faults in every check that comes after files and schema."""
    whole = F.when(F.size("image_flux") == 64, F.col("image_flux"))
    shapes = v.table("embeddings").select(F.col("vec_id").alias("targetid"), F.col("embedding").alias("_full"))
    rows = staged(v).join(shapes, "targetid").withColumn("image_flux", F.coalesce(whole, F.col("_full"))).drop("_full")
    m = manifest(v)
    return pq.validate(rows, m, m.filter("in_sample"), labels(v), GRID, 4, SplitParams(), all_there(v), ["log_flux_1", "log_sfr"])


@query("job_validate_stops", f"WITH {M_SQL} {FILES_OK} UNION ALL {SCHEMA_SQL}")
def job_validate_stops(v):
    """Short images: the schema fails, and nothing after it is reported."""
    m = manifest(v)
    return pq.validate(staged(v), m, m.filter("in_sample"), labels(v), GRID, 4, SplitParams(), all_there(v), ["log_flux_1", "log_sfr"])


def worse(v):
    """Staged rows with a fault for every count that `staged` leaves at 0."""
    k = F.col("targetid")
    rows = staged(v).withColumns({
        "spectra": F.when(k % 53 == 4, F.slice("spectra", 1, 63)).otherwise(F.col("spectra")), "has_wise": (k % 59 == 7) != F.col("has_wise"),
        "spectra_ivar": F.when(k % 47 == 6, F.slice("spectra_ivar", 1, 63)).otherwise(F.col("spectra_ivar"))})
    other = F.when(F.col("split") == "train", "val").otherwise("train")
    again = rows.filter(k % 43 == 2)
    return rows.union(again).union(rows.filter(k % 41 == 3).withColumn("split", other)).union(rows.filter(k % 37 == 5).withColumn("targetid", k + 10_000_000))


W_SQL = """wx AS (SELECT *, targetid % 53 = 4 AS s_bad, targetid % 47 = 6 AS v_bad, targetid % 59 = 7 AS w_bad, targetid AS old FROM st),
w AS (SELECT * FROM wx UNION ALL SELECT * FROM wx WHERE targetid % 43 = 2
  UNION ALL SELECT * REPLACE (CASE WHEN split = 'train' THEN 'val' ELSE 'train' END AS split) FROM wx WHERE targetid % 41 = 3
  UNION ALL SELECT * REPLACE (targetid + 10000000 AS targetid) FROM wx WHERE targetid % 37 = 5),
wk AS (SELECT *, targetid < 10000000 AS known FROM w)"""
WORSE_SCHEMA = _check("schema", "wk", ("spectra_shape", "count_if(s_bad)"), ("ivar_shape", "count_if(v_bad)"), ("image_shape", "count_if(len(image) <> 64)"))
WORSE_AGREE = _check("manifest_agreement", "wk", ("absent", "count_if(NOT known)"), ("split", "count_if(known AND split <> m_split)"),
                     ("has_z", "count_if(known AND has_z <> m_has_z)"), ("has_wise", "count_if(known AND w_bad)"), ("redshift", "count_if(known AND redshift <> z)"))


@query("dq_every_fault", f"""
WITH {M_SQL}, {W_SQL},
per AS (SELECT targetid, split, count(*) AS n FROM wk GROUP BY targetid, split),
ids AS (SELECT coalesce(p.targetid, m.targetid) AS k, count_if(n > 1) AS dup, count(n) AS held, count_if(n IS NULL OR m.targetid IS NULL) AS diff
  FROM per p FULL JOIN m ON p.targetid = m.targetid AND p.split = m.split GROUP BY 1)
{WORSE_SCHEMA} UNION ALL {WORSE_AGREE} UNION ALL
{_check("targetids", "ids", ("duplicates", "sum(dup)"), ("in_two_splits", "count_if(held > 1)"), ("differ_from_split_table", "sum(diff)"))}""")
def dq_every_fault(v):
    rows, m = worse(v), manifest(v)
    checks = [q.check_schema(rows, GRID, 4), q.check_manifest_agreement(rows, m), q.check_targetids(rows, m.filter("in_sample"))]
    return q.report(checks)


@query("snk_staged_split", f"WITH {M_SQL} SELECT split, count(*) AS rows, min(targetid) AS first_row, max(targetid) AS last_row FROM m GROUP BY split")
def snk_staged_split(v):
    path = stage_path(v.spark, "staged")
    sinks.write_staged(staged(v, clean=True), path, 128)
    back = v.spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"))


@query("job_stage", f"""
WITH {M_SQL} SELECT m.targetid, m.split, m.targetid AS source_row, CAST(CAST(z AS FLOAT) AS DOUBLE) AS redshift, 64 AS bins, len(m.image) AS pixels FROM m""")
def job_stage(v):
    m = manifest(v).withColumns({f"ls10_flux_{b}": F.lit(1.0) for b in ("w1", "w2", "w3")})
    spectra = v.table("embeddings").select(F.col("vec_id").alias("targetid"), F.col("vec_id").alias("source_row"), F.col("embedding").alias("flux"), F.col("embedding").alias("ivar"))
    out = ps.stage(m, spectra, v.images)
    return out.select("targetid", "split", "source_row", F.col("redshift").cast("double").alias("redshift"), F.size("spectra").alias("bins"), F.size("image_flux").alias("pixels"))
