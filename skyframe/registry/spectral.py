"""Spectra, images, staging and emission lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import spectra as fs
from skyframe.functions.core import shape_problem
from skyframe.operators import lines as ln
from skyframe.operators import spectra as sp
from skyframe.operators.joins import strict_lookup
from skyframe.operators.rank import order_breaks
from skyframe.params import LINE_COMPLEXES, Grid
from skyframe.plans import spectra as ps
from skyframe.registry.base import query
from skyframe.session import stage_path

CAMERA_GRID = Grid(3600.0, 0.8, 176)
LINE_GRID = Grid(3600.0, 2.0, 3100)

COADD = """
px AS (SELECT targetid, survey, program, healpix, unnest(wave) AS wave, unnest(flux) AS flux, unnest(ivar) AS ivar FROM v_camera),
binned AS (SELECT targetid, survey, program, healpix, CAST(round_even((wave - 3600.0e0) / 0.8e0, 0) AS INT) AS bin,
  CASE WHEN flux IS NOT NULL AND ivar > 0 THEN flux * ivar ELSE 0 END AS fv, CASE WHEN flux IS NOT NULL AND ivar > 0 THEN ivar ELSE 0 END AS v FROM px),
sums AS (SELECT targetid, survey, program, healpix, bin, sum(fv) AS num, sum(v) AS den FROM binned WHERE bin >= 0 AND bin < 176
  GROUP BY targetid, survey, program, healpix, bin),
shards AS (SELECT targetid, survey, program, healpix, count_if(den > 0) AS n_good,
  concat(survey, '__', program, '__', CAST(healpix AS VARCHAR)) AS shard FROM sums GROUP BY targetid, survey, program, healpix),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY targetid ORDER BY n_good DESC, shard) AS rn FROM shards) WHERE rn = 1)
"""

WINDOWS = f"""
complexes(line, lo, hi) AS (VALUES {", ".join(f"('{c.name}', {c.window[0]!r}e0, {c.window[1]!r}e0)" for c in LINE_COMPLEXES)}),
covered AS (SELECT s.targetid, s.z, s.flux, s.ivar, c.line, c.lo, c.hi FROM v_spectra s JOIN complexes c
  ON s.z > 0 AND s.z >= 3600.0e0 / c.lo - 1 AND s.z <= 9798.0e0 / c.hi - 1),
px AS (SELECT targetid, z, line, lo, hi, (3600.0e0 + 2.0e0 * unnest(range(0, 3100))) / (1 + z) AS x, unnest(flux) AS y, unnest(ivar) AS v FROM covered),
inside AS (SELECT * FROM px WHERE x >= lo AND x <= hi),
stats AS (SELECT targetid, z, line, lo, hi, count(*) AS n_window, count_if(v > 0) AS n_good,
  median(CASE WHEN v > 0 THEN 1 / sqrt(v) END) AS noise,
  CASE WHEN count_if(v > 0 AND (x < lo + 0.22e0 * (hi - lo) OR x > hi - 0.22e0 * (hi - lo))) > 10
    THEN median(CASE WHEN v > 0 AND (x < lo + 0.22e0 * (hi - lo) OR x > hi - 0.22e0 * (hi - lo)) THEN y END)
    ELSE median(CASE WHEN v > 0 THEN y END) END AS c0, max(CASE WHEN v > 0 THEN y END) AS top FROM inside GROUP BY ALL),
gated AS (SELECT *, CASE WHEN n_window < 60 THEN 'off_grid' WHEN n_good < 0.8e0 * n_window THEN 'window_ivar' END AS status FROM stats)
""".replace("GROUP BY ALL", "GROUP BY targetid, z, line, lo, hi")


def shards(v):
    return sp.coadd(v.camera, CAMERA_GRID)


@query("src_spectra_by_target", """
SELECT targetid, camera, len(flux) AS pixels FROM v_camera WHERE (targetid, survey, program, healpix) IN
  (SELECT targetid, survey, program, healpix FROM v_camera WHERE camera = 'b' AND targetid % 3 <> 1)""")
def src_spectra_by_target(v):
    want = v.camera.filter("camera = 'b' AND targetid % 3 <> 1").select("targetid", "survey", "program", "healpix")
    return sp.wanted_spectra(v.camera, want).select("targetid", "camera", F.size("flux").alias("pixels"))


@query("agg_coadd", f"""
WITH {COADD}, every AS (SELECT targetid, survey, program, healpix, unnest(range(0, 176)) AS bin FROM shards)
SELECT e.targetid, e.survey, e.healpix, e.bin, round(CAST(CAST(CASE WHEN den > 0 THEN num / CASE WHEN den > 0 THEN den END ELSE 0 END AS FLOAT) AS DOUBLE), 5) AS flux,
  coalesce(den, 0) AS ivar FROM every e LEFT JOIN sums s USING (targetid, survey, program, healpix, bin)""")
def agg_coadd(v):
    out = shards(v).select("targetid", "survey", "healpix", F.posexplode(F.arrays_zip("flux", "ivar")).alias("bin", "p"))
    return out.select("targetid", "survey", "healpix", "bin", F.round(F.col("p.flux").cast("double"), 5).alias("flux"),
                      F.col("p.ivar").cast("double").alias("ivar"))


@query("agg_merge_best", f"WITH {COADD} SELECT targetid, shard, n_good FROM best")
def agg_merge_best(v):
    return sp.merge_best(shards(v)).select("targetid", "shard", "n_good")


@query("agg_merge_counts", f"""
WITH {COADD} SELECT count(DISTINCT shard) AS shards, count(*) AS rows, count(DISTINCT targetid) AS unique_targets,
  count(*) - count(DISTINCT targetid) AS duplicates_dropped FROM shards""")
def agg_merge_counts(v):
    return sp.merge_counts(shards(v))


@query("agg_missing_after_merge", "SELECT count(*) AS missing FROM (SELECT DISTINCT o_orderkey AS targetid FROM orders) WHERE targetid NOT IN (SELECT targetid FROM v_camera)")
def agg_missing_after_merge(v):
    want = v.table("orders").select(F.col("o_orderkey").alias("targetid")).distinct()
    return want.join(v.camera.select("targetid"), "targetid", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("job_coadd_spectra", f"""
WITH {COADD}, chosen AS (SELECT s.targetid, b.shard, b.n_good, sum(den) AS total_ivar, sum(CASE WHEN den > 0 THEN num / CASE WHEN den > 0 THEN den END END) AS total_flux
  FROM best b JOIN sums s USING (targetid, survey, program, healpix) GROUP BY s.targetid, b.shard, b.n_good)
SELECT targetid, shard, n_good, total_ivar, round(total_flux, 3) AS total_flux FROM chosen WHERE targetid % 5 <> 2""")
def job_coadd_spectra(v):
    want = v.camera.filter("targetid % 5 <> 2").select("targetid", "survey", "program", "healpix").distinct()
    merged = ps.coadd_spectra(v.camera, want, CAMERA_GRID).spectra
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return merged.select("targetid", "shard", "n_good", total("ivar").alias("total_ivar"), F.round(total("flux"), 3).alias("total_flux"))


@query("src_shard_store", f"WITH {COADD} SELECT survey, program, healpix, count(*) AS rows FROM shards GROUP BY survey, program, healpix")
def src_shard_store(v):
    from skyframe.sources.sinks import write_shards
    folder = stage_path(v.spark, "shards")
    write_shards(shards(v), folder)
    return v.spark.read.parquet(folder).groupBy("survey", "program", "healpix").agg(F.count(F.lit(1)).alias("rows"))


@query("snk_group_status", """
WITH p AS (SELECT DISTINCT survey, program, healpix FROM v_camera), d AS (SELECT DISTINCT survey, program, healpix FROM v_camera WHERE camera = 'r' AND targetid % 2 = 0),
g AS (SELECT DISTINCT survey, program, healpix FROM v_camera WHERE healpix = 3)
SELECT survey, program, healpix, CASE WHEN (survey, program, healpix) IN (SELECT * FROM d) THEN 'done' WHEN (survey, program, healpix) IN (SELECT * FROM g) THEN 'absent' ELSE 'todo' END AS status FROM p""")
def snk_group_status(v):
    return sp.group_status(v.camera, v.camera.filter("camera = 'r' AND targetid % 2 = 0"), v.camera.filter("healpix = 3"))


@query("fn_grid_bin", """
SELECT vec_id, i, CASE WHEN b >= 0 AND b < 100 THEN b END AS bin, round(3600 + 0.8e0 * b, 6) AS centre FROM (
  SELECT vec_id, i, CAST(round_even((w - 3600.0e0) / 0.8e0, 0) AS INT) AS b FROM (
    SELECT vec_id, unnest(range(0, 64)) AS i, 3590.3e0 + unnest(range(0, 64)) * 1.7e0 + vec_id % 10 AS w FROM embeddings))""")
def fn_grid_bin(v):
    px = v.table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    w = F.lit(3590.3) + F.col("i") * F.lit(1.7) + F.col("vec_id") % 10
    b = F.rint((w - 3600.0) / 0.8).cast("int")
    return px.select("vec_id", "i", fs.grid_bin(w, Grid(3600.0, 0.8, 100)).alias("bin"), F.round(fs.bin_wavelength(b, Grid()), 6).alias("centre"))


@query("fn_array_predicates", """
SELECT targetid, NOT list_contains(list_transform(image, lambda x: isnan(x)), TRUE) AS finite, len(list_filter(image, lambda x: x <> 0)) > 0 AS nonzero,
  len(list_filter(image, lambda x: x > 0 AND NOT isnan(x))) AS positive FROM v_images""")
def fn_array_predicates(v):
    clean = F.transform("image", lambda x: F.when(~F.isnan(x), x))
    return v.images.select("targetid", fs.all_finite("image").alias("finite"), fs.any_nonzero("image").alias("nonzero"),
                           fs.count_positive(clean).alias("positive"))


@query("fn_image_contract", """
SELECT targetid, CASE WHEN lower(bands) <> 'griz' THEN 'bad_bands' WHEN len(image) <> 64 THEN 'bad_shape'
  WHEN list_contains(list_transform(image, lambda x: isnan(x)), TRUE) THEN 'not_finite' ELSE 'ok' END AS verdict FROM v_images""")
def fn_image_contract(v):
    return v.images.select("targetid", shape_problem("image", "bands", 4, "griz").alias("verdict"))


@query("join_positional_row", """
WITH rows AS (SELECT targetid, row_number() OVER (ORDER BY targetid) - 1 AS source_row FROM v_spectra)
SELECT i.targetid, r.source_row FROM v_images i JOIN rows r USING (targetid)""")
def join_positional_row(v):
    from skyframe.operators.rank import ordered_rank
    rows = ordered_rank(v.spectra.select("targetid"), ["targetid"], "source_row")
    return strict_lookup(v.images.select("targetid"), rows, ["targetid"], "spectra")


@query("win_order_check", """
SELECT o_custkey, o_orderkey, o_totalprice, previous FROM (SELECT o_custkey, o_orderkey, o_totalprice,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_totalprice <= previous""")
def win_order_check(v):
    return order_breaks(v.table("orders"), "o_totalprice", ["o_custkey"], "o_orderkey")


@query("flt_line_in_window", """
SELECT targetid, z > 0 AND z >= 3600.0e0 / 4920.0e0 - 1 AND z <= 9798.0e0 / 5080.0e0 - 1 AS oiii, z > 0 AND z >= 3600.0e0 / 3360.0e0 - 1 AND z <= 9798.0e0 / 3500.0e0 - 1 AS nev,
  z > 0 AND z >= 3600.0e0 / 6480.0e0 - 1 AND z <= 9798.0e0 / 6650.0e0 - 1 AS halpha, z > 0 AND z >= 3600.0e0 / 4770.0e0 - 1 AND z <= 9798.0e0 / 4940.0e0 - 1 AS hbeta FROM v_targets""")
def flt_line_in_window(v):
    return v.targets.select("targetid", *[fs.in_window("z", c.window, LINE_GRID.lam0, LINE_GRID.last).alias(c.name) for c in LINE_COMPLEXES])


@query("join_line_complexes", f"WITH {WINDOWS} SELECT targetid, line FROM covered")
def join_line_complexes(v):
    return ln.lines_in_window(v.spectra.select("targetid", "z"), LINE_GRID).select("targetid", "line")


@query("fn_window_slice", f"WITH {WINDOWS} SELECT targetid, line, count(*) AS pixels, round(sum(x), 4) AS sum_x, round(sum(y), 5) AS sum_y FROM inside GROUP BY targetid, line")
def fn_window_slice(v):
    cut = ln.lines_in_window(v.spectra, LINE_GRID)
    px = fs.window_pixels(F.col("flux"), F.col("ivar"), F.col("z"), (F.col("lo"), F.col("hi")), LINE_GRID)
    cut = cut.select("targetid", "line", px.alias("p"))
    def total(c):
        return F.aggregate(F.col(f"p.{c}"), F.lit(0.0), lambda a, x: a + x)
    return cut.select("targetid", "line", F.size("p").alias("pixels"), F.round(total("x"), 4).alias("sum_x"), F.round(total("y"), 5).alias("sum_y"))


@query("line_window_gates", f"""
WITH {WINDOWS} SELECT targetid, line, n_window, n_good, round(noise, 6) AS noise, round(c0, 6) AS c0, round(top - c0, 6) AS peak, status FROM gated""")
def line_window_gates(v):
    w = ln.line_windows(v.spectra, LINE_GRID)
    return w.select("targetid", "line", "n_window", "n_good", *[F.round(c, 6).alias(c) for c in ("noise", "c0", "peak")], "status")


@query("line_moment_flux", f"""
WITH {WINDOWS}, good AS (SELECT i.*, i.x - (i.lo + i.hi) / 2 AS d, x < i.lo + 0.22e0 * (i.hi - i.lo) OR x > i.hi - 0.22e0 * (i.hi - i.lo) AS edge, g.n_window
  FROM inside i JOIN gated g USING (targetid, line) WHERE g.status IS NULL AND v > 0),
f AS (SELECT targetid, line, sum(v) AS w, sum(v * d) AS sx, sum(v * d * d) AS sxx, sum(v * y) AS sy, sum(v * d * y) AS sxy FROM good WHERE edge GROUP BY targetid, line),
c AS (SELECT targetid, line, (w * sxy - sx * sy) / (w * sxx - sx * sx) AS slope, (sy * sxx - sx * sxy) / (w * sxx - sx * sx) AS level FROM f WHERE w * sxx - sx * sx > 0)
SELECT targetid, line, round(level, 5) AS level, round(slope, 6) AS slope, round(sum(y - level - slope * d) * (1 + any_value(z)) * any_value(hi - lo) / any_value(n_window), 4) AS flux
FROM good JOIN c USING (targetid, line) GROUP BY targetid, line, level, slope""")
def line_moment_flux(v):
    out = ln.moment_flux(ln.line_windows(v.spectra, LINE_GRID))
    return out.select("targetid", "line", F.round("level", 5).alias("level"), F.round("slope", 6).alias("slope"), F.round("flux", 4).alias("flux"))


@query("line_fits")
def line_fits(v):
    return ln.fit_lines(ln.line_windows(v.spectra, LINE_GRID))


def line_sample(v):
    return v.spectra.select("targetid", F.when(F.col("targetid") % 10 < 8, "train").otherwise("test").alias("split"),
                            F.when(F.col("targetid") % 3 == 0, "GALAXY").otherwise("QSO").alias("spectype"), "z")


def moment_fits(v):
    """Line fluxes of the moment method in the shape of fits."""
    windows = ln.line_windows(v.spectra, LINE_GRID)
    flux = ln.moment_flux(windows).select("targetid", "line", "flux", (F.abs("flux") * 0.1).alias("flux_err"), (F.col("flux") / 2).alias("an"))
    return windows.select("targetid", "line", F.coalesce("status", F.lit("ok")).alias("status")).join(flux, ["targetid", "line"], "left")


_MOMENT = """
m AS (SELECT targetid, line, round(sum(y - level - slope * d) * (1 + any_value(z)) * any_value(hi - lo) / any_value(n_window), 4) AS flux
  FROM good JOIN c USING (targetid, line) GROUP BY targetid, line),
s AS (SELECT g.targetid, g.line, coalesce(g.status, 'ok') AS status, m.flux FROM gated g LEFT JOIN m USING (targetid, line))"""

_GOOD = """good AS (SELECT i.*, i.x - (i.lo + i.hi) / 2 AS d, x < i.lo + 0.22e0 * (i.hi - i.lo) OR x > i.hi - 0.22e0 * (i.hi - i.lo) AS edge, g.n_window
  FROM inside i JOIN gated g USING (targetid, line) WHERE g.status IS NULL AND v > 0),
f AS (SELECT targetid, line, sum(v) AS w, sum(v * d) AS sx, sum(v * d * d) AS sxx, sum(v * y) AS sy, sum(v * d * y) AS sxy FROM good WHERE edge GROUP BY targetid, line),
c AS (SELECT targetid, line, (w * sxy - sx * sy) / (w * sxx - sx * sx) AS slope, (sy * sxx - sx * sxy) / (w * sxx - sx * sx) AS level FROM f WHERE w * sxx - sx * sx > 0)"""


def _feature_sql(stem: str, name: str, lo: float, hi: float) -> str:
    return f"""coalesce(max(CASE WHEN s.line = '{name}' AND s.status = 'ok' THEN s.flux END), 0) AS {stem}_flux,
  coalesce(max(CASE WHEN s.line = '{name}' THEN s.status END), CASE WHEN p.z > 0 AND p.z >= 3600.0e0 / {lo!r}e0 - 1 AND p.z <= 9798.0e0 / {hi!r}e0 - 1 THEN 'unfitted'
    WHEN p.z > 0 THEN 'not_in_window' ELSE 'no_redshift' END) AS {stem}_status"""


FEATURES = f"""WITH {WINDOWS}, {_GOOD}, {_MOMENT},
features AS (SELECT p.targetid, {", ".join(_feature_sql(c.stem, c.name, *c.window) for c in LINE_COMPLEXES)}
FROM v_spectra p LEFT JOIN s USING (targetid) GROUP BY p.targetid, p.z)"""


@query("line_features", f"{FEATURES} SELECT * FROM features")
def line_features(v):
    out = ln.features_from_fits(line_sample(v), moment_fits(v), LINE_GRID)
    return out.select("targetid", *[c for m in LINE_COMPLEXES for c in (F.round(f"{m.stem}_flux", 4).alias(f"{m.stem}_flux"), F.col(f"{m.stem}_status"))])


@query("agg_line_status", f"{FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c.stem}' AS line, {c.stem}_status AS status, count(*) AS rows FROM features GROUP BY {c.stem}_status" for c in LINE_COMPLEXES))
def agg_line_status(v):
    return ln.status_counts(ln.features_from_fits(line_sample(v), moment_fits(v), LINE_GRID))


@query("agg_line_totals", f"{FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c.stem}' AS line, count_if({c.stem}_status = 'ok') AS measured, count_if({c.stem}_status NOT IN ('not_in_window', 'no_redshift')) AS in_window FROM features"
    for c in LINE_COMPLEXES))
def agg_line_totals(v):
    return ln.line_totals(ln.status_counts(ln.features_from_fits(line_sample(v), moment_fits(v), LINE_GRID)))


@query("join_line_lookup", f"{FEATURES} SELECT targetid, oiii_5007_flux, nev_3426_flux, halpha_flux, hbeta_flux FROM features WHERE targetid % 2 = 0")
def join_line_lookup(v):
    features = ln.features_from_fits(line_sample(v), moment_fits(v), LINE_GRID)
    names = [f"{c.stem}_flux" for c in LINE_COMPLEXES]
    out = strict_lookup(v.images.filter("targetid % 2 = 0").select("targetid"), features, ["targetid"], "line features")
    return out.select("targetid", *[F.round(n, 4).alias(n) for n in names])


@query("agg_line_scaling", f"{FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c.stem}' AS target, count(*) AS n, round(avg({c.stem}_flux), 3) AS mean, round(stddev_pop({c.stem}_flux), 3) AS scale FROM features WHERE targetid % 10 < 8"
    for c in LINE_COMPLEXES))
def agg_line_scaling(v):
    from skyframe.operators.sample import moments
    features = ln.features_from_fits(line_sample(v), moment_fits(v), LINE_GRID).filter("split = 'train'")
    out = moments(features, {c.stem: F.col(f"{c.stem}_flux") for c in LINE_COMPLEXES})
    return out.withColumns({"mean": F.round("mean", 3), "scale": F.round("scale", 3)})


@query("job_line_features")
def job_line_features(v):
    return ps.line_features(line_sample(v), v.spectra, LINE_GRID).features


PLANTED = f"""WITH {WINDOWS.replace("v_spectra", "v_planted")},
kinds(kind, line, rest) AS (VALUES {", ".join(f"({k}, '{c.name}', {c.primary!r}e0)" for k, c in enumerate(LINE_COMPLEXES))}),
truth AS (SELECT t.*, k.line, (1 + t.z) * t.amp * k.rest * (1 + t.vel / 299792.458e0) * t.s / 299792.458e0 * sqrt(2 * pi()) AS flux FROM v_planted_truth t JOIN kinds k USING (kind)),
found AS (SELECT g.*, t.kind, t.slope, t.vel, t.s, t.amp, t.flux, t.c0 AS level FROM gated g JOIN truth t USING (targetid, line))"""


def planted_line():
    return F.create_map(*[F.lit(x) for k, c in enumerate(LINE_COMPLEXES) for x in (k, c.name)])[F.col("kind")].alias("line")


@query("line_fits_planted", f"""{PLANTED}
SELECT targetid, line, 'ok' AS status, n_good AS n, round(noise, 6) AS noise, round(level, 4) AS c0, round(slope, 6) AS slope, round(vel, 3) AS v_kms, round(s, 3) AS sigma_kms,
  round(amp, 4) AS amp, round(amp / noise, 3) AS an, round(flux, 3) AS flux, 0.0e0 AS chi2, 0 AS at_bound FROM found WHERE status IS NULL
UNION ALL SELECT targetid, line, status, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM found WHERE status IS NOT NULL""")
def line_fits_planted(v):
    """Fits of noise-free windows, one complex per vector: they must return what was planted."""
    fits = ln.fit_lines(ln.line_windows(v.planted, LINE_GRID))
    kinds = v.planted_truth.select("targetid", planted_line())
    digits = {"noise": 6, "c0": 4, "slope": 6, "v_kms": 3, "sigma_kms": 3, "amp": 4, "an": 3, "flux": 3, "chi2": 6}
    return fits.join(kinds, ["targetid", "line"]).select("targetid", "line", "status", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in digits.items()], "at_bound")


@query("job_line_features_planted", f"""{PLANTED}
SELECT t.targetid, t.line, round(coalesce(CASE WHEN f.status IS NULL THEN t.flux END, 0), 3) AS flux, round(CASE WHEN f.status IS NULL THEN t.amp / f.noise END, 3) AS an,
  coalesce(f.status, 'ok') AS status FROM truth t JOIN found f USING (targetid)""")
def job_line_features_planted(v):
    """The feature table of the planted spectra, each at the line that it holds."""
    sample = v.planted_truth.select("targetid", F.lit("train").alias("split"), F.lit("QSO").alias("spectype"), "z", "kind")
    out = ps.line_features(sample, v.planted, LINE_GRID).features.join(sample.select("targetid", "kind"), "targetid")

    def own(what):
        return F.coalesce(*[F.when(F.col("kind") == k, F.col(f"{c.stem}_{what}")) for k, c in enumerate(LINE_COMPLEXES)])

    return out.select("targetid", planted_line(), F.round(own("flux"), 3).alias("flux"), F.round(own("an"), 3).alias("an"), own("status").alias("status"))


@query("fn_line_model", """
SELECT vec_id, i, round(0.5e0 + 0.01e0 * (x - 5008.24e0) + 2.0e0 * (exp(-0.5e0 * pow((x - c1) / (c1 * s / 299792.458e0), 2))
  + 0.335e0 * exp(-0.5e0 * pow((x - c2) / (c2 * s / 299792.458e0), 2))), 6) AS y FROM (
  SELECT vec_id, unnest(range(0, 64)) AS i, 4940.0e0 + unnest(range(0, 64)) * 1.5e0 AS x, 200.0e0 + vec_id % 50 AS s,
    5008.24e0 * (1 + (vec_id % 300) / 299792.458e0) AS c1, 4960.295e0 * (1 + (vec_id % 300) / 299792.458e0) AS c2 FROM embeddings)""")
def fn_line_model(v):
    wave = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(4940.0) + i * F.lit(1.5))
    y = fs.line_model(wave, LINE_COMPLEXES[0], F.lit(0.5), F.lit(0.01), F.col("vec_id") % 300, F.lit(200.0) + F.col("vec_id") % 50, [F.lit(2.0)])
    return v.table("embeddings").select("vec_id", F.posexplode(y).alias("i", "y")).withColumn("y", F.round("y", 6))


@query("fn_line_flux", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS amp, l_linenumber * 20.0e0 AS vel, l_extendedprice / 200.0e0 AS s, l_discount AS z FROM lineitem),
y AS (SELECT *, (1 + z) * amp * 5008.24e0 * (1 + vel / 299792.458e0) * s / 299792.458e0 * sqrt(2 * pi()) AS flux FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(flux, 5) AS flux, round(flux * sqrt(4 / (amp * amp) + 9 / (s * s)), 5) AS flux_err FROM y""")
def fn_line_flux(v):
    l = v.table("lineitem")
    amp, vel, s = F.col("l_quantity"), F.col("l_linenumber") * 20.0, F.col("l_extendedprice") / 200.0
    flux = fs.integrated_flux(amp, vel, s, F.col("l_discount"), 5008.24)
    err = fs.integrated_flux_error(flux, amp, s, F.lit(4.0), F.lit(9.0))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(flux, 5).alias("flux"), F.round(err, 5).alias("flux_err"))
