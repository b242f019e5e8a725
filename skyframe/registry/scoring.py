"""Densities, quadrature and scores."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from skyframe.functions import poisson as po
from skyframe.functions.core import computed_once
from skyframe.operators import density as dn
from skyframe.operators import linear
from skyframe.operators import sample as sm
from skyframe.operators import scoring as sc
from skyframe.params import Head
from skyframe.plans import scoring as ps
from skyframe.registry.base import query
from skyframe.session import spread
from skyframe.registry.sampling import SUBSETS_SQL

SCORES = f"""
scores AS (SELECT b.source_id, h.head, x.subset, x.ordinal, b.redshift, b.spectype, b.common,
  CASE WHEN h.head = 'lx' THEN b.prior_lx ELSE b.prior_flux END AS prior,
  (CASE WHEN h.head = 'lx' THEN b.prior_lx ELSE b.prior_flux END) + x.ordinal * 0.05e0 + ((b.source_id * 7 + x.ordinal * 13) % 29) / 40.0e0 AS ll
  FROM v_score_base b, {SUBSETS_SQL} x, (SELECT unnest(['lx', 'flux']) AS head) h)"""


def scores(v):
    rows = sm.with_subsets(v.score_base)
    rows = rows.withColumn("head", F.explode(F.array(F.lit("lx"), F.lit("flux"))))
    prior = F.when(F.col("head") == "lx", F.col("prior_lx")).otherwise(F.col("prior_flux"))
    rows = rows.withColumn("prior", prior)
    return rows.withColumn("ll", F.col("prior") + F.expr("ordinal * 0.05e0 + ((source_id * 7 + ordinal * 13) % 29) / 40.0e0")).drop("prior_lx", "prior_flux")


def rounded(df, digits=6, **special):
    numeric = [n for n, k in df.dtypes if k == "double"]
    return df.withColumns({n: F.round(n, special.get(n, digits)) for n in numeric})


# ---- Poisson pieces; the checking engine has lgamma

LN10 = math.log(10.0)
PMF = "({n} * ln({mu}) - ({mu}) - lgamma({n} + 1.0e0))"
CENTRE = f"""
c AS (SELECT *, ln(10.0e0) AS l10, greatest(counts - bkg, 0.5e0) AS net FROM v_counts),
w AS (SELECT *, (log10(net / expo) + 0.8e0) / 0.6e0 AS uhat, sqrt(greatest(counts, 1)) / (l10 * 0.6e0 * net) AS sg FROM c),
p AS (SELECT *, uhat / (1 + sg * sg) AS centre, sg / sqrt(1 + sg * sg) AS width FROM w)"""
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("fn_poisson_log_pmf", f"""
SELECT {KEY}, round({PMF.format(n='counts', mu='expo * pow(10.0e0, 0.6e0 * 0.3e0 - 0.8e0) + bkg')}, 6) AS log_pmf,
  round(lgamma(counts + 1.0e0), 6) AS log_factorial FROM v_counts""")
def fn_poisson_log_pmf(v):
    return v.counts.select(*KEYS, F.round(po.log_pmf("counts", "bkg", "expo", F.lit(0.3), -0.8, 0.6), 6).alias("log_pmf"),
                           F.round(po.log_factorial(F.col("counts").cast("double")), 6).alias("log_factorial"))


@query("fn_laplace_proposal", f"WITH {CENTRE} SELECT {KEY}, round(centre, 6) AS centre, round(width, 6) AS width FROM p")
def fn_laplace_proposal(v):
    centre, width = po.proposal("counts", "bkg", "expo", -0.8, 0.6)
    return v.counts.select(*KEYS, F.round(centre, 6).alias("centre"), F.round(width, 6).alias("width"))


@query("fn_log_sum_exp", """
SELECT vec_id, round(m + ln(s), 6) AS log_sum FROM (SELECT vec_id, list_max(embedding)::DOUBLE AS m,
  list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) AS s FROM embeddings)""")
def fn_log_sum_exp(v):
    e = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.round(po.log_sum_exp(F.col("x")), 6).alias("log_sum"))


@query("stat_prior_axis", """
SELECT s_suppkey, i, round(-5.0e0 + i * 10.0e0 / 11, 9) AS node, round(ln(10.0e0 / 11), 9) AS spacing FROM supplier, (SELECT unnest(range(0, 12)) AS i)""")
def stat_prior_axis(v):
    axis = po.prior_axis(12, 5.0)
    s = v.table("supplier").select("s_suppkey", axis["spacing"].alias("spacing"), F.posexplode(axis["nodes"]).alias("i", "node"))
    return rounded(s, 9)


UNIQUE = CENTRE.replace("FROM v_counts", "FROM (SELECT DISTINCT * FROM v_counts)")
ALL_KEYS = f"{KEY}, l_extendedprice, counts, bkg"
ALL = [*KEYS, "l_extendedprice", "counts", "bkg"]
NODES = f"""{CENTRE}, n AS (SELECT *, unnest(range(0, 12)) AS i FROM p), nodes AS (SELECT *, centre + width * (-5.0e0 + i * 10.0e0 / 11) AS node FROM n)"""


@query("stat_rate_axis", f"""
WITH {NODES} SELECT {KEY}, i, round(node, 6) AS node, round(ln(width) + ln(10.0e0 / 11), 6) AS spacing,
  round({PMF.format(n='counts', mu='expo * pow(10.0e0, 0.6e0 * node - 0.8e0) + bkg')}, 5) AS log_like FROM nodes""")
def stat_rate_axis(v):
    axis = po.rate_axis("counts", "bkg", "expo", -0.8, 0.6)
    held = computed_once(v.counts.select(*KEYS, "counts", "bkg", "expo"), {"a": axis})
    out = held.select(*KEYS, F.col("a.spacing").alias("spacing"), F.posexplode(F.arrays_zip(F.col("a.nodes").alias("n"), F.col("a.like").alias("l"))).alias("i", "p"))
    return out.select(*KEYS, "i", F.round("p.n", 6).alias("node"), F.round("spacing", 6).alias("spacing"), F.round("p.l", 5).alias("log_like"))


@query("stat_pinned_axis", f"""
SELECT {KEY}, round(-0.5e0 * pow((l_extendedprice / 50000.0e0 - 0.2e0) / 1.3e0, 2) - ln(1.3e0) - 0.5e0 * ln(2 * pi()), 6) AS ll FROM v_counts""")
def stat_pinned_axis(v):
    axis = po.pinned_axis(F.col("l_extendedprice") / 50000.0)
    out = sc.log_marginal(v.counts, [axis], dn.NormalDensity((0.2,), (1.3,)), "ll")
    return out.select(*KEYS, F.round("ll", 6).alias("ll"))


_NORMAL = "(-0.5e0 * pow(({u} - {m}) / {s}, 2) - ln({s}) - 0.5e0 * ln(2 * pi()))"


@query("stat_poisson_marginal", f"""
WITH {NODES.replace(CENTRE, UNIQUE)}, t AS (SELECT {ALL_KEYS}, width, {_NORMAL.format(u='node', m='0.1e0', s='1.2e0')}
  + {PMF.format(n='counts', mu='expo * pow(10.0e0, 0.6e0 * node - 0.8e0) + bkg')} AS term FROM nodes),
m AS (SELECT {ALL_KEYS}, width, max(term) AS top FROM t GROUP BY {ALL_KEYS}, width)
SELECT {", ".join("t." + k for k in ALL)}, round(any_value(top) + ln(sum(exp(term - top))) + ln(any_value(t.width)) + ln(10.0e0 / 11), 5) AS ll
FROM t JOIN m USING ({ALL_KEYS}) GROUP BY {", ".join("t." + k for k in ALL)}""")
def stat_poisson_marginal(v):
    rows = spread(v.counts.distinct(), *KEYS)
    out = sc.log_marginal(rows, [po.rate_axis("counts", "bkg", "expo", -0.8, 0.6)], dn.NormalDensity((0.1,), (1.2,)), "ll")
    return out.select(*ALL, F.round("ll", 5).alias("ll"))


@query("stat_product_marginal", f"""
WITH {NODES.replace(CENTRE, UNIQUE)}, u AS (SELECT unnest(range(0, 12)) AS j), t AS (SELECT {ALL_KEYS}, width,
  {_NORMAL.format(u='node', m='0.1e0', s='1.2e0')} + {_NORMAL.format(u='(-5.0e0 + j * 10.0e0 / 11)', m='-0.2e0', s='0.9e0')}
  + {_NORMAL.format(u='(l_extendedprice / 50000.0e0)', m='0.0e0', s='1.1e0')}
  + {PMF.format(n='counts', mu='expo * pow(10.0e0, 0.6e0 * node - 0.8e0) + bkg')} AS term FROM nodes, u),
m AS (SELECT {ALL_KEYS}, max(term) AS top FROM t GROUP BY {ALL_KEYS})
SELECT {", ".join("t." + k for k in ALL)}, round(any_value(top) + ln(sum(exp(term - top))) + ln(any_value(t.width)) + 2 * ln(10.0e0 / 11), 5) AS ll
FROM t JOIN m USING ({ALL_KEYS}) GROUP BY {", ".join("t." + k for k in ALL)}""")
def stat_product_marginal(v):
    axes = [po.rate_axis("counts", "bkg", "expo", -0.8, 0.6), po.prior_axis(), po.pinned_axis(F.col("l_extendedprice") / 50000.0)]
    out = sc.log_marginal(spread(v.counts.distinct(), *KEYS), axes, dn.NormalDensity((0.1, -0.2, 0.0), (1.2, 0.9, 1.1)), "ll")
    return out.select(*ALL, F.round("ll", 5).alias("ll"))


UNIT = sm.Standardizer({"sfr": 0.2, "mstar": 10.0, "rate_p2": -0.8, "rate_p3": -0.7}, {"sfr": 0.7, "mstar": 0.6, "rate_p2": 0.6, "rate_p3": 0.5})
PAIR = Head("sfr_mstar", ("sfr", "mstar"))
RATES = Head("joint", ("rate_p2", "sfr"))

_PATTERN = f"""
WITH x AS (SELECT source_id, (log_sfr - 0.2e0) / 0.7e0 AS s, ape_cts_p2 AS n, ape_bkg_p2 AS b, CASE WHEN ape_exp_p2 > 0 THEN ape_exp_p2 END AS t,
    ape_cts_p2 IS NOT NULL AND ape_exp_p2 > 0 AS r_ok, log_sfr IS NOT NULL AS s_ok FROM v_labels),
p AS (SELECT *, (log10(greatest(n - b, 0.5e0) / t) + 0.8e0) / 0.6e0 AS uhat, sqrt(greatest(n, 1)) / (ln(10.0e0) * 0.6e0 * greatest(n - b, 0.5e0)) AS sg FROM x WHERE s_ok),
g AS (SELECT *, unnest(range(0, {{k}})) AS i FROM p),
h AS (SELECT *, CASE WHEN r_ok THEN uhat / (1 + sg * sg) + sg / sqrt(1 + sg * sg) * (-5.0e0 + i * 10.0e0 / ({{k}} - 1)) ELSE -5.0e0 + i * 10.0e0 / ({{k}} - 1) END AS u FROM g),
t AS (SELECT source_id, {_NORMAL.format(u='u', m='0.1e0', s='1.2e0')} + {_NORMAL.format(u='s', m='-0.2e0', s='0.9e0')}
    + CASE WHEN r_ok THEN n * ln(t * pow(10.0e0, 0.6e0 * u - 0.8e0) + b) - (t * pow(10.0e0, 0.6e0 * u - 0.8e0) + b) - lgamma(n + 1.0e0) ELSE 0 END AS term,
    CASE WHEN r_ok THEN ln(sg / sqrt(1 + sg * sg)) ELSE 0 END + ln(10.0e0 / ({{k}} - 1)) AS spacing FROM h),
m AS (SELECT source_id, max(term) AS top FROM t GROUP BY source_id),
ll AS (SELECT source_id, any_value(top) + ln(sum(exp(term - top))) + any_value(spacing) AS ll FROM t JOIN m USING (source_id) GROUP BY source_id)
"""


@query("stat_head_likelihood", _PATTERN.format(k=12) + "SELECT v.source_id, round(ll, 5) AS ll FROM v_labels v LEFT JOIN ll USING (source_id)")
def stat_head_likelihood(v):
    out = sc.head_log_likelihood(sm.with_masks(v.labels), RATES, UNIT, dn.NormalDensity((0.1, -0.2), (1.2, 0.9)))
    return out.select("source_id", F.round("ll", 5).alias("ll"))


@query("stat_quadrature_sweep", " UNION ALL ".join(
    f"SELECT {k} AS nodes, n, mean_ll FROM ({_PATTERN.format(k=k).strip()} SELECT count(*) AS n, round(avg(ll), 5) AS mean_ll FROM ll)" for k in (12, 24, 48)))
def stat_quadrature_sweep(v):
    out = sc.quadrature_sweep(sm.with_masks(v.labels), RATES, UNIT, dn.NormalDensity((0.1, -0.2), (1.2, 0.9)))
    return rounded(out, 5)


# ---- kernel density

def _kde_sql(columns: str, bandwidth: float) -> str:
    if columns == "a":
        return f"""
s AS (SELECT count(*) AS n, stddev_samp(a) * pow(count(*), -0.2e0) * {bandwidth}e0 AS h FROM v_kde_train),
d AS (SELECT e.id, -0.5e0 * pow((e.a - t.a) / h, 2) AS x, h, n FROM v_kde_eval e, v_kde_train t, s),
l AS (SELECT id, ln(sum(exp(x - m))) + any_value(m) - ln(any_value(h)) - 0.5e0 * ln(2 * pi()) - ln(any_value(n)) AS log_prob
  FROM (SELECT *, max(x) OVER (PARTITION BY id) AS m FROM d) GROUP BY id)"""
    return f"""
s AS (SELECT count(*) AS n, var_samp(a) AS p, covar_samp(a, b) AS q, var_samp(b) AS r, pow(count(*), -1.0e0 / 3) * {bandwidth ** 2}e0 AS f FROM v_kde_train),
d AS (SELECT e.id, -0.5e0 * (r * pow(e.a - t.a, 2) - 2 * q * (e.a - t.a) * (e.b - t.b) + p * pow(e.b - t.b, 2)) / ((p * r - q * q) * f) AS x,
  p, q, r, f, n FROM v_kde_eval e, v_kde_train t, s),
l AS (SELECT id, ln(sum(exp(x - m))) + any_value(m) - 0.5e0 * ln(any_value((p * r - q * q) * f * f)) - ln(2 * pi()) - ln(any_value(n)) AS log_prob
  FROM (SELECT *, max(x) OVER (PARTITION BY id) AS m FROM d) GROUP BY id)"""


@query("stat_kde_one", f"WITH {_kde_sql('a', 1.0)} SELECT id, round(log_prob, 6) AS log_prob FROM l")
def stat_kde_one(v):
    kde = dn.GaussianKDE.fit(v.kde_train, ["a"])
    return kde.scored(v.kde_eval, [F.col("a")], "log_prob").select("id", F.round("log_prob", 6).alias("log_prob"))


@query("stat_kde_two", f"WITH {_kde_sql('ab', 1.0)} SELECT id, round(log_prob, 6) AS log_prob FROM l")
def stat_kde_two(v):
    kde = dn.GaussianKDE.fit(v.kde_train, ["a", "b"])
    return kde.scored(v.kde_eval, [F.col("a"), F.col("b")], "log_prob").select("id", F.round("log_prob", 6).alias("log_prob"))


@query("join_kernel_blocks", f"WITH {_kde_sql('ab', 1.0)} SELECT id, round(log_prob, 6) AS log_prob FROM l")
def join_kernel_blocks(v):
    kde = dn.GaussianKDE.fit(v.kde_train, ["a", "b"])
    return kde.scored(v.kde_eval.withColumn("c", F.col("a")), [F.col("c"), F.col("b")], "log_prob").select("id", F.round("log_prob", 6).alias("log_prob"))


@query("stat_bandwidth_sweep", " UNION ALL ".join(
    f"SELECT {b}e0 AS bandwidth, count(*) AS n, round(avg(log_prob), 6) AS mean_log_prob FROM (WITH {_kde_sql('a', b)} SELECT * FROM l)" for b in (0.3, 1.0, 3.0)))
def stat_bandwidth_sweep(v):
    return rounded(sc.bandwidth_sweep(v.kde_train, v.kde_eval, ["a"], [0.3, 1.0, 3.0]))


@query("agg_covariance", """
SELECT 'a' AS a, 'a' AS b, round(covar_samp(a, a), 6) AS covariance FROM v_kde_train UNION ALL
SELECT 'a', 'b', round(covar_samp(a, b), 6) FROM v_kde_train UNION ALL SELECT 'b', 'b', round(covar_samp(b, b), 6) FROM v_kde_train""")
def agg_covariance(v):
    return rounded(dn.covariance_long(v.kde_train, ["a", "b"]))


def _kernel_pair(points: str, keys: str, name: str) -> str:
    """CTEs for ln density of the pair (a, b) of `train` at (u, w) of `points`; `spread` holds its covariance."""
    return f"""
{name}_x AS (SELECT {keys}, -0.5e0 * (vb * pow(u - a, 2) - 2 * cab * (u - a) * (w - b) + va * pow(w - b, 2)) / ((va * vb - cab * cab) * f) AS x,
  -0.5e0 * ln((va * vb - cab * cab) * f * f) - ln(2 * pi()) - ln(cn) AS norm FROM {points}, train, spread),
{name}_m AS (SELECT {keys}, max(x) AS top FROM {name}_x GROUP BY {keys}),
{name} AS (SELECT {keys}, any_value(top) + ln(sum(exp(x - top))) + any_value(norm) AS lp FROM {name}_x JOIN {name}_m USING ({keys}) GROUP BY {keys})"""


def _kernel_single(points: str, column: str, value: str, keys: str, name: str) -> str:
    """The same for one column of `train` at `value` of `points`."""
    return f"""
{name}_s AS (SELECT count(*) AS sn, stddev_samp({column}) * pow(count(*), -0.2e0) AS h FROM train),
{name}_x AS (SELECT {keys}, -0.5e0 * pow(({value} - {column}) / h, 2) AS x, -ln(h) - 0.5e0 * ln(2 * pi()) - ln(sn) AS norm FROM {points}, train, {name}_s),
{name}_m AS (SELECT {keys}, max(x) AS top FROM {name}_x GROUP BY {keys}),
{name} AS (SELECT {keys}, any_value(top) + ln(sum(exp(x - top))) + any_value(norm) AS lp FROM {name}_x JOIN {name}_m USING ({keys}) GROUP BY {keys})"""


_SPREAD = "spread AS (SELECT count(*) AS cn, var_samp(a) AS va, covar_samp(a, b) AS cab, var_samp(b) AS vb, pow(count(*), -1.0e0 / 3) AS f FROM train)"
_PRIOR_SQL = f"""
WITH r AS (SELECT source_id, split, log_sfr AS y, ape_cts_p2 AS n, ape_bkg_p2 AS k, CASE WHEN ape_exp_p2 > 0 THEN ape_exp_p2 END AS t,
    ape_cts_p2 IS NOT NULL AND ape_exp_p2 > 0 AS r_ok, log_sfr IS NOT NULL AS s_ok FROM v_prior_labels),
l AS (SELECT *, CASE WHEN r_ok THEN log10(greatest(n - k, 0.5e0) / t) END AS lr FROM r),
st AS (SELECT avg(lr) AS mr, stddev_pop(lr) AS sr, avg(y) AS my, stddev_pop(y) AS sy FROM l WHERE split = 'train'),
train AS (SELECT (lr - mr) / sr AS a, (y - my) / sy AS b FROM l, st WHERE split = 'train' AND r_ok AND s_ok), {_SPREAD},
p AS (SELECT source_id, n, k, t, r_ok, mr, sr, (y - my) / sy AS w, (lr - mr) / sr AS uhat, sqrt(greatest(n, 1)) / (ln(10.0e0) * sr * greatest(n - k, 0.5e0)) AS sg
  FROM l, st WHERE s_ok),
g AS (SELECT *, unnest(range(0, 12)) AS i FROM p),
nodes AS (SELECT *, CASE WHEN r_ok THEN uhat / (1 + sg * sg) + sg / sqrt(1 + sg * sg) * (-5.0e0 + i * 10.0e0 / 11) ELSE -5.0e0 + i * 10.0e0 / 11 END AS u FROM g),
{_kernel_pair("nodes", "source_id, i", "d")},
t AS (SELECT source_id, lp + CASE WHEN r_ok THEN n * ln(t * pow(10.0e0, sr * u + mr) + k) - (t * pow(10.0e0, sr * u + mr) + k) - lgamma(n + 1.0e0) ELSE 0 END AS term,
  CASE WHEN r_ok THEN ln(sg / sqrt(1 + sg * sg)) ELSE 0 END + ln(10.0e0 / 11) AS spacing FROM nodes JOIN d USING (source_id, i)),
m AS (SELECT source_id, max(term) AS top FROM t GROUP BY source_id),
ll AS (SELECT source_id, any_value(top) + ln(sum(exp(term - top))) + any_value(spacing) AS ll FROM t JOIN m USING (source_id) GROUP BY source_id)
SELECT v.source_id, round(ll, 5) AS ll FROM v_prior_labels v LEFT JOIN ll USING (source_id)"""


@query("stat_prior_likelihood", _PRIOR_SQL)
def stat_prior_likelihood(v):
    """The kernel prior of a pair with a rate, through the quadrature."""
    masked = sm.with_masks(v.prior_labels)
    standardizer = sm.fit_standardizer(v.prior_labels, RATES.targets)
    prior = sc.fit_prior(v.prior_labels, RATES, standardizer)
    return sc.head_log_likelihood(masked, RATES, standardizer, prior).select("source_id", F.round("ll", 5).alias("ll"))


_RATE_SQL = f"""
WITH st AS (SELECT avg(log_sfr) AS my, stddev_pop(log_sfr) AS sy, avg(logmstar_cigale) AS mm, stddev_pop(logmstar_cigale) AS sm FROM v_prior_labels WHERE split = 'train'),
paired AS (SELECT source_id, split, (log_sfr - my) / sy AS a, (logmstar_cigale - mm) / sm AS b, log_sfr, logmstar_cigale FROM v_prior_labels, st),
train AS (SELECT a, b FROM paired WHERE split = 'train' AND a IS NOT NULL AND b IS NOT NULL), {_SPREAD},
p AS (SELECT source_id, log_sfr - logmstar_cigale AS s, unnest(range(0, 256)) AS i FROM paired WHERE split = 'test' AND a IS NOT NULL AND b IS NOT NULL),
nodes AS (SELECT source_id, i, -8.0e0 + i * 16.0e0 / 255 AS w, (s + (-8.0e0 + i * 16.0e0 / 255) * sm + mm - my) / sy AS u FROM p, st),
{_kernel_pair("nodes", "source_id, i", "d")},
ta AS (SELECT (log_sfr - my) / sy AS a FROM v_prior_labels, st WHERE split = 'train' AND log_sfr IS NOT NULL),
tb AS (SELECT (logmstar_cigale - mm) / sm AS b FROM v_prior_labels, st WHERE split = 'train' AND logmstar_cigale IS NOT NULL),
{_kernel_single("nodes", "a", "u", "source_id, i", "da").replace("FROM train", "FROM ta").replace(", train,", ", ta,")},
masses AS (SELECT DISTINCT i, w FROM nodes),
{_kernel_single("masses", "b", "w", "i", "db").replace("FROM train", "FROM tb").replace(", train,", ", tb,")},
t AS (SELECT source_id, d.lp AS pair, da.lp + db.lp AS apart FROM d JOIN da USING (source_id, i) JOIN db USING (i)),
m AS (SELECT source_id, max(pair) AS top, max(apart) AS high FROM t GROUP BY source_id),
densities AS (SELECT source_id, any_value(top) + ln(sum(exp(pair - top))) + ln(16.0e0 / 255) - ln(any_value(sy)) AS log_p_joint,
  any_value(high) + ln(sum(exp(apart - high))) + ln(16.0e0 / 255) - ln(any_value(sy)) AS log_p_independent FROM t JOIN m USING (source_id), st GROUP BY source_id)"""


def specific_rates(v):
    """Density of the specific rate under the pair against its two margins, on the test split."""
    standardizer = sm.fit_standardizer(v.prior_labels, PAIR.targets)
    joint = sc.fit_prior(v.prior_labels, PAIR, standardizer)
    sfr, mstar = (sc.fit_prior(v.prior_labels, Head(t, (t,)), standardizer) for t in PAIR.targets)
    test = v.prior_labels.filter("split = 'test' AND log_sfr IS NOT NULL AND logmstar_cigale IS NOT NULL")
    test = test.select("source_id", (F.col("log_sfr") - F.col("logmstar_cigale")).alias("s"))
    return sc.specific_rate_densities(test, "s", standardizer, joint, sfr, mstar)


@query("stat_specific_rate_gain", _RATE_SQL + """
SELECT count(*) AS n, round(avg(log_p_joint), 5) AS mean_joint, round(avg(log_p_independent), 5) AS mean_independent,
  round(avg(log_p_joint - log_p_independent), 5) AS gain, round(stddev_samp(log_p_joint - log_p_independent) / sqrt(count(*)), 5) AS gain_se FROM densities""")
def stat_specific_rate_gain(v):
    return rounded(sc.specific_rate_gain(specific_rates(v)), 5)


@query("stat_specific_rate", _RATE_SQL + """
SELECT source_id, round(log_p_joint, 5) AS log_p_joint, round(log_p_independent, 5) AS log_p_independent FROM densities""")
def stat_specific_rate(v):
    return rounded(specific_rates(v).drop("s"), 5)


FEATURES = {"Z": ["f_z"], "S": ["f_s1", "f_s2"], "I": ["f_i"], "W": ["f_w1", "f_w2"]}


def feature_labels(v):
    k = F.col("source_id")
    return v.labels.withColumns({
        "f_z": F.col("redshift"), "f_s1": (k * 31 % 1009) / 400.0 + (k % 7), "f_s2": (k * 13 % 331) / 100.0, "f_i": (k * 17 % 1013) / 600.0,
        "f_w1": (k % 17) / 40.0, "f_w2": (k * 5 % 97) / 30.0, "f_i2": (k * 17 % 1013) / 600.0 + (k % 11) / 4.0, "f_w3": (k % 17) / 40.0 + (k % 5) / 3.0})


_FEATURE_SQL = {"f_z": "redshift", "f_s1": "(source_id * 31 % 1009) / 400.0e0 + (source_id % 7)", "f_s2": "(source_id * 13 % 331) / 100.0e0",
                "f_i": "(source_id * 17 % 1013) / 600.0e0", "f_w1": "(source_id % 17) / 40.0e0", "f_w2": "(source_id * 5 % 97) / 30.0e0",
                "f_i2": "(source_id * 17 % 1013) / 600.0e0 + (source_id % 11) / 4.0e0", "f_w3": "(source_id % 17) / 40.0e0 + (source_id % 5) / 3.0e0"}


def _regression_sql(target: str, column: str, subset: str) -> str:
    """Least squares by orthogonalising one feature after the other on the training rows; window sums over them are constants."""
    rows = f"(SELECT source_id, split = 'test' AS te, split = 'train' AND {column} IS NOT NULL AS tr, {column} AS y, " + ", ".join(
        f"{sql} AS {f}" for f, sql in _FEATURE_SQL.items()) + " FROM v_labels)"
    names = [f for m in subset for f in FEATURES[m]]

    def over(e: str) -> str:
        return f"sum({e}) FILTER (WHERE tr) OVER ()"

    for k, f in enumerate(names):
        parts = "".join(f" - {over(f'{f} * q{j}')} / {over(f'q{j} * q{j}')} * q{j}" for j in range(k))
        rows = f"(SELECT *, {f} - avg({f}) FILTER (WHERE tr) OVER (){parts} AS q{k} FROM {rows})"
    fit = "".join(f" + {over(f'y * q{j}')} / {over(f'q{j} * q{j}')} * q{j}" for j in range(len(names)))
    rows = f"(SELECT *, avg(y) FILTER (WHERE tr) OVER (){fit} AS mean FROM {rows})"
    rows = f"(SELECT *, sqrt(avg(pow(y - mean, 2)) FILTER (WHERE tr) OVER ()) AS sigma FROM {rows})"
    return (f"SELECT source_id, '{target}' AS head, '{subset}' AS subset, round(-0.5e0 * pow((y - mean) / sigma, 2) - ln(sigma) - 0.5e0 * ln(2 * pi()), 5) AS ll, "
            f"round(mean, 5) AS mean, round(y, 9) AS truth FROM {rows} WHERE te")


@query("stat_subset_heads", " UNION ALL ".join(_regression_sql(t, c, s) for t, c in (("sfr", "log_sfr"), ("mstar", "logmstar_cigale")) for s in sm.subset_names()))
def stat_subset_heads(v):
    labels = feature_labels(v).withColumns({"sfr": F.col("log_sfr"), "mstar": F.col("logmstar_cigale")})
    heads = linear.fit_heads(labels.filter("split = 'train'"), FEATURES, ["sfr", "mstar"])
    return rounded(linear.score_heads(labels.filter("split = 'test'"), heads).drop("sigma"), 5, truth=9)


EVALUATED = {"flux": ["log_flux_1"], "lx": ["log_lx"], "sfr": ["log_sfr"], "mstar": ["logmstar_cigale"], "sfr_mstar": ["log_sfr", "logmstar_cigale"]}
# no target is an exact combination of these, so that every deviation is well above rounding
NOISY = {"Z": ["f_z"], "S": ["f_s1", "f_s2"], "I": ["f_i2"], "W": ["f_w2", "f_w3"]}
_COMMON = "has_z AND has_spectrum AND has_image AND has_wise"


def _fitted_sql(columns: list[str], subset: str) -> str:
    """Test rows that all heads of these columns are compared on, with y0.., r0.. (residuals) and the sums s00.. of the training residuals' products."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    names = [f for m in subset for f in NOISY[m]]
    rows = (f"(SELECT source_id, split = 'test' AND {_COMMON} AND {known} AS te, split = 'train' AND {known} AS tr, " + ", ".join(
        f"{c} AS y{i}" for i, c in enumerate(columns)) + "".join(f", {_FEATURE_SQL[f]} AS {f}" for f in names) + " FROM v_labels)")

    def over(e: str) -> str:
        return f"sum({e}) FILTER (WHERE tr) OVER ()"

    for k, f in enumerate(names):
        parts = "".join(f" - {over(f'{f} * q{j}')} / {over(f'q{j} * q{j}')} * q{j}" for j in range(k))
        rows = f"(SELECT *, {f} - avg({f}) FILTER (WHERE tr) OVER (){parts} AS q{k} FROM {rows})"
    for i in range(len(columns)):
        fit = "".join(f" + {over(f'y{i} * q{j}')} / {over(f'q{j} * q{j}')} * q{j}" for j in range(len(names)))
        rows = f"(SELECT *, y{i} - (avg(y{i}) FILTER (WHERE tr) OVER (){fit}) AS r{i} FROM {rows})"
    moments = ", ".join(f"avg(r{i} * r{j}) FILTER (WHERE tr) OVER () AS s{i}{j}" for i in range(len(columns)) for j in range(i, len(columns)))
    return f"(SELECT * FROM (SELECT *, {moments} FROM {rows}) WHERE te)"


def _prior_parts(head: str, columns: list[str]) -> str:
    """p_<head>: log of the kernel prior in natural units at the test rows."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    train = f"t_{head} AS (SELECT {', '.join(f'{c} AS y{i}' for i, c in enumerate(columns))} FROM v_labels WHERE split = 'train' AND {known})"
    if len(columns) == 1:
        spread = f"h_{head} AS (SELECT count(*) AS n, stddev_samp(y0) * pow(count(*), -0.2e0) AS h FROM t_{head})"
        gap, norm = f"-0.5e0 * pow((e.{columns[0]} - t.y0) / h, 2)", "ln(h) + 0.5e0 * ln(2 * pi())"
    else:
        spread = (f"h_{head} AS (SELECT *, p * r - q * q AS det FROM (SELECT count(*) AS n, var_samp(y0) * pow(count(*), -1.0e0 / 3) AS p, "
                  f"covar_samp(y0, y1) * pow(count(*), -1.0e0 / 3) AS q, var_samp(y1) * pow(count(*), -1.0e0 / 3) AS r FROM t_{head}))")
        a, b = f"(e.{columns[0]} - t.y0)", f"(e.{columns[1]} - t.y1)"
        gap, norm = f"-0.5e0 * (r * {a} * {a} - 2 * q * {a} * {b} + p * {b} * {b}) / det", "0.5e0 * ln(det) + ln(2 * pi())"
    point = (f"p_{head} AS (SELECT source_id, ln(sum(exp({gap}))) - any_value({norm} + ln(n)) AS prior FROM v_labels e, t_{head} t, h_{head} "
             f"WHERE e.split = 'test' AND {known} AND {_COMMON} GROUP BY source_id)")
    return f"{train}, {spread}, {point}"


def _evaluated_sql(head: str, columns: list[str], subset: str) -> str:
    if len(columns) == 1:
        ll = "-0.5e0 * r0 * r0 / s00 - 0.5e0 * ln(s00) - 0.5e0 * ln(2 * pi())"
    else:
        ll = "-0.5e0 * (s11 * r0 * r0 - 2 * s01 * r0 * r1 + s00 * r1 * r1) / (s00 * s11 - s01 * s01) - 0.5e0 * ln(s00 * s11 - s01 * s01) - ln(2 * pi())"
    place = {c: i for i, c in enumerate(columns)}
    scores = ", ".join((f"round(1 - sum(r{place[c]} * r{place[c]}) / (var_pop(y{place[c]}) * count(*)), 5)" if c in place else "CAST(NULL AS DOUBLE)") + f" AS r2_{t}"
                       for t, c in ((t, c[0]) for t, c in EVALUATED.items() if len(c) == 1))
    return (f"SELECT '{head}' AS head, '{subset}' AS subset, count(*) AS n, round(avg({ll} - prior), 5) AS information_gain, {scores} "
            f"FROM {_fitted_sql(columns, subset)} JOIN p_{head} USING (source_id)")


LINES = ["flux_a", "flux_b", "flux_c", "flux_d"]


def _least_squares_sql(rows: str, names: list[str], group: str = "") -> str:
    """rows (with tr, y and the named features) and mean, sigma of the regression on them; with `group`, one regression per value of it."""
    window = f"OVER (PARTITION BY {group})" if group else "OVER ()"

    def over(e: str) -> str:
        return f"sum({e}) FILTER (WHERE tr) {window}"

    for k, f in enumerate(names):
        parts = "".join(f" - {over(f'{f} * q{j}')} / {over(f'q{j} * q{j}')} * q{j}" for j in range(k))
        rows = f"(SELECT *, {f} - avg({f}) FILTER (WHERE tr) {window}{parts} AS q{k} FROM {rows})"
    fit = "".join(f" + {over(f'y * q{j}')} / {over(f'q{j} * q{j}')} * q{j}" for j in range(len(names)))
    rows = f"(SELECT *, avg(y) FILTER (WHERE tr) {window}{fit} AS mean FROM {rows})"
    return f"(SELECT *, sqrt(avg(pow(y - mean, 2)) FILTER (WHERE tr) {window}) AS sigma FROM {rows})"


_LL = "-0.5e0 * pow((y - mean) / sigma, 2) - ln(sigma) - 0.5e0 * ln(2 * pi())"
_WITH_LINES = (f"(SELECT source_id, split = 'test' AS te, split = 'train' AND log_sfr IS NOT NULL AS tr, log_sfr AS y, {_COMMON} AND log_sfr IS NOT NULL AS common, "
               f"{', '.join(LINES)} FROM v_labels JOIN v_line_fluxes USING (source_id))")


@query("stat_line_baseline", f"""
WITH z AS (SELECT avg(log_sfr) AS m, stddev_pop(log_sfr) AS s FROM v_labels WHERE split = 'train'), {_prior_parts("sfr", ["log_sfr"])}
SELECT source_id, round({_LL} + ln(s), 5) AS ll, round((mean - m) / s, 5) AS mean, round((y - m) / s, 6) AS truth,
  CASE WHEN common THEN round(prior + ln(s), 5) END AS prior, common FROM {_least_squares_sql(_WITH_LINES, LINES)} CROSS JOIN z LEFT JOIN p_sfr USING (source_id) WHERE te""")
def stat_line_baseline(v):
    """A head on four looked-up line fluxes alone, beside the kernel prior."""
    standardizer = sm.fit_standardizer(v.labels, ["sfr"])
    prior = sc.fit_prior(v.labels, Head("sfr", ("sfr",)), standardizer)
    out = ps.line_baseline(v.labels, v.line_fluxes, LINES, "sfr", standardizer, prior)
    out = out.withColumn("prior", F.when(F.col("common"), F.col("prior")))
    return rounded(out.select("source_id", "ll", "mean", "truth", "prior", "common"), 5, truth=6)


def _fold_sql(target: str, column: str) -> str:
    rows = (f"(SELECT *, fold = CAST(floor(block / 2) AS INT) AS te, y IS NOT NULL AND NOT held AND CAST(floor(block / 2) AS INT) <> fold AND block <> (fold * 2 + 2) % 10 AS tr "
            f"FROM (SELECT source_id, {column} AS y, source_id * 7 % 10 AS block, source_id % 13 = 0 AS held, {', '.join(LINES)}, unnest(range(0, 5)) AS fold "
            f"FROM v_labels JOIN v_line_fluxes USING (source_id)))")
    return (f"SELECT source_id, CAST(fold AS INT) AS fold, '{target}' AS head, 'L' AS subset, round({_LL}, 5) AS ll, round(mean, 5) AS mean, round(y, 9) AS truth "
            f"FROM {_least_squares_sql(rows, LINES, 'fold')} WHERE te")


@query("job_fold_scores", " UNION ALL ".join(_fold_sql(t, c) for t, c in (("sfr", "log_sfr"), ("mstar", "logmstar_cigale"))))
def job_fold_scores(v):
    """Every source under heads on its line fluxes from the fold that tests it; flagged sources are not learned from."""
    k = F.col("source_id")
    rows = v.labels.join(v.line_fluxes, "source_id").withColumns({"block": (k * 7 % 10).cast("int"), "sfr": F.col("log_sfr"), "mstar": F.col("logmstar_cigale")})
    out = ps.fold_predictions(rows, {"L": LINES}, k % 13 == 0, ["sfr", "mstar"], subsets=["L"])
    return rounded(out.drop("sigma"), 5, truth=9)


@query("job_evaluate", "WITH " + ", ".join(_prior_parts(h, c) for h, c in EVALUATED.items()) + " " + " UNION ALL ".join(
    _evaluated_sql(h, c, s) for h, c in EVALUATED.items() for s in sm.subset_names()))
def job_evaluate(v):
    """Every head under every combination: gain over its kernel prior, and R2 of each of its scalar targets."""
    return rounded(ps.evaluate(feature_labels(v), NOISY).summary(), 5)


@query("job_evaluate_coverage", " UNION ALL ".join(
    f"SELECT '{h}' AS head, '{t}' AS target, {level}e0 AS level, count(*) AS n, round(avg(CAST(abs(r{i}) <= {NormalDist().inv_cdf((1 + level) / 2)!r}e0 * sqrt(s{i}{i}) AS DOUBLE)), 6) AS coverage "
    f"FROM {_fitted_sql(c, 'ZSIW')}"
    for h, c in EVALUATED.items() for i, t in enumerate([h] if len(c) == 1 else ["sfr", "mstar"]) for level in (0.68, 0.9, 0.95)))
def job_evaluate_coverage(v):
    return rounded(ps.evaluate(feature_labels(v), NOISY).coverage())


# ---- summaries of scores

@query("agg_information_gain", f"""
WITH {SCORES} SELECT head, subset, count(*) AS n, round(avg(ll - prior), 6) AS information_gain FROM scores WHERE common GROUP BY head, subset""")
def agg_information_gain(v):
    return rounded(sc.information_gain(scores(v)))


@query("agg_score_grid", f"""
WITH {SCORES}, g AS (SELECT head, subset, ordinal, avg(ll - prior) AS ig FROM scores WHERE common GROUP BY head, subset, ordinal)
SELECT subset, ordinal, round(max(CASE WHEN head = 'flux' THEN ig END), 6) AS flux_information_gain, round(max(CASE WHEN head = 'lx' THEN ig END), 6) AS lx_information_gain
FROM g GROUP BY subset, ordinal""")
def agg_score_grid(v):
    return rounded(sc.score_grid(sc.information_gain(scores(v)), ["flux", "lx"]))


@query("agg_wide_scores", f"WITH {SCORES} SELECT source_id, " + ", ".join(
    f"round(max(CASE WHEN head = '{h}' AND subset = '{s}' THEN ll END), 6) AS ll_{h}_{s}" for h in ("lx", "flux") for s in sm.subset_names()) +
    " FROM scores GROUP BY source_id")
def agg_wide_scores(v):
    return rounded(sc.wide_scores(scores(v), ["lx", "flux"]))


@query("agg_r_squared", f"""
WITH {SCORES} SELECT head, subset, count(*) AS n, round(1 - sum(pow(redshift - ll, 2)) / (var_pop(redshift) * count(*)), 6) AS r2 FROM scores WHERE common GROUP BY head, subset""")
def agg_r_squared(v):
    return rounded(sc.r_squared(scores(v).filter("common"), "redshift", "ll", ["head", "subset"]))


@query("agg_coverage", " UNION ALL ".join(f"""
SELECT {level}e0 AS level, count(*) AS n, round(avg(CAST(truth BETWEEN lo AND hi AS DOUBLE)), 6) AS coverage FROM v_draw_sources JOIN (
  SELECT source_id, quantile_cont(u1, {(1 - level) / 2!r}) AS lo, quantile_cont(u1, {(1 + level) / 2!r}) AS hi FROM v_draws GROUP BY source_id) USING (source_id)"""
    for level in (0.68, 0.9, 0.95)))
def agg_coverage(v):
    return rounded(sc.interval_coverage(v.draws, v.draw_sources, "source_id", "u1", "truth"))


@query("agg_validation_metric", f"""
WITH {SCORES} SELECT count(*) AS heads, round(avg(nll), 6) AS metric FROM (SELECT head, avg(-ll) AS nll FROM scores WHERE common GROUP BY head)""")
def agg_validation_metric(v):
    return rounded(sc.validation_metric(scores(v).withColumn("ll", F.when(F.col("common"), F.col("ll")))))


@query("agg_ranked_combinations", f"""
WITH {SCORES}, g AS (SELECT subset, avg(ll - prior) AS ig FROM scores WHERE common AND head = 'flux' GROUP BY subset)
SELECT subset, round(ig, 6) AS information_gain, 0.5e0 AS baseline, ig > 0.5e0 AS above FROM g""")
def agg_ranked_combinations(v):
    return rounded(sc.ranked_combinations(sc.information_gain(scores(v)), "flux", 0.5))


@query("dq_incomplete_heads", f"""
WITH {SCORES} SELECT 'lx' AS head, 15 - count(DISTINCT subset) AS missing FROM scores WHERE head = 'lx' AND length(subset) > 1 UNION ALL SELECT 'sfr', 15""")
def dq_incomplete_heads(v):
    gains = sc.information_gain(scores(v).filter("head = 'flux' OR length(subset) > 1"))
    return sc.incomplete_heads(gains, ["lx", "flux", "sfr"])
