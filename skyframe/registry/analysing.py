"""Gains, trends, draws and resampling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.operators import analysis as an
from skyframe.operators import rank
from skyframe.operators import sample as sm
from skyframe.plans import scoring as ps
from skyframe.registry.base import SQL, query
from skyframe.registry.scoring import SCORES, rounded, scores

_edges = []
_total = 0.0
for _k in range(12):
    _total += math.exp(-1.0) / math.factorial(_k)
    _edges.append(_total)


def weight_sql(rep: str, key: str, seed: int = 0) -> str:
    u = f"(CAST(('0x' || substr(md5(concat('{seed}:', CAST({rep} AS VARCHAR), ':', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0e0)"
    return "len(list_filter([" + ", ".join(repr(e) + "e0" if "e" not in repr(e) else repr(e) for e in _edges) + f"], lambda e: e <= {u}))"


@query("stat_poisson_weights", f"SELECT s_suppkey, rep, {weight_sql('rep', 's_suppkey', 5)} AS w FROM supplier, (SELECT unnest(range(0, 40)) AS rep)")
def stat_poisson_weights(v):
    s = v.table("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("rep"))
    return s.withColumn("w", rank.poisson_weight(5, "rep", "s_suppkey"))


@query("agg_bootstrap_se", f"""
WITH r AS (SELECT event_type, event_id, value, unnest(range(0, 100)) AS rep FROM events),
w AS (SELECT *, {weight_sql('rep', 'event_id')} AS w FROM r), m AS (SELECT event_type, rep, sum(w * value) / sum(w) AS mean FROM w GROUP BY event_type, rep)
SELECT event_type, (SELECT count(*) FROM events e WHERE e.event_type = m.event_type) AS n, round(stddev_samp(mean), 6) AS se FROM m GROUP BY event_type""")
def agg_bootstrap_se(v):
    return rounded(rank.bootstrap_se(v.table("events"), "value", "event_id", ["event_type"], 100))


@query("agg_combination_table", f"""
WITH {SCORES}, g AS (SELECT *, ll - prior AS gain FROM scores WHERE common), r AS (SELECT head, subset, source_id, gain, unnest(range(0, 20)) AS rep FROM g),
w AS (SELECT *, {weight_sql('rep', 'source_id')} AS w FROM r), m AS (SELECT head, subset, rep, sum(w * gain) / sum(w) AS mean FROM w GROUP BY head, subset, rep),
s AS (SELECT head, subset, round(stddev_samp(mean), 6) AS se FROM m GROUP BY head, subset)
SELECT head, subset, count(*) AS n, round(avg(gain), 6) AS information_gain, any_value(se) AS se FROM g JOIN s USING (head, subset) GROUP BY head, subset""")
def agg_combination_table(v):
    return rounded(an.combination_table(scores(v), 20))


GAINS = f"""{SCORES}, wide AS (SELECT source_id, any_value(redshift) AS redshift, max(CASE WHEN subset = 'Z' THEN ll END) - max(prior) AS redshift_alone,
  max(CASE WHEN subset = 'ZS' THEN ll END) - max(CASE WHEN subset = 'Z' THEN ll END) AS s, max(CASE WHEN subset = 'ZI' THEN ll END) - max(CASE WHEN subset = 'Z' THEN ll END) AS i,
  max(CASE WHEN subset = 'ZW' THEN ll END) - max(CASE WHEN subset = 'Z' THEN ll END) AS w FROM scores WHERE common AND head = 'lx' GROUP BY source_id)"""


@query("agg_modality_gains", f"""
WITH {GAINS}, long AS (SELECT source_id, 'Z' AS modality, redshift_alone AS gain FROM wide UNION ALL SELECT source_id, 'S', s FROM wide UNION ALL
  SELECT source_id, 'I', i FROM wide UNION ALL SELECT source_id, 'W', w FROM wide),
b AS (SELECT modality, rep, sum(wt * gain) / sum(wt) AS mean FROM (SELECT *, {weight_sql('rep', 'source_id')} AS wt FROM (SELECT *, unnest(range(0, 50)) AS rep FROM long)) GROUP BY modality, rep),
e AS (SELECT modality, stddev_samp(mean) AS se FROM b GROUP BY modality), p AS (SELECT modality, count(*) AS n, avg(gain) AS pooled FROM long GROUP BY modality)
SELECT modality, n, round(pooled, 6) AS pooled, round(se, 6) AS se,
  round(CASE WHEN modality <> 'Z' THEN pooled / (SELECT sum(pooled) FROM p WHERE modality <> 'Z') END, 5) AS attributed_fraction FROM p JOIN e USING (modality)""")
def agg_modality_gains(v):
    return rounded(an.modality_gains(scores(v), "lx", 50), attributed_fraction=5)


_HALF = "greatest(1, CAST(round_even(0.08e0 * (SELECT count(*) FROM {t}) / 2, 0) AS BIGINT))"


def _rolling_sql(table: str, x: str, y: str, key: str) -> str:
    return f"""r AS (SELECT {key} AS k, {x} AS x, {y} AS y, row_number() OVER (ORDER BY {x}, {key}) AS rank FROM {table}),
h AS (SELECT {_HALF.format(t=table)} AS half, count(*) AS n FROM {table}),
c AS (SELECT *, sum(y) OVER (ORDER BY rank) AS total FROM r),
roll AS (SELECT c.k, c.x, c.rank, (a.total - coalesce(b.total, 0)) / (least(c.rank + half, n) - greatest(c.rank - half - 1, 0)) AS mean
  FROM c CROSS JOIN h JOIN c a ON a.rank = least(c.rank + half, n) LEFT JOIN c b ON b.rank = c.rank - half - 1)"""


@query("win_rolling_mean", f"WITH {GAINS}, {_rolling_sql('wide', 'redshift', 's', 'source_id')} SELECT k AS source_id, x AS redshift, rank, round(mean, 9) AS mean FROM roll")
def win_rolling_mean(v):
    out = an.gain_trend(an.source_gains(scores(v), "lx"), "S")
    return out.withColumn("mean", F.round("mean", 9))


@query("win_rolling_events", """
WITH h AS (SELECT greatest(1, CAST(round_even(0.08e0 * count(*) / 2, 0) AS BIGINT)) AS half FROM events),
r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events)
SELECT a.event_id, a.rank, round(avg(b.value), 5) AS mean FROM r a, h JOIN r b ON b.rank BETWEEN a.rank - half AND a.rank + half GROUP BY a.event_id, a.rank""")
def win_rolling_events(v):
    out = rank.rolling_mean(v.table("events").select("event_id", "ts", "value"), "ts", "value", "event_id", 0.08)
    return out.select("event_id", "rank", F.round("mean", 5).alias("mean"))


@query("win_rolling_band", f"""
WITH h AS (SELECT greatest(1, CAST(round_even(0.08e0 * count(*) / 2, 0) AS BIGINT)) AS half, count(*) AS n FROM events),
r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events),
w AS (SELECT *, {weight_sql('rep', 'event_id', 3)} AS w FROM (SELECT *, unnest(range(0, 20)) AS rep FROM r)),
c AS (SELECT event_id, rep, rank, sum(w) OVER (PARTITION BY rep ORDER BY rank) AS tw, sum(w * value) OVER (PARTITION BY rep ORDER BY rank) AS ty FROM w),
m AS (SELECT c.event_id, c.rank, (a.ty - coalesce(b.ty, 0)) / (a.tw - coalesce(b.tw, 0)) AS mean FROM c CROSS JOIN h JOIN c a ON a.rep = c.rep AND a.rank = least(c.rank + half, n)
  LEFT JOIN c b ON b.rep = c.rep AND b.rank = c.rank - half - 1)
SELECT event_id, rank - 1 AS rank, round(quantile_cont(mean, 0.025), 8) AS lo, round(quantile_cont(mean, 0.975), 8) AS hi FROM m GROUP BY event_id, rank""")
def win_rolling_band(v):
    out = rank.rolling_band(v.table("events").select("event_id", "ts", "value"), "ts", "value", "event_id", 0.08, 20, 3)
    return out.select("event_id", "rank", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query("win_rolling_band_1000", SQL["win_rolling_band"].replace("range(0, 20)", "range(0, 1000)"))
def win_rolling_band_1000(v):
    out = rank.rolling_band(v.table("events").select("event_id", "ts", "value"), "ts", "value", "event_id", 0.08, 1000, 3)
    return out.select("event_id", "rank", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query("agg_combination_table_1000")
def agg_combination_table_1000(v):
    return rounded(an.combination_table(scores(v)))


# ---- draws

UNIT = sm.Standardizer({"rate_p2": -1.0, "rate_p3": -0.8, "sfr": 0.3, "mstar": 10.2}, {"rate_p2": 0.5, "rate_p3": 0.6, "sfr": 0.7, "mstar": 0.4})
DECODED = """
d AS (SELECT source_id, u1, pow(10.0e0, u0 * 0.5e0 - 1.0e0) AS p2, pow(10.0e0, u1 * 0.6e0 - 0.8e0) AS p3, u2 * 0.7e0 + 0.3e0 AS sfr, u3 * 0.4e0 + 10.2e0 AS mstar FROM v_draws),
x AS (SELECT *, (p3 - p2) / (p3 + p2) AS hr, sfr - mstar AS ssfr FROM d),
rho AS (SELECT source_id, count(*) AS draws, covar_pop(hr, ssfr) / sqrt(var_pop(hr) * var_pop(ssfr)) AS rho FROM x GROUP BY source_id)"""


@query("fn_decode_draws", f"WITH {DECODED} SELECT source_id, round(sum(p2), 4) AS p2, round(sum(p3), 4) AS p3, round(sum(sfr), 4) AS sfr, round(sum(mstar), 3) AS mstar FROM d GROUP BY source_id")
def fn_decode_draws(v):
    out = an.decoded(v.draws, ["rate_p2", "rate_p3", "sfr", "mstar"], UNIT, ["u0", "u1", "u2", "u3"])
    return rounded(out.groupBy("source_id").agg(F.sum("rate_p2").alias("p2"), F.sum("rate_p3").alias("p3"), F.sum("sfr").alias("sfr"), F.sum("mstar").alias("mstar")), 4, mstar=3)


@query("fn_hardness_ratio", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - l_quantity) / (l_extendedprice + l_quantity), 6) AS hr FROM lineitem""")
def fn_hardness_ratio(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                      F.round(an.hardness_ratio(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("hr"))


@query("agg_posterior_mean", "SELECT source_id, round(avg(u0), 6) AS u0, round(avg(u1), 6) AS u1, round(avg(u2), 6) AS u2, round(avg(u3), 6) AS u3 FROM v_draws GROUP BY source_id")
def agg_posterior_mean(v):
    return rounded(an.posterior_means(v.draws, ["u0", "u1", "u2", "u3"]))


@query("agg_within_object_rho", f"WITH {DECODED} SELECT source_id, draws, round(rho, 6) AS rho FROM rho")
def agg_within_object_rho(v):
    return rounded(an.within_object_correlation(v.draws, UNIT))


@query("agg_hardness_summary", f"""
WITH {DECODED} SELECT source_id, count(*) AS n, round(quantile_cont(hr, 0.5), 6) AS hr_median, round(quantile_cont(hr, 0.16), 6) AS hr_lo, round(quantile_cont(hr, 0.84), 6) AS hr_hi FROM x GROUP BY source_id""")
def agg_hardness_summary(v):
    return rounded(an.hardness_summary(v.draws, UNIT))


def rho(v):
    return an.within_object_correlation(v.draws, UNIT).join(v.draw_sources, "source_id")


@query("agg_population_shares", f"""
WITH {DECODED}, j AS (SELECT * FROM rho JOIN v_draw_sources USING (source_id) WHERE rho IS NOT NULL),
pop AS (SELECT 'all' AS population, source_id, rho FROM j UNION ALL SELECT 'galaxies', source_id, rho FROM j WHERE spectype = 'GALAXY' UNION ALL
  SELECT 'nearby_galaxies', source_id, rho FROM j WHERE spectype = 'GALAXY' AND redshift < 0.7e0 UNION ALL SELECT 'quasars', source_id, rho FROM j WHERE spectype = 'QSO'),
b AS (SELECT population, rep, sum(w * rho) / sum(w) AS mean FROM (SELECT *, {weight_sql('rep', 'source_id')} AS w FROM (SELECT *, unnest(range(0, 200)) AS rep FROM pop)) GROUP BY population, rep),
e AS (SELECT population, stddev_samp(mean) AS se FROM b GROUP BY population)
SELECT population, count(*) AS n, round(avg(CAST(rho < 0 AS DOUBLE)), 6) AS fraction_negative, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.5), 6) AS median, round(any_value(se), 6) AS se
FROM pop JOIN e USING (population) GROUP BY population""")
def agg_population_shares(v):
    return rounded(an.population_shares(rho(v), 200))


@query("agg_histogram", f"""
WITH {DECODED}, b AS (SELECT CAST(floor(rho / 0.005e0) AS BIGINT) AS i, count(*) AS rows FROM rho WHERE rho IS NOT NULL GROUP BY 1),
s AS (SELECT unnest(range((SELECT min(i) FROM b), (SELECT max(i) + 1 FROM b))) AS i)
SELECT round(s.i * 0.005e0, 6) AS edge, coalesce(rows, 0) AS rows FROM s LEFT JOIN b USING (i)""")
def agg_histogram(v):
    return rounded(an.fixed_width_histogram(an.within_object_correlation(v.draws, UNIT), "rho"))


@query("job_analyse", f"""
WITH {DECODED} SELECT source_id, draws, round(rho, 6) AS rho, spectype, round(redshift, 6) AS redshift FROM rho JOIN v_draw_sources USING (source_id)""")
def job_analyse(v):
    done = ps.analyse(scores(v), v.draws, v.draw_sources.drop("truth"), UNIT, "lx", 20)
    return rounded(done.rho)


def analysed(v):
    return ps.analyse(scores(v), v.draws, v.draw_sources.drop("truth"), UNIT, "lx", 20)


@query("job_analyse_table")
def job_analyse_table(v):
    return rounded(analysed(v).table)


@query("job_analyse_gains")
def job_analyse_gains(v):
    return rounded(analysed(v).modality_gains, attributed_fraction=5)


@query("job_analyse_trend")
def job_analyse_trend(v):
    return analysed(v).trends["S"].withColumn("mean", F.round("mean", 9))


_TRENDS = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_rolling_sql('wide', 'redshift', m.lower(), 'source_id')} SELECT '{m}' AS modality, k AS source_id, rank, round(mean + 1.0e-10, 7) AS mean FROM roll)" for m in "SIW")


@query("job_analyse_trends")
def job_analyse_trends(v):
    done = analysed(v)
    parts = [df.select(F.lit(m).alias("modality"), "source_id", "rank", F.round(F.col("mean") + 1e-10, 7).alias("mean")) for m, df in done.trends.items()]
    return reduce(DataFrame.unionByName, parts)


@query("job_analyse_bands")
def job_analyse_bands(v):
    """The bands of all modalities at the job's own number of replicates."""
    done = ps.analyse(scores(v), v.draws, v.draw_sources.drop("truth"), UNIT, "lx")
    parts = [df.select(F.lit(m).alias("modality"), "source_id", "rank", F.round(F.col("lo") + 1e-10, 7).alias("lo"), F.round(F.col("hi") + 1e-10, 7).alias("hi"))
             for m, df in done.bands.items()]
    return reduce(DataFrame.unionByName, parts)


@query("job_analyse_band", f"""
WITH {GAINS}, h AS (SELECT {_HALF.format(t="wide")} AS half, count(*) AS n FROM wide),
r AS (SELECT source_id, redshift, s AS value, row_number() OVER (ORDER BY redshift, source_id) AS rank FROM wide),
q AS (SELECT *, {weight_sql('rep', 'source_id')} AS w FROM (SELECT *, unnest(range(0, 1000)) AS rep FROM r)),
c AS (SELECT source_id, rep, rank, sum(w) OVER (PARTITION BY rep ORDER BY rank) AS tw, sum(w * value) OVER (PARTITION BY rep ORDER BY rank) AS ty FROM q),
m AS (SELECT c.source_id, c.rank, (a.ty - coalesce(b.ty, 0)) / (a.tw - coalesce(b.tw, 0)) AS mean FROM c CROSS JOIN h JOIN c a ON a.rep = c.rep AND a.rank = least(c.rank + half, n)
  LEFT JOIN c b ON b.rep = c.rep AND b.rank = c.rank - half - 1)
SELECT source_id, rank - 1 AS rank, round(quantile_cont(mean, 0.025) + 1.0e-10, 7) AS lo, round(quantile_cont(mean, 0.975) + 1.0e-10, 7) AS hi FROM m GROUP BY source_id, rank""")
def job_analyse_band(v):
    """One modality's band at the job's own number of replicates."""
    done = ps.analyse(scores(v), v.draws, v.draw_sources.drop("truth"), UNIT, "lx")
    return done.bands["S"].select("source_id", "rank", F.round(F.col("lo") + 1e-10, 7).alias("lo"), F.round(F.col("hi") + 1e-10, 7).alias("hi"))  # no ties


@query("job_analyse_shares")
def job_analyse_shares(v):
    return rounded(analysed(v).shares)


@query("job_analyse_hardness")
def job_analyse_hardness(v):
    return rounded(analysed(v).hardness)


@query("agg_exact_quantiles", """
SELECT 0.16e0 AS q, count(*) AS n, round(quantile_cont(l_extendedprice, 0.16), 6) AS value FROM lineitem UNION ALL
SELECT 0.5e0, count(*), round(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem UNION ALL SELECT 0.99e0, count(*), round(quantile_cont(l_extendedprice, 0.99), 6) FROM lineitem""")
def agg_exact_quantiles(v):
    return rounded(rank.exact_quantiles(v.table("lineitem"), "l_extendedprice", [0.16, 0.5, 0.99])).withColumn("n", F.col("n").cast("long"))


_BAND = SQL["job_analyse_band"][SQL["job_analyse_band"].index("h AS (SELECT greatest"):]
_CHEAD = SQL["job_analyse_band"][:SQL["job_analyse_band"].index("h AS (SELECT greatest")].rstrip().rstrip(",")
SQL["job_analyse_bands"] = f"{_CHEAD} " + " UNION ALL ".join(
    f"SELECT * FROM (WITH {_BAND.replace('s AS value', f'{m.lower()} AS value').replace('SELECT source_id, rank - 1', f'SELECT {chr(39)}{m}{chr(39)} AS modality, source_id, rank - 1')})" for m in "SIW")
SQL["job_analyse_trends"] = f"{_CHEAD} {_TRENDS}"
# outputs of the job that an operator's SQL already states, some at the job's number of replicates
SQL["agg_combination_table_1000"] = SQL["agg_combination_table"].replace("range(0, 20)", "range(0, 1000)")
SQL["job_analyse_table"] = SQL["agg_combination_table"]
SQL["job_analyse_gains"] = SQL["agg_modality_gains"].replace("range(0, 50)", "range(0, 20)")
SQL["job_analyse_trend"] = SQL["win_rolling_mean"]
SQL["job_analyse_shares"] = SQL["agg_population_shares"].replace("range(0, 200)", "range(0, 20)")
SQL["job_analyse_hardness"] = SQL["agg_hardness_summary"]
