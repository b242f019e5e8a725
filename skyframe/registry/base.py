"""Registration helpers and the catalogue-shaped views over the given tables.

A view is SQL arithmetic on the keys and values of one given table, valid in Spark and in the checking
engine alike, so both sides start from the same rows. `{name}` stands for a given table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyframe.params import LIGHT_KMS, LINE_COMPLEXES, LineComplex
from skyframe.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(Views) -> DataFrame` under a name, with its SQL."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


TARGET_ID = "((9010 + {k} % 4) * 4398046511104 + {k})"
_RA = "(150 + ({k} * 7919 % 15013) / 15013.0e0)"
_DEC = "(20 + ({k} * 104729 % 15017) / 15017.0e0)"


def _target_rows(targetid: str, shift: str, where: str) -> str:
    k = "k"
    return f"""
  SELECT {targetid} AS targetid,
    CASE WHEN k % 211 = 0 THEN NULL ELSE {_RA.format(k=k)} END AS target_ra,
    {_DEC.format(k=k)} + {shift} AS target_dec,
    CASE WHEN k % 4 = 3 THEN 'sv1    ' ELSE 'main   ' END AS survey,
    CASE WHEN k % 3 = 0 THEN 'dark  ' WHEN k % 3 = 1 THEN 'bright' ELSE 'backup' END AS program,
    CAST(k % 97 AS INT) AS healpix,
    CASE WHEN k % 10 = 9 THEN 'STAR  ' WHEN k % 10 >= 7 THEN 'GALAXY' ELSE 'QSO   ' END AS spectype,
    (k % 350) / 100.0e0 - 0.01e0 AS z,
    CASE WHEN k % 19 = 0 THEN 4 ELSE 0 END AS zwarn,
    k % 23 <> 0 AS zcat_primary
  FROM (SELECT o_orderkey AS k FROM {{orders}}) {where}"""


def _detection_rows(flag: str, p_i: str, shift: str, where: str) -> str:
    return f"""
  SELECT concat('D', lpad(CAST(c AS VARCHAR(20)), 8, '0')) AS ero_detuid,
    {_RA.format(k="k")} + (c % 2) * 0.0005e0 AS xray_ra,
    {_DEC.format(k="k")} + (c % 3) * 12.0e0 / 3600 + {shift} AS xray_dec,
    {_RA.format(k="k")} + (c % 7) * 0.1e0 / 3600 + (CASE WHEN c % 29 = 0 THEN 5.0e0 / 3600 ELSE 0.0e0 END) AS ls10_ra,
    CASE WHEN c % 113 = 0 THEN NULL ELSE {_DEC.format(k="k")} + (c % 5) * 0.2e0 / 3600 + {shift} END AS ls10_dec,
    (c_acctbal + 1000) / 11000.0e0 AS nway_p_any,
    {p_i} AS nway_p_i,
    CASE WHEN c % 9 = 0 THEN NULL ELSE 0.05e0 + (c % 10) * 0.03e0 END AS nway_threshold6,
    (c * 37 % 101) / 101.0e0 AS nway_dist_post,
    {flag} AS nway_match_flag,
    (c % 7 - 2) * 1.5e0 AS ls10_flux_w1, (c % 11 - 5) * 0.7e0 AS ls10_flux_w2, (c % 13 - 9) * 0.3e0 AS ls10_flux_w3,
    (c % 5) * 1.0e0 AS ls10_flux_ivar_w1, (c % 3) * 2.0e0 AS ls10_flux_ivar_w2, (c % 2) * 0.5e0 AS ls10_flux_ivar_w3
  FROM (SELECT c_custkey AS c, c_acctbal,
          10 * (CASE WHEN c_custkey % 46 = 1 AND c_custkey > 1 THEN c_custkey - 2
                     WHEN c_custkey % 23 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END) AS k
        FROM {{customer}}) {where}"""


def _band(b: str, salt: int) -> str:
    return f"""
    price * 1.0e-17 * {salt} AS ml_flux_{b},
    price * 1.0e-17 * ((k + {salt}) % 25) / 20.0e0 AS ml_flux_lowerr_{b},
    price * 1.0e-17 * ((k * 3 + {salt}) % 700) / 20.0e0 AS ml_flux_uperr_{b},
    (k + {salt}) % 60 - (CASE WHEN (k + {salt}) % 97 = 0 THEN 100 ELSE 0 END) AS ape_cts_{b},
    ((k * 7 + {salt}) % 50 - 2) / 10.0e0 AS ape_bkg_{b},
    CASE WHEN (k + {salt}) % 41 = 0 THEN 0.0e0 ELSE 100.0e0 + k % 17 END AS ape_exp_{b}"""


# One line complex per vector, without noise; the line's strength and level follow the vector's components.
_PLANTED = """
  SELECT vec_id AS targetid, label, CAST(vec_id % 4 AS INT) AS kind, 0.08e0 + (vec_id % 38) / 100.0e0 AS z, 0.5e0 + floor(100 * abs(CAST({second} AS DOUBLE))) / 100.0e0 AS c0,
    (vec_id % 5 - 2) / 1000.0e0 AS slope, (vec_id * 37 % 601 - 300) * 1.0e0 AS vel, 150.0e0 + vec_id * 53 % 250 AS s,
    2.0e0 + floor(100 * abs(CAST({first} AS DOUBLE))) / 100.0e0 AS amp, 1.0e0 + (vec_id * 17 % 40) / 20.0e0 AS amp2 FROM {{embeddings}}"""
PLANTED_TRUTH = (_PLANTED.format(first="embedding[0]", second="embedding[1]"), _PLANTED.format(first="embedding[1]", second="embedding[2]"))


def _planted_flux(c: LineComplex) -> str:
    """A complex in SQL at the observed wavelength of pixel i: amplitudes amp and amp2, velocity vel, width s."""
    x = "(3600.0e0 + 2.0e0 * i) / (1 + z)"
    terms = [f"c0 + slope * ({x} - {c.primary!r}e0)"]
    for amp, lines in zip(("amp", "amp2"), c.species):
        for rest, ratio in lines:
            centre = f"({rest!r}e0 * (1 + vel / {LIGHT_KMS!r}e0))"
            terms.append(f"{amp} * {ratio!r}e0 * exp(-0.5e0 * pow(({x} - {centre}) / ({centre} * s / {LIGHT_KMS!r}e0), 2))")
    return " + ".join(terms)


def _planted_held(c: LineComplex) -> list[tuple[str, str]]:
    """What `_planted_flux` works out for every pixel though it is the same for all of them: per line its strength, centre and width."""
    out = []
    for amp, lines in zip(("amp", "amp2"), c.species):
        for rest, ratio in lines:
            centre, n = f"({rest!r}e0 * (1 + vel / {LIGHT_KMS!r}e0))", len(out) // 3
            out += [(f"{c.name}_a{n}", f"{amp} * {ratio!r}e0"), (f"{c.name}_c{n}", centre), (f"{c.name}_w{n}", f"({centre} * s / {LIGHT_KMS!r}e0)")]
    return out


def _planted_spark(c: LineComplex) -> str:
    """`_planted_flux` at the rest wavelengths `held.xs`, operation by operation the same."""
    names = [f"held.{n}" for n, _ in _planted_held(c)]
    terms = [f"{a} * exp(-0.5e0 * pow((x - {m}) / {w}, 2))" for a, m, w in zip(names[::3], names[1::3], names[2::3])]
    return f"transform(held.xs, x -> {' + '.join([f'c0 + slope * (x - {c.primary!r}e0)', *terms])})"


def _held(source: str, fields: list[tuple[str, str]]) -> str:
    """The rows with a struct `held` of values worked out once per row; a generator of one element keeps the optimizer from moving them into lambdas."""
    return f"({source}) LATERAL VIEW explode(array(named_struct({', '.join(f"'{n}', {e}" for n, e in fields)}))) AS held"


_PLANTED_HELD = [("xs", "transform(sequence(0, 3099), i -> (3600.0e0 + 2.0e0 * i) / (1 + z))"), *(f for c in LINE_COMPLEXES for f in _planted_held(c))]
_PLANTED_SPARK = "CASE kind " + " ".join(f"WHEN {k} THEN {_planted_spark(c)}" for k, c in enumerate(LINE_COMPLEXES)) + " ELSE transform(held.xs, x -> CAST(NULL AS DOUBLE)) END"
_PLANTED_PIXEL = "CASE kind " + " ".join(f"WHEN {k} THEN {_planted_flux(c)}" for k, c in enumerate(LINE_COMPLEXES)) + " END"
_PLANTED_IVAR = "CASE WHEN (i + label * 40) % 1000 < 90 THEN 0.0e0 ELSE 9.0e0 + i % 4 END"

VIEWS: dict[str, str | tuple[str, str]] = {
    # observed targets: the scanned catalogue, with stacked copies 0.4 arcsec away
    "v_targets": _target_rows(TARGET_ID.format(k="k"), "0.0e0", "") + "\n  UNION ALL" + _target_rows(
        "((9010 + (k + 1) % 4) * 4398046511104 + 4194304 + k)", "0.4e0 / 3600", "WHERE k % 11 = 0"),
    # detections: with exact copies and second primaries
    "v_detections": _detection_rows("CASE WHEN c % 13 = 0 THEN 2 ELSE 1 END", "(c % 13) / 13.0e0", "0.0e0", "")
    + "\n  UNION ALL" + _detection_rows("CASE WHEN c % 13 = 0 THEN 2 ELSE 1 END", "(c % 13) / 13.0e0", "0.0e0",
                                        "WHERE c % 17 = 0")
    + "\n  UNION ALL" + _detection_rows("1", "(c % 29) / 29.0e0", "0.01e0", "WHERE c % 31 = 0"),
    # source catalogue keyed by detection
    "v_main": f"""
  SELECT concat('D', lpad(CAST(k AS VARCHAR(20)), 8, '0')) AS ero_detuid,
    (k % 40) * 1.0e0 AS det_like_0, (k % 30) * 1.0e0 AS det_like_p2, (k % 20) * 1.0e0 AS det_like_p3,
    {_band("1", 3)},{_band("p2", 1)},{_band("p3", 2)}
  FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 53 = 0 THEN 0.0e0 ELSE o_totalprice END AS price FROM {{orders}})""",
    # host-galaxy fits: several per target
    "v_host_fits": f"""
  SELECT {TARGET_ID.format(k="k")} AS targetid,
    CASE WHEN n % 3 = 0 THEN 'sv1' ELSE 'main' END AS survey,
    CASE WHEN n % 2 = 0 THEN 'dark' ELSE 'bright' END AS program,
    price / 1000.0e0 AS chi2,
    CASE WHEN d = 0.05e0 AND n = 2 THEN 0.0e0 WHEN d = 0.0e0 THEN -99.0e0 ELSE q / 5.0e0 + 2.0e0 END AS logm,
    CASE WHEN n = 7 THEN 0.0e0 ELSE t * 50.0e0 - 0.5e0 END AS logm_err,
    CASE WHEN d = 0.05e0 AND n = 2 THEN 0.0e0 ELSE q / 10.0e0 - 2.0e0 END AS logsfr,
    0.1e0 + d * 40.0e0 AS logsfr_err,
    0.1e0 + t * 80.0e0 AS flag_masspdf, 0.15e0 + d * 30.0e0 AS flag_sfrpdf
  FROM (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS price, l_discount AS d, l_tax AS t
        FROM {{lineitem}})""",
    # one row per sample candidate, with flags
    "v_sample": f"""
  SELECT {TARGET_ID.format(k="k")} AS targetid,
    concat('D', lpad(CAST(k AS VARCHAR(20)), 8, '0')) AS ero_detuid,
    k % 50 = 7 AS split_source, k % 41 <> 3 AS has_spectrum, k % 37 <> 5 AS has_image,
    k % 19 <> 0 AS has_z, k % 6 <> 1 AS has_wise,
    CASE WHEN k % 10 >= 7 THEN 'GALAXY' ELSE 'QSO' END AS spectype,
    price / 100000.0e0 AS redshift
  FROM (SELECT o_orderkey AS k, o_totalprice AS price FROM {{orders}})""",
    # joined labels of the scored sample
    "v_labels": f"""
  SELECT {TARGET_ID.format(k="k")} AS targetid, k AS source_id,
    CASE WHEN k % 10 < 8 THEN 'train' WHEN k % 10 = 8 THEN 'val' ELSE 'test' END AS split,
    CASE WHEN k % 3 = 0 THEN 'GALAXY' ELSE 'QSO' END AS spectype,
    price / 100000.0e0 AS redshift,
    k % 19 <> 0 AS has_z, k % 29 <> 2 AS has_spectrum, k % 31 <> 4 AS has_image, k % 6 <> 1 AS has_wise,
    CASE WHEN k % 21 = 0 THEN NULL ELSE -13.5e0 + price / 400000.0e0 + (k % 17) / 40.0e0 END AS log_flux_1,
    CASE WHEN k % 21 = 0 OR k % 33 = 0 THEN NULL ELSE 42.0e0 + price / 200000.0e0 + (k % 13) / 20.0e0 END AS log_lx,
    CASE WHEN k % 9 = 4 THEN NULL ELSE -1.0e0 + (k * 31 % 1009) / 400.0e0 END AS log_sfr,
    CASE WHEN k % 8 = 5 THEN NULL ELSE 9.5e0 + (k * 17 % 1013) / 600.0e0 + (k * 31 % 1009) / 1600.0e0 END AS logmstar_cigale,
    k % 60 AS ape_cts_p2, (k * 7 % 50) / 10.0e0 AS ape_bkg_p2,
    CASE WHEN k % 43 = 0 THEN 0.0e0 ELSE 100.0e0 + k % 17 END AS ape_exp_p2,
    CASE WHEN k % 51 = 0 THEN NULL ELSE k * 13 % 45 END AS ape_cts_p3, (k * 11 % 40) / 10.0e0 AS ape_bkg_p3,
    90.0e0 + k % 23 AS ape_exp_p3
  FROM (SELECT o_orderkey AS k, o_totalprice AS price FROM {{orders}})""",
    # measured fluxes of four lines, one row per source
    "v_line_fluxes": """
  SELECT o_orderkey AS source_id, o_totalprice / 50000.0e0 + (o_orderkey * 31 % 1009) / 300.0e0 AS flux_a, (o_orderkey * 7 % 613) / 200.0e0 AS flux_b,
    (o_orderkey * 31 % 1009) / 500.0e0 + (o_orderkey % 11) / 3.0e0 AS flux_c, (o_orderkey * 29 % 751) / 250.0e0 - 1.0e0 AS flux_d
  FROM {orders}""",
    # posterior draws: one row per draw
    "v_draws": """
  SELECT l_suppkey AS source_id, l_quantity / 50.0e0 - 0.5e0 AS u0, l_extendedprice / 50000.0e0 - 1.0e0 AS u1,
    l_discount * 20 - 1.0e0 AS u2, l_tax * 25 - 1.0e0 + l_quantity / 100.0e0 AS u3
  FROM {lineitem}""",
    "v_draw_sources": """
  SELECT s_suppkey AS source_id, s_acctbal / 10000.0e0 - 0.3e0 AS truth,
    CASE WHEN s_suppkey % 3 = 0 THEN 'QSO' ELSE 'GALAXY' END AS spectype,
    (s_suppkey % 200) / 100.0e0 AS redshift
  FROM {supplier}""",
    # scores per source and input combination
    "v_score_base": """
  SELECT o_orderkey AS source_id, o_totalprice / 100000.0e0 AS redshift, o_orderkey % 4 <> 1 AS common,
    CASE WHEN o_orderkey % 10 >= 7 THEN 'GALAXY' ELSE 'QSO' END AS spectype,
    -1.5e0 + (o_orderkey % 101) / 100.0e0 AS prior_lx, -1.2e0 + (o_orderkey % 103) / 90.0e0 AS prior_flux
  FROM {orders}""",
    # rates: one aperture triple per row
    "v_counts": """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS counts, l_discount * 200 AS bkg,
    100.0e0 + l_linenumber AS expo, l_extendedprice
  FROM {lineitem}""",
    # training rows of a prior and the rows it is asked about
    "v_prior_labels": """
  SELECT c_custkey AS source_id, 'train' AS split, CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE c_acctbal / 3000.0e0 END AS log_sfr,
    9.0e0 + c_acctbal / 9000.0e0 + (c_custkey * 37 % 1009) / 400.0e0 AS logmstar_cigale, c_custkey % 60 AS ape_cts_p2, (c_custkey * 7 % 50) / 10.0e0 AS ape_bkg_p2,
    CASE WHEN c_custkey % 43 = 0 THEN 0.0e0 ELSE 100.0e0 + c_custkey % 17 END AS ape_exp_p2 FROM {customer}
  UNION ALL SELECT 1000000 + s_suppkey AS source_id, 'test' AS split, CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE s_acctbal / 3000.0e0 END AS log_sfr,
    9.0e0 + s_acctbal / 9000.0e0 + (s_suppkey * 37 % 1009) / 400.0e0 AS logmstar_cigale, s_suppkey % 60 AS ape_cts_p2, (s_suppkey * 7 % 50) / 10.0e0 AS ape_bkg_p2,
    CASE WHEN s_suppkey % 43 = 0 THEN 0.0e0 ELSE 100.0e0 + s_suppkey % 17 END AS ape_exp_p2 FROM {supplier}""",
    "v_kde_train": "SELECT c_custkey AS id, c_acctbal / 3000.0e0 AS a, (c_custkey * 37 % 1009) / 400.0e0 + c_acctbal / 9000.0e0 AS b FROM {customer}",
    "v_kde_eval": "SELECT s_suppkey AS id, s_acctbal / 3000.0e0 AS a, (s_suppkey * 53 % 997) / 300.0e0 AS b FROM {supplier}",
    # arrays: cameras, spectra and images from the vectors
    "v_camera": (
        """
  SELECT CAST(floor(vec_id / 3.0e0) AS BIGINT) AS targetid,
    CASE WHEN vec_id % 2 = 0 THEN 'main' ELSE 'sv1' END AS survey, 'dark' AS program, CAST(vec_id % 7 AS INT) AS healpix,
    substring('brz', CAST(vec_id % 3 AS INT) + 1, 1) AS camera,
    transform(sequence(0, 63), i -> 3600.0e0 + 0.8e0 * (i + 56 * (vec_id % 3)) + 0.05e0) AS wave,
    transform(embedding, (x, i) -> CASE WHEN (i + vec_id) % 31 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(x AS DOUBLE) END) AS flux,
    transform(sequence(0, 63), i -> CAST((i + label) % 5 - (CASE WHEN i % 29 = 3 THEN 4 ELSE 0 END) AS DOUBLE)) AS ivar
  FROM {embeddings}""",
        """
  SELECT CAST(floor(vec_id / 3.0e0) AS BIGINT) AS targetid,
    CASE WHEN vec_id % 2 = 0 THEN 'main' ELSE 'sv1' END AS survey, 'dark' AS program, CAST(vec_id % 7 AS INT) AS healpix,
    substring('brz', CAST(vec_id % 3 AS INT) + 1, 1) AS camera,
    list_transform(range(0, 64), lambda i: 3600.0e0 + 0.8e0 * (i + 56 * (vec_id % 3)) + 0.05e0) AS wave,
    list_transform(embedding, lambda x, i: CASE WHEN (i - 1 + vec_id) % 31 = 0 THEN NULL ELSE CAST(x AS DOUBLE) END) AS flux,
    list_transform(range(0, 64), lambda i: CAST((i + label) % 5 - (CASE WHEN i % 29 = 3 THEN 4 ELSE 0 END) AS DOUBLE)) AS ivar
  FROM {embeddings}"""),
    "v_spectra": (
        f"""
  SELECT targetid, z, transform(sequence(0, 3099), i -> CAST(e[i % 64] * 0.3e0
      + 8.0e0 * exp(-0.5e0 * pow((3600.0e0 + 2.0e0 * i - held.c1) / 5.0e0, 2))
      + 5.0e0 * exp(-0.5e0 * pow((3600.0e0 + 2.0e0 * i - held.c2) / 7.0e0, 2)) AS DOUBLE)) AS flux,
    transform(sequence(0, 3099), i -> CASE WHEN (i + label * 40) % 1000 < 90 THEN 0.0e0 ELSE 9.0e0 + i % 4 END) AS ivar
  FROM {_held("""SELECT vec_id AS targetid, label, embedding AS e,
          CASE WHEN vec_id % 20 = 3 THEN -0.01e0 ELSE (vec_id % 130) / 100.0e0 + 0.05e0 END AS z FROM {embeddings}""", [("c1", "5008.24e0 * (1 + z)"), ("c2", "4862.683e0 * (1 + z)")])}""",
        """
  SELECT targetid, z, list_transform(range(0, 3100), lambda i: CAST(e[i % 64 + 1] AS DOUBLE) * 0.3e0
      + 8.0e0 * exp(-0.5e0 * pow((3600.0e0 + 2.0e0 * i - 5008.24e0 * (1 + z)) / 5.0e0, 2))
      + 5.0e0 * exp(-0.5e0 * pow((3600.0e0 + 2.0e0 * i - 4862.683e0 * (1 + z)) / 7.0e0, 2))) AS flux,
    list_transform(range(0, 3100), lambda i: CASE WHEN (i + label * 40) % 1000 < 90 THEN 0.0e0 ELSE 9.0e0 + i % 4 END) AS ivar
  FROM (SELECT vec_id AS targetid, label, embedding AS e,
          CASE WHEN vec_id % 20 = 3 THEN -0.01e0 ELSE (vec_id % 130) / 100.0e0 + 0.05e0 END AS z FROM {embeddings})"""),
    "v_planted": (
        f"SELECT targetid, kind, z, {_PLANTED_SPARK} AS flux, transform(sequence(0, 3099), i -> {_PLANTED_IVAR}) AS ivar FROM {_held(PLANTED_TRUTH[0], _PLANTED_HELD)}",
        f"SELECT targetid, kind, z, list_transform(range(0, 3100), lambda i: {_PLANTED_PIXEL}) AS flux, list_transform(range(0, 3100), lambda i: {_PLANTED_IVAR}) AS ivar FROM ({PLANTED_TRUTH[1]})"),
    "v_planted_truth": PLANTED_TRUTH,
    "v_images": (
        """
  SELECT vec_id AS targetid, CASE WHEN vec_id % 17 = 3 THEN 'GRI' WHEN vec_id % 2 = 0 THEN 'GRIZ' ELSE 'griz' END AS bands,
    CASE WHEN vec_id % 23 = 5 THEN slice(embedding, 1, 60)
         WHEN vec_id % 29 = 7 THEN transform(embedding, (x, i) -> CASE WHEN i = 9 THEN CAST('NaN' AS FLOAT) ELSE x END)
         WHEN vec_id % 31 = 11 THEN transform(embedding, x -> CAST(0 AS FLOAT)) ELSE embedding END AS image
  FROM {embeddings}""",
        """
  SELECT vec_id AS targetid, CASE WHEN vec_id % 17 = 3 THEN 'GRI' WHEN vec_id % 2 = 0 THEN 'GRIZ' ELSE 'griz' END AS bands,
    CASE WHEN vec_id % 23 = 5 THEN embedding[1:60]
         WHEN vec_id % 29 = 7 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 10 THEN CAST('NaN' AS FLOAT) ELSE x END)
         WHEN vec_id % 31 = 11 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS image
  FROM {embeddings}"""),
    # file listings
    "v_files": "SELECT concat('raw/', CAST(page_id AS VARCHAR(20)), '.fits') AS path, CAST(length(html) AS BIGINT) AS length, html FROM {pages}",
    "v_expected": """
  SELECT concat('raw/', CAST(page_id + (CASE WHEN page_id % 31 = 4 THEN 1000000 ELSE 0 END) AS VARCHAR(20)), '.fits') AS path,
    CAST(length(html) + (CASE WHEN page_id % 13 = 2 THEN 5 WHEN page_id % 17 = 6 THEN -5 ELSE 0 END) AS BIGINT) AS expected_bytes,
    CASE WHEN page_id % 11 = 3 THEN md5('x') ELSE md5(html) END AS md5
  FROM {pages}""",
}

_TABLE = re.compile(r"\{(\w+)\}")
_USED = re.compile(r"\bv_\w+\b")


def with_views(sql: str) -> str:
    """Checking SQL with the views it names put in front as common table expressions."""
    names: list[str] = []
    for name in _USED.findall(sql):
        if name in VIEWS and name not in names:
            names.append(name)
    parts = []
    for name in names:
        body = VIEWS[name]
        body = body if isinstance(body, str) else body[1]
        parts.append(f"{name} AS ({_TABLE.sub(lambda m: m.group(1), body)})")
    sql = sql.strip()
    if not parts:
        return sql
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql


class Views:
    """The given tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        body = VIEWS.get(f"v_{name}")
        if body is None:
            raise AttributeError(name)
        body = body if isinstance(body, str) else body[0]
        used = {t: self.table(t) for t in set(_TABLE.findall(body))}
        if name in ("spectra", "planted"):  # short vectors become long arrays: spread them first
            used = {t: spread(df, "vec_id") for t, df in used.items()}
        return self.spark.sql(body, **used)
