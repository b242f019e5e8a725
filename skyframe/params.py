"""Parameters of the jobs, as plain dataclasses, and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Numbers, names and column lists the published results are defined by.

RELEASE_SHIFT = 42
RELEASE_MASK = 65535
MAIN_RELEASES = (9010, 9011, 9012)
EXCLUDED_CLASSES = ("STAR",)

DETECTION_RENAMES = {
    "DETUID": "ero_detuid",
    "RA": "xray_ra",
    "DEC": "xray_dec",
    "LS10_RA": "ls10_ra",
    "LS10_DEC": "ls10_dec",
    "NWAY_p_any": "nway_p_any",
    "NWAY_p_i": "nway_p_i",
    "NWAY_match_flag": "nway_match_flag",
    "NWAY_threshold6": "nway_threshold6",
    "NWAY_dist_post": "nway_dist_post",
    "LS10_flux_w1": "ls10_flux_w1",
    "LS10_flux_w2": "ls10_flux_w2",
    "LS10_flux_w3": "ls10_flux_w3",
    "LS10_flux_ivar_w1": "ls10_flux_ivar_w1",
    "LS10_flux_ivar_w2": "ls10_flux_ivar_w2",
    "LS10_flux_ivar_w3": "ls10_flux_ivar_w3",
}
TARGET_RENAMES = {
    "TARGETID": "targetid",
    "TARGET_RA": "target_ra",
    "TARGET_DEC": "target_dec",
    "SURVEY": "survey",
    "PROGRAM": "program",
    "HEALPIX": "healpix",
    "SPECTYPE": "spectype",
    "Z": "z",
    "ZWARN": "zwarn",
    "ZCAT_PRIMARY": "zcat_primary",
}
DETECTION_COLUMNS = tuple(DETECTION_RENAMES.values())
TARGET_COLUMNS = tuple(c for c in TARGET_RENAMES.values() if c not in ("targetid", "zcat_primary"))
MATCHED_COLUMNS = (
    ("targetid",)
    + tuple(c for c in DETECTION_COLUMNS if c != "nway_match_flag")
    + TARGET_COLUMNS
    + ("sep_arcsec", "split_source")
)

XRAY_BANDS = ("1", "p2", "p3")
WISE_BANDS = ("w1", "w2", "w3")
FIT_SENTINEL = -90.0
FIT_VALUE_COLUMNS = ("logm", "logm_err", "logsfr", "logsfr_err", "flag_masspdf", "flag_sfrpdf")
COUNTED_LABELS = ("log_flux_1", "log_lx", "log_flux_p2", "log_flux_p3", "log_sfr", "logmstar_cigale")

PRESENCE_FLAGS = ("has_spectrum", "has_z", "has_wise", "has_image")
SPLITS = ("train", "val", "test")
MANIFEST_COLUMNS = (
    "targetid", "ero_detuid", "in_sample", "split", "has_spectrum", "has_z", "has_wise", "has_image",
    "spectype", "z", "zwarn", "target_ra", "target_dec", "ls10_flux_w1", "ls10_flux_w2", "ls10_flux_w3",
    "survey", "program", "healpix", "split_source",
)
IMAGE_BANDS = "griz"

MODALITIES = ("Z", "S", "I", "W")
COVERAGE_LEVELS = (0.68, 0.90, 0.95)
NEARBY_REDSHIFT = 0.7
ROLLING_WINDOW = 0.08
BOOTSTRAP_REPLICATES = 1000
RHO_BIN = 0.005

QUADRATURE_NODES = 12
QUADRATURE_SPAN = 5.0
NET_COUNT_FLOOR = 0.5
COUNT_FLOOR = 1.0
MASS_NODES = 256
MASS_SPAN = 8.0

LIGHT_KMS = 299792.458
LINE_MIN_PIXELS = 60
LINE_MIN_COVER = 0.80
LINE_EDGE = 0.22
LINE_START_WIDTHS = (120.0, 300.0, 700.0)
LINE_MAX_STEPS = 3000
LINE_MIN_WIDTH = 25.0


@dataclass(frozen=True)
class LineComplex:
    """One emission-line complex: rest window, kinematic bounds, and its species.

    A species is a list of (rest wavelength, amplitude ratio) sharing one amplitude; the first
    species holds the primary line.
    """

    name: str
    stem: str
    window: tuple[float, float]
    primary: float
    max_velocity: float
    max_width: float
    species: tuple[tuple[tuple[float, float], ...], ...]


LINE_COMPLEXES = (
    LineComplex("oiii", "oiii_5007", (4920.0, 5080.0), 5008.240, 1500.0, 1500.0,
                (((5008.240, 1.0), (4960.295, 0.335)),)),
    LineComplex("nev", "nev_3426", (3360.0, 3500.0), 3426.85, 1500.0, 2000.0,
                (((3426.85, 1.0),),)),
    LineComplex("halpha", "halpha", (6480.0, 6650.0), 6564.614, 1500.0, 3000.0,
                (((6564.614, 1.0),), ((6549.86, 1.0), (6585.27, 2.96)))),
    LineComplex("hbeta", "hbeta", (4770.0, 4940.0), 4862.683, 1500.0, 3000.0,
                (((4862.683, 1.0),),)),
)

# X-ray emission expected from star formation: (band keV) -> log alpha, gamma, log beta, delta
# (Lehmer et al. 2016, Table 3), and the rate per unit star formation of Mineo et al. (2014).
SOFT_BAND = (0.2, 2.3)
LEHMER_2016 = {
    (0.5, 2.0): (29.04, 3.78, 39.38, 0.99),
    (2.0, 10.0): (29.37, 2.03, 39.28, 1.31),
}
MINEO_2014 = 4.0e39
MINEO_BAND = (0.5, 8.0)
SALPETER_FACTOR = 0.63
SF_MARGIN = 10.0

# Planck 2018 cosmology (Planck Collaboration VI, Table 2, last column).
PLANCK18_H0 = 67.66
PLANCK18_OMEGA_M = 0.30966
PLANCK18_TCMB = 2.7255
PLANCK18_NEFF = 3.046
PLANCK18_NU_EV = 0.06


@dataclass(frozen=True)
class CrossmatchParams:
    radius_arcsec: float = 1.0
    main_releases: tuple[int, ...] = MAIN_RELEASES
    uncalibrated_min: float = 0.05
    split_max_sep_arcsec: float = 15.0
    cell_per_radius: float = 4.0


@dataclass(frozen=True)
class LabelParams:
    cap_dex: float = 1.5
    det_like_min: float = 6.0
    z_floor: float = 0.001
    flag_window: tuple[float, float] = (0.2, 5.0)
    max_sigma_dex: float = 3.0


@dataclass(frozen=True)
class Grid:
    """A uniform wavelength grid: bin i sits at lam0 + dlam * i."""

    lam0: float = 3600.0
    dlam: float = 0.8
    nbin: int = 7781

    @property
    def last(self) -> float:
        return self.lam0 + self.dlam * (self.nbin - 1)


@dataclass(frozen=True)
class SplitParams:
    seed: int = 42
    fractions: tuple[float, ...] = (0.8, 0.1, 0.1)
    names: tuple[str, ...] = SPLITS


@dataclass(frozen=True)
class Target:
    """A predicted quantity: a scalar label column, or the (counts, background, exposure) of a rate."""

    name: str
    columns: tuple[str, ...]

    @property
    def is_rate(self) -> bool:
        return len(self.columns) == 3


TARGETS = {
    t.name: t
    for t in (
        Target("flux", ("log_flux_1",)),
        Target("lx", ("log_lx",)),
        Target("sfr", ("log_sfr",)),
        Target("mstar", ("logmstar_cigale",)),
        Target("rate_p2", ("ape_cts_p2", "ape_bkg_p2", "ape_exp_p2")),
        Target("rate_p3", ("ape_cts_p3", "ape_bkg_p3", "ape_exp_p3")),
    )
}


@dataclass(frozen=True)
class Head:
    """One scored density over one or more targets."""

    name: str
    targets: tuple[str, ...]

    def scalars(self) -> list[str]:
        return [t for t in self.targets if not TARGETS[t].is_rate]

    def rates(self) -> list[str]:
        return [t for t in self.targets if TARGETS[t].is_rate]


@dataclass(frozen=True)
class ScoreParams:
    heads: tuple[Head, ...] = field(default_factory=lambda: (
        Head("flux", ("flux",)),
        Head("lx", ("lx",)),
        Head("sfr", ("sfr",)),
        Head("mstar", ("mstar",)),
        Head("sfr_mstar", ("sfr", "mstar")),
    ))
    nodes: int = QUADRATURE_NODES
    span: float = QUADRATURE_SPAN
    bandwidth: float = 1.0
