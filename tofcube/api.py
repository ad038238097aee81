"""The public surface under the names that users of imaging libraries know; each is one operator.

Tables in, tables out: energies, spectra, cubes and maps are DataFrames, so calls compose into one
plan and nothing runs until a result is written or read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.functions import scalars
from tofcube.operators import axes, broaden, calibrate, cube, decks, extras, grids, isotopes, limited, models, multifit, spatial, texts
from tofcube.sources import resonance, tiff

# -- sources -----------------------------------------------------------------------------

load_tiff_stack = tiff.load_tiff_stack
load_tiff_folder = tiff.load_tiff_folder
load_tiff_auto = tiff.load_tiff


def load_endf_file(spark: SparkSession, path: str) -> DataFrame:
    """The flat resonance table of one file or of a folder of files."""
    return resonance.resonance_table(texts.read_lines(spark, path))


def load_unresolved(spark: SparkSession, path: str) -> DataFrame:
    """The averages of unresolved ranges of one file or of a folder of files."""
    return resonance.unresolved_table(texts.read_lines(spark, path))


def load_limited(spark: SparkSession, path: str) -> DataFrame:
    """The spin groups of R-matrix limited ranges of one file or of a folder of files."""
    return resonance.limited_groups(texts.read_lines(spark, path))


def load_deck(spark: SparkSession, deck: str, cards: str) -> tuple[DataFrame, DataFrame]:
    """The spin groups of control decks and their resonances as the formulas take them: files or folders of both, matched by name without ending."""
    name = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    lines = lambda path: texts.read_lines(spark, path).withColumn("file", name)
    groups = decks.decks(lines(deck))
    return groups, decks.deck_resonances(groups, texts.parameter_cards(lines(cards)), texts.radius_cards(lines(cards)))


def create_resonance_data(spark: SparkSession, z: int, a: int, awr: float, radius_fm: float, rows: list[tuple[float, float, float, float]], l: int = 0) -> DataFrame:  # noqa: E741
    """Resonances (er, j, gn, gg) of one isotope as the formulas take them; no fission widths."""
    if not rows:
        raise ValueError("a resonance is needed")
    df = spark.createDataFrame(rows, "er double, j double, gn double, gg double")
    return df.select(F.lit(str(1000 * z + a)).alias("za"), F.lit(awr).alias("awr"), F.lit(radius_fm).alias("radius"), F.lit(l).alias("l"), "j", "er", "gn", "gg", F.lit(0.0).alias("gf"))


def load_resolution(spark: SparkSession, path: str) -> DataFrame:
    """ref_energy, k, offset, weight of a tabulated kernel file."""
    return texts.kernel_blocks(texts.read_lines(spark, path)).drop("file")


def load_nexus_events(events: DataFrame, binning: cube.Binning) -> tuple[DataFrame, DataFrame]:
    """Counts per cell, zeros included, and the retention row, of an event table (tof, x, y)."""
    return cube.dense(cube.histogram(events, binning), binning), cube.retention(events, binning)


def load_nexus_histogram(counts: DataFrame, mode: str = "error", angle: int = 0) -> DataFrame:
    """A cube from (rot, tof_bin, y, x, value): 'sum' over rotation angles, 'select' one, or 'error' if there are several."""
    if mode == "sum":
        return cube.sum_over_angle(counts)
    if mode == "select":
        return counts.where(F.col("rot") == angle).drop("rot")
    if mode != "error":
        raise ValueError("mode is 'error', 'sum' or 'select'")
    if counts.select("rot").distinct().limit(2).count() > 1:
        raise ValueError("several rotation angles: choose 'sum' or 'select'")
    return counts.drop("rot")


# -- processing ----------------------------------------------------------------------------

normalize = cube.normalize
detect_dead_pixels = cube.dead_pixels
tof_to_energy = scalars.tof_to_energy
energy_to_tof = scalars.energy_to_tof
beer_lambert = scalars.beer_lambert


def tof_to_energy_centers(edges: DataFrame, flight_m: float, delay_us: float = 0.0) -> DataFrame:
    return axes.centers(axes.edges_to_energy(edges, flight_m, delay_us))


# -- nuclear data ----------------------------------------------------------------------------

element_symbol = isotopes.z_to_symbol
parse_isotope_str = isotopes.parse_isotope
IsotopeGroup = isotopes


def natural_isotopes(abundances: DataFrame, z: int) -> DataFrame:
    return abundances.where(F.col("z") == z).select("a", "fraction")


# -- models ----------------------------------------------------------------------------------

FORMALISMS = {"slbw": models.slbw, "mlbw": models.mlbw, "reich_moore": models.reich_moore}


def cross_sections(energies: DataFrame, resonances: DataFrame, spin: float = 0.0, formalism: str = "reich_moore") -> DataFrame:
    """spin holds for resonances without a column of their own; ranges are those of their columns e_low and e_high."""
    return FORMALISMS[formalism](energies, resonances, spin)


unresolved_cross_sections = models.unresolved
limited_cross_sections = limited.limited
doppler_broaden = broaden.doppler
doppler_broaden_with_derivative = broaden.doppler_with_derivative
forward_model = broaden.forward


def resolution_broaden(curves: DataFrame, by: list[str], flight_m: float, dt_us: float | None = None, dl_m: float | None = None, kernels: DataFrame | None = None) -> DataFrame:
    """Gaussian widths, both or none, or tabulated kernels; never both."""
    if (dt_us is None) != (dl_m is None) or (dt_us is not None) == (kernels is not None):
        raise ValueError("give both widths, or kernels")
    return extras.tabulated_resolution(curves, kernels, flight_m, by) if kernels is not None else broaden.gaussian_resolution(curves, flight_m, dt_us, dl_m, by)


apply_resolution = models.apply_matrix
broadened_cross_sections_for_transmission = broaden.effective_sigma
extended_grid = grids.extended_grid
trace_detectability_survey = models.detectability
calibrate_energy = calibrate.calibrate_energy

# -- fits ------------------------------------------------------------------------------------

from_counts = spatial.from_counts
from_counts_with_nuisance = spatial.from_counts_with_nuisance
from_transmission = spatial.from_transmission
spatial_map_typed = spatial.fit_cube
spatial_map_groups = spatial.fit_groups
compute_model_jacobian = multifit.evaluate
fit_pixels = multifit.fit_pixels
evaluate_jacobian_and_fisher = multifit.jacobian_and_fisher


def fit_spectrum_typed(data: spatial.InputData, sigma: DataFrame, config: spatial.FitConfig = spatial.FitConfig()) -> DataFrame:
    """One row for a single spectrum: a cube of one pixel."""
    return spatial.fit_cube(data, sigma, config)
