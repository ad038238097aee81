"""Record-level operators: counts and order of resonances, spin groups by isotope, libraries, sample layers,
readers of axes and masks in table form, and the guards of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Libraries whose material numbers are tables of their own; the others share one. Fixed values.
OWN_TABLES = ("TENDL-2023", "CENDL-3.2")


def resonance_counts(res: DataFrame, by: list[str]) -> DataFrame:
    """by, resonances: how many rows with an energy."""
    return res.groupBy(*by).agg(F.count("er").alias("resonances"))


def by_energy(res: DataFrame, by: list[str]) -> DataFrame:
    """Resonances numbered in the order of energy within by; ties by width."""
    return res.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("er", "gn")) - 1)


def evaluable(ranges: DataFrame) -> DataFrame:
    """Ranges that can be evaluated: resolved ones of a known formalism (1, 2, 3, 7) and unresolved ones (1, 2)."""
    return ranges.where(((F.col("lru") == 1) & F.col("lrf").isin(1, 2, 3, 7)) | ((F.col("lru") == 2) & F.col("lrf").isin(1, 2)))


def spin_groups_by_j(groups: DataFrame, by: list[str]) -> DataFrame:
    """by, j, n: spin groups whose j agree to 1e-8 are one."""
    return groups.groupBy(*by, F.round(F.abs("j"), 8).alias("j")).agg(F.count("*").alias("n"))


def isotope_parts(groups: DataFrame) -> DataFrame:
    """Spin groups (case, number, label, abundance, spin) with part, the isotope that each belongs to: the label in upper
    case ('UNKNOWN' without) if the case has any, else abundance and target spin. conflict: a part's groups disagree on either."""
    labelled = F.max(F.col("label").isNotNull()).over(W.partitionBy("case"))
    key = F.when(labelled, F.upper(F.coalesce("label", F.lit("unknown")))).otherwise(F.concat(F.format_string("%.6f", F.col("abundance")), F.lit("_"), F.format_string("%.1f", F.col("spin"))))
    rows = groups.withColumn("part", key)
    w = W.partitionBy("case", "part")
    spread = lambda c: F.max(c).over(w) - F.min(c).over(w) >= 1e-12
    return rows.withColumn("conflict", spread("abundance") | spread("spin"))


def library_lookup(rows: DataFrame, shared: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (library, z, a) with mat: from own (library, z, a, mat) for the libraries with tables of their own, else from shared (z, a, mat).
    Null where there is no evaluation. Both are dimensions, joined by equality."""
    base = rows.where(~F.col("library").isin(*OWN_TABLES)).join(shared.select("z", "a", "mat"), ["z", "a"], "left")
    other = rows.where(F.col("library").isin(*OWN_TABLES)).join(own.select("library", "z", "a", "mat"), ["library", "z", "a"], "left")
    return base.select("library", "z", "a", "mat").unionByName(other.select("library", "z", "a", "mat"))


def layer_faults(layers: DataFrame) -> DataFrame:
    """Layers (layer, density, temperature) that can't be, with what is wrong. Densities and temperatures must be finite and not negative."""
    fine = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) >= 0)
    fault = F.when(~fine("density"), "density").when(~fine("temperature"), "temperature")
    return layers.withColumn("fault", fault).where("fault IS NOT NULL")


def within_box(densities: Column, box: Column) -> Column:
    """Whether trained surrogates hold: with several densities each is within 0 and 1.5 of its box, with one within the box; finite, equally many."""
    slack = F.when(F.size(box) > 1, 1.5).otherwise(1.0)
    each = F.zip_with(densities, box, lambda n, b: F.coalesce(~F.isnan(n) & (n >= 0) & (n <= b * slack), F.lit(False)))
    return (F.size(densities) == F.size(box)) & F.forall(each, lambda x: x)


def tof_axis(raw: DataFrame) -> DataFrame:
    """i, value in microseconds of a raw axis (i, ns)."""
    return raw.select("i", (F.col("ns") / 1000.0).alias("value"))


def attribute(group: Column, entry: Column) -> Column:
    """An attribute of the group, else of the entry."""
    return F.coalesce(group, entry)


def dead_mask(mask: DataFrame) -> DataFrame:
    """y, x of the pixels whose mask byte isn't 0."""
    return mask.where(F.col("mask") != 0).select("y", "x")


def override(value: Column, base: Column) -> Column:
    """A card's own width if it isn't 0, else the base."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), base)


def region_law(interval: Column, nbt: Column, law: Column) -> Column:
    """The interpolation law of an interval (from 0) from arrays of region ends (NBT, counted from 1) and laws: that of the first region
    that holds the interval's right point, else the last, else 2."""
    ends = F.filter(F.arrays_zip(nbt.alias("nbt"), law.alias("law")), lambda r: interval + 2 <= r["nbt"])
    return F.when(F.size(ends) > 0, F.try_element_at(ends, F.lit(1))["law"]).otherwise(F.coalesce(F.try_element_at(law, F.lit(-1)), F.lit(2)))


def fingerprint(axis: DataFrame, by: list[str]) -> DataFrame:
    """by, fingerprint: one hash of the values' bits in the order of i: equal axes agree."""
    held = axis.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("v"))
    return held.select(*by, F.xxhash64(F.col("v.value")).alias("fingerprint"))
