"""Elements, isotopes and groups of isotopes as dimension tables and lookups.

Abundances and evaluation lists are parameters: tables (z, a, fraction) and (z, a, mat) that the
caller loads. The element table is the only one kept here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Symbols by atomic number, 0 (the neutron) to 118.
SYMBOLS = (
    "n H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
# Names in the same order.
NAMES = (
    "neutron Hydrogen Helium Lithium Beryllium Boron Carbon Nitrogen Oxygen Fluorine Neon Sodium Magnesium Aluminum Silicon Phosphorus Sulfur Chlorine Argon Potassium Calcium Scandium Titanium Vanadium Chromium Manganese Iron Cobalt Nickel Copper Zinc Gallium Germanium Arsenic Selenium Bromine Krypton Rubidium Strontium Yttrium Zirconium Niobium Molybdenum Technetium Ruthenium Rhodium Palladium Silver Cadmium Indium Tin Antimony Tellurium Iodine Xenon Cesium Barium Lanthanum Cerium Praseodymium Neodymium Promethium Samarium Europium Gadolinium Terbium Dysprosium Holmium Erbium Thulium Ytterbium Lutetium Hafnium Tantalum Tungsten Rhenium Osmium Iridium Platinum Gold Mercury Thallium Lead Bismuth Polonium Astatine Radon Francium Radium Actinium Thorium Protactinium Uranium Neptunium Plutonium Americium Curium Berkelium Californium Einsteinium Fermium Mendelevium Nobelium Lawrencium Rutherfordium Dubnium Seaborgium Bohrium Hassium Meitnerium Darmstadtium Roentgenium Copernicium Nihonium Flerovium Moscovium Livermorium Tennessine Oganesson"
).split()


def elements(spark: SparkSession) -> DataFrame:
    """z, symbol, name: 119 rows."""
    return spark.createDataFrame([(z, s, n) for z, (s, n) in enumerate(zip(SYMBOLS, NAMES, strict=True))], "z int, symbol string, name string")


def symbol_to_z(symbol: Column) -> Column:
    """Atomic number in any case, but 'n' alone is the neutron ('N' is nitrogen); null if unknown."""
    at = F.array_position(F.array(*[F.lit(s.lower()) for s in SYMBOLS[1:]]), F.lower(symbol))
    return F.when(symbol == "n", F.lit(0)).when(at > 0, at.cast("int"))


def z_to_symbol(z: Column) -> Column:
    return F.when(z.between(0, 118), F.try_element_at(F.array(*map(F.lit, SYMBOLS)), (z + 1).cast("int")))


def valid_isotope(z: Column, a: Column) -> Column:
    return (a > 0) & (z <= a)


def parse_isotope(text: Column) -> Column:
    """struct(z, a) of 'U-238'; null unless it is two parts, a known symbol and a valid mass number."""
    parts = F.split(text, "-")
    a = F.when(F.trim(F.try_element_at(parts, F.lit(2))).rlike(r"^\+?[0-9]{1,9}$"), F.trim(F.try_element_at(parts, F.lit(2))).cast("int"))
    z = symbol_to_z(F.trim(F.try_element_at(parts, F.lit(1))))
    return F.when((F.size(parts) == 2) & z.isNotNull() & a.isNotNull() & valid_isotope(z, a), F.struct(z.alias("z"), a.alias("a")))


def isotope_name(z: Column, a: Column) -> Column:
    s = z_to_symbol(z)
    return F.when(s.isNotNull(), F.concat_ws("-", s, a.cast("string"))).otherwise(F.concat(F.lit("Z"), z.cast("string"), F.lit("-"), a.cast("string")))


def za(z: Column, a: Column) -> Column:
    return z * 1000 + a


def from_za(code: Column) -> Column:
    """struct(z, a); null for mass number 0."""
    z, a = F.floor(code / 1000).cast("int"), (code % 1000).cast("int")
    return F.when(a > 0, F.struct(z.alias("z"), a.alias("a")))


def evaluations(abundances: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """z, a, mat by the numbering rule of evaluated files: 100 z + 25 + 3 (a - the lightest natural a).
    extra: (z, a, mat) of materials outside the rule; they win."""
    base = abundances.withColumn("light", F.min("a").over(W.partitionBy("z")))
    rule = base.select("z", "a", (F.col("z") * 100 + 25 + 3 * (F.col("a") - F.col("light"))).cast("int").alias("mat"))
    return rule if extra is None else rule.join(extra, ["z", "a"], "left_anti").unionByName(extra.select("z", "a", "mat"))


def with_lookup(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Left join on (z, a) with a dimension of isotopes (a few thousand rows at most; the planner broadcasts it by its size)."""
    return rows.join(dim, ["z", "a"], "left")


def natural_group(abundances: DataFrame) -> DataFrame:
    """grp, z, a, ratio of every element's natural mixture, ratios made to sum to 1."""
    total = F.sum("fraction").over(W.partitionBy("z"))
    return abundances.select(F.concat(z_to_symbol(F.col("z")), F.lit(" (nat)")).alias("grp"), "z", "a", (F.col("fraction") / total).alias("ratio"))


def subset_group(abundances: DataFrame, z: int, masses: list[int]) -> DataFrame:
    """The named isotopes of an element, ratios among them."""
    rows = abundances.where((F.col("z") == z) & F.col("a").isin(masses))
    name = f"{SYMBOLS[z]}-" + "/".join(map(str, sorted(masses)))
    return rows.select(F.lit(name).alias("grp"), "z", "a", (F.col("fraction") / F.sum("fraction").over(W.partitionBy("z"))).alias("ratio"))


def check_custom(members: DataFrame) -> DataFrame:
    """grp, total, verdict of given ratios: 'reject' beyond 1e-3 of 1, 'renormalise' beyond 1e-6, else 'accept'."""
    t = members.groupBy("grp").agg(F.sum("ratio").alias("total"))
    off = F.abs(F.col("total") - 1.0)
    return t.withColumn("verdict", F.when(off > 1e-3, "reject").when(off > 1e-6, "renormalise").otherwise("accept"))
