"""Numbers and tables from text lines: spectrum files, fixed-width resonance fields, kernel blocks, plot columns.

Lines are rows (file, lineno, line). Per-line rules are expressions; what depends on the order of
lines is a window within the file, and a file's length bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.functions import scalars as S

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _in_file():
    return W.partitionBy("file").orderBy("lineno")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, lineno, line of text files, each read whole to keep the order of its lines."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return files.select("file", F.posexplode("lines").alias("lineno", "line"))


def spectrum_values(lines: DataFrame) -> DataFrame:
    """file, i, value: the first token of each line. Blank lines and comments (#) are skipped and
    one header is allowed before the first value. status: ok, or what is wrong with the line."""
    body = lines.withColumn("t", F.trim("line")).where("t <> '' AND NOT startswith(t, '#')")
    token = F.try_element_at(F.filter(F.split("t", r"[,\t ]+"), lambda x: x != ""), F.lit(1))
    rows = body.withColumn("token", token).withColumn("value", F.when(F.col("token").rlike(NUMBER), F.col("token").cast("double")))
    order = F.row_number().over(_in_file())
    bad = F.col("token").rlike("(?i)^[+-]?(nan|inf|infinity)$")
    status = F.when(bad, "not finite").when(F.col("value").isNotNull(), "ok").when(order == 1, "header").otherwise("not a number")
    rows = rows.withColumn("status", status).where("status <> 'header'")
    return rows.select("file", (F.row_number().over(_in_file()) - 1).alias("i"), "value", "status")


def endf_fields(lines: DataFrame) -> DataFrame:
    """The six numbers of 11 characters of each fixed-width line, with mat, mf, mt from columns 67-75; only resonance lines (mf 2, mt 151)."""
    cut = lambda at, n: F.trim(F.substring("line", at, n))
    part = lambda c: F.when(c.rlike(r"^[0-9]+$"), c.cast("int"))
    rows = lines.select("file", "lineno", "line", part(cut(67, 4)).alias("mat"), part(cut(71, 2)).alias("mf"), part(cut(73, 3)).alias("mt"))
    rows = rows.where("mf = 2 AND mt = 151")
    return rows.select("file", "lineno", "mat", *[S.endf_float(F.substring("line", 1 + 11 * k, 11)).alias(f"c{k + 1}") for k in range(6)])


def kernel_blocks(lines: DataFrame) -> DataFrame:
    """ref_energy, k, offset, weight of tabulated kernels: after two heading lines, blocks parted by
    blank lines, the first line of each giving its energy."""
    rows = lines.where("lineno >= 2").withColumn("t", F.trim("line"))
    rows = rows.withColumn("blk", F.sum(F.when(F.col("t") == "", 1).otherwise(0)).over(_in_file())).where("t <> ''")
    cols = F.split("t", r"\s+")
    rows = rows.select("file", "blk", "lineno", cols[0].cast("double").alias("a"), cols[1].cast("double").alias("b"))
    own = W.partitionBy("file", "blk").orderBy("lineno")
    rows = rows.withColumn("ref_energy", F.first("a").over(own)).withColumn("k", F.row_number().over(own) - 2).where("k >= 0")
    return rows.select("file", "ref_energy", "k", F.col("a").alias("offset"), F.col("b").alias("weight"))


def plot_rows(lines: DataFrame) -> DataFrame:
    """energy_kev, data, uncertainty, theory_initial, theory_final (0 if absent) of white-space tables; lines that don't start with four numbers are headings."""
    cols = F.split(F.trim("line"), r"\s+")
    number = lambda k: F.when(F.try_element_at(cols, F.lit(k)).rlike(NUMBER), F.try_element_at(cols, F.lit(k)).cast("double"))
    names = ["energy_kev", "data", "uncertainty", "theory_initial"]
    rows = lines.select("file", "lineno", *[number(k + 1).alias(c) for k, c in enumerate(names)], F.coalesce(number(5), F.lit(0.0)).alias("theory_final"))
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in names))


def named_like(names: DataFrame, pattern: str, col: str = "name") -> DataFrame:
    """Frame files whose whole name matches a * and ? pattern in any case, numbered by name."""
    return names.where(F.col(col).rlike(S.glob_regex(pattern))).withColumn("frame", (F.row_number().over(W.orderBy(col)) - 1).cast("int"))


def parameter_cards(lines: DataFrame) -> DataFrame:
    """energy_ev, gamma_gamma_ev, gamma_n_ev, gamma_f1_ev, gamma_f2_ev, spin_group of fixed-width resonance cards: five fields of
    11 characters, widths in meV, the group in columns 66-67. The table ends at its first blank line; a negative group leaves its row out."""
    ended = F.max(F.when(F.trim("line") == "", 1).otherwise(0)).over(_in_file())
    rows = lines.withColumn("ended", ended).where("ended = 0")
    f = [S.endf_float(F.substring("line", 1 + 11 * k, 11)) for k in range(5)]
    group = F.trim(F.substring("line", 66, 2))
    rows = rows.select("file", "lineno", f[0].alias("energy_ev"), *[(f[k] / 1000.0).alias(n) for k, n in enumerate(("gamma_gamma_ev", "gamma_n_ev", "gamma_f1_ev", "gamma_f2_ev"), 1)], F.when(group.rlike("^-?[0-9]+$"), group.cast("int")).otherwise(1).alias("spin_group"))
    return rows.where("spin_group >= 0")


def radius_cards(lines: DataFrame) -> DataFrame:
    """file, spin_group, radius_fm from the cards that follow RADIUS up to a blank line or another heading: the effective radius
    in the first ten columns, spin groups in fields of two from column 25 on, up to the first 0. Of several the last card holds."""
    head = F.upper(F.trim("line"))
    rows = lines.withColumn("heads", F.sum(F.when(head.rlike("^[A-Z]") | (head == ""), 1).otherwise(0)).over(_in_file()))
    first = lines.where(head.startswith("RADIUS")).groupBy(F.col("file").alias("r_file")).agg(F.min("lineno").alias("r_line"))
    at = rows.join(first, (F.col("file") == F.col("r_file")) & (F.col("lineno") == F.col("r_line"))).select(F.col("file").alias("h_file"), F.col("heads").alias("h_heads"))
    body = rows.join(at, (F.col("file") == F.col("h_file")) & (F.col("heads") == F.col("h_heads"))).where(~head.startswith("RADIUS"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest((F.length("line") - 24) / 2 - 1, F.lit(0)).cast("int")), lambda k: F.trim(F.substr(F.col("line"), 25 + 2 * k, F.lit(2))))
    numbers = F.transform(F.filter(cut, lambda x: x.rlike("^-?[0-9]+$")), lambda x: x.cast("int"))
    zero = F.array_position(numbers, 0)
    groups = F.filter(F.when(zero > 0, F.slice(numbers, F.lit(1), (zero - 1).cast("int"))).otherwise(numbers), lambda n: n > 0)
    radius = F.trim(F.substring("line", 1, 10))
    body = body.where(radius.rlike(NUMBER)).select("file", "lineno", radius.cast("double").alias("radius_fm"), F.explode(groups).alias("spin_group")).where("radius_fm > 0")
    return body.groupBy("file", "spin_group").agg(F.max_by("radius_fm", "lineno").alias("radius_fm"))
