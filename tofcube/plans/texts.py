"""Text sources: literal files, and tokens of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.functions import scalars as S
from tofcube.operators import texts as T

FLOATS = ["1.234567+2", " 9.223800+4", "2.360060+2 ", "-1.5-3", "1.0E+5", "1.5D-02", "", "    ", "12", "+7.", ".5+1", "1.5d", "abc", "1.2.3"]
SPECTRUM = ["# comment", "", "energy,counts", "1000.0,0.5", "2000.0\t0.6", " 3000 ", "nan,1", "x", "4e3,1"]
KERNEL = ["FTS kernel", "-----", "5.0 0.0", "-1.0 0.25", "0.0 0.5", "1.0 0.25", "", "10.0 0.0", "-2.0 0.1", "0.0 0.8", "2.0 0.1"]
PLOT = ["E data err th0 th1", "1.0 0.5 0.01 0.49 0.495", "2.0 0.6 0.01 0.61", "bad row", "3 .7 1e-2 .69 .7 9"]
CARDS = [f"{t:<65}{g}" for t, g in ((" 6.674280+0   22.71100    1.49230    0.00000    0.00000 0 0 0 0 0", " 1"), ("    -10.000     23.000      1.000      0.500          -", "-2"), ("1.00000D+02     25.000        2.0", " 2"))] + ["", "      5.000      1.000"]
NAMES = ["a_001.tif", "A_002.TIF", "b_001.tiff", "a_10.tif", "ab.tif", "a_x.tif.bak"]


def lines(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([("f", k, v) for k, v in enumerate(rows)], "file string, lineno int, line string")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in conversations: each turn a line of a file per conversation."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("lineno"), F.concat(F.length("text").cast("string"), F.lit(","), F.col("text")).alias("line"))


def _values(rows: list[str]) -> str:
    return ", ".join(f"({k}, '{v.replace(chr(9), chr(32))}')" for k, v in enumerate(rows))


_NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_EF = "regexp_replace(regexp_replace(replace(line, ' ', ''), '[dD]', 'E', 'g'), '([0-9.])([+-][0-9]+)$', '\\1E\\2')"
_SPECTRUM_SQL = rf"""b AS (SELECT file, lineno, trim(line) AS t FROM src WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
k AS (SELECT file, lineno, list_filter(regexp_split_to_array(t, '[, ]+'), lambda x: x <> '')[1] AS token, row_number() OVER (PARTITION BY file ORDER BY lineno) AS n FROM b),
s AS (SELECT *, CASE WHEN regexp_matches(token, '(?i)^[+-]?(nan|inf|infinity)$') THEN 'not finite' WHEN regexp_matches(token, '{_NUM}') THEN 'ok' WHEN n = 1 THEN 'header' ELSE 'not a number' END AS status FROM k)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY lineno) - 1 AS i, CASE WHEN status = 'ok' THEN token::DOUBLE END AS value, status FROM s WHERE status <> 'header'"""

QUERIES = {
    "endf_float_parse": lambda s, d: lines(s, FLOATS).select("lineno", S.endf_float(F.col("line")).alias("value")),
    "spectrum_text_parse": lambda s, d: T.spectrum_values(lines(s, SPECTRUM)),
    "spectrum_turns_parse": lambda s, d: T.spectrum_values(turns(s, d)),
    "kernel_blocks": lambda s, d: T.kernel_blocks(lines(s, KERNEL)),
    "plot_rows": lambda s, d: T.plot_rows(lines(s, PLOT)),
    "parameter_cards": lambda s, d: T.parameter_cards(lines(s, CARDS)).select("lineno", "energy_ev", *[F.round(c, 9).alias(c) for c in ("gamma_gamma_ev", "gamma_n_ev")], "spin_group"),
    "frame_names": lambda s, d: T.named_like(s.createDataFrame([(x,) for x in NAMES], "name string"), "a_*.tif"),
}
ORACLES = {
    "endf_float_parse": f"SELECT lineno::INT AS lineno, CASE WHEN v = '' THEN 0 WHEN regexp_matches(v, '{_NUM}') THEN v::DOUBLE END AS value FROM (SELECT lineno, {_EF} AS v FROM (VALUES {_values(FLOATS)}) t(lineno, line))",
    "spectrum_text_parse": f"WITH src AS (SELECT 'f' AS file, lineno, line FROM (VALUES {_values(SPECTRUM)}) t(lineno, line)), {_SPECTRUM_SQL}",
    "spectrum_turns_parse": f"WITH src AS (SELECT conv_id::VARCHAR AS file, turn AS lineno, length(text) || ',' || text AS line FROM conversations), {_SPECTRUM_SQL}",
    "kernel_blocks": f"""WITH l AS (SELECT lineno, trim(line) AS t FROM (VALUES {_values(KERNEL)}) t(lineno, line) WHERE lineno >= 2),
b AS (SELECT lineno, t, sum((t = '')::INT) OVER (ORDER BY lineno) AS blk FROM l), c AS (SELECT lineno, blk, split_part(t, ' ', 1)::DOUBLE AS a, split_part(t, ' ', 2)::DOUBLE AS w FROM b WHERE t <> '')
SELECT 'f' AS file, ref_energy, k::INT AS k, a AS "offset", w AS weight FROM (SELECT *, first_value(a) OVER (PARTITION BY blk ORDER BY lineno) AS ref_energy, row_number() OVER (PARTITION BY blk ORDER BY lineno) - 2 AS k FROM c) WHERE k >= 0""",
    "plot_rows": f"""WITH l AS (SELECT lineno, regexp_split_to_array(trim(line), '\\s+') AS c FROM (VALUES {_values(PLOT)}) t(lineno, line)), n AS (SELECT lineno, list_transform(c, lambda x: CASE WHEN regexp_matches(x, '{_NUM}') THEN x::DOUBLE END) AS c FROM l)
SELECT 'f' AS file, lineno::INT AS lineno, c[1] AS energy_kev, c[2] AS data, c[3] AS uncertainty, c[4] AS theory_initial, coalesce(c[5], 0) AS theory_final FROM n WHERE c[1] IS NOT NULL AND c[2] IS NOT NULL AND c[3] IS NOT NULL AND c[4] IS NOT NULL""",
    "parameter_cards": f"WITH c AS (SELECT lineno, regexp_replace(regexp_replace(replace(substr(line, 1, 11), ' ', ''), '[dD]', 'E', 'g'), '([0-9.])([+-][0-9]+)$', '\\1E\\2') AS e, trim(substr(line, 12, 11))::DOUBLE AS g, trim(substr(line, 23, 11))::DOUBLE AS n, trim(substr(line, 66, 2)) AS s FROM (VALUES {_values(CARDS[:3])}) t(lineno, line)) SELECT lineno::INT AS lineno, e::DOUBLE AS energy_ev, round(g / 1000, 9) AS gamma_gamma_ev, round(n / 1000, 9) AS gamma_n_ev, s::INT AS spin_group FROM c WHERE s::INT >= 0",
    "frame_names": "SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS frame FROM (VALUES ('a_001.tif'), ('A_002.TIF'), ('b_001.tiff'), ('a_10.tif'), ('ab.tif'), ('a_x.tif.bak')) t(name) WHERE regexp_full_match(name, '(?i)a_.*\\.tif')",
}
