"""Sinks and project folders: result maps, a Markdown report, and a session as a folder of tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.sources.tiff import tiff_bytes

VERSION = "1.0"


def write_maps(maps: DataFrame, path: str) -> None:
    """Maps (metric, label, y, x, value) as Parquet folders by metric and label; readers prune by either."""
    maps.repartition("metric", "label").write.mode("overwrite").partitionBy("metric", "label").parquet(path)


def map_tiff(values: DataFrame, height: int, width: int) -> DataFrame:
    """metric, label, tiff: each map (metric, label, y, x, value) as a single-page float32 TIFF, NaN where no value is. A map's pixels bound a row's work."""
    import numpy as np

    def encode(t: pa.Table) -> pa.Table:
        frame = np.full((height, width), np.nan)
        frame[t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column("value").to_numpy()
        return pa.table({"metric": [t.column("metric")[0].as_py()], "label": [t.column("label")[0].as_py()], "tiff": pa.array([tiff_bytes(frame)], pa.binary())})

    return values.groupBy("metric", "label").applyInArrow(encode, "metric string, label string, tiff binary")


def escape_cell(c):
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def report_rows(fits: DataFrame) -> DataFrame:
    """label, mean and std as text from rows (label, density, converged); N/A without a converged finite value."""
    v = F.when(F.col("converged") & ~F.isnan("density"), F.col("density"))
    text = lambda c: F.coalesce(F.format_string("%.6e", c), F.lit("N/A"))
    out = fits.groupBy("label").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.count_if("converged").alias("n_converged"), F.count("*").alias("n_total"))
    pick = lambda c: F.when(F.col(c).isNotNull(), text(F.col(c))).otherwise("N/A")
    return out.select(escape_cell(F.col("label")).alias("label"), pick("m").alias("mean"), pick("s").alias("std"), "n_converged", "n_total")


def markdown_report(fits: DataFrame, title: str, provenance: list[tuple[str, str, str]] = ()) -> str:
    """The report's text. One row per isotope reaches the driver."""
    rows = report_rows(fits).orderBy("label").collect()
    done, total = sum(r["n_converged"] for r in rows), sum(r["n_total"] for r in rows)
    out = [f"# {title}", "", f"Converged: {done} of {total} ({100.0 * done / total if total else 0.0:.1f} %)", "", "| isotope | mean density | std |", "|---|---|---|"]
    out += [f"| {r['label']} | {r['mean']} | {r['std']} |" for r in rows]
    if provenance:
        out += ["", "| time | kind | message |", "|---|---|---|", *("| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in p) + " |" for p in provenance)]
    return "\n".join(out) + "\n"


def embedded_size(cube: DataFrame) -> DataFrame:
    """Bytes of a cube's values at 8 each, and an estimate when compressed to a third."""
    n = cube.agg((F.count("*") * 8).alias("raw_bytes"))
    return n.withColumn("compressed_bytes", F.floor(F.col("raw_bytes") / 3.0).cast("bigint"))


def save_project(spark: SparkSession, path: str, config: Mapping, tables: Mapping[str, DataFrame]) -> None:
    """A folder: config (one row of JSON, with the schema version) and a Parquet folder for each table."""
    row = json.dumps({"version": VERSION, "config": dict(config), "tables": sorted(tables)})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_project(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The configuration and tables of a saved folder; another schema version is an error."""
    meta = json.loads(spark.read.text(f"{path}/config").first()[0])
    if meta["version"] != VERSION:
        raise ValueError(f"schema version {meta['version']} is not {VERSION}")
    return meta["config"], {t: spark.read.parquet(f"{path}/tables/{t}") for t in meta["tables"]}
