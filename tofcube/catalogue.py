"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tofcube.plans import axes, cubes, extras, fits, models, records, scans, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (cubes, axes, texts, models, fits, extras, records, scans):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
