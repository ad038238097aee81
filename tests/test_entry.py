"""The driver's contract, and that the training-data package is optional."""

import importlib.util
import os
import re

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["y", "x", "mean_transmission", "n_valid"] and df.count() > 0


def test_nothing_else_imports_the_optional_package():
    for top, _, files in os.walk(os.path.join(ROOT, "tofcube")):
        if os.path.basename(top) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(top, f), encoding="utf-8").read()
                assert not re.search(r"tofcube\.llm|from tofcube import .*llm", text), f
    assert importlib.util.find_spec("tofcube.api")


def test_api_names(spark):
    from tofcube import api

    res = api.create_resonance_data(spark, 92, 238, 236.006, 9.48, [(6.67, 0.5, 0.0015, 0.023)])
    e = spark.range(100).selectExpr("'92238' AS za", "6.0 + id * 0.0133D AS e")
    got = {f: api.cross_sections(e, res, formalism=f).selectExpr("max(total)").first()[0] for f in api.FORMALISMS}
    assert min(got.values()) > 1e3
    try:
        api.resolution_broaden(e, [], 25.0, dt_us=1.0)
    except ValueError:
        pass
    else:
        raise AssertionError("half of the widths were taken")
