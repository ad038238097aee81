"""Tables that are broadcast or read to the driver are dimensions of a checked size."""

import numpy as np
import pytest

from tofcube.operators import axes, multifit


def test_bounded(spark):
    rows, table = spark.range(5).withColumnRenamed("id", "i"), spark.range(3).withColumnRenamed("id", "i")
    assert rows.join(axes.bounded(table, "i", 3), "i").count() == 3
    assert rows.join(axes.bounded(table.where("i > 5"), "i", 3), "i").count() == 0
    with pytest.raises(Exception, match="more than 2 rows"):
        rows.join(axes.bounded(table, "i", 2), "i").collect()


def test_model_of_tables(spark, monkeypatch):
    axis = spark.createDataFrame([(2, 3.0), (0, 1.0), (1, 2.0)], "i int, energy double")
    kind = "grp string, i int, sigma double, temperature double"
    rows = [("b", 2, 7.0, 300.0), ("a", 0, 1.0, 300.0), ("a", 1, 2.0, 400.0), ("a", 2, None, 300.0)]
    m = multifit.model_of(spark.createDataFrame(rows, kind), axis, flight_m=20.0)
    assert (m.groups, m.nodes.tolist(), m.energies.tolist(), m.flight_m) == (["a", "b"], [300.0, 400.0], [1.0, 2.0, 3.0], 20.0)
    want = np.zeros((2, 2, 3))
    want[1, 0, 2], want[0, 0, 0], want[0, 1, 1] = 7.0, 1.0, 2.0
    assert (m.sigma == want).all()
    assert multifit.model_of(spark.createDataFrame(rows[:2], kind).drop("temperature"), axis).nodes.tolist() == [293.6]
    with pytest.raises(ValueError, match="no bin"):
        multifit.model_of(spark.createDataFrame([*rows, ("a", 3, 1.0, 300.0)], kind), axis)
    with pytest.raises(ValueError, match="two cross sections"):
        multifit.model_of(spark.createDataFrame([*rows, ("a", 0, 1.0, 300.0)], kind), axis)
    monkeypatch.setattr(multifit, "MOST_ROWS", 3)
    with pytest.raises(ValueError, match="more than 3 rows"):
        multifit.model_of(spark.createDataFrame(rows, kind), axis)
