"""Control decks, their resonances and radii."""

import math

import pytest
from pyspark.sql import functions as F

from tofcube.operators import decks
from tofcube.operators import models as M
from tofcube.operators import texts as T


def deck(observation="TRANSMISSION", command="PRINT EVERYTHING", widths=True):
    cards = ["      300.      25.0     0.025     0.010     0.020"] if widths else []
    groups = ["  1      1    0   .5    0.5000  1.5 Iso1", "    1    1    0    0      .500", "  2      1    2 -1.5            1.5 Iso2", "    1    1    0    1      .500", "    2", "    3"]
    return ["A CASE", "      FE56   55.9000    1000.0   2.0+3", command, "", *cards, "      6.00   0.0175", observation, *groups, "", "BROADENING", " 6.0 300. 0.0175 0.040 0.0 0.030"]


def cards():
    row = lambda e, g, n, a, b, k: f"{e:>11}{g:>11}{n:>11}{a:>11}{b:>11}" + " 0" * 5 + f"{k:>2}"
    return [row("1.1500+3", "500.0", "60.0", "", "", 1), row("1.4000E+03", "450.0", "20.0", "30.", "-10.", 1), "", "RADIUS PARAMETERS FOLLOW", f"{5.5:>10}{5.5:>10}{chr(32) * 4} 1 0 2", " 7.25     ", "", "EXPLICIT"]


def table(spark, rows, name="f"):
    return spark.createDataFrame([(name, k, v) for k, v in enumerate(rows)], "file string, lineno int, line string")


def test_deck(spark):
    a, b = decks.decks(table(spark, deck()).unionByName(table(spark, ["t"] + deck()[1:4], "empty"))).orderBy("number").collect()
    assert (a["symbol"], a["awr"], a["e_min"], a["e_max"], a["temperature"], a["flight_m"]) == ("FE56", 55.9, 1000.0, 2000.0, 300.0, 25.0)
    assert (a["dl"], a["dg"], a["de"]) == (0.04, 0.02, 0.03) and (a["radius_fm"], a["thickness"], a["observation"], a["broadened"]) == (6.0, 0.0175, "transmission", True)
    assert [(r["number"], r["j"], r["l"], r["abundance"], r["spin"], r["label"]) for r in (a, b)] == [(1, 0.5, 0, 0.5, 1.5, "Iso1"), (2, -1.5, 1, 1.0, 1.5, "Iso2")]
    bare = decks.deck(deck("TOTAL CROSS SECTION", "BROADENING IS NOT WANTED", widths=False))
    assert bare[0][10] is False and bare[0][11:14] == (6.0, 0.0175, "total") and len(bare) == 2
    for bad in (deck("CAPTURE"), ["only a title"], ["t", "short"]):
        with pytest.raises(ValueError):
            decks.deck(bad)


def test_resonances_of_a_deck(spark):
    g = decks.decks(table(spark, deck()))
    c, r = T.parameter_cards(table(spark, cards())), T.radius_cards(table(spark, cards()))
    assert [tuple(x) for x in r.collect()] == [("f", 1, 5.5)]
    assert decks.undefined(g, c).count() == 0 and decks.undefined(g, c.withColumn("spin_group", F.lit(9))).count() == 2
    rows = decks.deck_resonances(g, c, r).orderBy("l", "er").collect()
    assert [(x["l"], x["j"], x["er"], x["gn"], x["radius"], x["spin"]) for x in rows] == [(0, 0.5, 1150.0, 0.06, 5.5, 1.5), (0, 0.5, 1400.0, 0.02, 5.5, 1.5), (1, 1.5, -1.0, 0.0, 6.0, 1.5)]
    assert rows[1]["gfa"] == 0.03 and rows[1]["gfb"] == -0.01 and math.isclose(rows[1]["gf"], 0.04)
    e = spark.createDataFrame([("f", x) for x in (1001.0, 1150.0, 1400.0)], "za string, e double")
    xs = M.reich_moore(e, decks.deck_resonances(g, c, r)).orderBy("e").collect()
    assert xs[1]["total"] > 3 * xs[0]["total"] and xs[2]["fission"] > 0
    # far from resonances the potential scattering of both groups is left
    assert decks.deck_resonances(g, c.limit(0)).count() == 2
