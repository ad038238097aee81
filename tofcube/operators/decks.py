"""Control decks of a fitting program: fixed cards as tables, and their resonances as the formulas take them.

A deck is a few hundred lines whose meaning depends on those before them, so a file's lines meet in
one group; decks are spread over the cluster. Everything after the cards is joins and windows.
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.operators.extras import spin_offsets

DECK = "file string, title string, symbol string, awr double, e_min double, e_max double, temperature double, flight_m double, dl double, de double, dg double, broadened boolean, radius_fm double, thickness double, observation string, number int, j double, l int, abundance double, spin double, label string"
NAMES = [x.split()[0] for x in DECK.split(", ")]
#: First letters of the observations that are read. Fixed values.
OBSERVED = {"TRANS": "transmission", "TOTAL": "total", "FISSI": "fission"}
#: Those that are refused. Fixed values.
UNREAD = ("CAPTU", "DIRAC")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def _number(text: str, other: float | None = None) -> float:
    t = re.sub(r"(?<=[\d.])([+-]\d+)$", r"E\1", text.strip().upper().replace("D", "E"))
    if _NUMBER.match(t):
        return float(t)
    if other is None or t:
        raise ValueError(f"a number is expected, not {text!r}")
    return other


#: The cards in columns: name, first and last column (from 0, the last not included), how it is read, and what a blank stands for
#: (nothing: it must be there). Fixed values of the format.
COLUMNS = {
    "case": [("symbol", 0, 10, str.strip, ""), ("awr", 10, 20, _number), ("e_min", 20, 30, _number), ("e_max", 30, 40, _number, None)],
    "group": [("number", 0, 5, int), ("entrance", 5, 10, int, 1), ("exit", 10, 15, int, 0), ("j", 15, 20, _number), ("abundance", 20, 30, _number, 1.0), ("spin", 30, 35, _number, 0.0), ("label", 36, None, str.strip, None)],
}
#: The cards of free numbers: their names, how many must be there, and what stands for them otherwise. Fixed values of the format.
FREE = {
    "physical": (["temperature", "flight_m", "dl", "de", "dg"], 2, [300.0, 0.0, 0.0, 0.0, 0.0]),
    "sample": (["radius_fm", "thickness"], 2, [0.0, 0.0]),
    "widths": (["radius", "temperature", "thickness", "dl", "dg", "de"], 6, []),
}
#: Commands that leave out the physical card, unless both cards are there.
UNBROADENED = re.compile(r"BROADENING IS NOT|.*NO LOW-ENERGY BROADENING")


def in_columns(card: str, line: str) -> dict:
    out = {}
    for name, first, last, read, *blank in COLUMNS[card]:
        text = line[first:last]
        out[name] = read(text) if text.strip() or not blank else blank[0]
    return out


def in_words(card: str, line: str) -> dict[str, float]:
    names, least, missing = FREE[card]
    words = [float(x) if _NUMBER.match(x) else 0.0 for x in line.upper().replace("D", "E").split()]
    return dict(zip(names, (words + [0.0] * len(names)) if len(words) >= least else missing, strict=False))


def _sections(lines: list[str]) -> list[list[str]]:
    """Runs of lines between blank ones."""
    return [list(run) for some, run in groupby(lines, key=lambda x: bool(x.strip())) if some]


def _spin_groups(lines: list[str]) -> list[dict]:
    """Each group's card with l of its first channel; the cards of its channels follow it."""
    out, channels = [], 0
    for line in lines:
        if channels:
            if channels == out[-1]["entrance"] + out[-1]["exit"] and line[18:20].strip().isdigit():
                out[-1]["l"] = int(line[18:20])
            channels -= 1
        elif line[:5].strip().isdigit() or out:
            out.append({"l": 0} | in_columns("group", line))
            channels = out[-1]["entrance"] + out[-1]["exit"]
    return out


def deck(lines: list[str]) -> list[tuple]:
    """Rows of DECK without the file, one for each spin group.

    Title, case and commands, to the first blank line; then the free numbers: physical, where
    broadening is on or both cards are there, and sample; then sections that open with their
    observation and hold its spin groups. Widths that follow BROADENING take the place of the others unless they are 0."""
    if len(lines) < 2 or len(lines[1]) < 30:
        raise ValueError("a deck has a title and a card of symbol, mass and energies")
    head, *rest = _sections(lines[2:]) if any(x.strip() for x in lines[2:3]) else [[], *_sections(lines[2:])]
    broadened = not any(UNBROADENED.match(x.strip().upper()) for x in head)
    body = [*rest[0], *([""] if len(rest) > 1 else []), *(x for run in rest[1:] for x in (*run, ""))] if rest else []
    both = broadened or len(body) > 1 and re.match(r"[\d.+-]", body[1].strip() or " ")
    names = ["physical", "sample"] if both else ["sample"]
    values = in_words("physical", "") | {k: v for card, line in zip(names, body, strict=False) for k, v in in_words(card, line).items()}
    row = {"title": lines[0].strip(), "observation": "transmission", "broadened": broadened} | in_words("sample", "") | in_columns("case", lines[1]) | values
    row["e_max"] = row["e_min"] if row["e_max"] is None else row["e_max"]
    groups: list[dict] = []
    for run in _sections(body[len(names) :]):
        words = [x.strip().upper() for x in run]
        for k, word in enumerate(words):
            if word[:5] in UNREAD:
                raise ValueError(f"observation {word.split()[0]} is not read")
            if word[:5] in OBSERVED:
                row["observation"] = OBSERVED[word[:5]]
                groups += _spin_groups(run[k + 1 :])
                break
            if word.startswith("BROADENING"):
                own = in_words("widths", run[k + 1]) if k + 1 < len(run) else {}
                row |= {c: own[c] for c in ("dl", "dg", "de") if own.get(c)}
                break
        else:
            continue
        if word.startswith("BROADENING"):
            break
    return [tuple((row | g)[c] for c in NAMES[1:]) for g in groups]


def decks(lines: DataFrame) -> DataFrame:
    """DECK of lines (file, lineno, line): one row for each spin group of each file."""

    def parse(t: pa.Table) -> pa.Table:
        t = t.sort_by("lineno")
        name = t.column("file")[0].as_py()
        rows = [(name, *r) for r in deck(t.column("line").to_pylist())]
        kinds = [pa.string() if x.endswith("string") else pa.int32() if x.endswith("int") else pa.bool_() if x.endswith("boolean") else pa.float64() for x in DECK.split(", ")]
        cols = list(zip(*rows, strict=True)) or [[] for _ in NAMES]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=NAMES)

    return lines.select("file", "lineno", "line").groupBy("file").applyInArrow(parse, DECK)


def deck_resonances(groups: DataFrame, cards: DataFrame, radii: DataFrame | None = None) -> DataFrame:
    """Resonances as operators.models takes them, za being the file's name: spin groups (DECK) with the cards
    (file, energy_ev, gamma_gamma_ev, gamma_n_ev, gamma_f1_ev, gamma_f2_ev, spin_group) of the file. radii: (file,
    spin_group, radius_fm) in place of the deck's radius.

    Groups of one l and j of a target with spin are told apart by 1e-6; a group without resonances keeps
    its potential scattering by a row of zero widths. The target's spin is that of the file's first group."""
    first = groups.groupBy(F.col("file").alias("f_file")).agg(F.min_by("spin", "number").alias("target"))
    if radii is not None:
        r = radii.select(F.col("file").alias("r_file"), F.col("spin_group").alias("r_group"), F.col("radius_fm").alias("r_own"))
        groups = groups.join(r, (F.col("file") == F.col("r_file")) & (F.col("number") == F.col("r_group")), "left").withColumn("radius_fm", F.coalesce("r_own", "radius_fm"))
    g = spin_offsets(groups.select(F.col("file").alias("case"), "number", "l", "j", "awr", "radius_fm", "spin").join(first, F.col("case") == F.col("f_file")).drop("f_file", "spin").withColumnRenamed("target", "spin"))
    c = cards.select(F.col("file").alias("c_file"), "spin_group", "energy_ev", "gamma_gamma_ev", "gamma_n_ev", "gamma_f1_ev", "gamma_f2_ev")
    rows = g.join(c, (F.col("case") == F.col("c_file")) & (F.col("number") == F.col("spin_group")), "left")
    none = F.col("energy_ev").isNull()
    width = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    gfa, gfb = width("gamma_f1_ev"), width("gamma_f2_ev")
    return rows.select(
        F.col("case").alias("za"), "awr", F.col("radius_fm").alias("radius"), "l", F.abs("j").alias("j"), F.when(none, -1.0).otherwise(F.col("energy_ev")).alias("er"), width("gamma_n_ev").alias("gn"),
        width("gamma_gamma_ev").alias("gg"), (F.abs(gfa) + F.abs(gfb)).alias("gf"), gfa.alias("gfa"), gfb.alias("gfb"), "spin",
    )


def undefined(groups: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards whose spin group their file's deck doesn't have."""
    return cards.join(groups.select("file", F.col("number").alias("spin_group")).distinct(), ["file", "spin_group"], "left_anti")
