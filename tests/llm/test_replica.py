"""The audit of a replica with an index of its own: lost, changed, shifted and reordered records."""

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import warc_pages
from tofcube.llm import common, queries, warc


@pytest.fixture(scope="module")
def first(spark):
    return common.work_table(warc.archive_index(warc_pages(spark), "page_id", "bytes", archive_rows=64, extra=("bytes",)), "idx")


def found(first, second, **how):
    """(page_id, status) of each record that the audit names."""
    rows = warc.audit(first, second, **{"fanout": 4, "range_rows": 7} | how)
    rows = rows.select("archive", F.explode(F.sequence("ordinal", "last")).alias("ordinal"), "status").join(first, ["archive", "ordinal"]).select("page_id", "status").collect()
    return sorted((r["page_id"] if r["page_id"] is not None else -1, r["status"]) for r in rows)


def behind(first, ids):
    """Records that stand behind one of these in its archive, as shifted."""
    rows = [(r["archive"], r["ordinal"], -1 if r["page_id"] is None else r["page_id"]) for r in first.collect()]
    at = {a: min(o for x, o, p in rows if x == a and p in ids) for a in {x for x, _, p in rows if p in ids}}
    return [(p, "shifted") for a, o, p in rows if o > at.get(a, 1 << 30) and p not in ids]


def test_read_back_after_a_loss_and_a_change(spark, first, tmp_path):
    html = F.when(F.col("page_id") == 99, F.lit("longer than it was before, by a good deal"))
    own = first.withColumn("bytes", F.coalesce(F.when(F.col("page_id") == 99, warc.record_bytes(F.col("page_id"), F.lit("u"), html)), F.col("bytes")))
    own = warc.without(own, F.col("page_id") == 17)
    warc.write_warc(own, "bytes", str(tmp_path / "w"))
    back = common.work_table(warc.read_warc(spark, str(tmp_path / "w")), "back")
    got = found(first, back)
    assert got == sorted({(17, "missing"), (99, "changed"), *(x for x in behind(first, {17}) + behind(first, {99}) if x[0] not in (17, 99))})


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
def test_shifted_offsets_are_seen(first, range_rows):
    every = sorted((-1 if r["page_id"] is None else r["page_id"], "shifted") for r in first.collect())
    moved = first.withColumns({"start": F.col("start") + 7, "stop": F.col("stop") + 7})
    assert found(first, moved, range_rows=range_rows) == every
    one = first.withColumns({c: F.col(c) + F.when((F.col("archive") == 2) & (F.col("ordinal") >= 40), 3).otherwise(0) for c in ("start", "stop")})
    want = sorted((r["page_id"], "shifted") for r in first.where("archive = 2 AND ordinal >= 40").collect())
    assert found(first, one, range_rows=range_rows) == want


def test_reversed_archives_are_seen(first):
    ends = first.groupBy(F.col("archive").alias("a")).agg(F.max("ordinal").alias("top"), F.max("stop").alias("end"))
    turned = first.join(ends, F.col("archive") == F.col("a")).withColumns({"ordinal": F.col("top") - F.col("ordinal"), "start": F.col("end") - F.col("stop"), "stop": F.col("end") - F.col("start")})
    got = found(first, turned)
    assert {s for _, s in got} <= {"reordered", "shifted"} and len(got) >= first.count() - 5  # those in the middle stay


def test_two_neighbours_change_places(first):
    """Equal lengths: no offset but those of the two differs."""
    a, b = first.where("archive = 1 AND ordinal IN (30, 31)").orderBy("ordinal").collect()
    length = a["stop"] - a["start"]
    swap = F.when((F.col("archive") == 1) & (F.col("ordinal") == 30), 31).when((F.col("archive") == 1) & (F.col("ordinal") == 31), 30).otherwise(F.col("ordinal"))
    start = F.when(F.col("ordinal") == swap, F.col("start")).when(swap == 31, F.col("start") + (b["stop"] - b["start"])).otherwise(F.col("start") - length)
    other = first.select("*", swap.cast("int").alias("o"), start.alias("s")).withColumns({"ordinal": F.col("o"), "stop": F.col("s") + F.col("stop") - F.col("start"), "start": F.col("s")})
    assert found(first, other) == sorted([(a["page_id"], "reordered"), (b["page_id"], "reordered")])


def test_only_branches_that_differ_are_read(first):
    """One changed record: the ranges that the audit reads are those of its archive, and the records those of its range."""
    other = first.withColumn("sha256", F.when(F.col("page_id") == 150, F.lit("0")).otherwise(F.col("sha256")))
    one, two = warc.merkle_leaves(first, 7), warc.merkle_leaves(other, 7)
    archive = first.where("page_id = 150").first()["archive"]
    assert [r["s_node"] for r in warc.damaged_archives(one, two, 2).collect()] == [archive]
    assert one.exceptAll(two).count() == 1 < one.where(f"archive = {archive}").count()
    assert found(first, other) == [(150, "changed")]


def test_a_lost_archive_and_an_added_one(first):
    lost = first.where("archive <> 3")
    want = sorted((r["page_id"], "missing") for r in first.where("archive = 3").collect())
    assert found(first, lost) == want
    got = warc.audit(lost, first, fanout=4).collect()
    assert {(r["archive"], r["status"]) for r in got} == {(3, "extra")} and sum(r["last"] - r["ordinal"] + 1 for r in got) == len(want)
    assert warc.audit(first.limit(0), first.limit(0)).count() == 0


def test_repeated_key_loses_a_copy(first):
    row = first.where("page_id = 5").orderBy("archive", "ordinal").collect()[-1]
    second = warc.without(first, (F.col("archive") == row["archive"]) & (F.col("ordinal") == row["ordinal"]))
    got = found(first, second)
    assert [x for x in got if x[1] != "shifted"] == [(5, "missing")]


def test_query_finds_the_planted_damage_alone(spark):
    sf = "/root/testdata/sf0.001"
    html = dict(map(tuple, spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()))
    lost: set[int] = set()
    for r in sorted(queries.op10_merkle_audit(spark, sf).collect(), key=lambda r: (r["archive"], r["ordinal"])):
        k = r["page_id"]
        want = "missing" if k % 211 == 5 else "changed" if k % 97 == 13 and html[k] else "shifted" if r["archive"] in lost else "intact"
        assert r["status"] == want
        lost |= {r["archive"]} if want == "missing" else set()
