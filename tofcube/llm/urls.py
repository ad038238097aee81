"""URL rules, and link-graph propagation for the hosts that no rule decides. DataFrame functions only.

The longest rule that fits a url decides it. For the rest, host edges are taken from the links
in the pages and counted per pair of hosts; trust spreads along them as personalised PageRank
from the hosts of allowed pages, and distrust against them from the hosts of blocked pages (who
links to the blocked is suspect). A step back carries the share that the link has in the links
of the host that it starts from, so a host's distrust is that share of its own links, damped
once for each step, that leads to blocked pages: 0.85 for one that links to nothing else, 0.004
for one with a single such link among 200. A host whose distrust is at least `min_distrust` (a
twentieth, unless stated) and greater than its trust, in units of a mean seed's, is blocked.

Hosts with very many pages or links are pre-aggregated by map-side sums before any shuffle; the
joins on hosts are equi-joins which adaptive execution splits when skewed and broadcasts when
their measured size allows. The ranks are written to a work table every few rounds, so lineage
stays short.

Defined cases: a null url, or one without '://', has empty host and path, no rule fits it and it
is allowed; a null page has no links; repeated rows are judged each and their links counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import lower_ascii, work_table


@dataclass(frozen=True)
class UrlRule:
    """`place` is host/path: it fits the host and its subdomains where the url's path starts with the rule's."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits; of equally long ones the greater by text. Null if none fits."""
    by_host: dict[str, list[UrlRule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    none = F.array().cast("array<struct<length:int,rule:string,verdict:string,path:string>>")
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string,path:string>")
    table = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(len(r.place)).alias("length"), F.lit(r.place).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path")) for r in rs]))])
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.transform(ends, lambda h: F.filter(F.coalesce(F.try_element_at(table, h), none), lambda r: path.startswith(r["path"]))))
    return F.array_max(fits)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, links: links between different hosts, counted."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    out = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link")))
    out = out.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None, damping: float, tolerance: float = 0.0, every: int = 4, reverse: bool = False) -> DataFrame:
    """host, rank: personalised PageRank over edges (src, dst, links) from seeds (host, seed; seeds sum to 1).

    reverse: against the edges, each with its share in the links of its src all the same; seeds
    are 1 at most, and so are ranks. rounds None: until the change of a round, summed over hosts
    (reverse: the greatest), is below tolerance. A round shrinks the change by damping at least
    and the first is 2 at most, so the number of rounds is bounded. Rank that reaches a host
    without edges out is lost, so ranks sum to 1 at most."""
    most = rounds
    if most is None:
        if not 0 < damping < 1 or tolerance <= 0:
            raise ValueError("rounds without a number need a damping within 0 and 1 and a positive tolerance")
        most = max(1, math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1)
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    share = work_table(edges.join(out, "src").select(F.col(a).alias("start"), F.col(b).alias("to"), (F.col("links") / F.col("total")).alias("share")), "link-shares")
    start = seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))
    rank = seeds.select("host", F.col("seed").alias("rank"))
    for k in range(1, most + 1):
        moved = share.join(rank, F.col("start") == F.col("host")).select(F.col("to").alias("host"), (damping * F.col("share") * F.col("rank")).alias("rank"))
        before, rank = rank, moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % every == 0 or k == most:
            rank = work_table(rank, "link-ranks")
            if rounds is None and k < most:
                both = rank.unionByName(before.select("host", (-F.col("rank")).alias("rank"))).groupBy("host").agg(F.abs(F.sum("rank")).alias("change"))
                if (both.agg((F.max if reverse else F.sum)("change")).first()[0] or 0.0) < tolerance:
                    break
    return rank


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int | None = None, damping: float = 0.85, min_distrust: float = 0.05) -> DataFrame:
    """id, host, path, rule (null if none fits), verdict ('allow' or 'block'), and by_links (the method decided).

    min_distrust is a share of a host's own links: it depends on no other host. A blocked seed
    counts by the share of its pages that are blocked. Ranks are iterated until a round changes
    them by less than a hundredth of the threshold."""
    named = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = named.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    hosts = work_table(hosts, "link-hosts")
    edges = work_table(host_edges(pages, url_col, html_col), "link-edges")
    total, n = hosts.agg(F.sum("allowed"), F.count_if(F.col("allowed") > 0)).first()
    good = hosts.where("allowed > 0").select("host", (F.col("allowed") / F.lit(float(total or 1))).alias("seed"))
    suspect = hosts.where("blocked > 0").select("host", (F.col("blocked") / F.col("pages")).alias("seed"))
    unit, least = (1.0 - damping) / max(n, 1), min_distrust * (1.0 - damping)
    trust = propagate(edges, good, rounds, damping, 0.01 * min_distrust * unit).withColumnRenamed("rank", "trust")
    distrust = propagate(edges, suspect, rounds, damping, 0.01 * least, reverse=True)
    bad = distrust.join(trust, "host", "left").where((F.col("rank") >= least) & (F.col("rank") / (1.0 - damping) > F.coalesce(F.col("trust") / unit, F.lit(0.0))))
    bad = bad.select(F.col("host").alias("bad_host"))
    out = judged.join(bad, F.col("host") == F.col("bad_host"), "left")
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("rule").isNull().alias("by_links"))
