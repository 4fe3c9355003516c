"""URL filters: rules first, then trust and distrust spread over the links between hosts.

A rule is ``(verdict, host, path)``; it fits its host and all subdomains if the url's path starts
with its path, and the longest rule that fits (host and path together) wins. Hosts without a
fitting rule are judged by propagation: personalised PageRank from the hosts of allowed pages, and
the same over reversed edges from the hosts of blocked pages; a host is blocked if its distrust is
more than ``THRESHOLD`` times its trust.

Edges between hosts are the links of the pages that name a host, counted by pair before any shuffle,
and, as sites link to their parts, those between a host and its parent domain. Both kinds of ranks are
propagated together, for as many rounds as leave less than ``TOLERANCE`` of the walk under way, whatever
the graph; what reaches hosts without links goes back to the seeds. Ranks are written to the shared folder
every few rounds, so that lineage stays short.

Defined results: host and path are empty for a url that is null or has no ``://``; such pages and
hosts that nothing reaches are allowed; rules of equal length are decided by their text; repeated
rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import dropped, written

DAMPING = 0.85
#: The most of a rank's total that rounds which are left out could still move.
TOLERANCE = 1e-4
#: Rounds between two writes of the ranks.
WRITE_EVERY = 12
THRESHOLD = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]
TRUST, DISTRUST = 0, 1


def rounds(tolerance: float = TOLERANCE) -> int:
    """Rounds after which less than the tolerance is under way: each keeps ``DAMPING`` of it at most."""
    return ceil(log(tolerance) / log(DAMPING))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty strings where there are none."""
    rest = F.when(url.contains("://"), F.expr("1")).isNotNull()
    after = F.substring_index(url, "://", 1)
    tail = F.when(rest, url.substr(F.length(after) + 4, F.length(url)))
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text (host and path) of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit(h + p)).otherwise(found)
    return found


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Edges ``src, dst, n`` between different hosts; ``pages`` has a column ``host``."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^\"'\s>/?#]*)"), 1)
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    linked = linked.withColumn("dst", F.translate("dst", UPPER, LOWER))
    hosts = pages.where("host <> ''").select("host").distinct()
    parents = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("parent")).where("parent <> ''")
    up = parents.select(F.col("host").alias("src"), F.col("parent").alias("dst"))
    down = parents.select(F.col("parent").alias("src"), F.col("host").alias("dst"))
    return linked.unionByName(up).unionByName(down).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank ``kind, host, rank`` of each kind over its ``edges`` (kind, src, dst, n) from its ``seeds`` (kind, host, weight).

    The walk from hosts without edges goes back to the seeds: as the seeds are where all begins, that only
    scales the ranks, whose sum is made 1 at the end.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = written(seeds.join(total, "kind").where("total > 0").select("kind", "host", (F.col("weight") / F.col("total")).alias("start")), "start")
    degrees = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = written(edges.join(degrees, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all") * DAMPING).alias("share")), "shares")
    again = start.select("kind", "host", (F.col("start") * (1 - DAMPING)).alias("rank"))
    ranks, last = start.withColumnRenamed("start", "rank"), None
    for i in range(1, rounds(tolerance) + 1):
        moved = shares.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        ranks = moved.unionByName(again).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % WRITE_EVERY == 0:
            ranks = written(ranks, "ranks")
            if last is not None:
                dropped(last)
            last = ranks
    sums = ranks.groupBy("kind").agg(F.sum("rank").alias("sum"))
    return ranks.join(sums, "kind").select("kind", "host", (F.col("rank") / F.col("sum")).alias("rank"))


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Key, host, path, rule and verdict of each page, with the trust and distrust of its host."""
    host, path = host_and_path(F.col(url))
    pages = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), host.alias("host"), path.alias("path"))
    pages = pages.withColumn("rule", fitting(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for v, h, p in rules for x in (h + p, v)]) if rules else F.lit(None)
    pages = pages.withColumn("_ruled", F.when(F.col("rule").isNotNull(), by_rule[F.col("rule")]) if rules else F.lit(None).cast("string"))
    edges = written(host_edges(pages), "edges")
    counted = pages.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("_ruled") == "allow", 1)).cast("double").alias("allowed"), F.count(F.when(F.col("_ruled") == "block", 1)).cast("double").alias("blocked"))
    counted = written(counted, "seeds")
    ahead = edges.select(F.lit(TRUST).alias("kind"), "src", "dst", "n")
    back = edges.select(F.lit(DISTRUST).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    seeds = [counted.where(F.col(c) > 0).select(F.lit(k).alias("kind"), "host", F.col(c).alias("weight")) for k, c in ((TRUST, "allowed"), (DISTRUST, "blocked"))]
    ranks = propagate(ahead.unionByName(back), seeds[0].unionByName(seeds[1]))
    of_kind = lambda k, name: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(name)
    scores = written(ranks.groupBy("host").agg(of_kind(TRUST, "trust"), of_kind(DISTRUST, "distrust")), "scores")
    found = pages.drop("html").join(scores, "host", "left")
    judged = F.when(F.coalesce(F.col("distrust"), F.lit(0.0)) > threshold * F.coalesce(F.col("trust"), F.lit(0.0)), "block").otherwise("allow")
    return found.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("_ruled", judged).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
