"""Urls, exact search, and fixity audits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelark.llm import nearest, queries, warc, webtrust

PAGES = "page_id long, url string, html string, host int, rule int, verdict int"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2, 3) for r in rows], PAGES)


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path


URLS = [None, "", "no scheme", "http://", "https://Example.ORG/es/1?x=/fr/", "http://a.example.org/en/1", "http://example.org/en/2", "http://xexample.org/es/", "http://shop.com/fr/a#b",
        "http://shop.com/de/a", "http://shop.com?de/", "x://ÄB.net/p://q", "http://a.net\n/b", "http://com/fr/", "http://org", "http://org/"]


def test_rules(pages):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)]
    found = {r["page_id"]: r for r in webtrust.judge(pages(rows), queries.URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = plain_host_path(u)
        assert (found[i]["host"], found[i]["path"]) == (host, path)
        fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        assert found[i]["rule"] == rule
        assert found[i]["verdict"] == (verdict or found[i]["verdict"]) and found[i]["verdict"] in ("allow", "block")
    assert found[0]["verdict"] == "allow"
    assert webtrust.judge(pages([]), queries.URL_RULES).count() == 0
    assert webtrust.judge(pages(rows), []).where("rule is not null").count() == 0


def test_trust_and_distrust_reach_other_hosts(pages):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    rows = [
        (1, "http://good.org/", link("friend.net")),
        (2, "http://friend.net/", link("second.info")),
        (3, "http://spam.info/", link("shop.com")),
        (4, "http://shop.com/de/", ""),
        (5, "http://second.info/", None),
        (6, "http://island.net/", ""),
    ]
    found = {r["page_id"]: r for r in webtrust.judge(pages(rows), queries.URL_RULES).collect()}
    assert [found[i]["verdict"] for i in range(1, 7)] == ["allow", "allow", "block", "block", "allow", "allow"]
    assert found[2]["trust"] > found[5]["trust"] > 0 and found[3]["distrust"] > 0


def test_page_rank_against_linear_algebra(spark):
    """Converged ranks of two kinds at once; hosts without links give their rank back to the seeds."""
    rng = np.random.default_rng(3)
    weights = (rng.random((12, 12)) < 0.3) * rng.integers(1, 5, (12, 12))
    np.fill_diagonal(weights, 0)
    weights[[2, 7]] = 0  # dangling
    edges = [(k, f"h{i:02}", f"h{j:02}", int(w[i, j])) for k, w in enumerate((weights, weights.T)) for i in range(12) for j in range(12) if w[i, j]]
    seeds = [(0, "h00", 1.0), (0, "h04", 3.0), (1, "h07", 2.0)]
    found = webtrust.propagate(spark.createDataFrame(edges, "kind int, src string, dst string, n long"), spark.createDataFrame(seeds, "kind int, host string, weight double"))
    got = {(r["kind"], r["host"]): r["rank"] for r in found.collect()}
    for k, w in enumerate((weights, weights.T)):
        start = np.zeros(12)
        for kind, host, weight in seeds:
            start[int(host[1:])] += weight * (kind == k)
        start /= start.sum()
        out = w.sum(axis=1, keepdims=True)
        share = np.where(out > 0, w / np.maximum(out, 1), start)
        rank = np.linalg.solve(np.eye(12) - webtrust.DAMPING * share.T, (1 - webtrust.DAMPING) * start)
        assert [got.get((k, f"h{i:02}"), 0.0) for i in range(12)] == pytest.approx(rank.tolist(), abs=2 * webtrust.TOLERANCE)
    assert webtrust.propagate(spark.createDataFrame([], "kind int, src string, dst string, n long"), spark.createDataFrame([], "kind int, host string, weight double")).count() == 0


def test_links_that_name_a_host(pages):
    html = "<a href='//Rel.org/x'>1</a> <A HREF=http://abs.org?q>2</a> <a href='/own'>3</a> <a class=x href=\"ftp://f.org#y\">4</a> <a href='mailto:a@b'>5</a>"
    rows = pages([(1, "http://a.net/", html), (2, "http://a.net/b", None)]).withColumn("host", F.lit("a.net"))
    found = {(r["src"], r["dst"]): r["n"] for r in webtrust.host_edges(rows).collect()}
    assert found == {("a.net", "rel.org"): 1, ("a.net", "abs.org"): 1, ("a.net", "f.org"): 1}


def plain_top(rows, k, scale=64):
    """Sorted results of each row that is a query, in whole numbers."""
    ok = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(ok) if m != n and len(v) == len(w))[:k]
            out += [(i, rank, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "n"), [(3, 70), (64, 900)])
def test_top_k(spark, dims, n):
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(n, dims)) * rng.choice([0.1, 1, 3], (n, 1))
    vectors[5:25] = vectors[4]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2020, [None] * dims), (2040, [float("nan")] * dims), (2060, [float("inf")] + [0.0] * (dims - 1)), (2080, [0.0] * dims), (None, [1.0] * dims)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, key int, score int")
    rows = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    found = nearest.top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, 20)


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_PACK", 16)
    monkeypatch.setattr(nearest, "CANDIDATE_PACK", 64)
    monkeypatch.setattr(nearest, "STREAMED", 2)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1000, 8)).astype(np.float32))]
    found = nearest.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=7)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, 7)


def test_each_row_of_a_repeated_query_has_its_results(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_PACK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-9, 9, size=(90, 6)))]
    rows += [rows[20]] * 9 + [(40, rows[7][1]), (40, rows[8][1])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    found = nearest.top_k(df, F.col("vec_id") % 20 == 0, k=7, scale=1.0)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, 7, 1)
    twins = [(20, [3.0, 4.0])] * 3 + [(20, [4.0, 4.0]), (1, [0.0, 0.0])]
    found = nearest.top_k(spark.createDataFrame(twins, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=9, scale=1.0)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(twins, 9, 1)


@pytest.mark.parametrize("pack", [1024, 8])
def test_vectors_of_other_lengths_and_large_components(spark, monkeypatch, pack):
    monkeypatch.setattr(nearest, "QUERY_PACK", pack)
    monkeypatch.setattr(nearest, "CANDIDATE_PACK", pack)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=rng.choice([3, 3, 3, 5, 1, 0])) * rng.choice([1, 1, 1, 3])).tolist()) for i in range(200)]
    for i, scale in ((7, 1e30), (40, 1e30), (61, -1e9), (80, 2.0**40), (99, 1e12), (120, 1e300), (133, 3e17)):
        rows[i] = (i, (rng.normal(size=3) * scale).tolist())
    rows += [(300, [1e30, 0.0, 0.0]), (301, [1e30, 1.0, 0.0]), (320, [1e15, -1e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.top_k(df, F.col("vec_id") % 20 == 0, k=6)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, 6)


def test_few_or_no_candidates(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert nearest.top_k(make([]), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.top_k(make([(0, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert [tuple(r) for r in nearest.top_k(make([(0, [1.0]), (3, [0.5])]), F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 3, 2048)]


def test_audit_finds_what_was_damaged(spark):
    def records(rows):
        df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, node int")
        return df.select("page_id", "node", warc.record(F.col("url"), F.col("html")).alias("record"))

    rows = [(i * 37, f"http://h/{i}", "x" * (i % 50)) for i in range(400)] + [(None, None, None), (20000, "u", "")]
    other = [list(r) for r in rows]
    other[17][2] = "y" * 17
    other[200][1] = "http://h/other"
    gone = other.pop(300)[0]
    other.append([99999, "new", "page"])
    found = warc.audit(records(rows), records([tuple(r) for r in other]), "page_id", "record")
    verdicts = {r["page_id"]: r["verdict"] for r in found.collect()}
    assert {k for k, v in verdicts.items() if v == "corrupt"} == {17 * 37, 200 * 37}
    assert verdicts[gone] == "missing" and verdicts[99999] == "extra"
    assert len(verdicts) == len(rows) + 1
    same = warc.audit(records(rows), records(rows), "page_id", "record")
    assert {r["verdict"] for r in same.collect()} == {"ok"}
    assert warc.audit(records([]), records([]), "page_id", "record").count() == 0


def test_audit_of_null_and_repeated_ids(spark, monkeypatch):
    """More records of a null and of a repeated id than an archive holds: parts of bounded size, and every record once."""
    monkeypatch.setattr(warc, "ARCHIVE", 16)

    def records(rows):
        return spark.createDataFrame(rows, "page_id long, body string").select("page_id", warc.record(F.lit("u"), F.col("body")).alias("record"))

    rows = [(None, f"null {i}") for i in range(150)] + [(7, f"seven {i}") for i in range(90)] + [(7, "same")] * 40 + [(i, "one") for i in range(40)]
    other = [r for r in rows if r not in ((None, "null 3"), (12, "one"))] + [(7, "same"), (12, "two"), (500, "new")]
    leaf = warc.leaves(records(rows), records(other), "page_id", "record")
    assert leaf.groupBy("archive", "part").count().agg(F.max("count")).first()[0] < 3 * 16
    found = [(r["page_id"], r["verdict"]) for r in warc.audit(records(rows), records(other), "page_id", "record").collect()]
    assert len(found) == len(rows) + 2
    odd = sorted(((i, v) for i, v in found if v not in ("ok", "moved")), key=str)
    assert odd == sorted([(None, "missing"), (7, "extra"), (12, "corrupt"), (500, "extra")], key=str)
    again = warc.audit(records(rows), records(rows[::-1]), "page_id", "record").collect()
    assert {r["verdict"] for r in again} == {"ok"} and len(again) == len(rows)
    for archive in {r["archive"] for r in again if r["archive"] not in (None, 0)}:
        spans = sorted((r["start"], r["length"]) for r in again if r["archive"] == archive)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_audit_is_dealt_once(spark):
    """One exchange of the counted records by archive is all that the trees and the descent need."""
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.col("id").cast("string").cast("binary").alias("record"))
    plan = warc.audit(rows, rows, "page_id", "record")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") >= 1 and plan.count("ENSURE_REQUIREMENTS") <= 12
