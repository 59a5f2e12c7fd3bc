import random

import pytest
from pyspark.sql import functions as F

from lodeglass.llm import links


def by_hand(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_components(spark, kind):
    choose = random.Random(4)
    edges = {
        "chain": [(n, n + 1) for n in range(60)],
        "star": [(0, n) for n in range(1, 300)] + [(1000 + n, 1999) for n in range(50)],
        "random": [(choose.randint(0, 150), choose.randint(0, 150)) for _ in range(90)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (7, 7)],
    }[kind]
    got = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = by_hand([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_no_edges(spark):
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("split", [5000, 4])
def test_connect_loses_no_link(spark, monkeypatch, split):
    """Bodies hold if they differ by at most 1: compared with all pairs of every bucket."""
    monkeypatch.setattr(links, "SPLIT", split)
    choose = random.Random(6)
    value = {n: choose.randint(0, 60) for n in range(40 if split > 100 else 10)}
    rows = sorted({(choose.randint(0, 3), n) for n in value for _ in range(2)})
    members = {}
    for bucket, node in rows:
        members.setdefault(bucket, []).append(node)
    edges = [(a, b) for m in members.values() for a in m for b in m if a < b and abs(value[a] - value[b]) <= 1]
    got = links.connect(
        spark.createDataFrame(rows, "bucket long, node long"),
        lambda nodes: nodes.select("node", F.element_at(F.create_map(*[F.lit(x) for p in value.items() for x in p]), F.col("node").cast("int")).alias("body")),
        lambda a, b: F.abs(a - b) <= 1,
    ).collect()
    got = {r["node"]: r["component"] for r in got}
    want = by_hand(edges)
    groups = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
    assert set(got) <= set(want) and all(want[n] == want[c] for n, c in got.items())
    if split == 5000:
        assert groups(got) == groups(want)


@pytest.mark.parametrize("nodes", [11, 14])
def test_every_pair_of_a_dealt_bucket_meets(spark, monkeypatch, nodes):
    """Nothing holds, so all pairs of a bucket must be compared, also far above SPLIT."""
    monkeypatch.setattr(links, "SPLIT", 4)
    monkeypatch.setattr(links, "AT_ONCE", 0)
    met, real = [], links.materialise

    def noted(rows, name):
        out = real(rows, name)
        met.extend(tuple(sorted(r)) for r in out.collect()) if name == "pairs" else None
        return out

    monkeypatch.setattr(links, "materialise", noted)
    rows = spark.createDataFrame([(0, n) for n in range(nodes)], "bucket long, node long")
    assert links.connect(rows, lambda found: found.selectExpr("node", "node body"), lambda a, b: a < b - 1000).count() == 0
    assert sorted(met) == [(a, b) for a in range(nodes) for b in range(a + 1, nodes)]


def test_connect_loses_no_link_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(links, "SPLIT", 4)
    choose = random.Random(8)
    value = {n: choose.randint(0, 60) for n in range(24)}
    rows = sorted({(choose.randint(0, 1), n) for n in value for _ in range(2)})
    edges = [(a, b) for p, a in rows for q, b in rows if p == q and a < b and abs(value[a] - value[b]) <= 1]
    values = spark.createDataFrame(list(value.items()), "node long, body long")
    got = links.connect(
        spark.createDataFrame(rows, "bucket long, node long"), lambda nodes: values.join(nodes, "node"), lambda a, b: F.abs(a - b) <= 1
    ).collect()
    assert {r["node"]: r["component"] for r in got} == by_hand(edges)


def test_terms_keep_strangers_of_a_bucket_apart(spark, monkeypatch):
    """200 members share a bucket and few hold: only those that share a term meet, and links without a common bucket are dropped."""
    met, real = [], links.materialise

    def noted(rows, name):
        out = real(rows, name)
        met.append(out.count()) if name == "pairs" else None
        return out

    monkeypatch.setattr(links, "materialise", noted)
    value = {n: n * 10 for n in range(200)} | {3: 1200, 7: 1201, 150: 1202, 500: 1203, 501: 1204}
    rows = [(0, n) for n in range(200)] + [(1, 500), (1, 501)]
    values = spark.createDataFrame(list(value.items()), "node long, body long")
    terms = lambda found: found.select("node", F.explode(F.array(F.floor(F.col("body") / 10), F.floor((F.col("body") + 5) / 10) + 1000)).alias("term"))
    got = links.connect(
        spark.createDataFrame(rows, "bucket long, node long"), lambda nodes: values.join(nodes, "node"), lambda a, b: F.abs(a - b) <= 2, terms
    ).collect()
    want = by_hand([(3, 120), (7, 120), (150, 120), (500, 501)])
    assert {r["node"]: r["component"] for r in got} == want
    assert sum(met) < 2 * len(rows)


def test_lengths_that_do_not_fit_spare_the_comparison(spark):
    """Bodies whose lengths do not fit are never tested, and no link is lost."""
    value = {n: "x" * (n % 7 + 1) for n in range(30)}
    values = spark.createDataFrame(list(value.items()), "node long, body string")
    rows = spark.createDataFrame([(n % 2, n) for n in value], "bucket long, node long")
    holds = lambda a, b: F.when(F.length(a) == F.length(b), True).otherwise(F.raise_error(F.lit("lengths differ")).cast("boolean"))
    got = links.connect(rows, lambda nodes: values.join(nodes, "node"), holds, fits=lambda a, b: a == b).collect()
    want = by_hand([(a, b) for a in value for b in value if a < b and a % 2 == b % 2 and value[a] == value[b]])
    assert {r["node"]: r["component"] for r in got} == want
