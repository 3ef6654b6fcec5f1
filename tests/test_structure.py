"""Graphs and co-change against plain walks and plain counting."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from repolytics.operators import boundaries, coupling, graph


def plain_components(edges):
    """node: smallest member, of nodes on a cycle, by reachability."""
    nodes = sorted({x for e in edges for x in e})
    reach = {n: set() for n in nodes}
    for n in nodes:
        front = [n]
        while front:
            x = front.pop()
            for a, b in edges:
                if a == x and b not in reach[n]:
                    reach[n].add(b)
                    front.append(b)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize(("nodes", "edges", "seed"), [(12, 14, 1), (30, 45, 2), (40, 44, 3), (25, 120, 4)])
def test_components_equal_a_plain_walk(spark, nodes, edges, seed):
    r = random.Random(seed)
    own = [(f"n{r.randrange(nodes):02}", f"n{r.randrange(nodes):02}") for _ in range(edges)]
    got = graph.strong_components(spark.createDataFrame(own, "src string, dst string").repartition(3))
    assert {x["node"]: x["component"] for x in got.collect()} == plain_components(own)


def test_components_of_shapes(spark):
    ring = [(i, (i + 1) % 12) for i in range(12)]
    chain = [(100 + i, 101 + i) for i in range(20)]
    two = [(200, 201), (201, 200), (201, 210), (210, 211), (211, 210)]
    own = [*ring, *chain, (5, 100), *two, (300, 300), (301, 302), (None, 5), (5, None), *ring]
    got = {x["node"]: x["component"] for x in graph.strong_components(spark.createDataFrame(own, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(12)}, 200: 200, 201: 200, 210: 210, 211: 210, 300: 300}
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cycles_count_known_packages_alone(spark):
    own = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "fmt"), ("fmt", "b"), ("c", "c")], "src string, dst string")
    known = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "package string, boundary string")
    found = boundaries.cycles(own, known)
    assert sorted(map(tuple, found.collect())) == [("a", "a", 2), ("a", "b", 2), ("c", "c", 1)]
    shown = boundaries.cycle_violations(found, known, shown=1).orderBy("package").collect()
    assert [tuple(r) for r in shown] == [("cycle", "a", "and 1 more", "x", ""), ("cycle", "c", "", "y", "")]


def commits_of(spark, commits):
    rows = [(str(k), 1_000_000 + k, p) for k, paths in enumerate(commits) for p in paths]
    return spark.createDataFrame(rows, "commit string, s long, path string").select("commit", F.timestamp_seconds("s").alias("at"), "path").repartition(3)


@pytest.mark.parametrize("block", [1, 3, 7, 500])
def test_pairs_do_not_depend_on_blocks(spark, block):
    r = random.Random(5)
    commits = [[f"p{r.randrange(40):02}" for _ in range(r.choice([1, 2, 5, 30]))] for _ in range(30)]
    got = {(x["a"], x["b"]): (x["shared"], x["commits_a"], x["commits_b"], x["coupling"]) for x in coupling.pairs(commits_of(spark, commits), 2, 0.2, block_paths=block).collect()}
    each, shared = {}, {}
    for own in map(set, commits):
        for p in own:
            each[p] = each.get(p, 0) + 1
        for a, b in combinations(sorted(own), 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    want = {(a, b): (n, each[a], each[b], n / min(each[a], each[b])) for (a, b), n in shared.items() if n >= 2 and n / min(each[a], each[b]) >= 0.2}
    assert got == want and want


def test_a_sweeping_commit_is_many_tasks(spark):
    """Two commits of 20,000 paths, of which 1,200 change often enough: no key of the join has more than a small part."""
    paths = [f"p{i:05}" for i in range(20_000)]
    often = commits_of(spark, [paths[:1_200]] * 1)
    frame = often.unionByName(commits_of(spark, [[], paths, paths])).unionByName(spark.range(0).select(F.lit("x").alias("commit"), F.current_timestamp().alias("at"), F.lit("y").alias("path")))
    each = coupling.touched(frame)
    totals = each.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    left, right = coupling._grid(each.join(totals, "path"), 100)
    met = left.join(right, ["commit", "low", "high"]).groupBy("commit", "low", "high").count()
    rows = [x["count"] for x in met.collect()]
    assert len(rows) == 3 * 12 * 13 // 2 and max(rows) < 0.02 * sum(rows)
    assert coupling.pairs(frame, 3, 0.5, block_paths=100).count() == 1_200 * 1_199 // 2
