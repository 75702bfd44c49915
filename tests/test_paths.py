"""Sampled betweenness against the exact measure."""

import random

import pytest

from impactlake.operators import graph
from impactlake.operators.paths import sampled_betweenness, samples_needed


def _tables(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "idx long"), spark.createDataFrame(edges, "src long, dst long")


def _values(df):
    return {r["idx"]: r["betweenness"] for r in df.collect()}


def test_bound():
    assert samples_needed(10**6, 0.05, 0.1) == 4461
    assert samples_needed(10**6, 0.05, 0.1, diameter=10) < samples_needed(10**6, 0.05, 0.1)
    assert samples_needed(10**6, 0.01, 0.1) > 24 * samples_needed(10**6, 0.05, 0.1)


@pytest.mark.parametrize("blocks", [1, 3])
def test_within_the_bound(spark, blocks):
    rng = random.Random(5)
    n = 300
    hub = [(i, 0) for i in range(1, 120)] + [(0, i) for i in range(60, 200)]
    some = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)]
    nodes, edges = _tables(spark, n, hub + some + some[:5] + [(7, 7)])
    exact = _values(graph.betweenness(nodes, edges))
    r = samples_needed(n, 0.2, 0.1)
    assert r < n
    got = _values(sampled_betweenness(nodes, edges, epsilon=0.2, rows_at_once=-(-n * r // blocks)))
    assert set(got) == set(exact) and exact[0] > 0.2
    assert max(abs(got[i] - exact[i]) for i in exact) <= 0.2
    assert all(exact[i] > 0 for i in got if got[i] > 0)


def test_paths_are_drawn_in_proportion(spark):
    # from 0 to 5..: one way through 1, three ways through 2; every pair of them goes through 1 or 2
    n = 400
    mid = [(0, 1), (0, 2), (1, 3), (2, 6), (2, 7), (2, 8), (6, 9), (7, 9), (8, 9), (3, 9)]
    tail = [(9, i) for i in range(10, n)] + [(i, 0) for i in range(10, n)]
    nodes, edges = _tables(spark, n, mid + tail)
    exact = _values(graph.betweenness(nodes, edges))
    got = _values(sampled_betweenness(nodes, edges, epsilon=0.15, delta=0.1))
    assert max(abs(got[i] - exact[i]) for i in exact) <= 0.15
    assert got[2] > 2 * got[1] > 0
    assert abs(got[1] + got[2] - got[0]) < 0.1


def test_small_and_unconnected(spark):
    nodes, edges = _tables(spark, 5, [(0, 1), (1, 2)])
    assert _values(sampled_betweenness(nodes, edges)) == _values(graph.betweenness(nodes, edges)) == {0: 0.0, 1: 1 / 12, 2: 0.0, 3: 0.0, 4: 0.0}
    nodes, edges = _tables(spark, 200, [(0, 1)])
    assert set(_values(sampled_betweenness(nodes, edges, epsilon=0.3)).values()) == {0.0}
    nodes, edges = _tables(spark, 2, [(0, 1)])
    assert _values(sampled_betweenness(nodes, edges)) == {0: 0.0, 1: 0.0}


def test_pairs_walk_from_both_ends(spark, monkeypatch):
    """A pair on a long way off a tree with many leaves sees few nodes, and the path is the right one."""
    from impactlake.operators import paths
    from impactlake.sources.shared import dealt

    # 0 -> 1 -> .. -> 6 -> 7 and a second way 3 -> 8 -> 5; 1 has 300 leaves besides, and 300 nodes lead to 6
    edges = [(i, i + 1) for i in range(7)] + [(3, 8), (8, 5)] + [(1, i) for i in range(100, 400)] + [(i, 6) for i in range(500, 800)]
    e = spark.createDataFrame(edges, "at long, to long")
    ahead = lambda t: t.join(t.groupBy(t["at"].alias("to")).count().withColumnRenamed("count", "ahead"), "to", "left").fillna(0, ["ahead"]).select("at", "to", "ahead")
    ways = [dealt(ahead(t), "ways", "at") for t in (e, e.select(e["to"].alias("at"), e["at"].alias("to")))]
    pairs = spark.createDataFrame([(s, 0, 7) for s in range(64)] + [(64, 7, 0), (65, 0, 1), (66, 100, 0), (67, 2, 5)], "s long, u long, v long")
    found, visited = paths._inner_nodes(pairs, ways, 3)
    n = {r["id"]: r["n"] for r in found.collect()}
    assert {i: n.get(i) for i in (1, 2, 3, 5, 6)} == {1: 64, 2: 64, 3: 65, 5: 64, 6: 64} and n[4] + n[8] == 65 and 16 < n[4] < 48 and set(n) == {1, 2, 3, 4, 5, 6, 8}
    star = spark.createDataFrame([(0, 100, 900)], "s long, u long, v long")
    assert paths._inner_nodes(star, ways, 3) == (None, 0)
