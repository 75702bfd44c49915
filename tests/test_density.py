"""Density clusters against a brute-force tree over all pairs."""

import math
import random

import pytest
from impactlake.operators import density, topics


def brute(rows, least, k):
    """{row: (cluster as the frozenset of its rows or None, probability)} and the tree's edges, from all pairs of points."""
    places = {}
    for i, x in rows:
        places.setdefault(tuple(x), []).append(i)
    points = sorted((sorted(v), x) for x, v in places.items())
    m = [len(p[0]) for p in points]
    n = len(points)
    d = [[math.sqrt(sum((a - b) * (a - b) for a, b in zip(points[i][1], points[j][1]))) for j in range(n)] for i in range(n)]
    core = []
    for i in range(n):
        away = sorted(d[i][j] for j in range(n) for _ in range(m[j] - (i == j)))
        core.append(away[k - 1] if len(away) >= k else away[-1] if away else 0.0)
    edges = sorted((max(d[i][j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    comp, trees, tree = list(range(n)), {i: ("leaf", i) for i in range(n)}, []
    for w, i, j in edges:
        a, b = comp[i], comp[j]
        if a != b:
            comp = [a if c == b else c for c in comp]
            trees[a] = ("merge", w, trees[a], trees[b])
            tree.append((i, j, w))
    members = lambda t: [t[1]] if t[0] == "leaf" else members(t[2]) + members(t[3])
    count = lambda t: sum(m[i] for i in members(t))
    dense = lambda w: 1 / max(w, 1e-12)

    def cluster(t, birth):
        """(stability, last density, rows that leave with their densities, clusters within)"""
        leaves, within, mass, all_rows, last = [], [], 0.0, count(t), 0.0
        while True:
            if t[0] == "leaf":
                at, gone, rest = dense(core[t[1]]), [t[1]], None
            else:
                at = dense(t[1])
                sides = sorted((t[2], t[3]), key=count)
                if count(sides[0]) >= least:
                    within = [cluster(s, at) for s in sides]
                    mass += at * count(t)
                    last = max(last, at)
                    break
                gone = members(sides[0]) + (members(sides[1]) if count(sides[1]) < least else [])
                rest = sides[1] if count(sides[1]) >= least else None
            leaves += [(i, at) for i in gone]
            mass += at * sum(m[i] for i in gone)
            last = max(last, at)
            if rest is None:
                break
            t = rest
        return mass - birth * all_rows, last, leaves, within

    def every(c):
        return c[2] + [x for w in c[3] for x in every(w)]

    def taken(c):
        """(stability, clusters taken)"""
        sub = [taken(w) for w in c[3]]
        below = sum(s[0] for s in sub)
        return (c[0], [c]) if c[0] >= below else (below, [x for s in sub for x in s[1]])

    out = {i: (None, 0.0) for p in points for i in p[0]}
    whole = trees[comp[0]]
    if n > 1 and count(whole) >= least:
        for c in [x for w in cluster(whole, 0.0)[3] for x in taken(w)[1]]:
            own = every(c)
            name = frozenset(r for i, _ in own for r in points[i][0])
            for i, at in own:
                for r in points[i][0]:
                    out[r] = (name, min(at / c[1], 1.0))
    return out, tree


def data(seed, n, dims=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(0, 10) for _ in range(dims)] for _ in range(5)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15:
            x = [rng.uniform(0, 10) for _ in range(dims)]
        elif kind < 0.3 and out:
            x = rng.choice(out)[1]  # a copy
        else:
            c = rng.choice(centres)
            x = [v + rng.gauss(0, 0.2 + 0.2 * centres.index(c)) for v in c]
        out.append((i * 3 + 1, x))
    return out


def same(got, want):
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["idx"])
    by = {c: frozenset(v) for c, v in groups.items() if c != -1}
    assert {r["idx"]: by.get(r["cluster"]) for r in got} == {i: c for i, (c, _) in want.items()}
    assert all(abs(r["probability"] - want[r["idx"]][1]) < 1e-9 for r in got)
    assert sorted(by) == list(range(len(by)))
    sizes = [(-len(by[c]), min(by[c])) for c in sorted(by)]
    assert sizes == sorted(sizes)


@pytest.mark.parametrize("seed,n,least,k,cells,rows", [(1, 500, 10, 5, 20, 1_000_000), (2, 160, 4, 4, 3, 60)])
def test_clusters(spark, seed, n, least, k, cells, rows):
    own = data(seed, n)
    want, tree = brute(own, least, k)
    assert len({c for c, _ in want.values()}) > 2
    df = spark.createDataFrame(own, "idx long, x array<double>")
    same(density.density_clusters(df, "idx", "x", least, k, cells, rows).collect(), want)


def test_tree_between_far_groups(spark):
    """Lists of one neighbour hold few of the tree's edges: the others are found by searching cells."""
    own = [(i, [float(i % 7) * 100 + (i // 7) ** 1.5, float(i // 7) ** 1.3]) for i in range(70)]
    want = brute(own, 5, 1)[1]
    points = spark.createDataFrame([(i, x, 1) for i, x in own], "id long, x array<double>, m long")
    cores, lists, *rest = density.neighbour_lists(points, 1, 6)
    got = density.spanning_tree(cores, lists, *rest).collect()
    at = {i: own.index(r) for i, r in enumerate(sorted(own, key=lambda r: r[0]))}
    assert {(at[r["lo"]], at[r["hi"]]) for r in got} == {(i, j) for i, j, _ in want}


def test_small_and_odd_tables(spark):
    schema = "idx long, x array<double>, cluster string"
    run = lambda rows, **more: sorted(tuple(r) for r in density.density_clusters(spark.createDataFrame(rows, schema), least=3, cells=4, **more).collect())
    assert run([]) == []
    assert run([(1, [1.0], "a"), (2, None, "b"), (3, [], "c"), (4, [float("nan")], "d"), (5, [None], "e"), (6, [float("inf")], "f")]) == [(1, -1, 0.0)]
    assert run([(i, [2.0, 0.0], None) for i in range(6)]) == [(i, -1, 0.0) for i in range(6)]  # the whole is no cluster
    two = run([(i, [float(i % 2) * 9, 1.0], None) for i in range(8)])
    assert two == [(i, i % 2, 1.0) for i in range(8)]
    assert run([(1, [0.0], None), (2, [-0.0], None), (3, [5.0], None)]) == [(1, -1, 0.0), (2, -1, 0.0), (3, -1, 0.0)]


def test_topics(spark):
    """Three groups of documents and two far ones."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(9 * (i % 3 == j), 0.1) for j in range(6)]) for i in range(36)] + [(90, [40.0] * 6), (91, [-40.0] * 6), (92, None)]
    df = spark.createDataFrame(rows, "idx long, embedding array<double>")
    got = {r["idx"]: r["topic"] for r in topics.density_topics(df, least=5, dims=2, cells=6).collect()}
    assert got.pop(90) == got.pop(91) == -1 and 92 not in got
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in got)
    with pytest.raises(ValueError):
        topics.density_topics(df.limit(3))


def test_cells_grow_with_the_table(spark):
    """however many parts the driver's points give, no cell has over `size` points."""
    own = data(5, 300)
    points = spark.createDataFrame(sorted({(tuple(x)) for _, x in own}), "a double, b double, c double").selectExpr("row_number() over (order by a, b, c) - 1L id", "array(a, b, c) x", "1L m")
    cores, lists, *_ = density.neighbour_lists(points, 4, 3, 24)
    sizes = [r["count"] for r in cores.groupBy("cell").count().collect()]
    assert max(sizes) <= 24 and sum(sizes) == points.count()
    xs = {r["id"]: r["x"] for r in points.collect()}
    got = {}
    for r in lists.collect():
        got.setdefault(r["a"], []).append((r["d"], r["b"]))
    for i, x in xs.items():
        square = lambda y, c: (x[c] - y[c]) * (x[c] - y[c])
        away = sorted((math.sqrt(square(y, 0) + square(y, 1) + square(y, 2)), j) for j, y in xs.items() if j != i)  # sum() of floats adds otherwise
        assert sorted(got[i]) == [v for v in away if v[0] <= away[3][0]]
    same(density.density_clusters(spark.createDataFrame(own, "idx long, x array<double>"), "idx", "x", 5, 4, 3, size=24).collect(), brute(own, 5, 4)[0])


def test_deep_trees_take_no_job_a_level(spark, monkeypatch):
    """each group is farther off than the one before, so clusters lie 24 deep; the tables written do not grow with that."""
    own = [(3 * i + j, [5 * 1.3**i + 0.01 * j * (i + 1) ** 0.5]) for i in range(25) for j in range(3)]
    points = spark.createDataFrame([(i, x, 1) for i, x in own], "id long, x array<double>, m long")
    cores, lists, *rest = density.neighbour_lists(points, 2, 4)
    merges = density.merge_tree(density.spanning_tree(cores, lists, *rest), cores)
    written, saved = [], density.saved
    monkeypatch.setattr(density, "saved", lambda df, name: written.append(name) or saved(df, name))
    rows = {r["id"]: (r["cluster"], r["probability"]) for r in density.condensed(merges, cores, 3).collect()}
    assert len(written) < 40
    assert rows == {r["id"]: (r["cluster"], r["probability"]) for r in density.condensed(merges, cores, 3, 7).collect()}  # several pieces
    want = brute(own, 3, 2)[0]
    assert len({c for c, _ in want.values()}) > 5
    named = {}
    for i, (c, _) in rows.items():
        named.setdefault(c, set()).add(i)
    assert all((want[i][0] is None) if c is None else (want[i][0] == named[c] and abs(want[i][1] - p) < 1e-9) for i, (c, p) in rows.items())
