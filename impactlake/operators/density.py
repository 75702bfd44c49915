"""Density clusters with outliers: core distances, a minimum spanning tree in Boruvka rounds, a condensed tree with stabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impactlake.operators.dedupe import with_index
from impactlake.sources.shared import forget, saved

#: Distances of boxes and of points may differ in the last digits.
SLACK = 1e-9
#: The least distance that counts, so that no density is infinite.
LEAST = 1e-12


#: Rows that ask one cell at once, and rows of a block of distances.
ASKED, BLOCK = 16384, 256


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row a vector."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * x.shape[1]), pa.array(x.ravel()))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each x to each y; squares are added in the order of the components."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        away = x[:, j : j + 1] - y[None, :, j]
        total += away * away
    return np.sqrt(total)


def _gaps(low: np.ndarray, high: np.ndarray, boxes: tuple) -> np.ndarray:
    """The distance from each box (low, high; a point is a box) to each box of cells."""
    total = np.zeros((len(low), len(boxes[0])))
    for j in range(low.shape[1]):
        away = np.maximum(np.maximum(boxes[1][None, :, j] - high[:, j : j + 1], low[:, j : j + 1] - boxes[2][None, :, j]), 0.0)
        total += away * away
    return np.sqrt(total)


def _split(sample: np.ndarray, parts: int) -> list[tuple]:
    """A tree of at most `parts` leaves over halves of the sample by its widest component: (axis, at, below, above), or (-1, leaf, 0, 0)."""
    nodes: list = [None]
    todo, leaves = [(0, sample, parts)], 0
    while todo:
        i, x, n = todo.pop()
        axis = int(np.argmax(x.max(axis=0) - x.min(axis=0))) if len(x) else 0
        values = np.unique(x[:, axis])
        if n < 2 or len(values) < 2:
            nodes[i], leaves = (-1, float(leaves), 0, 0), leaves + 1
            continue
        at = min(np.quantile(x[:, axis], (n // 2) / n, method="lower"), values[-2])
        nodes[i] = (axis, float(at), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), x[x[:, axis] <= at], n // 2), (len(nodes) + 1, x[x[:, axis] > at], n - n // 2)]
        nodes += [None, None]
    return nodes


def _halves(x: np.ndarray, most: int) -> np.ndarray:
    """The number of each row's part: halves of halves by the widest component, until none has over `most` rows."""
    out, todo, n = np.zeros(len(x), dtype="int64"), [np.arange(len(x))], 0
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out[rows], n = n, n + 1
            continue
        axis = int(np.argmax(x[rows].max(axis=0) - x[rows].min(axis=0)))
        rows = rows[np.argsort(x[rows, axis], kind="stable")]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def _celled(points: DataFrame, cells: int, size: int) -> tuple[DataFrame, tuple, list]:
    """Points (id, x, m, cell), written, in cells of near points, `size` at most; the cells' numbers and boxes; some points' ids, the pivots.

    The points of the least hashes, 16 a part and 16 * `cells` at most, come to the driver and give up to `cells` parts. A
    task cuts a part into cells at its own medians, so cells are as many as the table asks for. The boxes are on the driver, a row a cell.
    """
    parts = max(1, min(cells, -(-2 * points.count() // size)))
    found = points.orderBy(F.xxhash64("id"), "id").limit(16 * max(parts, 16)).select("id", "x").collect()
    sample = np.array([r["x"] for r in found], dtype=float)
    nodes = _split(sample, parts)
    axis, at, below, above = (np.array(c) for c in zip(*nodes))

    def part(batches):
        for b in batches:
            x = _matrix(pa.chunked_array([b.column("x")]))
            node = np.zeros(len(x), dtype="int64")
            while len(inner := np.nonzero(axis[node] >= 0)[0]):
                v = node[inner]
                node[inner] = np.where(x[inner, axis[v]] > at[v], above[v], below[v])
            yield b.append_column("part", pa.array(at[node].astype("int64")))

    def cut(t: pa.Table) -> pa.Table:
        number = t.column("part").to_numpy() * 2**32 + _halves(_matrix(t.column("x")), size)
        return t.drop_columns("part").append_column("cell", pa.array(number))

    parted = points.select("id", "x", "m").mapInArrow(part, "id long, x array<double>, m long, part long")
    out = saved(parted.groupBy("part").applyInArrow(cut, "id long, x array<double>, m long, cell long"), "points")
    ends = [f(F.col("x")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(sample.shape[1])]
    rows = out.groupBy("cell").agg(*ends).orderBy("cell").collect()  # a row a cell
    return out, (np.array([r["cell"] for r in rows]), *np.hsplit(np.array([tuple(r)[1:] for r in rows]), 2)), [r["id"] for r in found[:1024]]


def _reached(x: np.ndarray, bound: np.ndarray, boxes: tuple, skip=None):
    """Blocks (rows, cells) of the points of one cell with each cell that may hold a point within their bounds; skip(rows, cells) are left out."""
    limit = bound * (1 + SLACK) + SLACK
    near = np.nonzero(_gaps(x.min(axis=0)[None], x.max(axis=0)[None], boxes)[0] <= limit.max())[0]
    some = tuple(b[near] for b in boxes)
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        inside = _gaps(part, part, some) <= limit[i : i + BLOCK, None]
        if skip is not None:
            inside &= ~skip(np.arange(i, i + len(part)), near)
        row, cell = np.nonzero(inside)
        yield i + row, boxes[0][near[cell]]


def _met(visits: DataFrame, points: DataFrame, meet, schema: str) -> DataFrame:
    """meet(visits, points) for each cell and at most some ASKED of its visits (written, with at); points has cell."""
    slices = visits.groupBy("at").agg(F.ceil(F.count("*") / ASKED).alias("slices"))  # a row a cell
    asking = visits.join(F.broadcast(slices), "at").withColumn("slice", F.pmod(F.xxhash64("id"), "slices")).drop("slices")
    asked = points.withColumnRenamed("cell", "at").join(F.broadcast(slices), "at").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    return asking.groupBy("at", "slice").cogroup(asked.groupBy("at", "slice")).applyInArrow(meet, schema)


def neighbour_lists(points: DataFrame, k: int, cells: int = 1024, size: int = 2048) -> tuple[DataFrame, DataFrame, tuple, list]:
    """Exact lists of the k nearest other points, all of them at the last distance kept, and each point's core distance.

    points: id, x (array<double>), m (copies), no two at one place. Gives (id, x, m, cell, core, listed: the list's
    last distance, infinite if it holds all) and (a, b, d), both written, the boxes of the cells and the pivots. A
    point meets its own cell first; the k-th distance there bounds which other cells it visits. The core distance
    is the least that holds k other rows, copies counted.
    """
    at, boxes, pivot_ids = _celled(points, cells, max(size, 4 * k))

    def visit(t: pa.Table) -> pa.Table:
        x, bound = _matrix(t.column("x")), np.full(len(t), np.inf)
        for i in range(0, len(x) if len(x) > k else 0, BLOCK):
            d = _distances(x[i : i + BLOCK], x)
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            bound[i : i + BLOCK] = np.partition(d, k - 1, axis=1)[:, k - 1]
        row, cell = (np.concatenate(c) for c in zip(*_reached(x, bound, boxes)))
        return pa.table({"id": t.column("id").take(row), "x": _vectors(x[row]), "m": t.column("m").take(row), "bound": bound[row], "at": cell})

    def meet(asking: pa.Table, asked: pa.Table) -> pa.Table:
        x, y, bound = _matrix(asking.column("x")), _matrix(asked.column("x")), asking.column("bound").to_numpy()
        ids, others, out = asking.column("id").to_numpy(), asked.column("id").to_numpy(), []
        for i in range(0, len(x) if len(y) else 0, BLOCK):
            d = _distances(x[i : i + BLOCK], y)
            d[ids[i : i + BLOCK, None] == others] = np.nan
            near = d <= bound[i : i + BLOCK, None]
            many = np.nonzero(near.sum(axis=1) > k)[0]
            if len(many):
                near[many] &= d[many] <= np.partition(d[many], k - 1, axis=1)[:, k - 1 : k]  # nan comes last
            row, col = np.nonzero(near)
            out.append((i + row, col, d[row, col]))
        row, col, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        return pa.table({"id": asking.column("id").take(row), "b": asked.column("id").take(col), "m": asking.column("m").take(row), "mb": asked.column("m").take(col), "d": d})

    visits = saved(at.groupBy("cell").applyInArrow(visit, "id long, x array<double>, m long, bound double, at long"), "visits")
    pairs = _met(visits, at, meet, "id long, b long, m long, mb long, d double")
    rank = Window.partitionBy("id").orderBy("d")
    lists = saved(pairs.withColumn("k", F.rank().over(rank)).filter(F.col("k") <= k).drop("k"), "lists")
    held = F.col("m") - 1 + F.sum("mb").over(Window.partitionBy("id").orderBy("d"))
    cores = lists.withColumn("held", held).groupBy("id").agg(F.min(F.when(F.col("held") >= k, F.col("d"))).alias("core"), F.max("d").alias("last"), F.count("*").alias("n"))
    core = F.when(F.col("m") > k, 0.0).otherwise(F.coalesce("core", "last", F.lit(0.0)))
    out = at.join(cores, "id", "left").select("id", "x", "m", "cell", core.alias("core"), F.when(F.col("n") >= k, F.col("last")).otherwise(float("inf")).alias("listed"))
    out = saved(out, "cores")
    forget(at, visits)
    return out, lists.select(F.col("id").alias("a"), "b", "d"), boxes, pivot_ids


def _roots(pointers: DataFrame) -> DataFrame:
    """v, root (written): where pointers v -> to end, at a node that points to itself or nowhere; found by doubling."""
    at = saved(pointers.select("v", F.col("to").alias("root")), "roots")
    while True:
        up = at.select(F.col("v").alias("root"), F.col("root").alias("next"))
        moved = F.coalesce(F.col("next") != F.col("root"), F.lit(False))
        new = saved(at.select("v", "root").join(up, "root", "left").select("v", F.coalesce("next", "root").alias("root"), moved.alias("moved")), "roots")
        done = new.filter("moved").isEmpty()
        forget(at)
        at = new
        if done:
            return at.select("v", "root")


def _hooked(best: DataFrame) -> DataFrame:
    """v, root (written): nodes that hang together by each one's least edge best(v, to, o); two that chose one edge end at the smaller."""
    back = best.select(F.col("v").alias("to"), F.col("o").alias("back"))
    ends = F.when(F.col("o").eqNullSafe(F.col("back")) & (F.col("v") < F.col("to")), F.col("v")).otherwise(F.col("to"))
    return _roots(best.join(back, "to", "left").select("v", ends.alias("to")))


def spanning_tree(points: DataFrame, lists: DataFrame, boxes: tuple, pivot_ids: list) -> DataFrame:
    """lo, hi, w (written): the minimum spanning tree over max(distance, both core distances), ties by lo and hi.

    A component's least edge in the lists is its least of all if no member's list ends below it. Members whose list does
    end below search the cells for other components' points within the best bound known from the lists, or else from the pivots.
    The component with the most pivots may leave that out in a round: the others still find theirs.
    """
    cores = points.select("id", "core")
    crossing = lists.join(cores.select(F.col("id").alias("a"), F.col("core").alias("ka")), "a").join(cores.select(F.col("id").alias("b"), F.col("core").alias("kb")), "b")
    crossing = saved(crossing.select("a", "b", F.greatest("d", "ka", "kb").alias("w")), "edges")
    comp = saved(points.select("id", F.col("id").alias("comp")), "components")
    edge = F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "cb"))
    tree = None
    while True:
        named = crossing.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").filter("ca != cb")
        named = saved(named, "edges")
        best = saved(named.groupBy("ca").agg(edge.alias("x")), "best")
        at = saved(points.join(comp, "id"), "at")
        of_pivot = at.filter(F.col("id").isin(pivot_ids)).select("x", "comp", "core").collect()
        held = [r["comp"] for r in of_pivot]
        most = min(set(held), key=lambda c: (-held.count(c), c))
        unsure = at.join(best.select(F.col("ca").alias("comp"), F.col("x.w").alias("known")), "comp", "left").filter(F.col("known").isNull() | (F.col("listed") < F.col("known")))
        unsure = saved(unsure.select("id", "x", "cell", "core", "comp", "known"), "unsure")
        searched = unsure.filter(F.col("comp") != most)
        sure = best.join(unsure.select(F.col("comp").alias("ca")).distinct(), "ca", "left_anti")
        found, visits = _outside(searched, at, boxes, of_pivot, best, edge)
        chosen = saved(sure.unionByName(found).select(F.col("ca").alias("v"), F.col("x.cb").alias("to"), F.struct("x.w", "x.lo", "x.hi").alias("o")), "chosen")
        if chosen.isEmpty():
            break
        added = chosen.select("o.lo", "o.hi", "o.w").distinct()
        tree = saved(added if tree is None else tree.unionByName(added), "tree")
        root = _hooked(chosen)
        new = saved(comp.join(root, F.col("comp") == F.col("v"), "left").select("id", F.coalesce("root", "comp").alias("comp")), "components")
        forget(crossing, comp, best, unsure, at, visits)
        crossing, comp = named.select("a", "b", "w"), new
        crossing._saved_path = named._saved_path
    return tree


def _outside(searched: DataFrame, at: DataFrame, boxes: tuple, pivots: list, best: DataFrame, edge) -> tuple[DataFrame, DataFrame]:
    """ca, x: the least edge out of each component of searched, among all points. Also a written table that it reads."""
    x, core, held = np.array([r["x"] for r in pivots]), np.array([r["core"] for r in pivots]), np.array([r["comp"] for r in pivots])

    def nearest(batches):
        for b in batches:
            for part in (b.iloc[i : i + BLOCK] for i in range(0, len(b), BLOCK)):
                w = np.maximum(np.maximum(_distances(np.stack(part["x"]), x), core), part["core"].to_numpy()[:, None])
                w[part["comp"].to_numpy()[:, None] == held] = np.inf
                yield pd.DataFrame({"comp": part["comp"].to_numpy(), "far": w.min(axis=1)})

    far = searched.filter("known is null").select("x", "core", "comp").mapInPandas(nearest, "comp long, far double").groupBy("comp").agg(F.min("far").alias("far"))
    asked = searched.join(far, "comp", "left").withColumn("bound", F.coalesce("known", "far", F.lit(float("inf")))).filter(F.col("core") <= F.col("bound"))
    alone = {r["cell"]: r["comp"] for r in at.groupBy("cell").agg(F.min("comp").alias("comp"), F.max("comp").alias("last")).filter("comp = last").collect()}  # a row a cell
    only = np.array([alone.get(c, -1) for c in boxes[0].tolist()])

    def visit(t: pa.Table) -> pa.Table:
        x, bound, comp = _matrix(t.column("x")), t.column("bound").to_numpy(), t.column("comp").to_numpy()
        row, cell = (np.concatenate(c) for c in zip(*_reached(x, bound, boxes, lambda rows, cells: comp[rows, None] == only[cells])))
        return t.select(["id", "core", "comp", "bound"]).take(row).append_column("x", _vectors(x[row])).append_column("at", pa.array(cell))

    def meet(asking: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("id")  # so the first of equal edges is the least
        x, y = _matrix(asking.column("x")), _matrix(asked.column("x"))
        a, ka, ca, bound = (asking.column(c).to_numpy() for c in ("id", "core", "comp", "bound"))
        b, kb, cb = (asked.column(c).to_numpy() for c in ("id", "core", "comp"))
        out = [(np.zeros(0, "int64"), np.zeros(0), *[np.zeros(0, "int64")] * 3)]
        for i in range(0, len(x) if len(y) else 0, BLOCK):
            rows = slice(i, i + BLOCK)
            w = np.maximum(np.maximum(_distances(x[rows], y), ka[rows, None]), kb)
            w[ca[rows, None] == cb] = np.inf
            to = w.argmin(axis=1)
            w = w[np.arange(len(w)), to]
            k = np.nonzero((w <= bound[rows]) & (w < np.inf))[0]
            to, own = to[k], a[rows][k]
            out.append((ca[rows][k], w[k], np.minimum(own, b[to]), np.maximum(own, b[to]), cb[to]))
        ca, w, lo, hi, cb = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((hi, lo, w, ca))
        order = order[np.unique(ca[order], return_index=True)[1]]
        return pa.table({"ca": ca[order], "w": w[order], "lo": lo[order], "hi": hi[order], "cb": cb[order]})

    visits = asked.select("id", "x", "core", "comp", "bound", "cell").groupBy("cell").applyInArrow(visit, "id long, core double, comp long, bound double, x array<double>, at long")
    visits = saved(visits, "visits")
    pairs = _met(visits, at.select("id", "x", "core", "comp", "cell"), meet, "ca long, w double, lo long, hi long, cb long").select("ca", F.struct("w", "lo", "hi", "cb").alias("x"))
    # a component's least listed edge stays a candidate beside those of its members that searched
    every = pairs.unionByName(best.join(searched.select(F.col("comp").alias("ca")).distinct(), "ca", "left_semi").select("ca", "x"))
    return every.groupBy("ca").agg(F.min("x").alias("x")), visits


def _components(edges: DataFrame) -> DataFrame:
    """v, root (written) of the forest edges(a, b, rank)."""
    member, rest = None, edges
    while True:
        both = rest.select("a", "b", "rank").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank"))
        best = both.groupBy(F.col("a").alias("v")).agg(F.min(F.struct("rank", "b")).alias("x")).select("v", F.col("x.b").alias("to"), F.col("x.rank").alias("o"))
        step = _hooked(saved(best, "best"))
        member = step if member is None else saved(member.join(step.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root")), "members")
        to = lambda c: step.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root"))
        rest = saved(rest.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"), "rank").filter("a != b"), "rest")
        if rest.isEmpty():
            return member


def merge_tree(tree: DataFrame, points: DataFrame, rows_at_once: int = 1_000_000) -> DataFrame:
    """node, left, right, w, left_rows, right_rows: what each edge of the tree joins when they come by w, lo and hi.

    tree: lo, hi, w over points (id from 0 to n - 1, m). A point's node is its id, the node of the i-th edge is n + i. The
    edges' order is halved until a piece has rows_at_once edges at most; an upper half sees the lower one's components as
    single nodes, each named by its last edge. A task then joins one piece's edges one by one.
    """
    n = points.count()
    edges = saved(with_index(tree.select("lo", "hi", "w"), ["w", "lo", "hi"], "rank").select("rank", F.col("lo").alias("a"), F.col("hi").alias("b"), "w"), "edges")
    rows = points.select(F.col("id").alias("v"), F.col("m").alias("rows"))
    size = 1
    while size < n - 1:
        size *= 2
    while size > rows_at_once:
        upper = F.pmod(F.floor(F.col("rank") / (size // 2)), F.lit(2)) == 1
        low = edges.filter(~upper)
        member = _components(low)
        last = low.join(member, F.col("a") == F.col("v")).groupBy("root").agg((F.max("rank") + n).alias("name"))
        name = saved(member.join(last, "root").select("v", "name"), "names")
        rows = saved(rows.unionByName(name.join(rows, "v").groupBy(F.col("name").alias("v")).agg(F.sum("rows").alias("rows"))).distinct(), "rows")  # a component may keep its name through several halvings
        to = lambda c: name.select(F.col("v").alias(c), F.col("name").alias(f"{c}_name"))
        moved = edges.filter(upper).join(to("a"), "a", "left").join(to("b"), "b", "left").select("rank", F.coalesce("a_name", "a").alias("a"), F.coalesce("b_name", "b").alias("b"), "w")
        edges = saved(low.unionByName(moved), "edges")
        size //= 2

    def join(piece: pd.DataFrame) -> pd.DataFrame:
        top: dict = {}
        held: dict = {}
        node: dict = {}

        def find(v):
            while top.setdefault(v, v) != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        out = []
        for r in piece.sort_values("rank").itertuples():
            a, b = find(r.a), find(r.b)
            left, right = (node.get(a, a), held.get(a, r.a_rows)), (node.get(b, b), held.get(b, r.b_rows))
            out.append((n + r.rank, left[0], right[0], r.w, left[1], right[1]))
            top[b] = a
            node[a], held[a] = n + r.rank, left[1] + right[1]
        return pd.DataFrame(out, columns=["node", "left", "right", "w", "left_rows", "right_rows"])

    of = lambda c: rows.select(F.col("v").alias(c), F.col("rows").alias(f"{c}_rows"))
    ready = edges.join(of("a"), "a").join(of("b"), "b").withColumn("piece", F.floor(F.col("rank") / size))
    return saved(ready.groupBy("piece").applyInPandas(join, "node long, left long, right long, w double, left_rows long, right_rows long"), "merges")


def condensed(merges: DataFrame, points: DataFrame, least: int, rows_at_once: int = 1_000_000) -> DataFrame:
    """id, cluster (a node, null for outliers), probability: the clusters of most stability, the whole never one of them.

    A merge of two sides of at least `least` rows begins two clusters, from its density (1 / w) on; smaller sides are
    rows that leave a cluster. Stability: the sum over rows of the density at which they leave less that of the beginning.
    A cluster is taken unless the clusters within have more in sum. Probability: the density at which a row
    leaves, over the greatest at which any leaves the cluster itself, 1 at most. Copies leave together; `least` of them are a cluster at their core distance.
    Nodes are numbered in the order of merges, so a cluster comes after those within: pieces of rows_at_once clusters in
    that order are judged one by one, a task a piece, and the depth of the tree does not matter.
    """
    dense = lambda c: 1 / F.greatest(c, F.lit(LEAST))
    side = lambda v, own, other: merges.select(F.col(v).alias("v"), F.col(own).alias("rows"), F.col(other).alias("beside"), F.col("node").alias("parent"), dense("w").alias("at"))
    up = saved(side("left", "left_rows", "right_rows").unionByName(side("right", "right_rows", "left_rows")), "sides")
    root = merges.agg(F.max("node")).first()[0]
    whole = merges.filter(F.col("node") == root).select((F.col("left_rows") + F.col("right_rows")).alias("rows")).first()["rows"]
    large = up.filter(F.col("rows") >= least)
    begins = F.col("beside") >= least
    ends = large.select("v", F.when(begins, F.col("v")).otherwise(F.col("parent")).alias("to")).unionByName(merges.filter((F.col("node") == root) & F.lit(whole >= least)).select(F.col("node").alias("v"), F.col("node").alias("to")))
    cluster = _roots(ends).select("v", F.col("root").alias("cluster"))
    first = _roots(up.filter(F.col("rows") < least).select("v", F.col("parent").alias("to"))).select("v", F.col("root").alias("large"))
    parents = cluster.select(F.col("v").alias("parent"), F.col("cluster").alias("of"))
    alone = points.filter(F.col("m") >= least).select(F.col("id").alias("v"), F.col("m").alias("rows"), dense("core").alias("at"))
    leave = up.filter((F.col("rows") < least) | begins).join(parents, "parent").select("of", "rows", "at").unionByName(alone.join(cluster.withColumnRenamed("cluster", "of"), "v").select("of", "rows", "at"))
    sums = leave.groupBy("of").agg(F.sum(F.col("rows") * F.col("at")).alias("mass"), F.max("at").alias("last"))
    born = large.filter(begins).join(parents, "parent").select(F.col("v").alias("c"), F.col("of").alias("parent"), F.col("rows").alias("size"), "at")
    clusters = born.join(sums, F.col("c") == F.col("of")).select("c", "parent", (F.col("mass") - F.col("size") * F.col("at")).alias("stability"), "last")
    clusters = saved(with_index(clusters, ["c"], "rank").withColumn("piece", F.floor(F.col("rank") / rows_at_once)).drop("rank"), "clusters")

    def judge(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("c")
        below, values, taken = dict(zip(piece["c"], piece["below"])), [], []
        for c, parent, stability in zip(piece["c"], piece["parent"], piece["stability"]):
            taken.append(stability >= below[c])
            values.append(max(stability, below[c]))
            if parent in below:
                below[parent] += values[-1]
        return piece[["c", "parent", "last"]].assign(value=values, taken=taken)

    done = None
    for i in range(-(-clusters.count() // rows_at_once)):
        own = clusters.filter(F.col("piece") == i)
        if done is None:
            own = own.withColumn("below", F.lit(0.0))
        else:
            given = done.groupBy(F.col("parent").alias("c")).agg(F.sum("value").alias("below"))
            own = own.join(given, "c", "left").fillna(0.0, ["below"])
        ready = saved(own.groupBy("piece").applyInPandas(judge, "c long, parent long, last double, value double, taken boolean"), "ready")
        done = ready if done is None else done.unionByName(ready)
    if done is None:
        return points.select("id", F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    top = saved(done.select("c", F.col("parent").alias("above"), F.when(F.col("taken"), F.col("c")).alias("top")), "tops")
    while not top.filter("above is not null").isEmpty():
        higher = top.select(F.col("c").alias("above"), F.col("above").alias("next"), F.col("top").alias("over"))
        top = saved(top.join(higher, "above", "left").select("c", F.col("next").alias("above"), F.coalesce("over", "top").alias("top")), "tops")
    leaves = points.select(F.col("id").alias("v"), "core", "m").join(first, "v", "left").withColumn("large", F.coalesce("large", "v"))
    leaves = leaves.join(cluster.select(F.col("v").alias("large"), "cluster"), "large", "left").join(merges.select(F.col("node").alias("large"), "w"), "large", "left")
    leaves = leaves.join(top.select(F.col("c").alias("cluster"), "top"), "cluster", "left").join(done.select(F.col("c").alias("top"), "last"), "top", "left")
    density = dense(F.coalesce("w", "core"))
    return leaves.select(F.col("v").alias("id"), F.col("top").alias("cluster"), F.when(F.col("top").isNotNull(), F.least(density / F.col("last"), F.lit(1.0))).otherwise(0.0).alias("probability"))


def density_clusters(rows: DataFrame, idx: str = "idx", vector: str = "x", least: int = 15, neighbours: int | None = None, cells: int = 1024, rows_at_once: int = 1_000_000, size: int = 2048) -> DataFrame:
    """idx, cluster (from 0, the largest first, ties by least idx; -1 for outliers), probability (0 for outliers).

    Hierarchical density clustering of Campello, Moulavi and Sander: at least `least` rows a cluster, core distances to
    the `neighbours`-th other row (`least` unless given). Exact, ties by the points' order. Equal vectors are one point
    with copies. Null or empty vectors and those with components that are null or not finite are left out; an empty
    table gives none. Vectors of few dimensions (a reduction's) suit it: boxes prune little in many. idx must be unique.
    16 * `cells` points and the cells' boxes are the only rows on the driver; a cell has `size` points at most, so work grows with the points times the cells that they visit.
    """
    k = neighbours or least
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    own = saved(rows.filter(F.col(vector).isNotNull()).filter(finite & (F.size(x) > 0)).select(F.col(idx).cast("long").alias("row"), F.transform(x, lambda v: v + 0.0).alias("x")), "rows")
    places = own.groupBy("x").agg(F.min("row").alias("row"), F.count("*").alias("m"))
    points = saved(with_index(places, ["row"], "id").select(F.col("id").cast("long").alias("id"), "x", "m", "row"), "places")
    if points.limit(2).count() < 2:
        return own.select(F.col("row").alias(idx), F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    cores, lists, boxes, pivot_ids = neighbour_lists(points.select("id", "x", "m"), k, cells, size)
    tree = spanning_tree(cores, lists, boxes, pivot_ids)
    found = saved(condensed(merge_tree(tree, cores, rows_at_once), cores, least, rows_at_once), "found")
    member = own.join(points.select("x", "id"), "x").join(found, "id").select("row", "cluster", "probability")
    sizes = member.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg((-F.count("*")).alias("n"), F.min("row").alias("row"))
    numbers = with_index(sizes, ["n", "row"], "number").select("cluster", "number")
    return member.join(numbers, "cluster", "left").select(F.col("row").alias(idx), F.coalesce(F.col("number").cast("long"), F.lit(-1).cast("long")).alias("cluster"), "probability")
