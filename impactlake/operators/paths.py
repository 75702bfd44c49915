"""Betweenness from sampled shortest paths, with a bound on the error of every node."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.operators.dedupe import with_index
from impactlake.operators.graph import betweenness
from impactlake.sources.shared import dealt, forget, saved


def samples_needed(nodes: int, epsilon: float, delta: float, diameter: int | None = None) -> int:
    """How many shortest paths keep all nodes' errors within epsilon with probability 1 - delta.

    The bound of Riondato and Kornaropoulos (2014): 0.5 / e**2 * (floor(log2(d - 2)) + 1 + ln(1 / delta)), where no
    shortest path has more than d nodes (all nodes unless a diameter is given) and e is epsilon as a share of all pairs
    of two nodes, while betweenness here is a share of those without the node itself.
    """
    d = max(min(diameter or nodes, nodes), 3)
    e = epsilon * (nodes - 2) / nodes
    return math.ceil(0.5 / e**2 * (math.floor(math.log2(max(d - 2, 1))) + 1 + math.log(1 / delta)))


def sampled_betweenness(nodes: DataFrame, edges: DataFrame, idx: str = "idx", epsilon: float = 0.05, delta: float = 0.1, diameter: int | None = None, seed: int = 42, rows_at_once: int = 20_000_000) -> DataFrame:
    """idx, betweenness: within epsilon of graph.betweenness() at all nodes with probability 1 - delta; 0 for repeated and unknown ends of edges as there.

    Pairs of nodes are drawn by seeded hashes. Frontiers walk from each pair's first node on and from its second node
    back, the one with fewer links to follow first, until they meet or one ends; one shortest path is drawn through a
    node where they met, its inner nodes count one. A pair without a path counts nothing. Links are dealt by either end
    once and not shuffled by a level. The first block of pairs has rows_at_once rows if each pair sees all nodes, the
    following ones by what pairs did see; each level is written. Where as many samples as nodes would be needed the
    exact measure costs less and is taken.
    """
    ids = saved(with_index(nodes.select(F.col(idx).cast("long").alias("id")).distinct(), ["id"], "rank"), "nodes")
    n = ids.count()
    if n <= 2:
        return ids.select(F.col("id").alias(idx), F.lit(0.0).alias("betweenness"))
    r = samples_needed(n, epsilon, delta, diameter)
    if r >= n:
        return betweenness(nodes, edges, idx, rows_at_once)
    follow = saved(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src != dst").distinct(), "edges")
    outs, ins = follow.groupBy(F.col("src").alias("to")).agg(F.count("*").alias("ahead")), follow.groupBy(F.col("dst").alias("to")).agg(F.count("*").alias("ahead"))
    # from a node to the next one, and how many links the next one has ahead; on (0) and back (1)
    ways = [
        dealt(follow.select(F.col("src").alias("at"), F.col("dst").alias("to")).join(outs, "to", "left").select("at", "to", F.coalesce("ahead", F.lit(0)).alias("ahead")), "ways", "at"),
        dealt(follow.select(F.col("dst").alias("at"), F.col("src").alias("to")).join(ins, "to", "left").select("at", "to", F.coalesce("ahead", F.lit(0)).alias("ahead")), "ways", "at"),
    ]
    drawn = lambda c, size, what: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(what)), F.lit(size))
    first, other = drawn("s", n, "from"), drawn("s", n - 1, "to")
    pairs = nodes.sparkSession.range(r).select(F.col("id").alias("s"), first.alias("u"), F.pmod(first + 1 + other, F.lit(n)).alias("v"))
    name = lambda c: ids.select(F.col("rank").alias(c), F.col("id").alias(f"{c}_id"))
    pairs = saved(pairs.join(name("u"), "u").join(name("v"), "v").select("s", F.col("u_id").alias("u"), F.col("v_id").alias("v")), "pairs")
    done, size, sums = 0, max(1, -(-rows_at_once // n)), None
    while done < r:
        passed, visited = _inner_nodes(pairs.filter((F.col("s") >= done) & (F.col("s") < done + size)), ways, seed)
        done, size = done + size, max(1, rows_at_once * min(size, r - done) // max(visited, 1))
        if passed is not None:
            total = saved(passed if sums is None else passed.unionByName(sums).groupBy("id").agg(F.sum("n").alias("n")), "sums")
            forget(passed, *([sums] if sums is not None else []))
            sums = total
    forget(pairs, follow, *ways)
    scale = n / (n - 2) / r
    if sums is None:
        return ids.select(F.col("id").alias(idx), F.lit(0.0).alias("betweenness"))
    return ids.join(sums, "id", "left").select(F.col("id").alias(idx), (F.coalesce("n", F.lit(0)) * F.lit(scale)).alias("betweenness"))


def _inner_nodes(pairs: DataFrame, ways: list[DataFrame], seed: int) -> tuple[DataFrame | None, int]:
    """id, n (written): how many of the pairs' drawn shortest paths a node lies inside of, None if it is none; and the nodes that were seen, once a pair and side."""
    kept = [saved(pairs.select("s", F.lit(0).alias("side"), F.col("u").alias("at"), F.lit(1.0).alias("paths"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("ahead")).unionByName(pairs.select("s", F.lit(1).alias("side"), F.col("v").alias("at"), F.lit(1.0).alias("paths"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("ahead"))), "front")]
    front, seen, visited = kept[0], kept[0].select("s", "side", "at", "paths", "depth"), 0
    met: list[DataFrame] = []
    while True:
        # both sides must have links to follow; a node of one level goes the way with fewer
        links = lambda side: F.sum(F.when(F.col("side") == side, F.col("ahead")))
        turn = front.groupBy("s").agg(links(0).alias("on"), links(1).alias("back")).filter((F.col("on") > 0) & (F.col("back") > 0)).select("s", (F.col("on") > F.col("back")).cast("int").alias("turn"))
        held = saved(front.join(turn, "s"), "held")
        steps = [held.filter((F.col("turn") == side) & (F.col("side") == side)).join(ways[side], "at").select("s", "side", F.col("to").alias("at"), "paths", "depth", ways[side]["ahead"]) for side in (0, 1)]
        step = steps[0].unionByName(steps[1]).groupBy("s", "side", "at").agg(F.sum("paths").alias("paths"), (F.max("depth") + 1).alias("depth"), F.first("ahead").alias("ahead"))
        new = saved(step.join(seen, ["s", "side", "at"], "left_anti"), "front")
        kept.append(new)
        rows = new.count()
        visited += rows
        if not rows:
            forget(held)
            break
        # sides that met for the first time did so on the last levels of both, and in all nodes that shortest paths share there
        resting = held.filter("side != turn")
        both = saved(new.join(resting.select("s", "at", F.col("paths").alias("other_paths"), F.col("depth").alias("other_depth")), ["s", "at"]), "met")
        met.append(both)
        front = saved(new.unionByName(resting.select(new.columns)).join(both.select("s"), "s", "left_anti"), "held")
        forget(held)
        kept.append(front)
        seen = seen.unionByName(new.select("s", "side", "at", "paths", "depth"))
    every = met[0] if met else None
    for more in met[1:]:
        every = every.unionByName(more)
    if every is None or every.isEmpty():
        forget(*kept, *met)
        return None, visited
    # the least of exponential waiting times with the paths as rates: drawn in proportion to the paths
    uniform = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    wait = -F.log(uniform("s", "at")) / (F.col("paths") * F.col("other_paths"))
    drawn = every.groupBy("s").agg(F.min_by(F.struct("at", "side", "depth", "other_depth"), F.struct(wait, "at")).alias("x"))
    middle = saved(drawn.select("s", "x.*"), "path")
    inside = [middle.filter((F.col("depth") > 0) & (F.col("other_depth") > 0))]
    at = middle.select("s", "at", "side", "depth").unionByName(middle.select("s", "at", (1 - F.col("side")).alias("side"), F.col("other_depth").alias("depth")))
    paths = []
    while True:
        # a side's node before another one is reached against that side's way
        at = at.filter("depth > 1")
        before = [at.filter(F.col("side") == side).join(ways[1 - side].select("at", "to"), "at").select("s", "side", (F.col("depth") - 1).alias("depth"), F.col("to").alias("at")) for side in (0, 1)]
        back = before[0].unionByName(before[1]).join(seen, ["s", "side", "depth", "at"])
        at = saved(back.groupBy("s", "side", "depth").agg(F.min_by("at", F.struct(-F.log(uniform("s", "side", "at", "depth")) / F.col("paths"), "at")).alias("at")), "path")
        paths.append(at)
        if at.isEmpty():
            break
        inside.append(at)
    all_ = inside[0].select("at")
    for more in inside[1:]:
        all_ = all_.unionByName(more.select("at"))
    out = saved(all_.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("n")), "inside")
    forget(*kept, *met, middle, *paths)
    return out, visited
