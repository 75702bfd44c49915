"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import drop, written


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes of these pairs that are not the smallest themselves."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, r) for x in list(up) if (r := root(x)) != x]


def _compact(batches):
    """Each task's edges as stars: as many as before at most, and the same components."""
    pairs: list[tuple[int, int]] = []

    def stars():
        found = list(zip(*spanning(pairs))) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["u", "v"])

    for batch in batches:
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(pairs) >= 500_000:  # what a task holds stays bounded
            yield stars()
            pairs = []
    yield stars()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, label (smallest node of its component) for every node of an edge list of longs that is not its component's smallest.

    Null ends and loops are ignored, repeated edges do no harm, no edges give no rows. Rounds go on until nothing
    changes; each is written to the shared folder.
    """
    star = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u != v").mapInArrow(_compact, "u long, v long")
    star = written(star, "stars")
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, it is broadcast or comes straight from a shuffle: adaptive execution can split a hub's edges
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = written(down, "stars")
        low = written(down.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), "m"), F.struct(F.col("v").alias("a"), "m"))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.m").alias("v"))
        new = written(small.filter("u != v").distinct(), "stars")
        done = new.exceptAll(star).isEmpty() and star.exceptAll(new).isEmpty()
        drop(star, least, down, low)
        if done:
            return new.select(F.col("u").alias("node"), F.col("v").alias("label"))
        star = new

