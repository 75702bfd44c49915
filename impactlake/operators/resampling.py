"""Ranks within groups over range partitions, and multinomial resampling of histograms down a tree of conditional draws."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impactlake.sources.shared import saved


def ranked(counted: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """counted(by, value, n; a row a value) with _at (how many records of the group come before), _i (how many values do), _all and _kinds (records and values of the group). A null value counts nothing.

    The table is dealt by ranges of group and value and written once; each range is summed up for itself and moved on by
    what the group has in the ranges before. So a group, however large or uneven its values, is spread over tasks.
    """
    stored = saved(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "counted")
    there = F.col(value).isNotNull()
    rows, kinds = F.when(there, F.col(n)).otherwise(0), F.when(there, 1).otherwise(0)
    sizes = stored.groupBy(*by, "_part").agg(F.sum(rows).alias("_r"), F.sum(kinds).alias("_k"))  # a row a group and range
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts, group = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by)
    bases = sizes.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_part").alias("_b_part"), earlier(F.col("_r"), parts).alias("_base"), earlier(F.col("_k"), parts).alias("_first"), F.sum("_r").over(group).alias("_all"), F.sum("_k").over(group).alias("_kinds"))
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    local = stored.withColumns({"_at": earlier(rows, inside), "_i": earlier(kinds, inside)})
    joined = local.join(bases, [*[F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], F.col("_part") == F.col("_b_part")])
    return joined.select(*by, value, n, (F.col("_at") + F.col("_base")).alias("_at"), (F.col("_i") + F.col("_first")).alias("_i"), "_all", "_kinds")


def resampled(hist: DataFrame, by: list[str], replicates: int, seed: int, shares: tuple[float, ...] = (), extra: float = 0.0, most: int | None = None, fan: int = 1024) -> DataFrame:
    """by, r, mean, q (discrete quantiles of the shares, as distribution() has them): what `replicates` multinomial draws from each group's hist(by, k, n) give.

    A replicate draws as many records as the group has, `most` at most. Values are the leaves of a tree in which a node
    has up to `fan` children: given a node's draws those of its children are multinomial in their shares, so level by
    level and node by node a task draws a matrix of replicates by `fan` numbers at most, from a generator that group,
    level and node seed. Ranks go down with the draws. Leaves send sums by replicate. A lost task draws the same again.
    """
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    counted = hist.groupBy(*by, F.col("k").cast("double").alias("k")).agg(F.sum("n").alias("n")).filter("k is not null and n > 0")
    leaves = saved(ranked(counted, by, "k", "n").select(key.alias("key"), *by, F.col("_i").cast("long").alias("i"), "k", F.col("n").cast("long"), F.col("_all").cast("long").alias("all"), F.col("_kinds").alias("kinds")), "leaves")
    groups = leaves.filter("i = 0").select("key", *by, "all", F.least("all", F.lit(most or (1 << 62))).alias("size"))
    kinds = leaves.agg(F.max("kinds")).first()[0] or 0
    levels = [leaves.select("key", F.col("i").alias("node"), "n", "k")]
    while kinds > fan:
        kinds = -(-kinds // fan)
        levels.append(saved(levels[-1].groupBy("key", F.floor(F.col("node") / fan).alias("node")).agg(F.sum("n").alias("n")).withColumn("k", F.lit(None).cast("double")), "nodes"))
    state = groups.select("key", F.lit(0).cast("long").alias("up"), "size", F.lit(None).cast("binary").alias("draws"), F.lit(None).cast("binary").alias("ranks"))
    p = len(shares)

    def draw(level: int):
        def one(key: tuple[pa.Scalar, ...], children: pa.Table, above: pa.Table) -> pa.Table:
            name, up = key[0].as_py(), key[1].as_py()
            order = np.argsort(children["node"].to_numpy())
            n = children["n"].to_numpy()[order].astype(float)
            size, drawn, ranks = above["size"][0].as_py(), above["draws"][0].as_py(), above["ranks"][0].as_py()
            drawn = np.full(replicates, size) if drawn is None else np.frombuffer(drawn, np.int64)
            ranks = np.tile([s * size + extra for s in shares], (replicates, 1)) if ranks is None else np.frombuffer(ranks, float).reshape(replicates, p)
            rng = np.random.default_rng([seed, zlib.crc32(name.encode()), level, up])
            found = rng.multinomial(drawn, n / n.sum())
            below = found.cumsum(axis=1)
            at = [np.minimum((below < ranks[:, [j]]).sum(axis=1), len(n) - 1) for j in range(p)]
            if level:
                rest = np.full((len(n), replicates, p), np.nan)
                for j in range(p):
                    own = np.nonzero(~np.isnan(ranks[:, j]))[0]
                    rest[at[j][own], own, j] = ranks[own, j] - (below - found)[own, at[j][own]]
                nodes = children["node"].to_numpy()[order]
                return pa.table([pa.array([name] * len(n), pa.string()), pa.array(nodes), pa.array([size] * len(n), pa.int64()), pa.array([found[:, c].astype(np.int64).tobytes() for c in range(len(n))], pa.binary()), pa.array([rest[c].tobytes() for c in range(len(n))], pa.binary())], names=["key", "up", "size", "draws", "ranks"])
            k = children["k"].to_numpy()[order]
            quantiles = [pa.array(k[at[j]], mask=np.isnan(ranks[:, j])) for j in range(p)]
            return pa.table([pa.array([name] * replicates, pa.string()), pa.array(np.arange(replicates)), pa.array(found @ k), *quantiles], names=["key", "r", "part", *[f"q{j}" for j in range(p)]])

        return one

    for level in range(len(levels) - 1, -1, -1):
        below = levels[level].withColumn("up", F.floor(F.col("node") / fan).cast("long")).groupBy("key", "up")
        schema = "key string, up long, size long, draws binary, ranks binary" if level else ", ".join(["key string, r long, part double", *[f"q{j} double" for j in range(p)]])
        state = below.cogroup(state.groupBy("key", "up")).applyInArrow(draw(level), schema)
    sums = state.groupBy("key", "r").agg(F.sum("part").alias("sum"), *[F.max(f"q{j}").alias(f"q{j}") for j in range(p)])
    return sums.join(groups, "key").select(*by, "r", (F.col("sum") / F.col("size")).alias("mean"), F.array(*[F.col(f"q{j}") for j in range(p)]).alias("q"))
