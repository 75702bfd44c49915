"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every table hashes each distinct vector by rounded Gaussian projections; (table, bucket) decides which part of the
index a row goes to, and a bucket of more than a part's rows is dealt over several parts. A query goes to the parts
of its own bucket and of perturbed ones, in order of estimated success (least squared distance to the crossed
borders). A part computes exact distances to the rows of the visited buckets alone; the tables' candidates are
merged and ranked. The numbers of functions and probes and the width come from a fit: for a bounded sample of queries
the true neighbours among all rows are found once by brute force, and a bounded sample of rows stands for the others.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches, drop, written


@dataclass(frozen=True)
class Settings:
    """sample_rows and sample_queries bound the fit; recall is what the plan has to reach for the sample queries' true neighbours; part_rows and query_rows are about the most rows and queries that meet in a task's group."""

    tables: int = 4
    recall: float = 0.96
    sample_rows: int = 1000
    sample_queries: int = 64
    part_rows: int = 4096
    query_rows: int = 1024
    seed: int = 11


@dataclass(frozen=True)
class Plan:
    functions: int
    width: float
    probes: int


@lru_cache(maxsize=64)
def projections(seed: int, table: int, dims: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, table, dims, functions])
    return rng.standard_normal((dims, functions)), rng.random(functions)


@lru_cache(maxsize=64)
def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of border crossings in order of expected score, as places in a query's borders sorted by distance; two crossings of one function never go together.

    The expected squared distance of the j-th nearest of 2m borders is j(j+1)/4(m+1)(m+2) in the nearer half and
    1 - (2m+1-j)/(m+1) + (2m+1-j)(2m+2-j)/4(m+1)(m+2) in the other; j and 2m+1-j belong to one function.
    """
    m = functions
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - j not in chosen for j in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def bucket_keys(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cells."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for j in range(cells.shape[-1]):
        key = (key ^ cells[..., j].astype(np.int64).view(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return key


def buckets(vectors: np.ndarray, table: int, plan: Plan, seed: int) -> np.ndarray:
    """Each vector's bucket in a table."""
    a, b = projections(seed, table, vectors.shape[1], plan.functions)
    return bucket_keys(np.floor(vectors @ a / plan.width + b))


def probed(queries: np.ndarray, table: int, plan: Plan, seed: int) -> np.ndarray:
    """The buckets that each query visits in a table, its own first."""
    m, sets = plan.functions, perturbations(plan.functions, plan.probes)
    steps = np.zeros((len(sets), 2 * m), bool)
    for i, chosen in enumerate(sets):
        steps[i, list(chosen)] = True
    a, b = projections(seed, table, queries.shape[1], m)
    z = queries @ a / plan.width + b
    cell = np.floor(z)
    part = z - cell
    borders = np.concatenate([part, 1 - part], axis=1)  # below, above
    rank = np.argsort(borders, axis=1, kind="stable")
    crossed = np.zeros((len(queries), len(sets), 2 * m), bool)
    np.put_along_axis(crossed, np.broadcast_to(rank[:, None, :], crossed.shape), np.broadcast_to(steps[None], crossed.shape), axis=2)
    return bucket_keys(cell[:, None, :] + crossed[..., m:].astype(np.int8) - crossed[..., :m].astype(np.int8))


def fit(queries: np.ndarray, near: np.ndarray, others: np.ndarray, settings: Settings) -> Plan:
    """The plan that visits the smallest share of the other rows and finds the wanted share of the true neighbours near(query, rank, dimension); the most thorough one if none does."""
    typical = np.sqrt(((near - queries[:, None, :]) ** 2).sum(-1)).mean() if near.size else 1.0
    dims, best, fallback = queries.shape[1], None, None
    for functions in (4, 8, 10, 12):
        for width in (1.0, 2.0, 3.0):
            for probes in (2, 8, 32, 100, 300):
                plan = Plan(functions, float(max(typical, 1e-12) * width), min(probes, 3**functions))
                hit, share = np.zeros(near.shape[:2], bool), np.zeros((len(queries), len(others)), bool)
                for t in range(settings.tables):
                    wanted = np.sort(probed(queries, t, plan, settings.seed), axis=1)
                    of_near = buckets(near.reshape(-1, dims), t, plan, settings.seed).reshape(near.shape[:2])
                    of_others = buckets(others, t, plan, settings.seed)
                    for q in range(len(queries)):
                        hit[q] |= np.isin(of_near[q], wanted[q])
                        share[q] |= np.isin(of_others, wanted[q])
                recall = hit.mean() if hit.size else 1.0
                if recall >= settings.recall:
                    if best is None or share.mean() < best[0]:
                        best = (share.mean(), plan)
                    break
                if fallback is None or recall > fallback[0]:
                    fallback = (recall, plan)
    return (best or fallback)[1]


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, d: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)


def _by_length(batch, at: int):
    """(length, places, matrix) of the vectors of each length in a batch."""
    size = np.asarray(batch.column(at).value_lengths().to_numpy(zero_copy_only=False))
    for d in np.unique(size).tolist():
        places = np.nonzero(size == d)[0]
        yield d, places, _matrix(batch.column(at).take(pa.array(places)), d)


def _true_neighbours(index: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """q, near: the k nearest other distinct vectors of each of the few sample queries, among all rows. A task holds k rows a query."""
    wanted: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(queries):
        wanted.setdefault(len(v), []).append(i)

    def scan(batches):
        best: dict[int, list[tuple[float, bytes]]] = {}
        for batch in batches:
            for d, _, m in _by_length(batch, 0):
                if d not in wanted:
                    continue
                q = np.array([queries[i][1] for i in wanted[d]], float)
                near = np.maximum((m**2).sum(1)[None] - 2 * q @ m.T + (q**2).sum(1)[:, None], 0.0)
                near[near < 1e-12] = np.inf  # itself
                for row, i in zip(near, wanted[d]):
                    at = np.argpartition(row, min(k, len(row)) - 1)[:k]
                    best[i] = sorted(best.get(i, []) + [(float(row[j]), m[j].tobytes()) for j in at if row[j] < np.inf])[:k]
        rows = [(i, x, v) for i, found in best.items() for x, v in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[], [], []], (pa.int32(), pa.float64(), pa.binary()))], ["q", "x", "near"])

    found = index.select("v").mapInArrow(scan, "q int, x double, near binary")
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("x", "near"))).filter(F.col("rn") <= k).select("q", "near")


def _plans(index: DataFrame, settings: Settings, k: int) -> tuple[dict[int, Plan], dict[int, int]]:
    """(plan, distinct vectors) of every vector length; the driver gets sample_rows vectors and sample_queries * k neighbours a length."""
    lengths = {r["d"]: r["n"] for r in index.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a vector length
    if not lengths:
        return {}, {}
    share = F.create_map(*[F.lit(x) for d, n in sorted(lengths.items()) for x in (d, min(1.0, 1.5 * settings.sample_rows / n))])
    drawn = index.filter(F.xxhash64("h", F.lit(3)) / F.lit(2.0**64) + F.lit(0.5) <= share[F.size("v")]).select("h", "v").collect()  # about sample_rows a length
    drawn = sorted((r["h"], r["v"]) for r in drawn)
    queries = [x for d in sorted(lengths) for x in [y for y in drawn if len(y[1]) == d][: settings.sample_queries]]
    near: dict[int, list] = {}
    for r in _true_neighbours(index, queries, k).collect():
        near.setdefault(r["q"], []).append(np.frombuffer(r["near"]))
    plans = {}
    for d in lengths:
        full = [i for i, (_, v) in enumerate(queries) if len(v) == d and len(near.get(i, ())) == min(k, lengths[d] - 1) > 0]
        if not full:
            plans[d] = Plan(1, 1.0, 1)
            continue
        q, found = np.array([queries[i][1] for i in full], float), np.array([near[i] for i in full], float)
        plans[d] = fit(q, found, np.array([v for _, v in drawn if len(v) == d][: settings.sample_rows], float), settings)
    return plans, lengths


def search(vectors: DataFrame, is_query: Column, k: int = 10, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds its k nearest of all other rows that the probes find.

    Euclidean distance in double precision, ties to the smaller id. Rows with a null id and vectors that are
    null, empty, zero or hold null or non-finite components take no part; vectors of another length are compared
    among themselves. Repeated ids are one row where the vectors are equal and else the nearest counts; a row is
    never its own id's neighbour. Equal vectors are one entry of the index with their k + 1 smallest ids, all that a
    result can name. A query whose probes meet fewer than k vectors is compared with all rows. An empty table or one
    row gives no rows. vectors must be a stored table. Clashing other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 4096)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    own = own.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("h", F.xxhash64("v"))
    least = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))  # the limit is applied in each task before the shuffle
    ids = own.select("h", "v", "id").distinct().withColumn("rn", least).filter(F.col("rn") <= k + 1)
    index = written(ids.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asked = written(own.filter("q").groupBy("h", "v").agg(F.count("*").alias("n")).select("h", "v"), "queries")
    plans, lengths = _plans(index, settings, k)
    if not lengths:
        drop(index, asked)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = {d: -(-n // settings.part_rows) for d, n in lengths.items()}

    def place(batches):
        """A row's bucket in each table."""
        for batch in batches:
            for d, at, m in _by_length(batch, 1):
                part = batch.take(pa.array(at))
                for t in range(settings.tables):
                    b = buckets(m, t, plans[d], settings.seed).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array([t] * len(at), pa.int32()), pa.array(b), *part.columns], ["d", "t", "b", "h", "v", "ids"])

    placed = index.select("h", "v", "ids").mapInArrow(place, f"d int, t int, b long, h long, v {kind}, ids array<bigint>")
    large = placed.groupBy("d", "t", "b").agg(F.count("*").alias("n")).filter(F.col("n") > settings.part_rows)
    large = written(large.select("d", "t", "b", F.ceil(F.col("n") / settings.part_rows).cast("int").alias("k")), "large-buckets")
    n_parts = F.create_map(*[F.lit(x) for d, n in sorted(parts.items()) for x in (d, n)])
    part = lambda salt: F.pmod(F.xxhash64("b", salt), n_parts[F.col("d")]).cast("int")
    rows = placed.join(large, ["d", "t", "b"], "left").withColumn("part", part(F.pmod(F.col("h"), F.coalesce("k", F.lit(1))).cast("int"))).drop("k")

    def probe(batches):
        """The buckets that a query visits in each table."""
        for batch in batches:
            for d, at, m in _by_length(batch, 1):
                hs = batch.column(0).take(pa.array(at))
                for t in range(settings.tables):
                    wanted = probed(m, t, plans[d], settings.seed).view(np.int64)
                    n, p = wanted.shape
                    yield pa.RecordBatch.from_arrays([pa.array([d] * (n * p), pa.int32()), pa.array([t] * (n * p), pa.int32()), hs.take(pa.array(np.repeat(np.arange(n), p))), pa.array(wanted.ravel())], ["d", "t", "h", "b"])

    probes = asked.select("h", "v").mapInArrow(probe, "d int, t int, h long, b long").join(large, ["d", "t", "b"], "left")
    probes = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).withColumn("part", part(F.col("salt")))
    visits = written(probes.groupBy("d", "t", "part", "h").agg(F.collect_set("b").alias("wanted")), "visits")  # a query has a fixed number of probes
    blocks = written(visits.groupBy("d", "t", "part").agg(F.ceil(F.count("*") / settings.query_rows).cast("int").alias("k")), "visits")
    left = rows.join(blocks, ["d", "t", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    right = visits.join(blocks, ["d", "t", "part"]).withColumn("block", F.pmod(F.xxhash64("h", F.lit(5)), F.col("k")).cast("int")).drop("k").join(asked, "h").filter(F.size("v") == F.col("d"))

    def look_up(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and queries.num_rows:
            d, b = key[0].as_py(), rows["b"].to_numpy()
            order = np.argsort(b, kind="stable")
            b, m, ids = b[order], _matrix(rows["v"], d)[order], rows["ids"].take(pa.array(order)).to_pylist()
            for h, q, wanted in zip(queries["h"].to_pylist(), _matrix(queries["v"], d), queries["wanted"].to_pylist()):
                wanted = np.array(wanted, np.int64)
                at = np.concatenate([np.arange(x, y) for x, y in zip(np.searchsorted(b, wanted, "left"), np.searchsorted(b, wanted, "right")) if x < y] or [np.zeros(0, np.int64)])
                out += _nearest(h, q, m, ids, at, k)
        return _found(out)

    found = written(left.groupBy("d", "t", "part", "block").cogroup(right.groupBy("d", "t", "part", "block")).applyInArrow(look_up, FOUND), "candidates")
    best = found.groupBy("h", "vec_id").agg(F.min("score").alias("score"))
    few = written(asked.join(found.groupBy("h").agg(F.count_distinct("vec_id").alias("n")), "h", "left").filter(F.coalesce("n", F.lit(0)) < k + 1).select("h", "v"), "few")
    if not few.isEmpty():  # rare: far from all others, or hardly any rows
        best = best.unionByName(_scanned(index, few, k, settings)).groupBy("h", "vec_id").agg(F.min("score").alias("score"))
    top = F.row_number().over(Window.partitionBy("h").orderBy("score", "vec_id"))
    best = best.withColumn("rn", top).filter(F.col("rn") <= k + 1).select("h", "vec_id", "score")
    named = own.filter("q").select(F.col("id").alias("query_id"), "h").distinct().join(best, "h").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return named.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


FOUND = "h long, vec_id long, score double"


def _nearest(h: int, query: np.ndarray, vectors: np.ndarray, ids: list, at: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(h, id, distance) of the k + 1 nearest ids among the vectors at these places."""
    if not len(at):
        return []
    near = np.sqrt(((vectors[at] - query) ** 2).sum(1))
    if len(near) > k + 1:
        keep = near <= np.partition(near, k)[k]
        at, near = at[keep], near[keep]
    return sorted(((h, i, float(x)) for j, x in zip(at.tolist(), near) for i in ids[j]), key=lambda r: (r[2], r[1]))[: k + 1]


def _found(out: list) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[], [], []], (pa.int64(), pa.int64(), pa.float64()))], names=["h", "vec_id", "score"])


def _scanned(index: DataFrame, few: DataFrame, k: int, settings: Settings) -> DataFrame:
    """FOUND rows of the few queries against all rows: blocks of rows with blocks of queries."""
    n, q = index.count(), few.count()
    row_blocks, query_blocks = -(-n // settings.part_rows), -(-q // settings.query_rows)
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = index.withColumn("i", F.pmod(F.xxhash64("h", F.lit(9)), F.lit(row_blocks)).cast("int")).withColumn("j", all_of(query_blocks))
    right = few.withColumn("j", F.pmod(F.xxhash64("h", F.lit(9)), F.lit(query_blocks)).cast("int")).withColumn("i", all_of(row_blocks))

    def look_up(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and queries.num_rows:
            size, ids = rows["v"].combine_chunks().value_lengths().to_numpy(), rows["ids"].to_pylist()
            for h, q in zip(queries["h"].to_pylist(), queries["v"].to_pylist()):
                own = np.nonzero(size == len(q))[0]
                if len(own):
                    out += _nearest(h, np.array(q, float), _matrix(rows["v"].take(pa.array(own)), len(q)), [ids[i] for i in own], np.arange(len(own)), k)
        return _found(out)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(look_up, FOUND)
