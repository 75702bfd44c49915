"""SimHash near duplicates by a vantage-point tree over fingerprints.

A fingerprint's bit is the majority over the text's word n-grams, repeats included. Equal fingerprints are one point.
A tree of vantage points, fitted on a bounded sample, splits the points at the median distance from each vantage; its
leaves are the shards. A point belongs to one shard and is a guest of those beyond a border that it is near to: by the
triangle inequality two points within r differ by r at most in their distance from any vantage, so all other branches
are pruned and no pair is lost. Of a pair that a border parts only the inner point crosses it. In a shard's task the
same splitting goes on down to small nodes, which are compared directly. Shards are dealt in cells of bounded size,
and cells send spanning forests of their links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches, drop, mix64, written
from impactlake.llm.components import components, spanning

#: The tree is fitted on about so many points, whatever the table's size, and has at most so many leaves.
SAMPLE, LEAVES = 1 << 17, 1 << 12
#: Points of a shard that the tree aims at, and points of either kind in a cell.
SHARD, CELL = 2048, 1 << 19
#: Nodes of a shard that are compared directly.
DIRECT = 192
#: n-grams whose bits are added up at once.
CHUNK = 1 << 14


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64 majority bits of the XXH64 hashes of the n-grams; a text of fewer words is one n-gram, without words it is 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space
    if not words:
        return 0
    width = min(width, len(words))
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width))))
        h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


def choose(points: np.ndarray, radius: int, tries: int = 6) -> tuple[int, int] | None:
    """(vantage, border): of a few of the points the one from which the fewest lie near the median distance; None if none splits them."""
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, tries).astype(np.int64)]:
        d = distance(points, vantage)
        border = int(np.median(d))
        inside = int((d <= border).sum())
        if inside == len(points):
            border -= 1
            inside = int((d <= border).sum())
        if 0 < inside < len(points):
            cost = (int(((d > border - radius) & (d <= border + radius)).sum()) + abs(2 * inside - len(points)), int(vantage), border)
            best = min(best or cost, cost)
    return best and best[1:]


def fit(sample: np.ndarray, leaves: int, radius: int) -> list:
    """The tree: [vantage, border, inner, outer] or [] for a leaf, with about the leaves asked for."""
    split = choose(sample, radius) if leaves > 1 and len(sample) > 1 else None
    if split is None:
        return []
    d = distance(sample, split[0])
    return [*split, *(fit(sample[side], (leaves + 1) // 2, radius) for side in (d <= split[1], d > split[1]))]


def routed(tree: list, points: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, members, guests) of the leaves that get any of the points, leaves numbered as the tree's paths."""
    out, todo = [], [(tree, 1, points, points[:0])]
    while todo:
        node, path, own, guests = todo.pop()
        if not len(own) + len(guests):
            continue
        if not node:
            out.append((path, own, guests))
            continue
        vantage, border, inner, outer = node
        d, g = distance(own, vantage), distance(guests, vantage)
        todo.append((inner, 2 * path, own[d <= border], guests[g <= border + radius]))
        todo.append((outer, 2 * path + 1, own[d > border], np.concatenate([own[(d <= border) & (d > border - radius)], guests[g > border - radius]])))
    return out


def near_pairs(members: np.ndarray, guests: np.ndarray, radius: int, inside: bool = True):
    """Arrays (u, v) of the pairs within the radius among members (if inside) and between guests and members."""
    todo = [(members, guests, inside)]
    while todo:
        own, visit, within = todo.pop()
        if not len(own) or not (within and len(own) > 1) and not len(visit):
            continue
        split = choose(own[:4096], radius, 3) if len(own) > DIRECT else None
        if split is None:
            if within:
                for at in range(0, len(own) - 1, DIRECT):
                    part = own[at : at + DIRECT]
                    for low in range(at, len(own), CHUNK):
                        rest = own[low : low + CHUNK]
                        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ rest[None, :]) <= radius)
                        keep = i + at < j + low
                        yield part[i[keep]], rest[j[keep]]
            for at in range(0, len(own), DIRECT):
                part = own[at : at + DIRECT]
                for low in range(0, len(visit), CHUNK):
                    rest = visit[low : low + CHUNK]
                    i, j = np.nonzero(np.bitwise_count(part[:, None] ^ rest[None, :]) <= radius)
                    yield part[i], rest[j]
            continue
        vantage, border = split
        d, g = distance(own, vantage), distance(visit, vantage)
        near = own[(d <= border) & (d > border - radius)] if within else own[:0]
        todo.append((own[d <= border], visit[g <= border + radius], within))
        todo.append((own[d > border], np.concatenate([near, visit[g > border - radius]]), within))


def links(points: DataFrame, radius: int, column: str = "point") -> DataFrame:
    """u, v: links that connect all points (distinct longs of a stored table) within the radius, as spanning forests of cells."""
    spark, n = points.sparkSession, points.count()
    leaves = max(1, min(LEAVES, -(-n // SHARD)))
    scale = 1 << 30
    drawn = F.pmod(F.xxhash64(column), F.lit(scale)) < min(scale, -(-SAMPLE * scale // max(1, n)))
    sample = np.array([r[0] for r in points.filter(drawn).select(column).collect()], np.int64).view(np.uint64)  # about SAMPLE numbers
    tree = spark.sparkContext.broadcast(fit(sample[np.argsort(mix64(sample))], leaves, radius))  # LEAVES nodes at most

    def route(batches):
        for batch in batches:
            parts = routed(tree.value, batch.column(0).to_numpy().view(np.uint64), radius)
            size = [len(x) for _, own, guests in parts for x in (own, guests)]
            leaf = np.repeat(np.repeat([p for p, _, _ in parts], 2), size).astype(np.int64)
            guest = np.repeat(np.tile([False, True], len(parts)), size)
            flat = np.concatenate([x for _, own, guests in parts for x in (own, guests)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(guest), pa.array(flat.view(np.int64))], ["leaf", "guest", "point"])

    routed_ = written(points.select(column).mapInArrow(route, "leaf long, guest boolean, point long"), "simhash-shards")
    sizes = routed_.groupBy("leaf").agg(F.count_if(~F.col("guest")).alias("own"), F.count_if(F.col("guest")).alias("visit")).filter("own > 0 and own + visit > 1")  # a row a leaf
    # cell (i, q): member block i with query chunk q; members of later blocks are queries of the earlier ones
    blocks, chunks = F.ceil(F.col("own") / CELL), F.greatest(F.lit(1), F.ceil((F.col("visit") + F.col("own")) / CELL))
    sizes = sizes.select("leaf", blocks.cast("int").alias("blocks"), F.when(blocks > 1, chunks).otherwise(F.greatest(F.lit(1), F.ceil(F.col("visit") / CELL))).cast("int").alias("chunks"))
    spread = F.xxhash64("point", F.lit(7))
    rows = routed_.join(F.broadcast(sizes), "leaf").withColumns({"b": F.when(~F.col("guest"), F.pmod(spread, F.col("blocks")).cast("int")), "c": F.pmod(F.shiftright(spread, 20), F.col("chunks")).cast("int")})
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    cell = lambda i, q, member: F.struct(i.cast("int").alias("i"), q.cast("int").alias("q"), F.lit(member).alias("member"))
    as_member = F.when(F.col("guest"), F.array().cast("array<struct<i:int,q:int,member:boolean>>")).otherwise(F.transform(upto(F.col("chunks") - 1), lambda q: cell(F.col("b"), q, True)))
    as_query = F.transform(upto(F.when(F.col("guest"), F.col("blocks") - 1).otherwise(F.col("b") - 1)), lambda i: cell(i, F.col("c"), False))
    rows = rows.select("leaf", "point", F.explode(F.concat(as_member, as_query)).alias("x")).select("leaf", "x.*", "point")

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        member, point = rows["member"].to_numpy().astype(bool), rows["point"].to_numpy().view(np.uint64)
        found: list[tuple[int, int]] = []
        for u, v in near_pairs(point[member], point[~member], radius, inside=key[2].as_py() == 0):
            found += zip(u.view(np.int64).tolist(), v.view(np.int64).tolist())
            if len(found) > 200_000:
                found = spanning(found)
        return pa.table([pa.array([p[k] for p in spanning(found)], pa.int64()) for k in (0, 1)], names=["u", "v"])

    out = written(rows.groupBy("leaf", "i", "q").applyInArrow(compare, "u long, v long"), "simhash-links")
    drop(routed_)
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, point (the fingerprint as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def prints(batches):
        for batch in batches:
            found = np.array([fingerprint(x, width, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "point"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(prints, "id long, point long")


def simhash_components(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id that links reach, its own included) of every document.

    Fingerprints link at `radius` or fewer differing bits. Null texts and texts without a word have the fingerprint
    zero and link like any other; long texts count whole; repeated rows and equal ids are documents of their own, linked
    by their equal fingerprints; a component whose ids are all null has a null component_id. An empty table gives no
    rows; other columns are ignored. docs must be a stored table: it is read once.
    """
    rows = written(fingerprints(docs, width, seed, id_col, text_col), "simhash-rows")
    points = written(rows.groupBy("point").agg(F.min("id").alias("least")), "simhash-points")
    found = links(points, radius)
    labels = components(found, "u", "v")
    drop(found)
    named = points.join(labels.withColumnRenamed("node", "point"), "point", "left").select("point", "least", F.coalesce("label", "point").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_point = written(named.join(least, "label").select("point", "component_id"), "simhash-components")
    drop(points)
    return rows.join(of_point, "point", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")
