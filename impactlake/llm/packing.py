"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the instance is a histogram of at most `capacity` counts, whatever
the number of documents. The reduction and best fit work on that histogram and give slots; Spark deals the
pieces into the slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches, written
from impactlake.llm.tokens import encoder

PIECES = "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Martello-Toth reduction: (fixed bins as (lengths, how many), what is left of the histogram).

    For each length, largest first, the bin {j}, {j, k} is fixed if it dominates every other feasible bin that
    holds j: nothing else fits, k fills the bin, only one more item fits (take the largest), or the largest
    partner is at least any pair that fits while no three do.
    """
    counts = counts.copy()
    fixed = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            own = counts.copy()
            own[j] -= 1
            sizes = np.nonzero(own[: room + 1])[0]
            sizes = sizes[sizes > 0]
            if not len(sizes):
                take, bin_ = 1 if j <= room else counts[j], (j,)
            else:
                k = int(sizes[-1])
                if k != room and not _partner_dominates(own, sizes, k, room):
                    break
                take, bin_ = (counts[j] // 2 if k == j else min(counts[j], counts[k])), (j, k)
            fixed.append((bin_, int(take)))
            for x in bin_:
                counts[x] -= take
    return fixed, counts


def _partner_dominates(own: np.ndarray, sizes: np.ndarray, k: int, room: int) -> bool:
    small = [int(s) for s in sizes[:3] for _ in range(min(3, int(own[s])))][:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return True
    if len(small) == 3 and sum(small) <= room:
        return False
    lo, hi, best = 0, len(sizes) - 1, 0  # the largest sum of a pair that fits
    while lo <= hi:
        total = int(sizes[lo] + sizes[hi])
        if total > room or (lo == hi and own[sizes[lo]] < 2):
            hi -= 1
        else:
            best = max(best, total)
            lo += 1
    return k >= best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram, a group of equal bins at a time."""
    rooms: list[int] = []  # sorted residual capacities that some open bin has
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if n:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((pattern, n))

    for w in range(capacity, 0, -1):
        n = int(counts[w])
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                pattern, have = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, pattern, have = capacity, (), n
            each = room // w
            full = min(have, n // each)
            put(pattern + (w,) * each, full, room - each * w)
            n -= full * each
            if full < have:
                rest = n if n < each else 0
                if rest:
                    put(pattern + (w,) * rest, 1, room - rest * w)
                    n -= rest
                if pattern:
                    put(pattern, have - full - bool(rest), room)
    return [x for room in rooms for x in bins[room]]


def slots(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Runs of places: pieces of `length` with ranks from `rank` on go to consecutive sequences from `sequence` on, at `offset`."""
    fixed, left = reduce_instance(counts, capacity)
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, n in fixed + best_fit(left, capacity):
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    assert (used == counts).all(), "every piece has its place"
    table = np.array(rows, np.int64).reshape(-1, 4)
    order = np.lexsort((table[:, 1], table[:, 0]))
    return dict(zip(("length", "rank", "sequence", "offset"), table[order].T))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids (null text: none), then end_id, as pieces of at most `capacity`; only a first piece of a longer one may be shorter. rank counts within task and length."""
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode, seen = encoder(tokenizer).encode, np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n, start = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    out.append((part, int(seen[length]), doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    seen[length] += 1
                    start += length
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are a
    piece of end_id alone; rows with equal or null ids are packed each for itself; an empty table gives no rows;
    other columns are ignored. The driver holds one count per length (capacity + 1 of them) and the slots built
    from them; the pieces stay in Spark.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    table = docs.sparkSession.sparkContext.broadcast(slots(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches):
        t = table.value
        shift = np.int64(1) << np.int64(48)
        keys = t["length"] * shift + t["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            sequence = t["sequence"][at] + rank - t["rank"][at] if len(length) else rank
            offset = t["offset"][at] if len(length) else rank
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
