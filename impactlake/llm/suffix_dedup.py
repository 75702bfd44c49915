"""Repeated passages: bytes covered by a string of `width` bytes that starts anywhere else too.

A depth-limited radix sort of the suffixes, most significant digit first: each pass groups what is left by its
next digit (a hash of it: only equality counts, not the order), groups of one are done, and after `width` bytes
the groups of two or more are exactly the repeated windows.

The first digit is chosen so that few suffixes enter: of the k-grams inside a window the one with the least hash
(the leftmost of equals) is its anchor, and equal windows have equal anchors at equal places. So

1. the windows of one anchor go together; their first digit is the anchor's k-gram. If all the bytes that they
   span occur twice, all of them are repeated.
2. else they are cut into cells of `cell` neighbouring places relative to the anchor; the next digit is what all
   windows of a cell have in common, and again the span of a cell may occur twice as a whole.
3. what is left is grouped window by window.

Of spans that occur twice one representative goes on, where windows with the same digit still are undecided.

With a width in words the same passes run over the texts' words, each as its 64-bit hash: equal windows begin and end
with words.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.llm import sketches
from impactlake.llm.common import bounded_batches, drop, free_name, mix64, schema_with, written

_WORDS = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Unit:
    """What windows are counted in: bytes of one place in a coded text, places of an anchor's k-gram and of a cell, places handled at once."""

    size: int
    gram: int
    cell: int
    segment: int

    def coded(self, texts: list) -> list[bytes]:
        raws = [(t or "").encode() for t in texts]
        if self.size == 1:
            return raws
        return [h.tobytes() for h in word_hashes(raws)]


BYTES, WORDS = Unit(1, 32, 24, 1 << 19), Unit(8, 4, 4, 1 << 17)


_PIECE = 1 << 19
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    factors = np.full(2 * _PIECE + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _pieces(raw: bytes) -> list[bytes]:
    """A text cut at ASCII white space into pieces of about _PIECE bytes; a longer word is a piece of its own."""
    out, start = [], 0
    while len(raw) - start > _PIECE:
        cut = _SPACE.search(raw, start + _PIECE)
        if not cut:
            break
        out.append(raw[start : cut.end()])
        start = cut.end()
    return [*out, raw[start:]]


def word_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of each text's words (between ASCII white space): polynomials of their bytes, scrambled."""
    found: list[list[np.ndarray]] = [[] for _ in raws]
    held: list[tuple[int, bytes]] = []

    def run():
        flat = np.frombuffer(b"".join(p + b" " for _, p in held), np.uint8)
        space = (flat == 32) | (flat - np.uint8(9) < 5)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))  # starts and ends by turns
        start, end = edge[0::2], edge[1::2]
        value = flat.astype(np.uint64) + np.uint64(1)
        if len(flat) <= 2 * _PIECE:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_P)[: len(flat)], dtype=np.uint64)])
            h = (total[end] - total[start]) * _powers(pow(_P, -1, 1 << 64))[start]
        else:  # words of more than _PIECE bytes
            h = np.array([_polynomial(value[a:b]) for a, b in zip(start, end)], np.uint64)
        h = mix64(h ^ (end - start).astype(np.uint64) * _C[1])
        at = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for _, p in held]))
        for (i, _), a, b in zip(held, at[:-1], at[1:]):
            found[i].append(h[a:b])
        held.clear()

    n = 0
    for i, raw in enumerate(raws):
        for piece in _pieces(raw):
            if held and n + len(piece) + 1 > _PIECE:
                run()
                n = 0
            held.append((i, piece))
            n += len(piece) + 1
    if held:
        run()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]


def _polynomial(value: np.ndarray) -> int:
    """The sum of value[j] * _P**j, piece by piece."""
    total = 0
    for at in range(0, len(value), _PIECE):
        part = value[at : at + _PIECE]
        total += int((part * _powers(_P)[: len(part)]).sum(dtype=np.uint64)) * pow(_P, at, 1 << 64)
    return total & 0xFFFFFFFFFFFFFFFF


def gram_hashes(raw: bytes, unit: Unit) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    n = len(raw)
    if unit.size == 8:
        load, step = np.frombuffer(raw, "<u8"), 1
    else:
        load, step = np.empty(n - 7, np.uint64), 8
        for r in range(8):
            load[r::8] = np.frombuffer(raw, "<u8", (n - r) // 8, r)
    m = n // unit.size - unit.gram + 1
    h = load[:m] * _C[0]
    for i in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += load[step * i : step * i + m]
        h *= _C[i]
    h ^= h >> np.uint64(32)
    h *= _C[0]
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x)
    pad = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(pad, axis=1).ravel()
    after = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(texts: list[bytes], width: int, unit: Unit = BYTES):
    """(text, anchor, first start, last start, hash of the anchor's k-gram) arrays of all runs of windows with one anchor, about a segment at a time."""
    k = unit.size

    def run(parts: list[tuple[int, int, bytes]]):
        h = gram_hashes(b"".join(p for _, _, p in parts), unit)
        at = np.arange(len(h), dtype=np.uint64)
        least = sliding_min((h & ~_LOW) | at, width - unit.gram + 1) & _LOW
        size = np.array([len(p) // k for _, _, p in parts])
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        starts = size - width + 1
        s = np.repeat(base - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts) + np.arange(starts.sum())
        part = np.repeat(np.arange(len(parts)), starts)
        a = least[s].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
        last = np.append(first[1:], len(s)) - 1
        shift = np.array([off for _, off, _ in parts])[part[first]] - base[part[first]]
        return np.array([t for t, _, _ in parts])[part[first]], a[first] + shift, s[first] + shift, s[last] + shift, h[a[first]].view(np.int64)

    held, n = [], 0
    for t, raw in enumerate(texts):
        for off in range(0, max(0, len(raw) // k - width + 1), unit.segment):
            held.append((t, off, raw[off * k : (off + unit.segment + width - 1) * k]))
            n += len(held[-1][2]) // k
            if n >= unit.segment:
                yield run(held)
                held, n = [], 0
    if held:
        yield run(held)


def short_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def long_hash(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _byte_ranges(raw: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes from the first to the last word of each range of words."""
    at = [m.span() for m in _WORDS.finditer(raw)] if found else []
    return [(at[a][0], at[b - 1][1]) for a, b in found]


def _spans(batches, width: int, unit: Unit):
    """First pass: a row per anchor. digit is its k-gram, span all that its windows cover."""
    u = unit.size
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), unit.coded(batch.column(1).to_pylist())
        for found in anchors(texts, width, unit):
            t, a, lo, hi = (x.tolist() for x in found[:4])
            span = [long_hash(texts[i][x * u : (y + width) * u]) for i, x, y in zip(t, lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in t], pa.binary()), pa.array(a, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(found[4]), pa.array(span, pa.binary())], ["key", "a", "lo", "hi", "digit", "span"])


RUN = "key binary, a long, lo long, hi long, digit long, span binary"


def _maybe(rows: DataFrame, digits: DataFrame) -> DataFrame:
    """rows whose digit may be one of the digits, by a table of 2**24 bits (of at most 2**18 lines, so it is broadcast): what it rules out need not be shuffled."""
    slot = lambda d: d.bitwiseAND(F.lit((1 << 24) - 1))
    word, bit = lambda d: F.shiftright(slot(d), 6).alias("_word"), lambda d: d.bitwiseAND(F.lit(63)).cast("int")
    table = digits.groupBy(word(F.col("digit"))).agg(F.bit_or(F.expr("shiftleft(1L, cast(digit & 63 as int))")).alias("_bits"))
    return rows.join(F.broadcast(table), word(F.col("digit")) == F.col("_word")).filter(F.getbit("_bits", bit(F.col("digit"))) == 1).select(*rows.columns)


def radix_pass(rows: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(tables to drop when the others have been read, rows whose span occurs twice, those that go on to the next digit); rows are dropped.

    Counting has partial sums, and what was counted is written before it is joined: it is then broadcast, or both
    sides come straight from a shuffle and adaptive execution splits a hot digit or span.
    """
    twice = written(rows.groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit"), name)
    left = written(_maybe(rows, twice).join(twice, "digit"), name)
    drop(rows, twice)
    by_span = written(left.groupBy("span").agg(F.count("*").alias("n"), F.min(F.struct("key", "a", "lo")).alias("rep")).filter("n > 1").select("span", "rep"), name)
    found = F.col("rep").isNotNull()
    judged = left.join(by_span, "span", "left").select(*left.columns, found.alias("whole"), (found & (F.struct("key", "a", "lo") == F.col("rep"))).alias("is_rep"))
    judged = written(judged, name)
    drop(left, by_span)
    open_ = written(judged.filter("not whole").select("digit").distinct(), name)
    return [judged, open_], judged.filter("whole").select("key", "lo", "hi"), judged.filter("not whole or is_rep").join(open_, "digit", "left_semi").select("key", "a", "lo", "hi").distinct()


ANY = 0xFFFFFFFF  # stands for any of a text's anchors


def _slot(key: bytes, a: int, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(key, a & 0xFFFFFFFF) & ((1 << bits) - 1)


def repeated_runs(texts: DataFrame, width: int = 400, unit: Unit = BYTES) -> DataFrame:
    """key, runs: for texts(key, text) the runs of starts whose windows of `width` units are repeated, as lo, hi, lo, hi, ...; key is the text's md5.

    texts must be a stored table (it is read twice), without nulls.
    """
    if width < 2 * unit.gram:
        raise ValueError(f"width must be {2 * unit.gram} or more")
    u, cell = unit.size, unit.cell
    spark = texts.sparkSession
    bounded_batches(spark, 250)
    rows = written(texts.select("key", "text").mapInArrow(lambda b: _spans(b, width, unit), RUN), "suffix-runs")
    done, whole, left = radix_pass(rows, "suffix-pass1")
    left = written(left, "suffix-left")
    bits = min(24, max(16, math.ceil(math.log2(32 * left.count() + 1))))

    def mark(own, batch):
        for key, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own[_slot(key, a, bits)] = own[_slot(key, ANY, bits)] = 1

    wanted = spark.sparkContext.broadcast(sketches.sums(left.select("key", "a"), 1 << bits, mark, np.uint8) > 0)

    def contexts(batches):
        """The bytes around the undecided anchors; the bit array lets a few others pass, which does no harm."""
        seen: set[tuple[bytes, int, int]] = set()
        for batch in batches:
            open_ = [bool(wanted.value[_slot(k, ANY, bits)]) for k in batch.column(0).to_pylist()]
            if not any(open_):
                continue
            batch = batch.filter(pa.array(open_))
            keys, docs = batch.column(0).to_pylist(), unit.coded(batch.column(1).to_pylist())
            if len(seen) > 100_000:
                seen.clear()
            for found in anchors(docs, width, unit):
                out = []
                for t, a, lo, hi in zip(*(x.tolist() for x in found[:4])):
                    if wanted.value[_slot(keys[t], a, bits)] and (keys[t], a, lo) not in seen:
                        seen.add((keys[t], a, lo))
                        out.append((keys[t], a, lo, hi, docs[t][lo * u : (hi + width) * u]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "a", "lo", "hi", "bytes"])

    around = texts.select("key", "text").mapInArrow(contexts, "key binary, a long, lo long, hi long, bytes binary")
    around = written(around.groupBy("key", "a", "lo").agg(F.first("hi").alias("hi"), F.first("bytes").alias("bytes")), "suffix-around")

    def cells(batches):
        """Second pass: a row per cell. Places count from the anchor: o = a - start, cell j has o in [j * cell, (j + 1) * cell)."""
        for batch in batches:
            out = []
            for key, a, lo, hi, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for j in range((a - hi) // cell, (a - lo) // cell + 1):
                    s1, s2 = max(lo, a - (j + 1) * cell + 1), min(hi, a - j * cell)
                    out.append((key, a, s1, s2, _digit(raw, lo, a, j, width, unit), long_hash(raw[(s1 - lo) * u : (s2 - lo + width) * u])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "a", "lo", "hi", "digit", "span"])

    cell_rows = written(around.select("key", "a", "lo", "hi", "bytes").mapInArrow(cells, RUN), "suffix-cells")
    done2, whole2, left2 = radix_pass(cell_rows, "suffix-pass2")
    inside = (F.col("c.lo") >= F.col("x.lo")) & (F.col("c.lo") <= F.col("x.hi"))
    open_cells = left2.alias("c").join(around.alias("x"), (F.col("c.key") == F.col("x.key")) & (F.col("c.a") == F.col("x.a")) & inside).select("c.key", "c.lo", "c.hi", F.expr(f"substring(x.bytes, cast((c.lo - x.lo) * {u} + 1 as int), cast((c.hi - c.lo + {width}) * {u} as int))").alias("bytes"))

    def windows(batches):
        """Last pass: a row per window; span is all of it."""
        for batch in batches:
            out = [(key, s, long_hash(raw[(s - lo) * u : (s - lo + width) * u])) for key, lo, hi, raw in zip(*(c.to_pylist() for c in batch.columns)) for s in range(lo, hi + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.binary(), pa.int64(), pa.binary()))], ["key", "lo", "span"])

    window_rows = written(open_cells.mapInArrow(windows, "key binary, lo long, span binary"), "suffix-windows")
    twice = written(window_rows.groupBy("span").agg(F.count("*").alias("n")).filter("n > 1").select("span"), "suffix-windows")
    last = window_rows.join(twice, "span").select("key", "lo", F.col("lo").alias("hi"))
    every = whole.unionByName(whole2).unionByName(last)
    out = written(every.groupBy("key").agg(F.flatten(F.collect_set(F.array("lo", "hi"))).alias("runs")), "suffix-repeats")
    drop(*done, left, around, *done2, window_rows, twice)
    return out


def _digit(raw: bytes, lo: int, a: int, j: int, width: int, unit: Unit) -> int:
    """What all windows of cell j have in common, whether or not all of them are there: from a - j * cell to a - (j + 1) * cell + 1 + width. It lies inside any one of them."""
    return short_hash(raw[max(0, a - j * unit.cell - lo) * unit.size : (a - (j + 1) * unit.cell + 1 + width - lo) * unit.size])


def merged(runs: list[int], width: int) -> list[tuple[int, int]]:
    """Maximal ranges that windows starting in the runs (lo, hi, lo, hi, ...) cover."""
    out: list[tuple[int, int]] = []
    start = end = -1
    for lo, hi in sorted(zip(runs[0::2], runs[1::2])):
        if lo > end:
            if start >= 0:
                out.append((start, end))
            start, end = lo, hi + width
        else:
            end = max(end, hi + width)
    if start >= 0:
        out.append((start, end))
    return out


class Ranges:
    """A list of ranges per row, as a column."""

    def __init__(self):
        self.ends, self.flat = [0], []

    def add(self, found: list[tuple[int, int]]) -> None:
        for x in found:
            self.flat += x
        self.ends.append(len(self.flat) // 2)

    def array(self) -> pa.ListArray:
        flat = np.array(self.flat, np.int64)
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[0::2]), pa.array(flat[1::2])], ["start", "end"]))


def _runs(docs: DataFrame, text_col: str, width: int, unit: Unit) -> DataFrame:
    """key, runs of the texts that have repeated windows."""
    own = docs.select(_key(docs[text_col]).alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return repeated_runs(own.filter(F.octet_length("text") >= (width if unit is BYTES else 2 * width - 1)), width, unit)


def without_repeats(docs: DataFrame, width: int = 400, text_col: str = "text", unit: str = "bytes", mark_words: int = 0) -> DataFrame:
    """docs with a struct column `repeats`: n_bytes, n_removed, spans (removed byte ranges), kept (remaining bytes), kept_text (their whole characters), kept_sha256, passages.

    A byte goes if a string of `width` bytes that covers it also starts anywhere else, in the same text or any
    other row's. With unit="words" width counts words (between ASCII white space, which itself does not matter); what
    goes are the bytes from the first to the last word of a repeated passage. passages are the byte ranges of passages
    of mark_words words or more (0: none are looked for) that occur twice, whether or not they are removed. Null and
    empty texts and those shorter than width lose nothing (null counts as empty). Repeated
    rows are copies of each other. An empty table gives no rows; names are never taken twice. docs must be a
    stored table.
    """
    if unit not in ("bytes", "words"):
        raise ValueError("unit must be bytes or words")
    by_words = unit == "words"
    key, runs_name, marks_name, name = free_name(docs, "key", "runs", "marks", "repeats")
    bounded_batches(docs.sparkSession, 250)
    joined = docs.withColumn(key, _key(docs[text_col])).join(_runs(docs, text_col, width, WORDS if by_words else BYTES).withColumnsRenamed({"key": key, "runs": runs_name}), key, "left")
    if mark_words:
        joined = joined.join(_runs(docs, text_col, mark_words, WORDS).withColumnsRenamed({"key": key, "runs": marks_name}), key, "left")
    else:
        joined = joined.withColumn(marks_name, F.lit(None).cast("array<bigint>"))
    joined = joined.select(*docs.columns, runs_name, marks_name)
    at, places = docs.columns.index(text_col), len(docs.columns)

    def cut(batches):
        for batch in batches:
            counts, kept, texts, digests = ([], []), [], [], []
            spans, passages = Ranges(), Ranges()
            for text, found, marked in zip(batch.column(at).to_pylist(), batch.column(places).to_pylist(), batch.column(places + 1).to_pylist()):
                raw = (text or "").encode()
                gone = merged(found, width) if found else []
                gone = _byte_ranges(raw, gone) if by_words else gone
                passages.add(_byte_ranges(raw, merged(marked, mark_words)) if marked else [])
                spans.add(gone)
                left = raw
                if gone:
                    ends = [0, *(x for s in gone for x in s), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(ends[0::2], ends[1::2]))
                counts[0].append(len(raw))
                counts[1].append(len(raw) - len(left))
                kept.append(left)
                texts.append(left.decode("utf-8", "ignore") if gone else text or "")
                digests.append(hashlib.sha256(left).hexdigest())
            columns = [pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64()), spans.array(), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(digests, pa.string()), passages.array()]
            out = pa.StructArray.from_arrays(columns, ["n_bytes", "n_removed", "spans", "kept", "kept_text", "kept_sha256", "passages"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:places], out], [*batch.schema.names[:places], name])

    ranges = "array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(cut, schema_with(docs, name, f"n_bytes long, n_removed long, spans {ranges}, kept binary, kept_text string, kept_sha256 string, passages {ranges}"))
