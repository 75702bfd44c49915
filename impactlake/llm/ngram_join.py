"""Similarity self-join of documents on their sets of word n-grams, by a blocked sparse matrix product.

The product of the document by n-gram matrix with its transpose counts what two documents share. Only the
columns that can decide are multiplied at first: if two sets overlap enough for the threshold, the rarest
n - ceil(t * n) + 1 n-grams of each (in one common order) have one in common, so the product over these columns
has all links among its non-zero cells. Cells whose sizes rule the threshold out are discarded, the others'
overlaps are counted over whole rows.

Documents with equal sets are one class. In each column the smallest class is the pivot: first every class is
multiplied with its pivots, which is linear in the column. Each class has a parity map of a bit or two a gram, which
with the two sizes bounds an overlap from above: pairs that it rules out are discarded before any set is shipped.
What is left of the columns (classes of different components, of sizes that can link) goes through the same bound in
blocks of bounded size, which keep the rows that may link with one of another component; only those rows' sets are
multiplied, in blocks again, and the tasks send a spanning forest of the links and never the pairs. Columns of near
copies have mostly the same rows, so each class's largest column is multiplied first and columns within those
are settled by it.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.llm import sketches
from impactlake.llm.common import WordHashes, bounded_batches, drop, free_name, mix64, written
from impactlake.llm.components import components, spanning

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A block of the product holds about this many documents and n-grams at most.
BLOCK_ROWS, BLOCK_GRAMS = 1024, 1_000_000
#: A block of the parity maps holds about this many rows.
MAP_ROWS = 4096


class GramSets:
    """Sorted distinct hashes of a text's word n-grams; a text of fewer words is one n-gram."""

    def __init__(self, width: int):
        self.width, self.hashes = width, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes.of(words)
        width = min(self.width, len(h))  # shorter texts: the hash of one word or two, as far from the others as any
        key = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            key *= _A
            key += h[k : len(h) - width + 1 + k]
        key = np.sort(mix64(key ^ _B))
        return key[np.concatenate([[True], key[1:] != key[:-1]])]


def prefix_size(n: int, t: Fraction) -> int:
    return n - math.ceil(t * n) + 1


def class_of(grams: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed) - (1 << 63)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(shared, n, m, t: Fraction):
    return shared * (t.numerator + t.denominator) >= t.numerator * (n + m)  # shared / (n + m - shared) >= t


def block_links(classes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of a block whose labels differ: sparse product, 256 rows at a time."""
    n = np.array([len(s) for s in sets], np.int64)
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(grams)) > 1  # a column with one entry adds nothing
    new = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), n)
    keep = often[column]
    row, column = row[keep], new[column[keep]]
    by_column = np.argsort(column, kind="stable")
    row_c = row[by_column]
    start = np.searchsorted(column[by_column], np.arange(int(often.sum()) + 1))
    at_row = np.searchsorted(row, np.arange(len(sets) + 1))
    pairs = []
    for i in range(len(sets)):  # one row of the product
        own = column[at_row[i] : at_row[i + 1]]
        low, size = start[own], start[own + 1] - start[own]
        if not len(own):
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        shared = np.bincount(row_c[at], minlength=len(sets))
        good = linked(shared, n[i], n, t) & (labels != labels[i])
        good[: i + 1] = False
        pairs += [(int(classes[i]), int(classes[j])) for j in np.nonzero(good)[0]]
    return spanning(pairs)


def parity_map(grams: np.ndarray) -> np.ndarray:
    """For each of 2**k slots (as many as grams or up to twice as many, 64 at least) whether an odd number of grams falls there, as 64-bit words."""
    bits = 1 << max(6, int(len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A parity map made smaller: slots that become one are added up."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def may_link(words: np.ndarray, other: np.ndarray, n, m, t: Fraction):
    """False where the maps and sizes rule a link out: every odd slot of their difference holds a gram that the sets don't share."""
    odd = np.bitwise_count(words ^ other).sum(axis=-1, dtype=np.int64)
    return linked((n + m - odd) // 2, n, m, t)


def open_rows(maps: list[np.ndarray], n: np.ndarray, labels: np.ndarray, t: Fraction) -> np.ndarray:
    """Which rows of a block may link with a row of another label."""
    size = min(map(len, maps))
    table = np.stack([folded(m, size) for m in maps])
    out = np.zeros(len(maps), bool)
    for i in range(len(maps)):
        if not out[i]:
            good = may_link(table, table[i], n, n[i], t) & (labels != labels[i])
            out[i] = good.any()
            out |= good
    return out


def similar_classes(docs: DataFrame, threshold: Fraction, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(a row per document: id, key, n, c; a row per class that is not its component's smallest: node, label).

    key is the text's md5; c is the class of documents with equal sets, null without words. docs must be a stored table: it is read
    three or four times.
    """
    spark, t = docs.sparkSession, threshold
    bounded_batches(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(16, math.ceil(math.log2(max(2, size / 6 / 16)))))  # about 16 n-grams a counter while 2**24 are enough
    shift = np.uint64(64 - bits)

    def count(own, batch):
        sets = GramSets(width)
        slots = [(sets(x) >> shift).astype(np.int64) for x in batch.column(0).to_pylist()]
        slots, n = np.unique(np.concatenate(slots or [np.zeros(0, np.int64)]), return_counts=True)
        own[slots] += n.astype(np.uint32)

    frequency = spark.sparkContext.broadcast(sketches.sums(texts, 1 << bits, count))  # 16 MB at most; it only orders
    for seed in range(8):
        rows = written(_rows(docs, frequency, shift, threshold, width, seed, id_col, text_col), "ngram-rows")
        worded = rows.filter("n > 0")
        clash = worded.groupBy("c").agg((F.min("c2") != F.max("c2")).alias("x")).filter("x")
        if clash.isEmpty():
            break
        drop(rows)
    classes = written(worded.groupBy("c").agg(*(F.first(x).alias(x) for x in ("n", "map", "prefix"))), "ngram-classes")
    rows_ = written(rows.select("id", "key", "n", "c"), "ngram-rows")
    drop(rows)
    maps = classes.select("c", "n", "map")
    entries = classes.select("c", F.explode("prefix").alias("h"))
    # columns with two rows or more; the pivot is the smallest class
    columns = written(entries.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("p")).filter("m > 1").select("h", "p"), "ngram-columns")
    members = written(entries.join(columns, "h").filter("c != p"), "ngram-columns")
    drop(columns)
    pairs = written(_paired(members.select("c", "p").distinct(), maps, t), "ngram-pairs")
    sets = [written(_sets(docs, _ends(pairs), width, seed, text_col), "ngram-sets")]
    # a class meets one of its pivots first, the others only if the two are not yet connected
    first = pairs.groupBy("c").agg(F.min("p").alias("p"))
    found = [_verified(first, sets[0], t)]
    stars = components(found[0], "u", "v")
    rest = _labelled(pairs, stars, "c", "p").filter("label != label_p").select("c", "p")
    found.append(_verified(rest, sets[0], t))
    drop(pairs)
    edges = _stars(stars).unionByName(found[1])
    if not found[1].isEmpty():
        stars = components(edges, "u", "v")
    # rows other than pivots, by column and size: sizes that can link are in one of two neighbouring steps together
    step = F.floor(F.log(F.col("n").cast("double")) / -math.log(float(t)))
    of_class = written(classes.select("c", "n", F.array(step, step + 1).alias("s")).join(stars.select(F.col("node").alias("c"), "label"), "c", "left").select("c", "n", "s", F.coalesce("label", "c").alias("label")), "ngram-labels")
    labelled = members.join(of_class, "c").select("h", "c", "n", F.explode("s").alias("s"), "label")
    labelled = written(labelled, "ngram-labels")
    mixed = written(labelled.groupBy("h", "s").agg(F.count("*").alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("h", "s", "m"), "ngram-open")
    opened = written(_salted(labelled, mixed, ["h", "s"]).select(F.xxhash64("h", "s").alias("g"), "m", "n", "c", "label"), "ngram-open")
    drop(members, of_class, labelled, mixed)
    left = written(_open(opened, maps, t), "ngram-open")
    tables = [classes, opened, left, *found]
    links = [_stars(stars)]
    if not left.isEmpty():
        more = written(left.select("c").distinct().join(sets[0].select("c"), "c", "left_anti"), "ngram-ends")
        if not more.isEmpty():
            sets.append(written(_sets(docs, more, width, seed, text_col, sets[0]), "ngram-sets"))
        tables.append(more)
    every = sets[0] if len(sets) == 1 else sets[0].unionByName(sets[1])
    for last in (False, False, True):
        if left.isEmpty():
            break
        now = left
        if not last:  # the largest column of each class: most others of its rows are within these
            chosen = written(left.groupBy("c").agg(F.max(F.struct("m", "g")).alias("x")).select(F.col("x.g").alias("g")).distinct(), "ngram-open")
            now = written(left.join(chosen, "g", "left_semi"), "ngram-open")
            tables += [chosen, now]
        links.append(written(_products(now, every, t), "ngram-links"))
        tables.append(links[-1])
        if last:
            break
        # a column is settled if one that was multiplied has all its rows
        within = left.select("g", "m", "c").join(now.select("c", F.col("g").alias("done")), "c").groupBy("g", "done").agg(F.count("*").alias("have"), F.first("m").alias("m"))
        settled = written(within.filter("have = m").select("g").distinct(), "ngram-open")
        left = written(left.join(settled, "g", "left_anti"), "ngram-open")
        tables += [settled, left]
    labels = stars
    if len(links) > 1:
        edges = links[0]
        for x in links[1:]:
            edges = edges.unionByName(x)
        labels = components(edges, "u", "v")
    drop(*tables, *sets)
    return rows_, labels


def _stars(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("node").alias("u"), F.col("label").alias("v"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("c").unionByName(pairs.select(F.col("p").alias("c"))).distinct()


def _labelled(pairs: DataFrame, stars: DataFrame, c: str, p: str) -> DataFrame:
    out = pairs.join(stars.select(F.col("node").alias(c), "label"), c, "left").join(stars.select(F.col("node").alias(p), F.col("label").alias("label_p")), p, "left")
    return out.select(c, p, F.coalesce("label", c).alias("label"), F.coalesce("label_p", p).alias("label_p"))


def _paired(pairs: DataFrame, maps: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (c, p) that sizes and parity maps leave."""
    left, right = (maps.select(F.col("c").alias(k), F.col("n").alias(f"n_{k}"), F.col("map").alias(f"map_{k}")) for k in "cp")
    small, large = F.least("n_c", "n_p"), F.greatest("n_c", "n_p")
    both = pairs.join(left, "c").join(right, "p").filter(small * t.denominator >= large * t.numerator)

    def bound(batches):
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                keep.append(bool(may_link(folded(x, size), folded(y, size), n, m, t)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["c", "p"]).filter(pa.array(keep, pa.bool_()))

    return both.select("c", "p", "map_c", "map_p", "n_c", "n_p").mapInArrow(bound, "c long, p long")


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (c, p) whose sets link, as u and v: overlaps counted over whole rows."""

    def multiply(batches):
        for batch in batches:
            out = []
            for c, p, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if linked(overlap(x, y), len(x), len(y), t):
                    out.append((c, p))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    both = pairs.join(sets.select("c", F.col("grams").alias("x")), "c").join(sets.select(F.col("c").alias("p"), F.col("grams").alias("y")), "p")
    return written(both.select("c", "p", "x", "y").mapInArrow(multiply, "u long, v long"), "ngram-links")


def _salted(rows: DataFrame, keys: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """rows joined with one row a key, a key's rows dealt to several tasks by their class."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(salts)))
    each = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(each, [*on, "salt"]).drop("salt")


def _cells(columns: DataFrame, blocks, *more: str) -> DataFrame:
    """Each row of columns(g, c, ...) once for every pair of its column's blocks that its own block is in."""
    own = F.pmod(F.xxhash64("c"), F.col("k")).cast("int")
    cells = columns.withColumn("k", blocks.cast("int")).withColumn("own", own).select("g", "c", "label", "own", *more, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    return cells.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "label", *more)


def _open(columns: DataFrame, maps: DataFrame, t: Fraction) -> DataFrame:
    """What parity maps leave of columns(g, m, n, c, label): rows that may link with one of another label, and how many and large those of their column are."""
    cells = _cells(columns, F.ceil(F.col("m") / MAP_ROWS), "n").join(maps.select("c", "map"), "c")

    def bound(rows: pa.Table) -> pa.Table:
        labels, n = (rows[k].to_numpy() for k in ("label", "n"))
        keep = open_rows([np.frombuffer(x, np.uint64) for x in rows["map"].to_pylist()], n, labels, t) if (labels != labels[0]).any() else np.zeros(len(n), bool)
        return rows.select(["g", "c", "n", "label"]).filter(pa.array(keep))

    kept = cells.groupBy("g", "i", "j").applyInArrow(bound, "g long, c long, n long, label long").distinct()
    kept = written(kept, "ngram-open")
    sizes = written(kept.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("grams")), "ngram-open")
    return kept.join(sizes, "g").select("g", "m", "grams", "c", "label")


def _products(columns: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Links between rows of columns(g, m, grams, c, label) whose labels differ, as spanning forests of blocks of bounded size."""
    cells = _cells(columns, F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS))).join(sets, "c")

    def product(rows: pa.Table) -> pa.Table:
        classes, labels = (rows[k].to_numpy() for k in ("c", "label"))
        found = block_links(classes, [np.frombuffer(x, np.uint64) for x in rows["grams"].to_pylist()], labels, t) if len(set(labels.tolist())) > 1 else []
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return cells.groupBy("g", "i", "j").applyInArrow(product, "u long, v long")


def _rows(docs, frequency, shift, t: Fraction, width: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    def rows(batches):
        sets = GramSets(width)
        for batch in batches:
            sets.hashes.trim()
            out = []
            for x in batch.column(1).to_pylist():
                g = sets(x)
                if not len(g):
                    out.append((0, None, None, None, None))
                    continue
                rare = np.lexsort((g, frequency.value[(g >> shift).astype(np.int64)]))[: prefix_size(len(g), t)]
                out.append((len(g), class_of(g, seed), class_of(g, seed + 100), parity_map(g).tobytes(), g[rare].view(np.int64)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))], ["id", "key", "n", "c", "c2", "map", "prefix"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.unhex(F.md5(text_col)).alias("key"))
    return own.mapInArrow(rows, "id long, key binary, n long, c long, c2 long, map binary, prefix array<bigint>")


def _sets(docs, needed: DataFrame, width: int, seed: int, text_col: str, have: DataFrame | None = None) -> DataFrame:
    """c, grams of the needed classes; a bit array of fixed size tells the tasks which, and lets a few others pass, but none that are in `have`."""
    spark = docs.sparkSession
    n = needed.count()
    bits = min(24, max(16, math.ceil(math.log2(16 * n + 1))))

    def mark(own, batch):
        own[batch.column(0).to_numpy() & ((1 << bits) - 1)] |= 1

    wanted = spark.sparkContext.broadcast(sketches.sums(needed, 1 << bits, mark, np.uint8) > 0)

    def rows(batches):
        sets, seen = GramSets(width), set()
        for batch in batches:
            sets.hashes.trim()
            if len(seen) > 200_000:
                seen.clear()
            out = []
            for x in batch.column(0).to_pylist():
                g = sets(x)
                if len(g) and wanted.value[(c := class_of(g, seed)) & ((1 << bits) - 1)] and c not in seen:
                    seen.add(c)
                    out.append((c, g.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["c", "grams"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "c long, grams binary")
    found = found.groupBy("c").agg(F.first("grams").alias("grams"))
    return found.join(have.select("c"), "c", "left_anti") if have is not None else found


def jaccard_components(docs: DataFrame, threshold: Fraction = Fraction(8, 10), width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document: its set's size and the smallest id that links reach from it.

    Two documents link if the Jaccard similarity of their sets of word n-grams is at least the threshold. Null
    texts and texts without a word have an empty set and no links; equal ids and repeated rows are documents of
    their own that link as their sets do; a component whose ids are all null has a null component_id. An empty
    table gives no rows; other columns are ignored. docs must be a stored table.
    """
    rows, labels = similar_classes(docs, threshold, width, id_col, text_col)
    ids = rows.filter("c is not null").groupBy("c").agg(F.min("id").alias("least"))
    ids = ids.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = ids.groupBy("label").agg(F.min("least").alias("component"))
    of_class = ids.select("c", "label").join(least, "label").select("c", "component")
    joined = rows.join(of_class, "c", "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, threshold: Fraction = Fraction(8, 10), width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that another one of their component stands for: the smallest id stays (null ids last).

    Of repeated rows one stays. Texts that are null or have no word are linked with nothing and all stay. Columns
    and their names are those of docs, which must be a stored table.
    """
    rows, labels = similar_classes(docs, threshold, width, id_col, text_col)
    labelled = rows.filter("c is not null").select("key", "c").distinct().join(labels.select(F.col("node").alias("c"), "label"), "c", "left")
    labelled = labelled.select("key", F.coalesce("label", "c").alias("label"))
    named = free_name(docs, "row_mark", "row_key")
    text, mark, key = F.col(text_col).cast("string"), *map(F.col, named)
    worded = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    marked = docs.filter(worded).withColumns({named[0]: F.xxhash64(*docs.columns), named[1]: F.unhex(F.md5(text))})
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), mark.alias("mark"), key.alias("key"))
    small = marked.select(order.alias("order"), key.alias("key"))
    first = small.join(labelled, "key").groupBy("label").agg(F.min("order").alias("order")).select(F.col("order.mark").alias(named[0]), F.col("order.key").alias(named[1]))
    stay = marked.join(first, named, "left_semi").dropDuplicates(named).select(*docs.columns)
    return stay.unionByName(docs.filter(~worded))
