"""Source divergence audit: how far the word use of each (language, source) group is from its language's other sources and from the language as a whole.

Terms are maximal runs of letters A-Z and of non-ASCII characters, with A-Z lower-cased. A language keeps the terms that
are in enough of its documents. Probabilities are smoothed whole numbers, so that sums are exact in any order.

A pair of sources is not compared term by term: what counts is its joint histogram, the number of kept terms for each
combination (count here, count there). Terms are dealt into blocks; a block's task tallies the combinations of each pair
of sources, the implied ones with a count of 0 on one side included (a source's own histogram without what the pair
shares), Spark adds the tallies up, and the distance is evaluated once a combination and multiplied. Terms that both
sides lack are what is left of the language's kept terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches, drop, written

#: What a task remembers before it hands its counts on.
ENTRIES = 250_000
#: A block has at most so many terms, and at most so many pairs of term and source.
BLOCK_TERMS, BLOCK_CELLS = 4096, 1 << 20
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """lang, source, term (binary), n occurrences in d documents, summed by tasks: a key may have several rows."""

    def count(batches):
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows():
            flat = [(g[0], g[1], t, n, d[t]) for g, (o, d) in seen.items() for t, n in o.items()]
            columns = list(zip(*flat)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "d"])

        for batch in batches:
            for k, s, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = seen.get((k, s))
                if own is None:
                    own = seen[k, s] = (Counter(), Counter())
                words = terms_of(x)
                own[0].update(words)
                own[1].update(set(words))
            if sum(len(o) for o, _ in seen.values()) > ENTRIES:
                yield rows()
                seen.clear()
        yield rows()

    return docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text")).mapInArrow(count, "lang string, source string, term binary, n long, d long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), in two steps that stay within 64 bits for totals below 2 * 10**14."""
    div = lambda a, b: F.call_function("div", a, b)
    whole = F.greatest(total + 5 * kept, F.lit(1).cast("long"))
    part = (count.cast("long") + 5) * 31250
    return 1 + div(part, whole) * 32000 + div(part % whole * 32000, whole)


def pair_tally(cells: pa.Table) -> pa.Table:
    """i, j, x, y, m: for each two sources i < j of a block how many terms have the counts x and y, one of which may be 0.

    cells: i (from 0), term, n > 0, sources (how many the language has).
    """
    source, n = cells["i"].to_numpy().astype(np.int64), cells["n"].to_numpy().astype(np.int64)
    term = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    sources = cells["sources"][0].as_py()
    order = np.argsort(term, kind="stable")
    source, n, term = source[order], n[order], term[order]
    start = np.searchsorted(term, np.arange(term[-1] + 2))
    levels, level = np.unique(n, return_inverse=True)
    out: list[tuple] = []
    for a in np.unique(source):
        own = np.nonzero(source == a)[0]
        low, size = start[term[own]], start[term[own] + 1] - start[term[own]]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        counts, x = np.unique(n[own], return_inverse=True)
        other, x_at = source[at], np.repeat(x, size)
        later = other > a
        key, m = np.unique((other[later] * len(counts) + x_at[later]) * len(levels) + level[at[later]], return_counts=True)
        left, y = np.divmod(key, len(levels))
        j, left = np.divmod(left, len(counts))
        out.append((np.full(len(key), a), j, counts[left], levels[y], m))
        shared = np.bincount(other * len(counts) + x_at, minlength=sources * len(counts)).reshape(sources, len(counts))
        alone = np.bincount(x, minlength=len(counts)) - shared  # with itself it shares all
        j, left = np.nonzero(alone)
        none, first = np.zeros(len(j), np.int64), j > a
        out.append((np.minimum(j, a), np.maximum(j, a), np.where(first, counts[left], none), np.where(first, none, counts[left]), alone[j, left]))
    return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["i", "j", "x", "y", "m"])


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs, null values read as ''.

    Part pair: item is each other source of the language, value the sum of the absolute differences of the terms' shares
    (whole numbers, see share()). Part term: item is each kept term that the group has and uses more than its language
    does, value the difference, the `top` largest. rank counts from 1 by value descending, then item in UTF-8 order. A
    group without terms has its pairs too; a language without kept terms has pairs of value 0; an only source has no
    pairs. Repeated rows are documents of their own, texts count whole, an empty table gives no rows, other columns are
    ignored. docs must be a stored table: its texts are read once and its groups once more.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    numbered = groups.withColumn("i", number).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    numbered = written(numbered.select("lang", "source", F.col("i").cast("long"), F.col("sources").cast("long")), "divergence-groups")
    counted = term_counts(docs, text_of(lang_col), text_of(source_col), text_of(text_col))
    every = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "divergence-counts")
    kept = written(every.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all_n")).filter(F.col("d") >= least_docs).select("lang", "term", "all_n"), "divergence-terms")
    cells = every.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).join(numbered, ["lang", "source"])
    cells = written(cells.select("lang", "i", "term", "n", "all_n", "sources"), "divergence-cells")
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    own = cells.groupBy("lang", "i").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    known = numbered.join(size, "lang", "left").join(own, ["lang", "i"], "left")
    known = written(known.select("lang", "source", "i", "sources", zero("kept"), zero("all_total"), zero("total")), "divergence-groups")

    # joint histograms by pair, then the distance once a combination
    terms = F.least(F.lit(BLOCK_TERMS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / F.col("sources"))))
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / terms).cast("long"))
    dealt = cells.join(size.select("lang", "kept"), "lang").select("lang", block.alias("block"), "i", "term", "n", "sources")

    found = dealt.groupBy("lang", "block").applyInArrow(_tally, "lang string, i long, j long, x long, y long, m long")
    joint = found.groupBy("lang", "i", "j", "x", "y").agg(F.sum("m").alias("m"))
    side = lambda k: known.select("lang", F.col("i").alias(k), F.col("total").alias(f"total_{k}"))
    kept_ = known.select("lang", "kept").distinct()
    distance = lambda x, y: F.abs(share(x, F.col("total_i"), F.col("kept")) - share(y, F.col("total_j"), F.col("kept")))
    scored = joint.join(side("i"), ["lang", "i"]).join(side("j"), ["lang", "j"]).join(kept_, "lang")
    sums = scored.groupBy("lang", "i", "j").agg(F.sum(F.col("m") * distance(F.col("x"), F.col("y"))).alias("part"), F.sum("m").alias("terms"))
    ends = known.select("lang", "i", "kept", F.col("source").alias("source_i"), F.col("total").alias("total_i")).join(known.select("lang", F.col("i").alias("j"), F.col("source").alias("source_j"), F.col("total").alias("total_j")), "lang").filter("i < j")
    nothing = F.lit(0).cast("long")
    value = F.coalesce("part", nothing) + (F.col("kept") - F.coalesce("terms", nothing)) * distance(nothing, nothing)
    pairs = written(ends.join(sums, ["lang", "i", "j"], "left").select("lang", "source_i", "source_j", value.alias("value")), "divergence-pairs")
    one_way = lambda a, b: pairs.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(b).alias("item"), "value")
    both = one_way("source_i", "source_j").unionByName(one_way("source_j", "source_i"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    # what a group uses more than its language: Spark keeps the first of each task before they are dealt
    more = cells.select("lang", "i", "term", "n", "all_n").join(known, ["lang", "i"])
    over = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("all_n"), F.col("all_total"), F.col("kept"))
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), over.alias("value")).filter("value > 0")
    drop(every)
    return ranked(both).unionByName(ranked(more).filter(F.col("rank") <= top))


def _tally(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    out = pair_tally(rows)
    return out.add_column(0, "lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))
