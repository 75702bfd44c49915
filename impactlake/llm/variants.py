"""Spelling variants: words of the vocabulary at edit distance one, by self-joins of a partitioned trie.

A trie joins with itself by active nodes: those within distance one of a node's prefix. A child's active nodes follow
from its parent's alone (the parent, the siblings, the own children, and what the same letter leads to from an active
node at distance one), so they are handed down the trie, and terminal nodes give off the active ones that are terminal.

The trie is dealt out by prefixes. Two words whose first difference is at position c share c letters, and behind the
edit they end alike. A shard (m, low, high) joins words of m and m + 1 letters that share their first `low` letters and
their last m - high ones, for pairs with low <= c < high: first the two halves of a word, and a shard of too many words
is halved again and again until it is small or its words differ in one place, so that neither a common prefix nor a
common ending fills a task. Every pair has one c, so no pair is found twice and none is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches, drop, written

#: Letters of these words are A-Z and U+00C0 to U+00FF: one byte each in Latin-1.
_LETTER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: What a task remembers before it hands its counts on; words of a shard; utf-8 forms that are remembered.
ENTRIES, SHARD, REMEMBERED = 300_000, 20_000, 200_000


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTER_BYTES).split()


def slipped(word: bytes, utf8: bytes, start: int, one_in: int) -> bytes:
    """The word, or one letter less if the crc32 of `<id>:<word>` (carried on from `start`, that of `<id>:`) is a multiple of one_in."""
    h = zlib.crc32(utf8, start)
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 199, shortest: int = 6) -> DataFrame:
    """word, n: runs of at least `shortest` letters after slips, over all texts."""

    def count(batches):
        seen: Counter = Counter()
        forms: dict[bytes, bytes] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{i or ''}:".encode())
                for w, n in Counter(w for w in runs(text or "") if len(w) >= shortest).items():
                    utf8 = w if w.isascii() else forms.get(w)
                    if utf8 is None:
                        utf8 = forms[w] = w.decode("latin-1").encode()
                    w = slipped(w, utf8, start, one_in)
                    if len(w) >= shortest:
                        seen[w] += n
                if len(forms) > REMEMBERED:
                    forms.clear()
                if len(seen) > ENTRIES:
                    yield rows()
                    seen.clear()
        yield rows()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def trie_pairs(words: list[str]) -> list[tuple[int, int, int]]:
    """(a, b, c) for every two of the distinct words at distance one, a < b: their places in the list, and how many letters they share before they differ."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for k, word in enumerate(words):
        node = 0
        for letter in word:
            down = children[node].get(letter)
            if down is None:
                down = children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
            node = down
        ends[node] = k
    out = []
    # active nodes at distance one, with the depth of the first difference; at distance zero it is the node itself
    todo = [(0, 0, {v: 0 for v in children[0].values()})]
    while todo:
        node, depth, active = todo.pop()
        a = ends[node]
        if a >= 0:
            out += [(a, ends[v], c) for v, c in active.items() if ends[v] > a]
        for letter, child in children[node].items():
            near = {}
            for v, c in active.items():  # the same letter on both sides
                w = children[v].get(letter)
                if w is not None and w != child:
                    near[w] = c
            for w in children[node].values():  # another letter
                if w != child:
                    near[w] = max(depth, near.get(w, 0))
            near[node] = max(depth, near.get(node, 0))  # one letter less
            for w in children[child].values():  # one letter more
                near[w] = max(depth + 1, near.get(w, 0))
            todo.append((child, depth + 1, near))
    return out


def _shard_key(m: Column, low: Column, high: Column, word: Column) -> Column:
    tail = F.greatest(F.lit(0), m - high)
    return F.concat_ws(":", m, low, high, F.substring(word, F.lit(1), low), F.substring(word, F.length(word) - tail + 1, tail))


def shards(words: DataFrame, largest: int = SHARD) -> DataFrame:
    """word, n, m, low, high, key: each word once for every shard that it is in (a shard has at most about `largest` words)."""

    def halves(rows: DataFrame) -> DataFrame:
        mid = F.expr("low + cast(ceil((high - low) / 2) as int)")
        parts = F.array(F.struct(mid.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), mid.alias("high")))
        cut = rows.select("word", "n", "m", F.explode(parts).alias("x")).select("word", "n", "m", "x.low", "x.high")
        return cut.withColumn("key", _shard_key(F.col("m"), F.col("low"), F.col("high"), F.col("word")))

    each = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"))
    todo = halves(each.withColumns({"low": F.lit(0), "high": F.col("m") + 1}))
    done = []
    while True:
        todo = written(todo, "variant-shards")
        sizes = todo.groupBy("key").agg(F.count("*").alias("words"), F.first(F.col("high") - F.col("low")).alias("free"))
        large = written(sizes.filter((F.col("words") > largest) & (F.col("free") > 1)).select("key"), "variant-large")
        if large.isEmpty():
            return _union([*done, todo])
        done.append(todo.join(large, "key", "left_anti"))
        todo = halves(todo.join(large, "key", "left_semi").select("word", "n", "m", "low", "high"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def near_words(sharded: DataFrame) -> DataFrame:
    """word, n_near, form_n, form of the words with a near word: how many, and of those the one of largest n (ties: the first in order); summed by shards, so a word may have several rows."""

    def joined(group: list[tuple]) -> list[tuple]:
        if len(group) < 2:  # alone in its shard a word has no partner there
            return []
        _, m, low, high, _, _ = group[0]
        tail = max(0, m - high)
        words = [g[4] for g in group]
        best: dict[int, list] = {}
        for a, b, c in trie_pairs([w[low : len(w) - tail] for w in words]):
            if low + c < high and min(len(words[a]), len(words[b])) == m:
                for x, y in ((a, b), (b, a)):
                    own = best.setdefault(x, [0, 0, ""])
                    own[0] += 1
                    own[1], own[2] = min((own[1], own[2]), (-group[y][5], words[y]))
        return [(words[x], k, -n, form) for x, (k, n, form) in best.items()]

    def stream(batches):
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    out += joined(group)
                    group = []
                group.append(row)
            yield _found(out)
        yield _found(joined(group))

    ordered = sharded.select("key", "m", "low", "high", "word", "n").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(stream, "word string, n_near long, form_n long, form string")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms(word, form): the end of the chain of forms, by doubling; a chain has no circle as counts grow along it."""
    step = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        drop(step)
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        step = new.drop("moved")
        step._llm_path = new._llm_path


def variants(docs: DataFrame, least: int = 5, shortest: int = 6, factor: int = 5, one_in: int = 199, largest: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least `least` occurrences.

    A word's form is its near word of largest n (ties: the first in code-point order) if that n is at least factor
    times its own, else null; its root is the end of the chain of forms, itself without one. Null texts have no words;
    a null id counts as empty text; runs of any length count whole; repeated rows count again; an empty table or one
    without such words gives no rows; other columns are ignored. docs must be a stored table: it is read once.
    """
    bounded_batches(docs.sparkSession)
    words = written(word_counts(docs, id_col, text_col, one_in, shortest).filter(F.col("n") >= least), "variant-words")
    near = near_words(shards(words, largest))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    nothing = F.lit(0).cast("long")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", nothing).alias("n_near"), (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))
    strong = F.col("form_n") >= factor * F.col("n")
    known = written(known.withColumns({"form": F.when(strong, F.col("form")), "form_n": F.when(strong, F.col("form_n"))}), "variant-forms")
    drop(words)
    return known.join(roots(known), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
