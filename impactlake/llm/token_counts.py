"""Edit-aware token counts: a segment tree over runs of pre-tokens for each document.

A leaf is a run of whole pre-tokens, its sums are its characters and tokens. An edit finds its leaves by
descending the character sums, changes their text, takes in a neighbour where the border between two leaves is
no longer a sure pre-token border, encodes that region alone and updates the sums on the path to the root.
"""

from __future__ import annotations

from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from impactlake.llm.common import bounded_batches, free_name
from impactlake.llm.tokens import encoder

LEAF_CHARS = 256
EDITS = "array<struct<start:bigint,deleted:bigint,inserted:string>>"


def sure_border(left: str, right: str) -> bool:
    """Whether pre-tokens surely end between left and right, whatever stands further away.

    So they do before a single white space between visible characters, and between a letter, a digit and another
    visible character; but after an apostrophe, and at the characters of added tokens' strings.
    """
    if not left or not right:
        return False
    a, b = left[-1], right[0]
    if a.isspace() or a in "<|>'" or b in "<|>":
        return False
    if b in " \n\t\r\u3000":
        return len(right) > 1 and not right[1].isspace()
    return not b.isspace() and _kind(a) != _kind(b)


def _kind(c: str) -> str:
    kind = category(c)[0]
    return kind if kind in "LN" else ""


def next_border(text: str, at: int, reach: int) -> int:
    """The first sure border from `at` on; at a space if there is one within `reach`. -1: there is none."""
    space = text.find(" ", at)
    while 0 <= space <= at + reach:
        if space and sure_border(text[space - 1], text[space : space + 2]):
            return space
        space = text.find(" ", space + 1)
    for i in range(max(1, at), len(text)):
        if sure_border(text[i - 1], text[i : i + 2]):
            return i
    return -1


def leaves_of(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text cut at a sure border from `size` characters on, again and again."""
    out, start = [], 0
    while len(text) - start > size and (at := next_border(text, start + size, size)) >= 0:
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


class SegmentTree:
    """Sums of characters and tokens in heap order: node i has the children 2i and 2i + 1, leaf j is node size + j."""

    def __init__(self, text: str, count, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.count, self.changed, self.encoded = count, {}, 0
        self.text = text
        if chars is None:
            leaves = leaves_of(text)
            self.size = 1 << max(0, len(leaves) - 1).bit_length()
            pad = [0] * (self.size - len(leaves))
            self.chars = self.heap([len(x) for x in leaves] + pad)
            self.tokens = self.heap([count(x) for x in leaves] + pad)
        else:
            self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2
        self.starts = np.concatenate([[0], np.cumsum(self.chars[self.size :])]).tolist()  # of the leaves in the text as it came

    @staticmethod
    def heap(leaves: list[int]) -> list[int]:
        level, levels = np.array(leaves, np.int64), []
        while True:
            levels.append(level)
            if len(level) == 1:
                return [0, *np.concatenate(levels[::-1]).tolist()]
            level = level[0::2] + level[1::2]

    def leaf(self, i: int) -> str:
        return self.changed[i] if i in self.changed else self.text[self.starts[i] : self.starts[i + 1]]

    def locate(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character; the end lies in the last leaf that has characters."""
        at = min(at, self.chars[1])
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node] and (at > self.chars[node] or self.chars[node + 1]):
                at -= self.chars[node]
                node += 1
        return node - self.size, at

    def put(self, i: int, text: str, tokens: int) -> None:
        """A leaf's new text; only the sums above it change."""
        self.changed[i] = text
        node = self.size + i
        more, more_tokens = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += more_tokens
            node //= 2

    def neighbour(self, i: int, step: int) -> int | None:
        """The next leaf that has characters."""
        i += step
        while 0 <= i < self.size and not self.chars[self.size + i]:
            i += step
        return i if 0 <= i < self.size else None

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replace `deleted` characters from `start` on; both are held to the text's limits."""
        start = min(max(0, start), self.chars[1])
        deleted = min(max(0, deleted), self.chars[1] - start)
        if not deleted and not inserted:
            return
        (first, a), (last, b) = self.locate(start), self.locate(start + deleted)
        text = self.leaf(first)[:a] + inserted + self.leaf(last)[b:]
        spent = {i for i in range(first + 1, last + 1) if self.chars[self.size + i]}
        left, right = self.neighbour(first, -1), self.neighbour(last, 1)
        while left is not None and not sure_border(self.leaf(left), text[:2]):
            text = self.leaf(left) + text
            spent.add(left)
            left = self.neighbour(left, -1)
        while right is not None and not sure_border(text, self.leaf(right)[:2]):
            text += self.leaf(right)
            spent.add(right)
            right = self.neighbour(right, 1)
        self.encoded += len(text)
        spent.add(first)
        pieces = [(x, self.count(x)) for x in leaves_of(text)] if len(text) > 2 * LEAF_CHARS else [(text, self.count(text))]
        if len(pieces) > max(spent) - min(spent) + 1:
            self.rebuild(min(spent), max(spent), pieces)
            return
        for i in range(min(spent), max(spent) + 1):
            self.put(i, *(pieces[i - min(spent)] if i - min(spent) < len(pieces) else ("", 0)))

    def rebuild(self, first: int, last: int, pieces: list[tuple[str, int]]) -> None:
        """A tree with more leaves: the pieces in place of the leaves first to last. Only sums are computed anew."""
        old = [(self.leaf(i), self.tokens[self.size + i]) for i in range(self.size)]
        leaves = [x for x in [*old[:first], *pieces, *old[last + 1 :]] if x[0]] or [("", 0)]
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        pad = [0] * (self.size - len(leaves))
        self.chars, self.tokens = self.heap([len(x) for x, _ in leaves] + pad), self.heap([n for _, n in leaves] + pad)
        self.text, self.changed = "".join(x for x, _ in leaves), {}
        self.starts = np.concatenate([[0], np.cumsum(self.chars[self.size :])]).tolist()

    @property
    def now(self) -> str:
        return "".join(self.leaf(i) for i in range(self.size))


def _with(df: DataFrame, at: list[str], add: list[tuple[str, object]], run) -> DataFrame:
    """df with further columns that run(values of the columns `at`) gives for each row."""
    bounded_batches(df.sparkSession, 500)
    places = [df.columns.index(c) for c in at]
    names = [n for n, _ in add]
    kinds = [{LongType: pa.int64(), ArrayType: pa.list_(pa.int32())}.get(type(t), pa.string()) for _, t in add]

    def rows(batches):
        for batch in batches:
            found = [run(*values) for values in zip(*(batch.column(i).to_pylist() for i in places))]
            columns = list(zip(*found)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*batch.schema.names, *names])

    return df.mapInArrow(rows, StructType([*df.schema.fields, *(StructField(n, t) for n, t in add)]))


def build_trees(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, tree_chars and tree_tokens, the state that apply_edits() goes on from.

    A null or empty text has 0 tokens; an empty table gives no rows; a very long text is cut into many leaves and
    counted leaf by leaf. If docs has such names already, the new ones get underscores before them.
    """
    names = free_name(docs, "n_tokens", "tree_chars", "tree_tokens")

    def run(text):
        tree = SegmentTree(text or "", encoder(tokenizer).count)
        return tree.tokens[1], tree.chars, tree.tokens

    return _with(docs, [text_col], list(zip(names, (LongType(), ArrayType(IntegerType()), ArrayType(IntegerType())))), run)


def apply_edits(trees: DataFrame, tokenizer: str, edits_col: str, text_col: str = "text", chars_col: str = "tree_chars", tokens_col: str = "tree_tokens", with_state: bool = True) -> DataFrame:
    """trees with tokens_after and chars_encoded, and with_state also text_after, chars_after and trees_after.

    edits_col is an array<struct<start, deleted, inserted>>, applied in order, each on the text the ones before
    left; positions are characters and held to the text's limits, null fields count as 0 and empty, null edits
    change nothing. Ties and repeated rows need no care: each row is edited for itself. An empty table gives no
    rows. In very long texts an edit encodes the touched leaves alone, and a leaf that grows is cut into several.
    """
    names = free_name(trees, "tokens_after", "chars_encoded", "text_after", "chars_after", "trees_after")[: 5 if with_state else 2]
    kinds = (LongType(), LongType(), StringType(), ArrayType(IntegerType()), ArrayType(IntegerType()))

    def run(text, chars, tokens, edits):
        tree = SegmentTree(text or "", encoder(tokenizer).count, chars, tokens)
        for e in edits or ():
            if e:
                tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
        out = (tree.tokens[1], tree.encoded)
        return (*out, tree.now, tree.chars, tree.tokens) if with_state else out

    return _with(trees, [text_col, chars_col, tokens_col, edits_col], list(zip(names, kinds)), run)


def sample_edits(text) -> object:
    """Three edits that depend on the text's length alone: words inserted at a quarter, replaced at the half, deleted at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    part = lambda share, deleted, inserted: F.struct(F.floor(n * share).alias("start"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(part(0.25, 0, " newly inserted words "), part(0.5, 24, "replaced, it's 2026"), part(0.75, 9, ""))
