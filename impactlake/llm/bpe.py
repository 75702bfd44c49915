"""BPE encoding and decoding by a table of distinct words.

Words are split off in Spark, each distinct word of the whole input is encoded once, and the ids come back by
position. Texts are handled in blocks of bounded size: a block sends its sorted distinct words, in buckets by
hash, to the tasks that own the buckets; those encode a word at its first sight and send ids and pieces back in
the same order; a cogroup by block puts them at the words' positions. Decoding joins ids to the vocabulary's
pieces, a table of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches

_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")
BLOCK_BYTES = 24_000_000


def words(text: bytes) -> list[bytes]:
    """Pieces of a text that the vocabulary treats independently and drops the white space between.

    White space always separates. As the vocabulary lower-cases, ASCII capitals are folded, and a full stop or
    comma between an ASCII letter and white space stands alone: fewer words are distinct. A text that may hold an
    added token's string is only split at white space.
    """
    if b"<|" in text:
        return text.split()
    return _STOP.sub(rb" \1", text.lower()).split()


def pack(parts: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts), 1)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = np.append(4 * (n + 1), ends)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def buckets_of(distinct, n: int) -> list[list[bytes]]:
    """The distinct words in order, dealt into n buckets by hash."""
    out: list[list[bytes]] = [[] for _ in range(n)]
    for w in sorted(distinct):
        out[zlib.crc32(w) % n].append(w)
    return out


class Blocks:
    """Numbers blocks within a task: a new one begins when the last has BLOCK_BYTES."""

    def __init__(self):
        self.part, self.no, self.bytes = TaskContext.get().partitionId(), 0, 0

    def take(self, n: int) -> int:
        if self.bytes > BLOCK_BYTES:
            self.no, self.bytes = self.no + 1, 0
        self.bytes += n
        return (self.part << 24) + self.no


def _texts(batch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(1).to_pylist()]


def _send_words(batches, n_buckets: int):
    blocks, block, distinct = Blocks(), None, set()

    def rows():
        found = [(b, w) for b, w in enumerate(buckets_of(distinct, n_buckets)) if w]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([pack(w) for _, w in found], pa.binary())], ["bucket", "block", "words"])

    for batch in batches:
        texts = _texts(batch)
        now = blocks.take(sum(map(len, texts)))
        if block is not None and now != block:
            yield rows()
            distinct = set()
        block = now
        for t in texts:
            distinct.update(words(t))
    if block is not None:
        yield rows()


def _send_texts(batches):
    blocks = Blocks()
    for batch in batches:
        texts = _texts(batch)
        block = blocks.take(sum(map(len, texts)))
        ids = pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([pack(texts)], pa.binary())], ["block", "ids", "texts"])


class WordEncoder(dict):
    """word -> (ids as little-endian unsigned 32-bit, pieces joined by a space); each word is encoded at its first sight."""

    limit = 1_000_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.library.id_to_token(i) or "").encode() for i in range(size)]  # the id-to-piece table

    def encode(self, new: list[bytes]) -> None:
        if len(self) + len(new) > self.limit:
            self.clear()
        for w, e in zip(new, self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            self[w] = (np.asarray(e.ids, "<u4").tobytes(), b" ".join([self.pieces[i] for i in e.ids]))

    def of(self, wanted: list[bytes]) -> list[tuple[bytes, bytes]]:
        if new := [w for w in wanted if w not in self]:
            self.encode(new)
            if len(self) < len(wanted):  # emptied meanwhile
                self.encode([w for w in wanted if w not in self])
        return [self[w] for w in wanted]


def _encode_words(batches, path: str):
    table = WordEncoder(path)
    for batch in batches:
        for bucket, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
            found = table.of(unpack(blob))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([pack([i for i, _ in found])], pa.binary()), pa.array([pack([p for _, p in found])], pa.binary())], ["bucket", "block", "ids", "pieces"])


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = DIGEST + ", ids array<int>, decoded string"


def _put_back(docs: pa.Table, coded: pa.Table, path: str, n_buckets: int, full: bool) -> pa.Table:
    payloads = [(ids, unpack(blob)) for ids, blob in zip(docs["ids"].to_pylist(), docs["texts"].to_pylist())]
    distinct: set[bytes] = set()
    for _, texts in payloads:
        for t in texts:
            distinct.update(words(t))
    by_bucket = buckets_of(distinct, n_buckets)
    ids: dict[bytes, bytes] = {}
    pieces: dict[bytes, bytes] = {}
    for bucket, i, p in zip(coded["bucket"].to_pylist(), coded["ids"].to_pylist(), coded["pieces"].to_pylist()):
        ids.update(zip(by_bucket[bucket], unpack(i), strict=True))
        pieces.update(zip(by_bucket[bucket], unpack(p), strict=True))
    out = []
    for doc_ids, texts in payloads:
        for doc, t in zip(doc_ids, texts):
            own = words(t)
            raw, decoded = b"".join([ids[w] for w in own]), b" ".join([p for w in own if (p := pieces[w])])
            row = (doc, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest())
            out.append(row + (np.frombuffer(raw, "<i4").tolist(), decoded.decode()) if full else row)
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())][: 6 if full else 4]
    columns = list(zip(*out)) or [[] for _ in kinds]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[k for k, _ in kinds])


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; with full=True also ids and the decoded text.

    For vocabularies that drop white space and have no decoder: a decoded text is its pieces joined by a space; words
    without an id (a no-break space between blanks) have no pieces.
    A null text is empty (no ids, hashes of nothing); repeated rows, null and repeated ids come out each for
    itself; an empty table gives no rows; other columns are ignored. docs must be a stored table: it is read twice,
    and both times its rows have to come in the same tasks and order. Very long texts are whole in their block.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a bucket row goes out per block and bucket: buckets grow like the root of the blocks
    n_buckets = max(16, int(4 * math.sqrt(own.rdd.getNumPartitions())))
    sent = own.mapInArrow(partial(_send_words, n_buckets=n_buckets), "bucket int, block long, words binary")
    coded = sent.repartition("bucket").mapInArrow(partial(_encode_words, path=tokenizer), "bucket int, block long, ids binary, pieces binary")
    texts = own.mapInArrow(_send_texts, "block long, ids array<long>, texts binary")

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        return _put_back(left, right, tokenizer, n_buckets, full)

    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(put_back, FULL if full else DIGEST)
