"""Language identification by compression: the dictionary that makes a text smallest names its language.

Each language has a zstandard raw-content dictionary of its own training texts. Texts are lower-cased and
reduced to letters and single spaces, then cut into blocks; every block is compressed with every dictionary and
the language with the fewest bytes in all wins. Narrow margins are rejected.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches, free_name, schema_with

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """sample_pieces: pieces of training texts per language at most (a documented bound of the fit, never of the prediction), each adding an equal share of dictionary_bytes. block_bytes: what is compressed at once. min_margin: a text is rejected if the runner-up needs less than this share more bytes."""

    sample_pieces: int = 400
    dictionary_bytes: int = 112 * 1024
    block_bytes: int = 2048
    level: int = 6
    min_margin: float = 0.01


def fit_dictionaries(labelled: DataFrame, text: Column, lang: Column, settings: Settings = Settings()) -> dict[str, bytes]:
    """Raw-content dictionaries from a sample of pieces of the labelled texts: those of the smallest hashes.

    Every labelled text is cut into pieces of equal length, to its end, and every piece is hashed; a first count sets
    the hash bound that leaves about twice sample_pieces a language, so the driver holds no more than the sample. Null
    or empty texts and null languages take no part; equal pieces count once.
    """
    own = labelled.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).filter("text != '' and lang is not null")
    each = max(64, settings.dictionary_bytes // settings.sample_pieces)
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / each)).alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, 2.0 * settings.sample_pieces / n))])
    pieces = own.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{each}}}"), F.lit(0))).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = pieces.filter((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) <= share[F.col("lang")]).dropDuplicates(["lang", "h"]).collect()
    out = {}
    for name in sorted(counts):
        texts = [letters(r["text"]) for r in sorted((r for r in rows if r["lang"] == name), key=lambda r: (r["h"], r["text"]))[: settings.sample_pieces]]
        room = settings.dictionary_bytes // max(1, len(texts))
        out[name] = b"".join(t[:room] for t in texts)
    return {k: v for k, v in out.items() if len(v) >= 8}


def letters(text: str) -> bytes:
    return f" {_NOT_LETTERS.sub(' ', text.lower())} ".encode()


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.block, self.names, self.all = settings.block_bytes, sorted(dictionaries), []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=settings.level)
            self.all.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        self.settings = settings

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(c(b)) for b in blocks) for c in self.all]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(letters(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        best = sizes[order[0]]
        # each byte saved halves the odds of the others eight times; softened to the mean over a block
        weights = [2.0 ** (-8.0 * (s - best) / max(1.0, math.sqrt(best))) for s in sizes]
        second = sizes[order[1]] if len(order) > 1 else best * 2
        narrow = second == best or second - best < self.settings.min_margin * best
        return self.names[order[0]], 1.0 / sum(weights), narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with a struct column `language`: lang_pred, score (0 to 1), rejected.

    Only the whole text decides, block by block, however long it is; repeated rows get equal results, an empty table
    gives no rows, other columns stay as they are. Null texts and texts without a letter are `und`, score 0 and rejected; so is every
    text if nothing was learned. Ties go to the alphabetically first language and are rejected as narrow.
    """
    bounded_batches(docs.sparkSession)
    (name,) = free_name(docs, "language")
    at = docs.columns.index(text_col)
    kinds = [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]

    def predict(batches):
        predict_one = Compressors(dictionaries, settings).predict
        for batch in batches:
            found = list(zip(*(predict_one(t) for t in batch.column(at).to_pylist()))) or [[], [], []]
            column = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(found, kinds)], [k for k, _ in kinds])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(predict, schema_with(docs, name, "lang_pred string, score double, rejected boolean"))
