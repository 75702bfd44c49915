"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: ASCII white space; words are maximal runs of anything else (what bytes.split() does).
ASCII_SPACE = b" \t\n\r\x0b\x0c"
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, in rows and in bytes (one row at least): texts may be long. Own, smaller settings of the session stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, str(1 << 26)).rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a local session gets a temporary one, as in tests; a cluster has none that its machines share, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = getattr(spark.sparkContext, "_llm_folder", None) or tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext._llm_folder = folder
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as a table in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made, once no plan reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df does not have (Spark's names ignore case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered; trim() keeps the memory bounded."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def crc_mod(column, n: int):
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % F.lit(n)


def schema_with(df: DataFrame, name: str, ddl: str) -> StructType:
    """df's schema and one more struct column."""
    return StructType([*df.schema.fields, StructField(name, StructType.fromDDL(ddl))])
