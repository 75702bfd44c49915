"""A bundle of named tables: a folder of Parquet tables, or a workbook."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlake.sources.workbook import read_sheet, sheet_names

#: The tables of a result.
TABLES = ["Records", "Edges", "Network", "Integer_Summary", "Fractional_Summary", "Baselines", "Run_Metadata"]


def safe_name(name: str, longest: int = 31) -> str:
    """A table name without characters that sheets forbid."""
    return re.sub(r"[\\/*?:\[\]]", " ", name or "").strip()[:longest] or "Sheet1"


def write_bundle(tables: dict[str, DataFrame], folder: str, csv: bool = False) -> None:
    for name, df in tables.items():
        path = f"{folder}/{safe_name(name)}"
        if csv:
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
            flat.write.mode("overwrite").csv(path, header=True)
        else:
            df.write.mode("overwrite").parquet(path)


#: Columns of the exported records, in order.
RECORD_COLUMNS = ["idx", "title", "year", "domain_label", "domain_id", "doi", "cited_by_count", "c_use", "c_use_window", "is_retracted", "c0_mean", "cf", "PPg_top1", "PPg_top10", "PPg_top25", "n_authors", "n_affiliations", "is_focal"]


def core_columns(records: DataFrame) -> DataFrame:
    """The exported columns that records have, in their fixed order."""
    return records.select(*[c for c in RECORD_COLUMNS if c in records.columns])


def write_query(rows: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """A search result as CSV with a header, and beside it path.meta.json with the time, the fields and what was left out as duplicates."""
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="", lineSep="\n")
    found = stats.first().asDict() if stats is not None else {}  # one row
    meta = {"timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"), "dedup_stats": found, "fieldnames": rows.columns}
    rows.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta.json")


def write_enrichment(authorships: DataFrame, folder: str) -> None:
    """authors, institutions and authorships of authorship_rows() as CSV tables."""
    tables = {
        "authors": authorships.filter("author_id is not null").groupBy("author_id").agg(F.min("author_name").alias("author_name"), F.min("orcid").alias("orcid")),
        "institutions": authorships.filter("ror is not null").groupBy("ror").agg(F.min("institution").alias("institution"), F.min("country").alias("country")),
        "authorships": authorships,
    }
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def read_table(spark: SparkSession, folder: str, *names: str) -> DataFrame | None:
    """The first of the names that the bundle has, which is a folder or a workbook."""
    plain = lambda name: re.sub(r"[^a-z0-9]", "", name.lower())
    if folder.lower().endswith(".xlsx"):
        sheets = {plain(s): s for s in sheet_names(folder)}
        found = next((sheets[plain(n)] for n in names if plain(n) in sheets), None)
        return read_sheet(spark, folder, found) if found else None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    have = {plain(f.getPath().getName()): f.getPath().toString() for f in fs.listStatus(path)}
    for name in names:
        found = have.get(plain(name))
        if found:
            return spark.read.parquet(found)
    return None


def file_hash(spark: SparkSession, path: str | None) -> str:
    """The first 16 digits of the SHA-256 of a file (of up to 2 GB), read where Spark reads; empty if there is none."""
    if not path:
        return ""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return ""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 16)).first()[0]


def run_metadata(spark: SparkSession, values: dict, files: dict[str, str | None] | None = None) -> DataFrame:
    """key, value rows, with a hash of all values and one of each file (name: path)."""
    digest = hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:16]
    hashes = {f"{name}_hash": file_hash(spark, path) for name, path in (files or {}).items()}
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in {**values, "config_hash": digest, **hashes}.items()], "key string, value string")
