"""Readers of bibliographic exports: each gives the same record columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlake.functions.text import all_dois, blank_to_null, norm_doi, year_of
from impactlake.operators.corpus import CROSSWALK
from impactlake.operators.dedupe import keep_missing
from impactlake.sources.quoted import read_quoted, union_all

RECORD = ["title", "year", "doi", "oa_id", "source", "authors", "abstract", "cited_by_count", "is_retracted", "ref_dois"]
#: Names that exports give their columns, in order of preference, by kind of export.
NAMES = {
    "scopus": {
        "title": ["title", "document_title", "document_title_"],
        "year": ["year", "publication_year"],
        "doi": ["doi"],
        "authors": ["authors", "author_names", "authors_with_affiliations"],
        "abstract": ["abstract", "description", "abstract_keywords"],
        "source": ["source_title", "publication_title", "journal"],
        "cited_by_count": ["cited_by", "citedby", "cited_by_count"],
        "references": ["references", "reference", "refs"],
    },
    "openalex": {"title": ["title"], "year": ["publication_year"], "doi": ["doi"], "oa_id": ["id"], "cited_by_count": ["cited_by_count"], "is_retracted": ["is_retracted"]},
    "pop": {"title": ["title"], "year": ["year"], "doi": ["doi"], "authors": ["authors"], "abstract": ["abstract"], "source": ["source"], "cited_by_count": ["cites"]},
}
SOURCES = {"wos": "wos", "scopus": "scopus", "csv": "scopus", "openalex": "openalex", "pop": "pop", "publish_or_perish": "pop", "auto": "auto"}


def tidy_header(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores, without a byte order mark; repeated names get a number."""
    names: list[str] = []
    for c in df.columns:
        name = c.lstrip("﻿").strip().lower().replace(" ", "_")
        names.append(name if name not in names else f"{name}_{len(names)}")
    return df.toDF(*names)


def is_works_csv(columns: list[str]) -> bool:
    return {"id", "title", "doi", "publication_year", "cited_by_count"} <= set(columns)


def is_pop_csv(columns: list[str]) -> bool:
    return "gsrank" in columns and "cites" in columns


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, pattern or folder stands for, in order."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    own = [f.getPath().toString() for f in fs.globStatus(place) or [] if f.isFile()]
    return sorted(own or (f.getPath().toString() for f in fs.listStatus(place) if f.isFile() and not f.getPath().getName().startswith(("_", "."))))


def _head(spark: SparkSession, file: str, n: int = 65_536) -> bytes:
    """The first bytes of a file."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(file)
    stream = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a path by encoding: UTF-16 by their byte order mark, UTF-8 if all their bytes are, else Latin-1.

    One parallel pass over the raw lines; the driver gets the names of files that are not UTF-8.
    """
    line = spark.read.option("lineSep", "\n").text(path)
    mark = F.substring(F.col("value").cast("binary"), 1, 2).isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
    line = line.select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), mark.alias("mark")).alias("line"))
    judged = line.groupBy("file").agg(F.bool_and("valid").alias("valid"), F.min("line")["mark"].alias("wide"))  # the mark of its first line
    odd = judged.filter("wide or not valid").collect()
    jvm = spark._jvm
    kind = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"])).toUri().getPath(): "UTF-16" if r["wide"] else "ISO-8859-1" for r in odd}
    out: dict[str, list[str]] = {}
    for f in _files(spark, path):
        out.setdefault(kind.get(jvm.org.apache.hadoop.fs.Path(f).toUri().getPath(), "UTF-8"), []).append(f)
    return out


def _large(spark: SparkSession, files: list[str], split_bytes: int) -> list[str]:
    """The files of more than split_bytes."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    size = lambda f: jvm.org.apache.hadoop.fs.Path(f).getFileSystem(conf).getFileStatus(jvm.org.apache.hadoop.fs.Path(f)).getLen()
    return [f for f in files if size(f) > split_bytes]


def read_csv(spark: SparkSession, path: str, separators: str = ",;\t", multi_line: bool = True, split_bytes: int = 64 << 20) -> DataFrame:
    """A CSV export with a header, all columns text: each file in its own encoding, the separator the one the first line has most of; lines with more or fewer fields are dropped, whatever columns are used.

    Fields may hold line feeds. A file of up to split_bytes is read by one task; the records of larger ones are found
    over their splits in parallel (quoted.py), with the same rows. UTF-16 files and files whose lines end in CR alone
    cannot be split. multi_line=False takes every line for a record. An empty file gives an empty table without columns.
    """
    found = encodings(spark, path)
    if not found:
        return spark.createDataFrame([], "")
    first = min(f for files in found.values() for f in files)
    encoding = next(e for e, files in found.items() if first in files)
    line = _head(spark, first).decode(encoding, "replace").lstrip("\ufeff").split("\n")[0]
    if not line.strip():
        return spark.createDataFrame([], "")
    sep = max(separators, key=line.count)
    parts: list[DataFrame] = []
    for e, files in sorted(found.items()):
        large = _large(spark, files, split_bytes) if multi_line and e != "UTF-16" else []
        large = [f for f in large if b"\n" in (head := _head(spark, f)) or b"\r" not in head]
        plain = lambda some: spark.read.option("columnPruning", False).csv(some, header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, mode="DROPMALFORMED", encoding=e)  # noqa: B023, E731
        names = plain(files).columns  # the first file's header
        spark_read = [f for f in files if f not in large]
        both = ([plain(spark_read).toDF(*names)] if spark_read else []) + ([read_quoted(spark, large, sep, e, names)] if large else [])
        parts += [tidy_header(df) for df in both]
    return union_all(parts)


def kind_of(columns: list[str]) -> str:
    """pop, openalex or scopus, by a table's column names."""
    return "pop" if is_pop_csv(columns) else "openalex" if is_works_csv(columns) else "scopus"


def csv_records(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Records of a tidied table of a kind (found by its header if None), once per DOI, all those without one.

    Without a DOI column that has values a DOI is looked for in all text columns, but for works tables; references give distinct
    DOIs in order and only scopus tables have any.
    """
    kind = kind or kind_of(df.columns)
    null = F.lit(None).cast("string")

    def column(what: str):
        found = next((c for c in NAMES[kind].get(what, ()) if c in df.columns), None)
        return blank_to_null(F.col(f"`{found}`").cast("string")) if found else null

    anywhere = F.coalesce(*[norm_doi(F.col(f"`{c}`")) for c in df.columns], null)
    own = norm_doi(column("doi"))
    doi = own
    if kind != "openalex" and ("doi" not in df.columns or df.filter(column("doi").isNotNull()).isEmpty()):
        doi = F.coalesce(own, anywhere)
    retracted = F.coalesce(F.lower(column("is_retracted")).try_cast("boolean"), F.lit(False))
    refs = all_dois(column("references")) if kind == "scopus" else F.array().cast("array<string>")
    rows = df.select(
        column("title").alias("title"), year_of(column("year")).alias("year"), doi.alias("doi"), column("oa_id").alias("oa_id"), column("source").alias("source"), column("authors").alias("authors"),
        column("abstract").alias("abstract"), column("cited_by_count").try_cast("double").cast("long").alias("cited_by_count"), retracted.alias("is_retracted"), refs.alias("ref_dois"),
    )
    return keep_missing(rows, "doi", ["title", "year", "authors", "source"])


def tagged_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a tagged text export: two-letter tags, continuation lines of three spaces, a line ER after each record.

    A continuation belongs to the tag before it; authors are joined by "; ", other lines by " | "; every cited line
    adds its DOIs. Lines may end in CR and LF; bytes that are not UTF-8 are left out.
    """
    chunk = spark.read.text(path, lineSep="\nER").select(F.col("value").alias("raw"))
    text = F.when(F.is_valid_utf8("raw"), F.col("raw")).otherwise(F.replace(F.make_valid_utf8("raw"), F.lit("\ufffd"), F.lit("")))
    chunk = chunk.select(F.regexp_replace(text, r"\r\n?", "\n").alias("text"))
    marked = F.regexp_replace("text", r"\n   +", "\u0001")  # continuation
    lines = F.split(marked, "\n")

    def field(tag: str, joiner: str):
        own = F.transform(F.filter(lines, lambda x: x.startswith(tag + " ")), lambda x: F.trim(F.substring(x, F.lit(4), F.length(x))))
        return blank_to_null(F.array_join(F.transform(own, lambda x: F.replace(x, F.lit("\u0001"), F.lit(joiner))), joiner))

    rows = chunk.select(field("TI", " ").alias("title"), year_of(field("PY", " ")).alias("year"), norm_doi(field("DI", " ")).alias("doi"), F.lit(None).cast("string").alias("oa_id"), field("SO", " ").alias("source"), field("AU", "; ").alias("authors"), field("AB", " ").alias("abstract"), field("TC", " ").try_cast("long").alias("cited_by_count"), F.lit(False).alias("is_retracted"), all_dois(field("CR", " | ")).alias("ref_dois"))
    return rows.filter("title is not null or doi is not null or authors is not null")


def parse_input(spark: SparkSession, path: str, source: str = "auto") -> DataFrame:
    """Records of a file: source is wos, scopus (or csv), openalex, pop (or publish_or_perish) or auto.

    auto takes .txt for tagged text and else goes by the header; scopus tables that look like one of the other two
    kinds are read as those, an empty one as pop.
    """
    kind = SOURCES.get(source.lower().strip())
    if kind is None:
        raise ValueError(f"source must be one of {sorted(SOURCES)}")
    if kind == "wos" or (kind == "auto" and path.lower().endswith(".txt")):
        return tagged_records(spark, path)
    df = read_csv(spark, path)
    if kind in ("auto", "scopus"):
        kind = kind_of(df.columns) if df.columns else "pop"
    return csv_records(df, kind)


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """A gold set: CSV with one of four separators, header names tidied."""
    return read_csv(spark, path, ",;\t|")


def crosswalk_csv(spark: SparkSession, path: str) -> DataFrame:
    """A crosswalk with all its columns (missing ones empty) and the line of each row; empty if the file is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in CROSSWALK) + ", line long")
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    missing = {c: F.lit("") for c in CROSSWALK if c not in df.columns}
    return df.withColumns(missing).select(*CROSSWALK, F.monotonically_increasing_id().alias("line"))


def topic_documents(records: DataFrame, idx: str = "idx") -> DataFrame:
    """idx, text: title and abstract in one text; records with neither are left out."""
    parts = [blank_to_null(F.col(c)) for c in ("title", "abstract") if c in records.columns]
    return records.select(idx, F.concat_ws(" ", *parts).alias("text")).filter("text != ''")


def works_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested works from JSON lines, with the schema that corpus.flat_record() takes."""
    schema = "id string, doi string, title string, publication_year string, cited_by_count string, is_retracted boolean, type string, concepts array<struct<id:string,display_name:string,level:int,score:double>>, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<ror:string,display_name:string,country_code:string>>>>, referenced_works array<string>"
    return spark.read.schema(schema).json(path)
