"""Nested works to flat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.functions.text import abstract_from_index, blank_to_null, norm_doi

#: Columns of the flat export, in order.
EXPORT = ["Authors", "Title", "Year", "Source title", "Cited by", "DOI", "Link", "Abstract", "Author Keywords", "Document Type", "EID"]


def _names(items: Column, field) -> Column:
    return F.array_join(F.filter(F.transform(items, field), lambda x: x.isNotNull()), "; ")


def export_rows(works: DataFrame) -> DataFrame:
    """The flat export of works(id, doi, title, publication_year, cited_by_count, type, authorships, concepts, ...).

    Keywords are the distinct concept names in order; the abstract is rebuilt from its inverted index if there is
    one; missing parts are null.
    """
    have = works.columns
    null = F.lit(None).cast("string")
    column = lambda c: F.col(c) if c in have else null
    abstract = abstract_from_index(F.col("abstract_inverted_index")) if "abstract_inverted_index" in have else column("abstract")
    keywords = F.array_join(F.array_sort(F.array_distinct(F.transform(F.col("concepts"), lambda c: c["display_name"]))), "; ") if "concepts" in have else null
    values = [
        blank_to_null(_names(F.col("authorships"), lambda a: a["author"]["display_name"])), blank_to_null(column("title")), column("publication_year").try_cast("int"), blank_to_null(column("source_title")),
        column("cited_by_count").try_cast("long"), norm_doi(column("doi")), column("id"), blank_to_null(abstract), blank_to_null(keywords), blank_to_null(column("type")), F.regexp_extract(F.coalesce(column("id"), F.lit("")), r"([^/]+)$", 1),
    ]
    return works.select(*[v.alias(n) for v, n in zip(values, EXPORT)])


def display_date(date: Column, year: Column) -> Column:
    """The date if it is one, else the year as text."""
    return F.coalesce(date.try_cast("date").cast("string"), year.cast("string"))


def first_author_last_name(authors: Column) -> Column:
    """Of "First Last; Other Name" the first author's last word, lower case."""
    return F.lower(blank_to_null(F.element_at(F.split(F.trim(F.split(authors, ";")[0]), r"\s+"), -1)))


def download_lines(df: DataFrame, authors: str = "authors", title: str = "title", year: str = "year", doi: str = "doi") -> DataFrame:
    """line: "authors; title; year; doi" for a download script.

    Numbers before authors are taken off, semicolons inside become commas, missing authors and titles have a stand-in,
    other missing parts are empty; the line does not begin with separators.
    """
    text = lambda c, missing: F.coalesce(c.cast("string"), F.lit(missing))
    comma = lambda c: F.replace(c, F.lit(";"), F.lit(","))
    who = comma(F.trim(F.regexp_replace(text(F.col(authors), "Unknown Author"), r"(?:^|[\s;])\d+[.)\s]?\s*", " ")))
    line = F.concat(who, F.lit("; "), comma(text(F.col(title), "No Title")), F.lit("; "), text(F.col(year), ""), F.lit("; "), text(F.col(doi), ""))
    return df.select(F.regexp_replace(line, "^[; ]+", "").alias("line"))
