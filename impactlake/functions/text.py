"""Column functions for identifiers, titles, labels and nested work fields. Null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed value: the shape of a DOI; it ends at white space, brackets or quotes.
DOI = r"10\.\d{4,9}/[^\s;()<>\"']+"
TRAILING = ".,;)]}"
#: Ordered keyword rules for broad areas; the first that occurs in a label wins.
MACRO_AREAS = [
    ("Physics & Astronomy", "physic|astro"),
    ("Mathematics", "math|algebra|geometry"),
    ("Computer Science", "computer|computat|intelligence|software"),
    ("Biology & Medicine", "bio|medic|genet|clini"),
    ("Chemistry & Materials", "chem|material|polymer"),
    ("Engineering", "engin|mechan|electr"),
    ("Earth & Environmental", "geo|earth|envir"),
    ("Social Sciences", "social|econ|psych|educ"),
]
TRUE_WORDS, FALSE_WORDS = ("1", "true", "t", "yes", "y", "sim", "s", "verdadeiro"), ("0", "false", "f", "no", "n", "nao", "não", "falso")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number(c: Column) -> Column:
    """A double, null where the value is no number or NaN."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def norm_doi(c: Column) -> Column:
    """The first DOI in a text, lower case, without trailing punctuation."""
    found = F.regexp_replace(F.regexp_extract(c.cast("string"), f"({DOI})", 1), r"[.,;)\]}]+$", "")
    return F.nullif(F.lower(found), F.lit(""))


def strip_doi_prefix(c: Column) -> Column:
    """A DOI without a resolver's address or "doi:" before it; the rest is kept as it is."""
    return blank_to_null(F.regexp_replace(F.trim(c.cast("string")), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))


def all_dois(c: Column) -> Column:
    """Distinct normalised DOIs of a text in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(f"({DOI})"), 1), norm_doi)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


@pandas_udf(StringType())
def unaccent(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no such built-in."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column, fold=unaccent) -> Column:
    """ASCII letters and digits, lower case, single spaces."""
    return collapse(F.regexp_replace(F.lower(fold(c) if fold else c), "[^a-z0-9]+", " "))


def norm_key(c: Column) -> Column:
    return collapse(c.cast("string"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays, 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)).cast("double")


def year_of(c: Column) -> Column:
    """The first year of 1900 to 2199 in a text."""
    return F.regexp_extract(c.cast("string"), r"(?:^|\D)((?:19|20|21)\d{2})", 1).try_cast("int")


def macro_area(c: Column) -> Column:
    """The broad area of a label; a label that no rule fits stays as it is, null is "Unknown"."""
    low, out = F.lower(c), c
    for name, words in reversed(MACRO_AREAS):
        out = F.when(low.rlike(words), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("Unknown"))


def macro_area_confidence(c: Column) -> Column:
    """low where a keyword rule fits, else unknown."""
    return F.when(F.lower(c).rlike("|".join(words for _, words in MACRO_AREAS)), "low").otherwise("unknown")


def hyperlink(doi: Column, year: Column, title: Column) -> Column:
    """A spreadsheet formula that links "year; title" to its DOI; the text alone without one."""
    shown = F.concat_ws("; ", F.coalesce(year.cast("string"), F.lit("")), F.replace(F.coalesce(title, F.lit("")), F.lit('"'), F.lit("'")))
    return F.when(blank_to_null(doi).isNotNull(), F.concat(F.lit('=HYPERLINK("https://doi.org/'), doi, F.lit('", "'), shown, F.lit('")'))).otherwise(shown)


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index map<word, array<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def index_from_abstract(text: Column) -> Column:
    """The inverted index of a text: each space-separated word's positions from 0."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    entries = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("key"), F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("value")))
    return F.map_from_entries(entries)


def best_concept(concepts: Column, level: int) -> Column:
    """The concept of the highest score at a level, of any level if there is none there; the first of equals."""
    scored = F.transform(concepts, lambda x, i: F.struct(F.coalesce(-x["score"], F.lit(0.0)).alias("s"), i.alias("i"), x.alias("c")))
    at_level = F.filter(scored, lambda x: x["c"]["level"] == level)
    first = lambda a: F.get(F.array_sort(a), F.lit(0))["c"]
    return F.coalesce(first(at_level), first(scored))


def concepts_at(concepts: Column, level: int) -> Column:
    return F.filter(concepts, lambda x: x["level"] == level)


def as_binary(c: Column) -> Column:
    """1 or 0 of a flag in words or numbers; what cannot be read is 0."""
    low = F.lower(F.trim(c.cast("string")))
    n = F.coalesce(low.try_cast("double"), F.lit(0.0))
    return F.when(low.isin(*TRUE_WORDS), 1).when(low.isin(*FALSE_WORDS), 0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.floor(n)))).cast("int")


def binary_coerced(c: Column) -> Column:
    """Whether as_binary() has to guess: a missing value, or one that is neither a known word nor a number. Count it with count_if."""
    low = F.lower(F.trim(c.cast("string")))
    return ~F.coalesce(low.isin(*TRUE_WORDS) | low.isin(*FALSE_WORDS), F.lit(False)) & low.try_cast("double").isNull()
