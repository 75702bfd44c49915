"""Work search: predicates from terms, exclusions, order, flat rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.functions.text import abstract_from_index, blank_to_null, unaccent
from impactlake.operators.convert import display_date


def any_of(column: Column, terms: str) -> Column:
    """Terms joined by " OR " or "|" inside, by commas (AND) outside; a term is found anywhere, case ignored."""
    out = F.lit(True)
    for clause in filter(None, (c.strip() for c in terms.split(","))):
        hit = F.lit(False)
        for term in filter(None, (t.strip() for t in re.split(r"\||\sOR\s", clause))):
            hit = hit | F.lower(column).contains(term.lower())
        out = out & hit
    return out


def predicate(title: str = "", abstract: str = "", languages: list[str] | None = None, types: list[str] | None = None, years: tuple[int | None, int | None] = (None, None), names: dict[str, str] | None = None) -> Column:
    """The conjunction of what is asked for; swapped years are put in order."""
    name = lambda k: (names or {}).get(k, k)
    low, high = years
    if low and high and low > high:
        low, high = high, low
    out = any_of(F.col(name("title")), title) if title else F.lit(True)
    out = out & any_of(F.col(name("abstract")), abstract) if abstract else out
    out = out & F.lower(name("language")).isin([x.strip().lower() for x in languages]) if languages else out
    out = out & F.col(name("type")).isin(types) if types else out
    out = out & (F.col(name("year")) >= low) if low else out
    return out & (F.col(name("year")) <= high) if high else out


#: Kinds of publication and what works call them.
KINDS = {"article": "journal-article", "review": "review-article", "preprint": "posted-content", "dissertation": "dissertation", "book": "book", "dataset": "dataset"}


def flags(kind: str = "all", has_abstract: bool = False, is_oa: bool = False, has_doi: bool = False, dates: tuple[str | None, str | None] = (None, None), names: dict[str, str] | None = None) -> Column:
    """What a search may ask for besides terms: a kind of publication (all: any), an abstract, open access, a DOI, publication dates."""
    name = lambda k: (names or {}).get(k, k)
    out = F.col(name("type")) == KINDS[kind] if kind in KINDS else F.lit(True)
    out = out & F.col(name("abstract")).isNotNull() if has_abstract else out
    out = out & F.coalesce(F.col(name("is_oa")), F.lit(False)) if is_oa else out
    out = out & blank_to_null(F.col(name("doi"))).isNotNull() if has_doi else out
    day = F.col(name("publication_date")).try_cast("date")
    out = out & (day >= F.lit(dates[0]).cast("date")) if dates[0] else out
    return out & (day <= F.lit(dates[1]).cast("date")) if dates[1] else out


#: Fields of a search result, in order.
FIELDS = ["id", "link", "title", "authors", "year", "publication_date", "venue", "type", "language", "cited_by", "doi", "url", "abstract"]


def flat_works(works: DataFrame, prefix: str = "https://openalex.org/") -> DataFrame:
    """One flat row of FIELDS per nested work; missing texts are empty, the venue always is.

    The url is the landing page, else the PDF, else the id; the year is that of the date.
    """
    have = works.columns
    text = lambda c: F.coalesce(c, F.lit(""))
    column = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    bare = F.replace(text(column("id")), F.lit(prefix), F.lit(""))
    date = text(display_date(column("publication_date"), column("publication_year")))
    place = (lambda f: F.col(f"primary_location.{f}")) if "primary_location" in have else (lambda f: F.lit(None).cast("string"))
    names = F.array_join(F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull() & (x != "")), "; ") if "authorships" in have else F.lit("")
    abstract = abstract_from_index(F.col("abstract_inverted_index")) if "abstract_inverted_index" in have else column("abstract")
    values = [
        bare, F.when(bare != "", F.concat(F.lit(prefix), bare)).otherwise(""), text(F.coalesce(blank_to_null(column("title")), column("display_name"))), text(names), F.substring(date, 1, 4), date, F.lit(""), text(column("type")), F.lower(text(column("language"))),
        F.coalesce(column("cited_by_count").try_cast("int"), F.lit(0)), F.replace(text(column("doi")), F.lit("https://doi.org/"), F.lit("")), text(F.coalesce(blank_to_null(place("landing_page_url")), blank_to_null(place("pdf_url")), column("id"))), text(abstract),
    ]
    return works.select(*[v.alias(n) for v, n in zip(values, FIELDS)])


def html_table(rows: DataFrame) -> DataFrame:
    """line: a row of an HTML table per row, links as links; write it with a header and a footer line as text."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    cell = lambda n: F.when((F.col(n) != "") & F.lit(n in ("link", "url")), F.concat(F.lit("<a href='"), escaped(F.col(n)), F.lit("' target='_blank'>link</a>"))).otherwise(escaped(F.col(n)))
    cells = [x for n in rows.columns for x in (F.lit("<td>"), cell(n), F.lit("</td>"))]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def exclude(df: DataFrame, patterns: list[str], columns: list[str]) -> DataFrame:
    """Without rows where a pattern is found in one of the columns, case ignored; invalid patterns are left out."""
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        for c in columns:
            df = df.filter(~F.coalesce(F.col(c).rlike(f"(?i){p}"), F.lit(False)))
    return df


def sort_works(df: DataFrame, key: str, cited: str = "cited_by_count", date: str = "publication_date", year: str = "publication_year", work_id: str = "id") -> DataFrame:
    """By citations, newest or oldest; a year alone counts as its last day, no date at all as the first of all days."""
    day = F.coalesce(F.col(date).try_cast("date"), F.make_date(F.col(year).try_cast("int"), F.lit(12), F.lit(31)), F.lit("0001-01-01").cast("date"))
    orders = {"citations": [F.col(cited).desc_nulls_last(), day.desc()], "newest": [day.desc(), F.col(cited).desc_nulls_last()], "oldest": [day.asc(), F.col(cited).desc_nulls_last()]}
    return df.orderBy(*orders[key], F.col(work_id))


#: Entry types of works' types; others are misc.
ENTRY_TYPES = {"journal-article": "article", "review-article": "article", "posted-content": "misc", "dissertation": "phdthesis", "book": "book", "book-chapter": "incollection", "proceedings-article": "inproceedings", "dataset": "misc"}
JOURNALS, COLLECTIONS = ("journal-article", "review-article"), ("proceedings-article", "book-chapter")


def bibtex(works: DataFrame, prefix: str = "https://openalex.org/", fold=unaccent) -> DataFrame:
    """entry: a BibTeX entry per nested work.

    The key is the first author's last name, the year and three words of the title; authors are "Last, First"; acronyms
    of two to six capitals are guarded; venue, publisher, volume, number and pages come from the locations and
    biblio; empty fields are left out. fold takes accents off the title's words in the key.
    """
    have = works.columns
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    column = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    kind = text(column("type"))
    entry = F.lit("misc")
    for name, value in ENTRY_TYPES.items():
        entry = F.when(kind == name, value).otherwise(entry)
    date = text(column("publication_date"))
    year = F.when(F.substring(date, 1, 4).rlike("^[0-9]{4}$"), F.substring(date, 1, 4)).otherwise("")
    words = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    turned = lambda p: F.when(F.size(p) >= 2, F.concat(F.element_at(p, -1), F.lit(", "), F.array_join(F.slice(p, 1, F.size(p) - 1), " "))).otherwise(F.array_join(p, " "))
    names = F.filter(F.transform(F.coalesce("authorships", F.array().cast(works.schema["authorships"].dataType)), lambda a: turned(words(text(a["author"]["display_name"])))), lambda x: x != "") if "authorships" in have else F.array().cast("array<string>")
    title = F.trim(F.coalesce(blank_to_null(column("display_name")), column("title"), F.lit("")))
    folded = F.lower(fold(title) if fold else title)
    first = F.when(F.size(names) > 0, F.split(F.get(names, F.lit(0)), ",")[0]).otherwise("")
    key = F.concat(first, year, F.when(folded == "", "noTitle").otherwise(F.array_join(F.slice(words(folded), 1, 3), "")))
    source = F.coalesce(*[F.col(f"{p}.source") for p in ("primary_location", "best_oa_location") if p in have], *([F.get(F.filter(F.transform("locations", lambda x: x["source"]), lambda x: x.isNotNull()), F.lit(0))] if "locations" in have else []), F.lit(None).cast("struct<display_name:string,publisher:string>"))
    venue, publisher = F.trim(text(source["display_name"])), F.trim(text(source["publisher"]))
    biblio = lambda k: text(F.col(f"biblio.{k}")) if "biblio" in have else F.lit("")
    from_, to = biblio("first_page"), biblio("last_page")
    bare = F.replace(text(column("id")), F.lit(prefix), F.lit(""))
    cited = column("cited_by_count").cast("string")
    fields = {
        "title": F.regexp_replace(title, r"\b([A-Z]{2,6})\b", "{$1}"), "year": year, "doi": F.trim(text(column("doi"))), "url": F.when(bare != "", F.concat(F.lit(prefix), bare)), "author": F.array_join(names, " and "), "journal": F.when(kind.isin(*JOURNALS), venue), "booktitle": F.when(kind.isin(*COLLECTIONS), venue),
        "publisher": publisher, "volume": biblio("volume"), "number": biblio("issue"), "pages": F.when((from_ != "") & (to != ""), F.concat(from_, F.lit("--"), to)).otherwise(F.concat(from_, to)), "language": text(column("language")), "note": F.concat(F.lit("Cited by "), cited, F.lit(" (OpenAlex)")),
    }
    escape = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r'([{}"%])', r"\\$1")
    lines = [F.when(v != "", F.concat(F.lit(f"  {k} = {{"), escape(v), F.lit("}"))) for k, v in fields.items()]
    return works.select(F.concat(F.lit("@"), entry, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}")).alias("entry"))
