"""Corpus building over a table of works: references, citers, citation windows, authorships, crosswalks, fuzzy names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType

from impactlake.functions.text import blank_to_null, norm_doi, norm_title, title_similarity, tokens
from impactlake.sources.shared import forget, saved


def flat_record(works: DataFrame, level: int) -> DataFrame:
    """One flat record per nested work: identifiers, counts of authors and affiliations (1 at least), their ids, domain, concepts of the level, references."""
    from impactlake.functions.text import best_concept, concepts_at

    concept = best_concept(F.col("concepts"), level)
    authors = F.col("authorships")
    institutions = F.flatten(F.transform(authors, lambda a: F.coalesce(a["institutions"], F.array())))
    size = lambda c: F.greatest(F.lit(1), F.coalesce(F.size(c), F.lit(0)))
    return works.select(
        F.col("id").alias("oa_id"), F.col("doi").alias("doi_raw"), norm_doi(F.col("doi")).alias("doi"), F.col("title"), F.col("publication_year").try_cast("int").alias("year"), F.col("cited_by_count").try_cast("double").alias("c_use"),
        F.coalesce(F.col("is_retracted"), F.lit(False)).alias("is_retracted"), F.col("type"), concept["id"].alias("domain_id"), concept["display_name"].alias("domain_label"), size(authors).alias("n_authors"), size(institutions).alias("n_affiliations"),
        F.transform(authors, lambda a: a["author"]["id"]).alias("author_ids"), F.filter(F.transform(institutions, lambda i: i["ror"]), lambda r: r.isNotNull()).alias("inst_ids"), concepts_at(F.col("concepts"), level).alias("concepts_lvl"), F.col("referenced_works"),
    )


def drop_retracted(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("is_retracted"), F.lit(False)))


def references_to_dois(records: DataFrame, idx: str = "idx", refs: str = "referenced_works", work_id: str = "oa_id", doi: str = "doi") -> DataFrame:
    """idx, ref_dois: the DOIs of a record's references in order, each once; references outside the corpus are dropped."""
    known = records.filter(F.col(work_id).isNotNull() & F.col(doi).isNotNull()).groupBy(F.col(work_id).alias("ref")).agg(F.min(doi).alias("ref_doi"))
    rows = records.select(idx, F.posexplode(refs).alias("pos", "ref")).join(known, "ref")
    listed = rows.groupBy(idx).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_doi"))), lambda x: x["ref_doi"])).alias("ref_dois"))
    return records.select(idx).join(listed, idx, "left").select(idx, F.coalesce("ref_dois", F.array().cast("array<string>")).alias("ref_dois"))


@pandas_udf(MapType(StringType(), ArrayType(IntegerType())))
def _positions(texts: pd.Series) -> pd.Series:
    """Each text's words, which stand between spaces, with their places from 0."""

    def index(text):
        if text is None:
            return None
        at: dict = {}
        for i, word in enumerate(w for w in text.split(" ") if w):
            at.setdefault(word, []).append(i)
        return at

    return pd.Series([index(t) for t in texts], dtype=object)


def inverted_indexes(works: DataFrame, work_id: str, text: str, name: str = "abstract_inverted_index") -> DataFrame:
    """works with the inverted index map<word, positions> of their texts, whose words stand between spaces.

    Each row is indexed where it is, in one pass over its words: nothing is shuffled, whatever the ids are. A null text
    has a null index, one without words an empty one.
    """
    return works.withColumn(name, _positions(F.col(text)))


def citers(works: DataFrame, focal: DataFrame, types: list[str] | None = None, work_id: str = "oa_id", refs: str = "referenced_works") -> DataFrame:
    """cited and all columns of the works that cite a focal work, optionally of some types only."""
    rows = works.filter(F.col("type").isin(types)) if types else works
    return rows.withColumn("cited", F.explode(refs)).join(focal.select(F.col(work_id).alias("cited")).distinct(), "cited", "left_semi")


def in_window(base_year: Column, year: Column, k: int) -> Column:
    return year.between(base_year, base_year + k - 1)


def shares_author(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def window_counts(focal: DataFrame, citing: DataFrame, key: str, k: int, drop_self: bool = True, year: str = "year", authors: str = "author_ids") -> DataFrame:
    """key, c_use_window: citing rows (cited, year, author ids) within k years of each focal work, optionally without shared authors."""
    f = focal.select(F.col(key).alias("_key"), F.col(year).alias("_year"), F.col(authors).alias("_authors"))
    c = citing.select("cited", F.col(year).alias("_cy"), F.col(authors).alias("_ca"))
    hit = in_window(F.col("_year"), F.col("_cy"), k)
    if drop_self:
        hit = hit & ~shares_author(F.col("_authors"), F.col("_ca"))
    counts = c.join(f, F.col("cited") == F.col("_key")).filter(hit).groupBy("_key").agg(F.count("*").alias("n"))
    return focal.select(key).join(counts, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("n", F.lit(0)).alias("c_use_window"))


def authorship_rows(works: DataFrame) -> DataFrame:
    """work_id, position, author (id, name, ORCID without its address) and institution of every authorship; authors without institution have one row."""
    a = works.select(F.col("id").alias("work_id"), F.posexplode("authorships").alias("position", "a"))
    rows = a.select("work_id", "position", F.col("a.author.id").alias("author_id"), F.col("a.author.display_name").alias("author_name"), F.regexp_replace(F.col("a.author.orcid"), r"^https?://orcid\.org/", "").alias("orcid"), F.explode_outer("a.institutions").alias("i"))
    return rows.select("work_id", "position", "author_id", "author_name", "orcid", F.col("i.ror").alias("ror"), F.col("i.display_name").alias("institution"), F.col("i.country_code").alias("country"))


def title_matches(queries: DataFrame, titles: DataFrame, query_id: str, query_title: str, title_id: str, title: str, at_least: float = 0.6, fold=None, query_year: str | None = None, year: str | None = None) -> DataFrame:
    """query_id, title_id, similarity: the most similar title of each query, ties to the smallest id, if it reaches at_least.

    With both years, titles within a year of the query's are looked at first and the others only for queries that
    found none. A pair of Jaccard similarity t has sizes within a factor of t and shares one of the query's
    n - ceil(t * n) + 1 rarest tokens, so only these are joined and counted; the counts bound the similarity from
    above, and what passes is compared in full. The titles' tokens are written once; titles of sizes that no query can
    reach are left out when that table is read.
    """
    key = lambda c: tokens(norm_title(F.col(c), fold))
    given = lambda c: (F.col(c).try_cast("int") if c else F.lit(None).cast("int"))
    q = queries.select(F.col(query_id).alias("q"), key(query_title).alias("qt"), given(query_year).alias("qy")).filter(F.size("qt") > 0)
    d = titles.select(F.col(title_id).alias("d"), key(title).alias("dt"), given(year).alias("dy"))
    ends = q.agg(F.min(F.size("qt")).alias("least"), F.max(F.size("qt")).alias("most"))  # titles of other sizes can match nothing
    sized = lambda c: ends.select(c).scalar()
    d = saved(d, "titles").filter((F.size("dt") >= at_least * sized("least")) & (at_least * F.size("dt") <= sized("most")))
    words = q.select("q", "qy", F.size("qt").alias("n"), F.explode("qt").alias("w"))
    each = d.select("d", "dy", F.size("dt").alias("m"), F.explode("dt").alias("w"))
    often = each.join(words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.coalesce("df", F.lit(0)), "w"))
    probes = words.join(often, "w", "left").withColumn("rn", rank).withColumn("probes", F.col("n") - F.ceil(at_least * F.col("n")) + 1).filter("rn <= probes").drop("rn", "df")
    sizes = (F.col("m") >= at_least * F.col("n")) & (at_least * F.col("m") <= F.col("n"))
    shared = each.join(probes, "w").filter(sizes).groupBy("q", "d").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "m", "probes", "qy", "dy")])
    most = F.least(F.col("c") + F.col("n") - F.col("probes"), F.least("n", "m"))
    pairs = shared.filter(most >= (at_least - 1e-9) * (F.col("n") + F.col("m") - most)).select("q", "d", F.coalesce(F.abs(F.col("qy") - F.col("dy")) <= 1, F.lit(False)).alias("near"))
    scored = pairs.join(q.select("q", "qt"), "q").join(d.select("d", "dt"), "d").select("q", "d", "near", title_similarity(F.col("qt"), F.col("dt")).alias("similarity")).filter(F.col("similarity") >= at_least)
    best = scored.groupBy("q").agg(F.min(F.struct((~F.col("near")).alias("far"), (-F.col("similarity")).alias("s"), "d")).alias("x"))
    return best.select(F.col("q").alias(query_id), F.col("x.d").alias(title_id), (-F.col("x.s")).alias("similarity"))


def works_by_doi(dois: DataFrame, works: DataFrame, doi: str = "doi") -> DataFrame:
    """Every DOI with its work, null columns where there is none; of several works of a DOI the smallest id."""
    own = works.withColumn("_doi", norm_doi(F.col(doi))).filter("_doi is not null")
    first = own.withColumn("_rn", F.row_number().over(Window.partitionBy("_doi").orderBy("id"))).filter("_rn = 1").drop("_rn", doi)
    return dois.select(norm_doi(F.col(doi)).alias("doi")).join(first, F.col("doi") == F.col("_doi"), "left").drop("_doi")


def found_focal(records: DataFrame, works: DataFrame, doi: str = "doi", title: str = "title", year: str = "year", at_least: float = 0.6) -> DataFrame:
    """The works of the records' DOIs, each once; if no record has a DOI, those that titles and years lead to and that have a DOI."""
    known = records.select(norm_doi(F.col(doi)).alias("doi")).dropna().distinct()
    if known.isEmpty():
        named = records.filter(F.col(title).isNotNull()).select(F.xxhash64(title, F.col(year).cast("string")).alias("_q"), title, F.col(year).alias("_year")).distinct()
        hits = title_matches(named, works.filter(norm_doi(F.col("doi")).isNotNull()), "_q", title, "id", "title", at_least, query_year="_year", year="publication_year")
        return works.join(hits.select("id").distinct(), "id", "left_semi")
    return works.join(known, norm_doi(works["doi"]) == known["doi"], "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy(norm_doi(F.col("doi"))).orderBy("id"))).filter("_rn = 1").drop("_rn")


def fetched(works: DataFrame, order: list[str], doi: str = "doi", work_id: str = "id", limit: int | None = None) -> DataFrame:
    """Works once per DOI, else once per id, in order; optionally the first `limit` of them."""
    key = F.coalesce(norm_doi(F.col(doi)), F.col(work_id))
    first = works.withColumn("_key", key).filter("_key is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_rn = 1").drop("_rn", "_key")
    return first.orderBy(*order).limit(limit) if limit is not None else first


CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def crosswalk(concepts: DataFrame, table: DataFrame, key: str, best: bool = True) -> DataFrame:
    """concepts with target_id, target_label, confidence of the mapping(key, target_id, target_label, confidence, line): the surest, earliest line, or all."""
    if best:
        w = Window.partitionBy(key).orderBy(_sureness("confidence").desc(), "line")
        table = table.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return concepts.join(table.drop("line"), key, "left")


def _sureness(column: str) -> Column:
    rank = F.lit(0)
    for name, value in CONFIDENCE.items():
        rank = F.when(F.lower(column) == name, value).otherwise(rank)
    return rank


#: Columns of a crosswalk and the words that two of them may hold.
CROSSWALK = ["source_scheme", "source_id", "source_label", "source_level", "target_scheme", "target_id", "target_label", "mapping_type", "confidence", "provenance", "version", "notes"]
MAPPING_TYPES = ["exact", "close", "broad", "narrow", "related", "manual", "unknown", ""]
CONFIDENCES = ["high", "medium", "low", "unknown", ""]


def crosswalk_problems(table: DataFrame) -> DataFrame:
    """problem: missing columns and, of the two columns with fixed words, every other word that occurs, with its rows."""
    spark = table.sparkSession
    missing = [(f"missing column: {c}", None) for c in CROSSWALK if c not in table.columns]
    out = spark.createDataFrame(missing, "problem string, rows long")
    for column, words in (("mapping_type", MAPPING_TYPES), ("confidence", CONFIDENCES)):
        if column in table.columns:
            value = F.coalesce(F.col(column).cast("string"), F.lit(""))
            bad = table.select(value.alias("v")).filter(~F.col("v").isin(words)).groupBy("v").agg(F.count("*").alias("rows"))
            out = out.unionByName(bad.select(F.concat(F.lit(f"invalid {column}: "), "v").alias("problem"), "rows"))
    return out


def mapped_concepts(concepts: DataFrame, table: DataFrame, source_scheme: str, target_scheme: str, best: bool = True) -> DataFrame:
    """concepts(source_id, source_label) with target_id, target_label, mapping_type, confidence and a warning where nothing fits.

    A concept with an id is looked up by it, one without by its label, white space and case aside; of several lines
    the surest, earliest counts, or all with best=False. table has CROSSWALK's columns and line.
    """
    label = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    rows = table.filter((F.col("source_scheme") == source_scheme) & (F.col("target_scheme") == target_scheme))
    ids = rows.select(F.concat(F.lit("i:"), F.col("source_id").cast("string")).alias("_key"), "*")
    both = ids.unionByName(rows.select(F.concat(F.lit("l:"), label(F.col("source_label"))).alias("_key"), "*"))
    if best:
        both = both.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(_sureness("confidence").desc(), "line"))).filter("_rn = 1").drop("_rn")
    key = F.when(F.col("source_id").isNotNull(), F.concat(F.lit("i:"), F.col("source_id").cast("string"))).when(F.col("source_label").isNotNull(), F.concat(F.lit("l:"), label(F.col("source_label"))))
    found = both.select("_key", blank_to_null(F.col("target_id").cast("string")).alias("target_id"), blank_to_null(F.col("target_label")).alias("target_label"), F.coalesce(blank_to_null(F.col("mapping_type")), F.lit("unknown")).alias("mapping_type"), F.coalesce(blank_to_null(F.col("confidence")), F.lit("unknown")).alias("confidence"))
    out = concepts.withColumn("_k", key).join(found, F.col("_k") == F.col("_key"), "left")
    warning = F.when(F.col("_k").isNull(), "no source id or label").when(F.col("_key").isNull(), F.concat(F.lit(f"no mapping for {source_scheme}: "), F.coalesce(F.col("source_id").cast("string"), F.col("source_label"))))
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return out.select(*concepts.columns, "target_id", "target_label", unknown("mapping_type"), unknown("confidence"), warning.alias("warning"))


@pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * normalised Indel similarity (2 * longest common subsequence over both lengths) of names with sorted words."""

    def lcs(x: str, y: str) -> int:
        at = {}
        for i, ch in enumerate(x):
            at[ch] = at.get(ch, 0) | (1 << i)
        s = (1 << len(x)) - 1
        for ch in y:
            u = s & at.get(ch, 0)
            s = (s + u) | (s - u)
        return sum(1 for i in range(len(x)) if not s >> i & 1)

    def ratio(x: str | None, y: str | None) -> float:
        x, y = (" ".join(sorted((s or "").lower().split())) for s in (x, y))
        return 200.0 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


def fuzzy_clusters(names: DataFrame, column: str, threshold: float = 95.0, order: list[str] | None = None) -> DataFrame:
    """name, head: the distinct names in first-seen order, gathered greedily around heads; empty and null names are left out.

    order says where a name was seen (its first row by these columns; without them, and among equals, names go by
    themselves). In that order a name that is similar to no earlier head is a head; every other name belongs to the last
    head that it is similar to. So heads are their own heads and no two heads are similar. What a loop over the names
    would give is found in rounds of joins: a name follows once an earlier similar name is known to be a head, and is
    one once all earlier similar names are known to follow others; each round settles the first of every group at least.
    """
    first = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order or [])], F.col(column).alias("name")))
    seen = saved(names.filter(F.coalesce(F.col(column) != "", F.lit(False))).groupBy(F.col(column).alias("name")).agg(first.alias("at")), "names")
    pairs = similar_names(seen.select("name"), threshold)
    where = lambda k: seen.select(F.col("name").alias(k), F.col("at").alias(f"{k}_at"))
    both = pairs.join(where("name"), "name").join(where("other"), "other")
    swap = F.col("name_at") < F.col("other_at")
    both = saved(both.select(F.when(swap, F.col("other")).otherwise(F.col("name")).alias("later"), F.when(swap, F.col("name")).otherwise(F.col("other")).alias("earlier")), "similar")
    followers = led(both)
    heads = seen.join(followers, "name", "left_anti")
    ends = both.select(F.col("later").alias("name"), F.col("earlier").alias("head")).unionByName(both.select(F.col("earlier").alias("name"), F.col("later").alias("head")))
    last = ends.join(followers, "name", "left_semi").join(heads.select(F.col("name").alias("head"), "at"), "head").groupBy("name").agg(F.max_by("head", "at").alias("head"))
    return heads.select("name", F.col("name").alias("head")).unionByName(last)


def led(edges: DataFrame) -> DataFrame:
    """name: the nodes of edges(later, earlier) that a greedy pass in order leaves out, as an earlier neighbour was taken; all others are taken.

    A round takes the nodes without an open earlier neighbour and settles all their later ones. edges are a stored table
    whose pairs have one order.
    """
    left, gone = edges, []
    while not left.isEmpty():
        taken = left.select("earlier").distinct().join(left.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        out = saved(left.join(taken, "earlier", "left_semi").select(F.col("later").alias("name")).distinct(), "followers")
        rest = saved(left.join(out, F.col("later") == F.col("name"), "left_anti").join(out, F.col("earlier") == F.col("name"), "left_anti"), "similar")
        if gone:
            forget(left)
        left = rest
        gone.append(out)
    every = edges.select(F.col("later").alias("name")).limit(0)
    for more in gone:
        every = every.unionByName(more)
    return every


def similar_names(distinct: DataFrame, threshold: float = 95.0) -> DataFrame:
    """name, other: the pairs of distinct names whose ratio reaches the threshold, name after other.

    A ratio of t allows (1 - t / 100) times both lengths of single-character edits, each of which spoils two pairs of
    neighbouring characters of the name with sorted words; so of each name's pairs in one common order, rarest
    first, two an edit and one more are enough to share one with every similar name. Names too short for this
    meet by their possible lengths instead. No pair is lost and frequent pairs of characters make no candidates.
    """
    sorted_ = F.array_join(F.array_sort(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != "")), " ")
    rows = distinct.select("name", sorted_.alias("s")).withColumn("m", F.length("s"))
    slack = (200 - threshold) / threshold  # the longest similar name's length, over this one's
    rows = rows.withColumn("edits", F.floor((1 - threshold / 100) * (1 + slack) * F.col("m") + 1e-9).cast("int"))
    pieces = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda i: F.substring("s", i, F.lit(2)))
    pairs = rows.filter("m >= 2").select("name", "m", "edits", F.posexplode(pieces).alias("at", "g"))
    nth = F.row_number().over(Window.partitionBy("name", "g").orderBy("at"))  # a repeated pair counts each time
    pairs = pairs.withColumn("k", F.concat("g", nth.cast("string")))
    often = pairs.groupBy("k").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("n", "k"))
    keys = pairs.join(often, "k").withColumn("rn", rank).filter(F.col("rn") <= 2 * F.col("edits") + 1).select("name", "m", "k")
    short = rows.filter(F.col("m") - 1 <= 2 * F.col("edits"))
    lengths = F.sequence(F.ceil(F.col("m") / slack).cast("int"), F.floor(F.col("m") * slack).cast("int"))
    reach = short.select("name", "m", F.explode(lengths).alias("other"))
    by_key = keys.join(keys.select(F.col("name").alias("head"), F.col("m").alias("hm"), "k"), "k").filter("head < name").filter((F.col("m") <= slack * F.col("hm")) & (F.col("hm") <= slack * F.col("m"))).select("name", "head")
    every = rows.select(F.col("name").alias("head"), F.col("m").alias("other"))
    met = reach.join(every, "other").filter("head != name").select(F.greatest("name", "head").alias("name"), F.least("name", "head").alias("head"))
    pairs = by_key.unionByName(met).distinct().filter(token_sort_ratio("name", "head") >= threshold)
    return pairs.select("name", F.col("head").alias("other"))
