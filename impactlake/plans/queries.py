"""The operators applied to the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlake.functions import text as T
from impactlake.operators import baselines, convert, corpus, counting, dedupe, graph, normalise, search, selection, units

BY = ["domain_id", "year"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# -- records: an order is a work, its priority the field, its total price the citations ---------------------------

RECORDS = """records AS (SELECT o_orderkey AS idx, o_custkey AS custkey, nullif(o_orderpriority, '5-LOW') AS domain_id, o_orderpriority AS domain_label, CAST(year(o_orderdate) AS INTEGER) AS year,
  o_totalprice AS c_use, CASE WHEN o_orderkey % 7 = 0 THEN round(o_totalprice / 2, 2) END AS c_use_window FROM orders)"""
BASE = """base AS (SELECT domain_id, year, avg(c_use) AS c0_mean, count(c_use) AS c0_n, quantile_cont(c_use, 0.75) AS thr_top25, quantile_cont(c_use, 0.9) AS thr_top10, quantile_cont(c_use, 0.99) AS thr_top1 FROM records GROUP BY ALL)"""
METRICS = """metrics AS (SELECT r.idx, r.custkey, r.domain_id, r.domain_label, r.year, coalesce(c_use_window, c_use) AS c, c0_mean, CASE WHEN c0_mean > 0 THEN coalesce(c_use_window, c_use) / c0_mean END AS cf,
  CAST(coalesce(c_use_window, c_use) >= thr_top25 AS INTEGER) AS p25, CAST(coalesce(c_use_window, c_use) >= thr_top10 AS INTEGER) AS p10, CAST(coalesce(c_use_window, c_use) >= thr_top1 AS INTEGER) AS p1
  FROM records r LEFT JOIN base b ON r.domain_id IS NOT DISTINCT FROM b.domain_id AND r.year IS NOT DISTINCT FROM b.year)"""
WITH = f"WITH {RECORDS}, {BASE}, {METRICS}"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records; one field in five is null, one record in seven has a window count."""
    o = table(spark, sf_dir, "orders")
    window = F.when(F.col("o_orderkey") % 7 == 0, F.round(F.col("o_totalprice") / 2, 2))
    return o.select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("custkey"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("domain_id"), F.col("o_orderpriority").alias("domain_label"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("c_use"), window.alias("c_use_window"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records(spark, sf_dir)
    return normalise.with_baseline(own, baselines.local_baselines(own, BY, "c_use"), BY)


def local_baseline(spark, sf_dir):
    out = baselines.local_baselines(records(spark, sf_dir), BY, "c_use").select(*BY, "c0_mean", "thr_top25", "thr_top10", "thr_top1", "c0_n")
    return rounded(out, "c0_mean", "thr_top25", "thr_top10", "thr_top1")


def mncs_pp_records(spark, sf_dir):
    out = metrics(spark, sf_dir).groupBy(*BY).agg(F.count("*").alias("n"), F.avg("cf").alias("mncs"), F.sum("PPg_top25").alias("n25"), F.sum("PPg_top10").alias("n10"), F.sum("PPg_top1").alias("n1"))
    return rounded(out, "mncs")


def integer_summary(spark, sf_dir):
    return rounded(counting.integer_summary(metrics(spark, sf_dir)), "MNCS", "PP1", "PP10", "PP25")


def _ppx(df: DataFrame, flag: str) -> DataFrame:
    return df.groupBy("l_suppkey").agg(F.sum(flag).alias("n_top"), F.count("*").alias("n"))


def ppx_top_decile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return _ppx(normalise.top_share(li, "l_quantity", ["l_suppkey"], 0.9), "pp10")


def ppx_strict_ties(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return _ppx(normalise.top_share(li, "l_quantity", ["l_suppkey"], 0.9, ">threshold"), "pp10")


def ppx_global(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return normalise.top_share(li, "l_extendedprice", None, 0.99).agg(F.sum("pp1").alias("n_top"), F.count("*").alias("n"))


def _hist(spark, sf_dir, method: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("domain_id"), F.year("l_shipdate").alias("year"), "l_quantity")
    return rounded(baselines.distribution(baselines.histogram(li, BY, "l_quantity"), BY, method), "c0_mean", "thr_top25", "thr_top10", "thr_top1")


def hist_mean_quantiles(spark, sf_dir):
    return _hist(spark, sf_dir, "cdf_min")


def hist_hazen(spark, sf_dir):
    return _hist(spark, sf_dir, "hazen")


def _hist_sql(extra: str) -> str:
    q = ", ".join(f"coalesce(min(k) FILTER (WHERE cum >= {p} * total + {extra}), max(k)) AS thr_{n}" for n, p in baselines.TOPS.items())
    return f"""WITH h AS (SELECT l_returnflag AS domain_id, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS k, count(*) AS n FROM lineitem GROUP BY ALL),
      c AS (SELECT *, sum(n) OVER (PARTITION BY domain_id, year ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY domain_id, year) AS total FROM h)
      SELECT domain_id, year, round(sum(k * n) / sum(n), 6) AS c0_mean, {q}, CAST(sum(n) AS BIGINT) AS c0_n FROM c GROUP BY ALL"""


def works_with_concepts(spark, sf_dir) -> DataFrame:
    """An order is a work, the brands of its items are its concepts, scored by price; its suppliers are its authors."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    brand = rows.groupBy("l_orderkey", "p_brand").agg(F.sum("l_extendedprice").alias("score"))
    concepts = brand.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("p_brand").alias("id"), F.col("p_brand").alias("label"), "score"))).alias("concepts"))
    authors = rows.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n_authors"))
    m = metrics(spark, sf_dir)
    return m.join(concepts.join(authors, "l_orderkey"), m["idx"] == F.col("l_orderkey"), "left").drop("l_orderkey")


def _fractional(spark, sf_dir, mode: str) -> DataFrame:
    out = counting.fractional_summary(counting.fractional_explode(works_with_concepts(spark, sf_dir), mode))
    return rounded(out, "W", "MNCS", "PP1", "PP10", "PP25")


def fractional_summary_equal(spark, sf_dir):
    return _fractional(spark, sf_dir, "equal")


def fractional_summary_score(spark, sf_dir):
    return _fractional(spark, sf_dir, "score")


def _fractional_sql(share: str) -> str:
    return f"""{WITH}, i AS (SELECT l_orderkey, p_brand, sum(l_extendedprice) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
      a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_authors FROM lineitem GROUP BY ALL),
      w AS (SELECT l_orderkey, p_brand, {share} AS w FROM i),
      e AS (SELECT coalesce(p_brand, domain_label) AS frac_label, year, coalesce(w, 1.0) / coalesce(n_authors, 1) AS weight, cf, p1, p10, p25 FROM metrics m LEFT JOIN w ON w.l_orderkey = m.idx LEFT JOIN a ON a.l_orderkey = m.idx)
      SELECT frac_label, year, round(sum(weight), 6) AS W, round(sum(weight * cf) / sum(weight), 6) AS MNCS, round(sum(weight * p1) / sum(weight), 6) AS PP1, round(sum(weight * p10) / sum(weight), 6) AS PP10, round(sum(weight * p25) / sum(weight), 6) AS PP25
      FROM e GROUP BY ALL"""


def by_nation(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    names = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("custkey"), F.col("n_name").alias("nation"))
    return metrics(spark, sf_dir).join(names, "custkey")


NATIONS = f"{WITH}, by_nation AS (SELECT m.*, n_name AS nation FROM metrics m JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def unit_summary(spark, sf_dir):
    return rounded(units.unit_means(by_nation(spark, sf_dir), "nation", flags=("PPg_top10", "PPg_top1")), "MNCS", "PP10", "PP1")


def overview(spark, sf_dir):
    return rounded(units.overview(metrics(spark, sf_dir)), "mncs", "pp10_pct")


def sensitivity_delta(spark, sf_dir):
    m = by_nation(spark, sf_dir).withColumnRenamed("nation", "country")
    out = units.sensitivity(m.filter("year < 1999"), m.filter("year >= 1997 and country <> 'FRANCE'"), "country")
    return rounded(out, "MNCS_base", "PP10_base", "MNCS_var", "PP10_var", "d_MNCS", "d_PP10")


def goldset_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("predicted", F.when(F.col("toxic") == 0, "yes").otherwise("no"))
    return rounded(units.gold_set(rows, "quality", "predicted"), "precision", "recall", "f1")


def trade(spark, sf_dir) -> DataFrame:
    """src, dst: a customer's and a supplier's key (made distinct) that an order ties together."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst")).distinct()


TRADE = "trade AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 10000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def citation_edges(spark, sf_dir):
    """Parts cite parts of the next brand by a made-up DOI list; duplicates lead to the last record."""
    p = table(spark, sf_dir, "part")
    doi = F.concat(F.lit("10.1234/"), F.col("p_partkey") % 500)
    refs = F.array(F.concat(F.lit("10.1234/"), (F.col("p_partkey") + 1) % 500), F.concat(F.lit("10.1234/"), (F.col("p_partkey") * 3) % 700), doi)
    return graph.citation_edges(p.select(F.col("p_partkey").alias("idx"), doi.alias("doi"), refs.alias("ref_dois")))


def degree(spark, sf_dir):
    edges = trade(spark, sf_dir)
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx")).unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("idx")))
    return graph.degrees(nodes, edges)


def nation_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nations, and edges from a customer's to a supplier's nation where more is ordered than between two nations on average."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"))
    pairs = e.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    often = pairs.crossJoin(F.broadcast(pairs.agg(F.avg("n").alias("mean")))).filter("n > mean")  # one row
    return nodes, graph.clean_edges(often, nodes)


NATION_EDGES = """c AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
  e AS (SELECT src, dst FROM c WHERE n > (SELECT avg(n) FROM c) AND src <> dst), d AS (SELECT idx, count(*) AS deg FROM (SELECT src AS idx FROM e UNION ALL SELECT dst FROM e) GROUP BY idx)"""


#: Rounds of PageRank in the query and in its SQL, which has them one by one.
PAGERANK_ROUNDS = 25


def trade_nodes(spark, sf_dir) -> DataFrame:
    """idx: all customers and suppliers, those without an order too."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_custkey").cast("long").alias("idx")).unionByName(s.select((F.col("s_suppkey") + 10_000_000).cast("long").alias("idx")))


def mutual_trade(spark, sf_dir) -> DataFrame:
    """src, dst: customers to their orders' suppliers, and suppliers back to customers with several such orders."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    often = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy((F.col("l_suppkey") + 10_000_000).cast("long").alias("src"), F.col("o_custkey").cast("long").alias("dst")).agg(F.count("*").alias("n")).filter("n > 1")
    return trade(spark, sf_dir).select(F.col("src").cast("long"), F.col("dst").cast("long")).unionByName(often.select("src", "dst"))


def pagerank(spark, sf_dir):
    """Over all customers and suppliers."""
    return rounded(graph.pagerank(trade_nodes(spark, sf_dir), mutual_trade(spark, sf_dir), iterations=PAGERANK_ROUNDS, tolerance=0.0), "pagerank", digits=9)


def _pagerank_sql() -> str:
    step = lambda i: f"r{i + 1} AS MATERIALIZED (SELECT p.idx, 0.15 / n.n + 0.85 * (coalesce(f.flow, 0) + lost.lost / n.n) AS r FROM p CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(r), 0) AS lost FROM r{i} WHERE idx NOT IN (SELECT src FROM o)) lost LEFT JOIN (SELECT dst, sum(r / o.n) AS flow FROM e JOIN r{i} ON e.src = r{i}.idx JOIN o ON o.src = e.src GROUP BY dst) f ON f.dst = p.idx)"
    return f"""WITH p AS (SELECT c_custkey AS idx FROM customer UNION ALL SELECT s_suppkey + 10000000 FROM supplier), n AS (SELECT count(*) AS n FROM p),
      e AS MATERIALIZED (SELECT DISTINCT o_custkey AS src, l_suppkey + 10000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT l_suppkey + 10000000, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) > 1),
      o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src), r0 AS (SELECT idx, 1.0::DOUBLE / n.n AS r FROM p CROSS JOIN n), {", ".join(map(step, range(PAGERANK_ROUNDS)))}
      SELECT idx, round(r, 9) AS pagerank FROM r{PAGERANK_ROUNDS}"""


def betweenness(spark, sf_dir):
    return rounded(graph.betweenness(*nation_graph(spark, sf_dir)), "betweenness")


def betweenness_sampled(spark, sf_dir):
    """Over all customers and suppliers, within 0.1 at all of them with probability 0.9."""
    from impactlake.operators.paths import sampled_betweenness

    return rounded(sampled_betweenness(trade_nodes(spark, sf_dir), mutual_trade(spark, sf_dir), epsilon=0.1), "betweenness", digits=9)


def communities(spark, sf_dir):
    return graph.communities(*nation_graph(spark, sf_dir))


def _citing(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Focal works are each customer's first order; all orders of the customer cite it. The author is an order's priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.array("o_orderpriority").alias("author_ids"))
    focal = rows.groupBy("cust").agg(F.min(F.struct("year", "id", "author_ids")).alias("x")).select("cust", "x.id", "x.year", "x.author_ids")
    return focal, rows.select(F.col("cust").alias("cited"), "year", "author_ids")


def window_citations_k(spark, sf_dir):
    focal, citing = _citing(spark, sf_dir)
    return corpus.window_counts(focal, citing, "cust", 3, drop_self=False)


def self_citation_excluded(spark, sf_dir):
    focal, citing = _citing(spark, sf_dir)
    return corpus.window_counts(focal, citing, "cust", 3, drop_self=True)


def _citing_sql(extra: str) -> str:
    return f"""WITH r AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_custkey AS cust, o_orderpriority AS author FROM orders),
      f AS (SELECT cust, min({{'y': y, 'id': id, 'author': author}}) AS x FROM r GROUP BY cust)
      SELECT f.cust, CAST(count(r.id) AS BIGINT) AS c_use_window FROM f LEFT JOIN r ON r.cust = f.cust AND r.y BETWEEN x.y AND x.y + 2 {extra} GROUP BY ALL"""


def documents_keyed(spark, sf_dir) -> DataFrame:
    """doc_id with keys that documents share: a digest of the whole text (one source has none), the length, language and source."""
    d = table(spark, sf_dir, "documents")
    key = F.when(F.col("source") != "src3", F.md5("text"))
    return d.select("doc_id", key.alias("doi"), F.when(F.col("lang") != "en", F.concat(F.lit("w"), F.col("n_chars"))).alias("oa_id"), F.concat_ws(" ", "lang", "source").alias("title"), "lang", "n_chars")


KEYED = "d AS (SELECT doc_id, CASE WHEN source <> 'src3' THEN md5(text) END AS doi, CASE WHEN lang <> 'en' THEN 'w' || n_chars END AS oa_id, concat_ws(' ', lang, source) AS title, lang, n_chars FROM documents)"


def dedupe_keep_missing(spark, sf_dir):
    return dedupe.keep_missing(documents_keyed(spark, sf_dir), "doi", ["doc_id"]).select("doc_id", "doi")


def dedupe_collapse_missing(spark, sf_dir):
    return dedupe.collapse_missing(documents_keyed(spark, sf_dir), "doi", ["doc_id"]).select("doc_id", "doi")


def dedupe_key_chain(spark, sf_dir):
    d = documents_keyed(spark, sf_dir).withColumn("doi", F.when(F.col("doc_id") % 2 == 0, F.col("doi")))
    return dedupe.by_chain(d, "doi", "oa_id", "title", "lang", "n_chars", ["doc_id"]).select("doc_id")


def union_or_search(spark, sf_dir):
    d = documents_keyed(spark, sf_dir)
    return dedupe.union_search([d.filter("lang = 'en'"), d.filter("n_chars > 1000")], "doi", "oa_id", ["doc_id"]).select("doc_id", "lang")


def dense_index(spark, sf_dir):
    """Whole documents are numbered; the text is shown by its md5."""
    return dedupe.with_index(table(spark, sf_dir, "documents"), ["n_chars", "doc_id"]).withColumn("text", F.md5("text")).select("doc_id", "n_chars", "text", "idx")


def title_jaccard_match(spark, sf_dir):
    """Benchmark items against the documents' whole texts."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return rounded(corpus.title_matches(b, d.select("doc_id", F.col("text").alias("t")), "item_id", "text", "doc_id", "t", 0.2), "similarity")


def doi_extract(spark, sf_dir):
    s = F.concat(F.lit("see https://doi.org/10.5555/AB"), F.col("page_id"), F.lit("x). And 10.77/short "), F.coalesce("url", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", T.norm_doi(s).alias("doi"), T.strip_doi_prefix(F.concat(F.lit("DOI: 10.1/X"), F.col("page_id"))).alias("bare"))


def label_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.collapse(F.concat(F.lit("  "), F.col("p_type"), F.lit("  x  "))).alias("label"), T.norm_title(F.col("p_name"), None).alias("title"), T.macro_area(F.col("p_type")).alias("area"))


def year_extract(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.year_of(F.concat(F.lit("No 12345, "), F.col("o_orderdate").cast("string"))).alias("year"))


def abstract_rebuild(spark, sf_dir):
    """The inverted index of each whole text turned back into its words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    return corpus.inverted_indexes(d, "doc_id", "t").select("doc_id", T.abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"))


def parts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("area"), F.col("p_retailprice").alias("cf"), F.col("p_size").alias("c_use"))


def select_mode_a(spark, sf_dir):
    return selection.one_per_area(parts(spark, sf_dir), 10, "area", "idx").select("idx", "area")


def select_mode_b(spark, sf_dir):
    return selection.by_quota(parts(spark, sf_dir), 40, "area", "idx").select("idx", "area")


def select_mode_c(spark, sf_dir):
    return selection.capped(parts(spark, sf_dir), 30, 2, "area", "idx").select("idx", "area")


def select_mode_d(spark, sf_dir):
    return selection.per_area(parts(spark, sf_dir), 3, "area", "idx").select("idx", "area")


def reading_parts(spark, sf_dir) -> DataFrame:
    """Parts as works: a brand is the area, a third have no window count, the kind of the part ranks as PageRank and the name's length as betweenness."""
    p = parts(spark, sf_dir).withColumn("year", F.lit(2000) + F.col("idx") % 20)
    return p.withColumns({"c_use_window": F.when(F.col("idx") % 3 != 0, F.col("c_use") * 2), "pagerank": (F.col("idx") % 17) / 100.0, "betweenness": (F.col("idx") % 13) / 10.0})


def reading_lists(spark, sf_dir):
    return selection.reading_lists(reading_parts(spark, sf_dir), "area", "idx").select("list", "position", "idx")


def download_union(spark, sf_dir):
    """Works of a quota selection and of the reading lists, each (doi, title) once."""
    rows = reading_parts(spark, sf_dir).withColumns({"doi": F.concat(F.lit("10.1/"), F.col("idx") % 500), "title": F.col("area"), "is_retracted": (F.col("idx") % 11 == 0).cast("int"), "is_focal": (F.col("idx") % 2).cast("int")})
    keep = selection.eligible(rows)
    main, read = selection.capped(keep, 40, 2, "area", "idx"), selection.reading_lists(keep, "area", "idx")
    return selection.for_download([main, read.drop("list", "position")]).groupBy("doi", "title").agg(F.count("*").alias("n"))


RANKED = "p AS (SELECT p_partkey AS idx, p_brand AS area, p_retailprice AS cf, p_size AS c_use, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS rn FROM part)"


def zscore(spark, sf_dir):
    return rounded(units.z_scores(parts(spark, sf_dir), ["cf", "c_use"]), "z_cf", "z_c_use").select("idx", "z_cf", "z_c_use")


def minmax(spark, sf_dir):
    return rounded(units.min_max("cf")(parts(spark, sf_dir)), "cf_scaled").select("idx", "cf_scaled")


def crosswalk_best(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.col("n_regionkey").alias("key"), F.col("n_nationkey").cast("string").alias("target_id"), F.col("n_name").alias("target_label"), F.when(F.col("n_nationkey") % 4 == 0, "low").when(F.col("n_nationkey") % 4 == 1, "medium").otherwise("high").alias("confidence"), F.col("n_nationkey").alias("line"))
    return corpus.crosswalk(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), "r_name"), lines, "key")


def authorship_explode(spark, sf_dir):
    """Conversations as works, their turns as authorships, the roles as institutions."""
    c = table(spark, sf_dir, "conversations")
    institution = F.struct(F.lit(None).cast("string").alias("ror"), F.col("role").alias("display_name"), F.lit("XX").alias("country_code"))
    author = F.struct(F.concat(F.lit("A"), F.col("turn")).alias("id"), F.col("role").alias("display_name"), F.concat(F.lit("https://orcid.org/0000-"), F.col("turn")).alias("orcid"))
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", author.alias("author"), F.array(institution).alias("institutions")))).alias("authorships"))
    return corpus.authorship_rows(rows).select("work_id", F.col("position").cast("long").alias("position"), "author_id", "author_name", "orcid", "institution", "country")


def sheet_quality(spark, sf_dir):
    """Documents as a table of works: a third has no title, a fifth no DOI, no year at all; the source is the area."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("Document Title"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("DOI"), F.col("source").alias("Area"), F.col("n_chars").alias("usage"))
    return rounded(units.completeness(d), "filled", "score")


def bootstrap_ci(spark, sf_dir):
    return rounded(counting.bootstrap_intervals(metrics(spark, sf_dir), BY), "MNCS_low", "MNCS_high")


def baseline_errors(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("domain_id"), "l_quantity")
    hist = baselines.histogram(li, ["domain_id"], "l_quantity")
    return rounded(baselines.baseline_errors(hist, ["domain_id"]), *[f"err_{k}_pct" for k in ("c0", "top25", "top10", "top1")])


def fuzzy_clusters(spark, sf_dir):
    """Names of parts, seen in the order of the parts."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.reverse(F.split("p_name", " "))[0], F.col("p_type"), F.col("p_brand")).alias("name"))
    return corpus.fuzzy_clusters(names, "name", 96.0, ["p_partkey"])


def query_filter_sort(spark, sf_dir):
    """English or French documents of two sources that hold a term, without repeated junk; the position in order of length."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("lang").alias("language"), F.col("source").alias("type"), F.col("n_chars").alias("cited_by_count"), F.lit(None).cast("string").alias("publication_date"), F.lit(2000).alias("publication_year"))
    rows = d.filter(search.predicate(title="the | les, an", languages=["EN", "fr"], types=["src1", "src2"]))
    return search.sort_works(search.exclude(rows, [r"!{2,}", "("], ["title"]), "citations").select("id", "cited_by_count")


def nested_works(spark, sf_dir) -> DataFrame:
    """Parts as nested works with two authors, a venue, pages, and a name whose words give an inverted index."""
    p = table(spark, sf_dir, "part")
    who = lambda n: F.struct(F.struct(F.lit(n).alias("display_name")).alias("author"))
    source = F.struct(F.struct(F.col("p_brand").alias("display_name"), F.lit(None).cast("string").alias("publisher")).alias("source"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://x/"), F.col("p_partkey"))).alias("landing_page_url"), F.lit("http://pdf").alias("pdf_url"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "journal-article").when(F.col("p_partkey") % 3 == 1, "book-chapter").otherwise("other")
    biblio = F.struct(F.lit("7").alias("volume"), F.lit(None).cast("string").alias("issue"), F.lit("1").alias("first_page"), F.when(F.col("p_partkey") % 5 == 0, "9").alias("last_page"))
    return p.select(F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey")).alias("id"), F.concat(F.lit("DNA of "), F.col("p_name")).alias("title"), F.concat(F.lit("DNA of "), F.col("p_name")).alias("display_name"), F.concat(F.lit("https://doi.org/10.1/"), F.col("p_partkey")).alias("doi"), kind.alias("type"), F.lit("EN").alias("language"), F.when(F.col("p_partkey") % 4 != 0, "1999-03-02").alias("publication_date"), F.lit(1998).alias("publication_year"), F.col("p_size").alias("cited_by_count"), F.array(who("Ada Byron"), who("Alan M. Turing")).alias("authorships"), source.alias("primary_location"), biblio.alias("biblio"))


def bibtex_entries(spark, sf_dir):
    return search.bibtex(nested_works(spark, sf_dir), fold=None)


def flat_results(spark, sf_dir):
    return search.flat_works(nested_works(spark, sf_dir))


def html_rows(spark, sf_dir):
    return search.html_table(search.flat_works(nested_works(spark, sf_dir)).select("id", "title", "url"))


def search_flags(spark, sf_dir):
    works = nested_works(spark, sf_dir).withColumns({"abstract": F.when(F.col("cited_by_count") > 10, F.col("title")), "is_oa": F.col("cited_by_count") % 2 == 0})
    return works.filter(search.flags("article", has_abstract=True, is_oa=True, has_doi=True, dates=("1999-01-01", "1999-12-31"))).select("id")


def works_found(spark, sf_dir):
    """Half of the DOIs that are asked for belong to a work."""
    works = nested_works(spark, sf_dir).withColumn("doi", F.concat(F.lit("doi:10.55555/"), F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 700))
    asked = table(spark, sf_dir, "part").filter("p_partkey <= 1400").select(F.concat(F.lit("10.55555/"), F.col("p_partkey") - 1).alias("doi"))
    return corpus.works_by_doi(asked, works).select("doi", "id")


def focal_works(spark, sf_dir):
    works = nested_works(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.55555/"), F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 700))
    asked = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.55555/"), F.col("p_partkey"))).alias("doi"), F.col("p_name").alias("title"), F.lit(None).cast("int").alias("year"))
    return corpus.found_focal(asked, works).select("id", "doi")


def fetched_works(spark, sf_dir):
    works = nested_works(spark, sf_dir).withColumn("doi", F.when(F.col("cited_by_count") > 5, F.concat(F.lit("10.55555/"), F.col("cited_by_count"))))
    return corpus.fetched(works, ["id"], limit=100).select("id")


def concept_map(spark, sf_dir):
    """Nations, some by id and some by label, mapped to regions by a crosswalk with lines of several confidences."""
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.lit("N").alias("source_scheme"), (F.col("n_nationkey") % 20).cast("string").alias("source_id"), F.col("n_name").alias("source_label"), F.lit("R").alias("target_scheme"), F.col("n_regionkey").cast("string").alias("target_id"), F.lit("").alias("target_label"), F.lit("exact").alias("mapping_type"), F.when(F.col("n_nationkey") < 20, "low").otherwise("high").alias("confidence"), F.col("n_nationkey").cast("long").alias("line"))
    asked = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).alias("source_id"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).alias("source_label"))
    return corpus.mapped_concepts(asked, lines, "N", "R").select("source_id", "source_label", "target_id", "confidence", "warning")


def crosswalk_check(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return corpus.crosswalk_problems(n.select(F.col("n_name").alias("source_label"), F.when(F.col("n_regionkey") == 1, "sort of").otherwise("exact").alias("mapping_type"), F.when(F.col("n_regionkey") == 2, "sure").otherwise("high").alias("confidence")))


def concept_works(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as works whose fields are the line numbers of their items, and the fields and years of large orders."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("domain_ids"))
    works = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), "domain_ids", F.year("o_orderdate").alias("year"), (F.floor("o_totalprice") % 50).alias("cited_by_count"), F.col("o_orderstatus").alias("type"))
    pairs = works.filter("id % 3 = 0").select(F.explode("domain_ids").alias("domain_id"), "year").filter("domain_id <> '7'").unionByName(works.limit(1).select(F.lit("99").alias("domain_id"), "year"))
    return works, pairs


def global_baselines(spark, sf_dir):
    works, pairs = concept_works(spark, sf_dir)
    out = baselines.global_baselines(works, pairs, replicates=50).select("domain_id", "year", "c0_mean", "thr_top1", "thr_top10", "thr_top25", "c0_n", "c0_complete", "c0_counts_json", "quantile_method", "ties_policy")
    return rounded(out, "c0_mean")


def sweep_counts(spark, sf_dir):
    works, pairs = concept_works(spark, sf_dir)
    hist, complete = baselines.swept(works, pairs, types=["O", "F"], max_rows=40)
    return hist.groupBy("domain_id", "year").agg(F.sum("n").alias("n"), F.sum(F.col("k") * F.col("n")).alias("citations")).withColumn("complete", complete)


def records_with_network(spark, sf_dir):
    """Customers with their degrees; the network's own name column gives way to the records'."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"))
    net = graph.degrees(c.select("idx").filter("idx % 2 = 0"), trade(spark, sf_dir)).withColumnRenamed("idx", "node").withColumn("NAME", F.lit("x"))
    return graph.with_network(c, net, "idx", "node")


def partition_agreement(spark, sf_dir):
    """How far a customer's nation and market segment say the same."""
    c = table(spark, sf_dir, "customer")
    return rounded(graph.normalised_mutual_information(c.select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("community")), c.select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("community"))), "nmi")


def louvain(spark, sf_dir):
    """Customers and suppliers that order together, at resolution 1."""
    return graph.modularity_communities(None, trade(spark, sf_dir))  # every customer and supplier of an order is the end of a link


def leiden(spark, sf_dir):
    """Customers and suppliers that order together, in connected communities."""
    from impactlake.operators import communities as found

    return found.leiden(trade_nodes(spark, sf_dir), trade(spark, sf_dir))


def greedy_communities(spark, sf_dir):
    """Customers and suppliers that order together, merged by gain."""
    from impactlake.operators import communities as found

    return found.greedy(trade_nodes(spark, sf_dir), trade(spark, sf_dir))


def styled_nodes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.concat("p_name", F.lit(" "), F.col("p_type"), F.lit(" "), F.col("p_type"), F.lit(" "), F.col("p_type")).alias("title"), F.col("p_brand").alias("domain_label"), F.col("p_size").alias("deg"))
    return rounded(graph.styled(p), "size").select("idx", "label", "size", "category", "category_rank", "hue", "tooltip")


def overview_errors(spark, sf_dir):
    m = metrics(spark, sf_dir)
    errors = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 1.0).alias("err_c0_pct"), F.lit("bad").alias("err_thr10_pct"))
    return rounded(units.overview_with_errors(m, errors), "mncs", "pp10_pct")


def area_confidence(spark, sf_dir):
    labels = F.concat("r_name", F.when(F.col("r_regionkey") == 1, " Bio Medicine").when(F.col("r_regionkey") == 2, " of ASTROnomy").otherwise(""))
    return table(spark, sf_dir, "region").select("r_regionkey", T.macro_area(labels).alias("area"), T.macro_area_confidence(labels).alias("confidence"), T.hyperlink(F.when(F.col("r_regionkey") > 1, "10.1/x"), F.lit(1999), F.concat(F.col("r_name"), F.lit(' "q"'))).alias("link"))


def topic_texts(spark, sf_dir):
    from impactlake.sources.records import topic_documents

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 2 != 0, F.col("text")).alias("abstract"))
    return topic_documents(d)


def topic_clusters(spark, sf_dir):
    from impactlake.operators import topics

    return topics.topics(table(spark, sf_dir, "embeddings"), "vec_id").groupBy("topic").agg(F.count("*").alias("n"))


def density_topics(spark, sf_dir):
    from impactlake.operators import topics

    return topics.density_topics(table(spark, sf_dir, "embeddings"), "vec_id").groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("probability"))


def export_rows(spark, sf_dir):
    """Customers as works: their name is the title, their segment the type, the nation the only author."""
    c = table(spark, sf_dir, "customer")
    author = F.struct(F.struct(F.lit(None).cast("string").alias("id"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("display_name")).alias("author"))
    concepts = F.array(F.struct(F.col("c_mktsegment").alias("display_name")), F.struct(F.lit("A").alias("display_name")), F.struct(F.col("c_mktsegment").alias("display_name")))
    works = c.select(F.concat(F.lit("https://x/W"), F.col("c_custkey")).alias("id"), F.concat(F.lit("https://doi.org/10.1234/C"), F.col("c_custkey")).alias("doi"), F.col("c_name").alias("title"), F.lit("2001").alias("publication_year"), F.col("c_custkey").cast("string").alias("cited_by_count"), F.col("c_mktsegment").alias("type"), F.array(author).alias("authorships"), concepts.alias("concepts"))
    out = convert.export_rows(works)
    return out.toDF(*[c.lower().replace(" ", "_") for c in out.columns])


def download_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("A; B").alias("authors"), F.concat(F.lit("12. "), F.col("p_name")).alias("title"), F.lit(1999).alias("year"), F.nullif(F.col("p_partkey").cast("string"), F.lit("3")).alias("doi"))
    return convert.download_lines(p)


def visible_graph(spark, sf_dir):
    nodes, edges = nation_graph(spark, sf_dir)
    kept, inside = graph.visible(graph.degrees(nodes, edges), edges, 24)
    return inside


def target_pairs(spark, sf_dir):
    return normalise.target_pairs(records(spark, sf_dir))


def min_metrics(spark, sf_dir):
    out = normalise.with_min_metrics(records(spark, sf_dir).select("idx", "domain_label", "year", "c_use"), "c_use", ["domain_label", "year"])
    return rounded(out.groupBy("domain_label", "year").agg(F.sum("PPg_top10").alias("n10"), F.max("cf").alias("cf")), "cf")


def histogram_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("domain_id"), "l_quantity")
    return baselines.histogram(li, ["domain_id"], "l_quantity")


def dedupe_stats(spark, sf_dir):
    d = documents_keyed(spark, sf_dir).withColumn("doi", F.when(F.col("doc_id") % 2 == 0, F.col("doi")))
    return dedupe.chain_stats(d, "doi", "oa_id", "title", "lang", "n_chars")


def majority_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("community"), "c_mktsegment")
    return graph.majority_labels(c, "c_mktsegment")


def references_ordered(spark, sf_dir):
    """An order's items as references to parts; the parts of a size over 25 have a DOI."""
    li = table(spark, sf_dir, "lineitem")
    refs = li.groupBy(F.concat(F.lit("o"), "l_orderkey").alias("oa_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("p"), x["l_partkey"])).alias("referenced_works"))
    works = refs.select("oa_id", F.lit(None).cast("string").alias("doi"), "referenced_works").unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("oa_id"), F.when(F.col("p_size") > 25, F.concat(F.lit("10.1/"), "p_partkey")).alias("doi"), F.array().cast("array<string>").alias("referenced_works")))
    out = corpus.references_to_dois(works, idx="oa_id")
    return out.filter("oa_id like 'o%'").select("oa_id", F.array_join("ref_dois", ",").alias("refs"))


_SELECT = {"select_mode_a": "WHERE rn = 1 ORDER BY cf DESC, c_use DESC, idx LIMIT 10", "select_mode_c": "WHERE rn <= 2 ORDER BY cf DESC, c_use DESC, idx LIMIT 30", "select_mode_d": "WHERE rn <= 3"}
_MATCH = r"list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '')"

READ = """r AS (SELECT p_partkey AS idx, p_brand AS area, p_retailprice AS cf, p_size AS c_use, 2000 + p_partkey % 20 AS year, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 2 END AS win, (p_partkey % 17) / 100.0 AS pr, (p_partkey % 13) / 10.0 AS btw FROM part)"""
_LISTS = {"core": ("cf DESC NULLS LAST, pr DESC NULLS LAST", 2), "recent": ("win DESC NULLS LAST, year DESC", 2), "bridge": ("btw DESC", 1), "diversity": ("score DESC", 1)}


def _lists_sql(source: str) -> str:
    z = lambda c: f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)"
    scored = f"s AS (SELECT *, round(0.5 * {z('cf')} + 0.3 * {z('win')} + 0.2 * {z('pr')}, 9) AS score FROM {source})"
    lists = " UNION ALL ".join(f"SELECT '{n}' AS list, idx, row_number() OVER (ORDER BY {o}, idx) AS position FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY {o}, idx) AS rn FROM s) WHERE rn <= {k} QUALIFY position <= 15" for n, (o, k) in _LISTS.items())
    return f"{scored}, lists AS ({lists})"


_WORK = """w AS (SELECT p_partkey AS k, 'W' || p_partkey AS wid, 'DNA of ' || p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'book-chapter' ELSE 'other' END AS type, CASE WHEN p_partkey % 4 <> 0 THEN '1999-03-02' END AS date, p_size, p_brand, CASE WHEN p_partkey % 5 = 0 THEN '1--9' ELSE '1' END AS pages FROM part)"""
_ENTRY = """'@' || CASE type WHEN 'journal-article' THEN 'article' WHEN 'book-chapter' THEN 'incollection' ELSE 'misc' END || '{Byron' || coalesce(date[:4], '') || 'dnaof' || split_part(lower(title), ' ', 3) || ',' || chr(10) || '  title = {\\{DNA\\} of ' || title[8:] || '}' || coalesce(',' || chr(10) || '  year = {' || date[:4] || '}', '')
      || ',' || chr(10) || '  doi = {https://doi.org/10.1/' || k || '},' || chr(10) || '  url = {https://openalex.org/' || wid || '},' || chr(10) || '  author = {Byron, Ada and Turing, Alan M.}' || CASE type WHEN 'journal-article' THEN ',' || chr(10) || '  journal = {' || p_brand || '}' WHEN 'book-chapter' THEN ',' || chr(10) || '  booktitle = {' || p_brand || '}' ELSE '' END
      || ',' || chr(10) || '  volume = {7},' || chr(10) || '  pages = {' || pages || '},' || chr(10) || '  language = {EN},' || chr(10) || '  note = {Cited by ' || p_size || ' (OpenAlex)}' || chr(10) || '}'"""
_URL = "CASE WHEN k % 2 = 0 THEN 'http://x/' || k ELSE 'http://pdf' END"
_CONCEPT = """w AS (SELECT DISTINCT o_orderkey AS id, CAST(l_linenumber AS VARCHAR) AS domain_id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice) AS BIGINT) % 50 AS k, o_orderstatus AS type FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  p AS (SELECT DISTINCT domain_id, year FROM w WHERE id % 3 = 0 AND domain_id <> '7')"""

ORACLE_SQL = {
    "reading_lists": f"WITH {READ}, {_lists_sql('r')} SELECT list, CAST(position AS INTEGER) AS position, idx FROM lists",
    "download_union": f"""WITH {READ}, keep AS (SELECT * FROM r WHERE idx % 11 <> 0 AND idx % 2 = 1), {_lists_sql('keep')},
      main AS (SELECT idx FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY cf DESC, win DESC NULLS LAST, c_use DESC, pr DESC, btw DESC, idx) AS rn FROM keep) WHERE rn <= 2 ORDER BY cf DESC, win DESC NULLS LAST, c_use DESC, pr DESC, btw DESC, idx LIMIT 40),
      every AS (SELECT idx FROM main UNION SELECT idx FROM lists) SELECT DISTINCT '10.1/' || (idx % 500) AS doi, area AS title, 1 AS n FROM every JOIN r USING (idx)""",
    "bibtex_entries": f"WITH {_WORK} SELECT {_ENTRY} AS entry FROM w",
    "flat_results": f"""WITH {_WORK} SELECT wid AS id, 'https://openalex.org/' || wid AS link, title, 'Ada Byron; Alan M. Turing' AS authors, CASE WHEN date IS NULL THEN '1998' ELSE '1999' END AS year, coalesce(date, '1998') AS publication_date, '' AS venue, type, 'en' AS language, p_size AS cited_by, '10.1/' || k AS doi, {_URL} AS url, '' AS abstract FROM w""",
    "html_rows": f"""WITH {_WORK} SELECT '<tr><td>' || wid || '</td><td>' || title || '</td><td><a href=' || chr(39) || {_URL} || chr(39) || ' target=' || chr(39) || '_blank' || chr(39) || '>link</a></td></tr>' AS line FROM w""",
    "search_flags": f"WITH {_WORK} SELECT 'https://openalex.org/' || wid AS id FROM w WHERE type = 'journal-article' AND p_size > 10 AND p_size % 2 = 0 AND date IS NOT NULL",
    "works_found": "SELECT '10.55555/' || (a.p_partkey - 1) AS doi, min('https://openalex.org/W' || w.p_partkey) AS id FROM part a LEFT JOIN part w ON w.p_partkey % 700 = a.p_partkey - 1 WHERE a.p_partkey <= 1400 GROUP BY a.p_partkey",
    "focal_works": "SELECT min('https://openalex.org/W' || w.p_partkey) AS id, '10.55555/' || a.p_partkey AS doi FROM part a JOIN part w ON w.p_partkey % 700 = a.p_partkey WHERE a.p_partkey % 2 = 0 GROUP BY a.p_partkey",
    "fetched_works": "SELECT min('https://openalex.org/W' || p_partkey) AS id FROM part GROUP BY CASE WHEN p_size > 5 THEN p_size ELSE -p_partkey END ORDER BY id LIMIT 100",
    "concept_map": """WITH a AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS source_id, CASE WHEN n_nationkey % 5 <> 0 THEN ' ' || lower(n_name) || ' ' END AS source_label, n_name FROM nation),
      t AS (SELECT *, CASE WHEN n_nationkey < 20 THEN 'low' ELSE 'high' END AS confidence FROM nation),
      i AS (SELECT CAST(n_nationkey % 20 AS VARCHAR) AS id, n_regionkey, confidence FROM t QUALIFY row_number() OVER (PARTITION BY n_nationkey % 20 ORDER BY CASE confidence WHEN 'high' THEN 3 ELSE 1 END DESC, n_nationkey) = 1)
      SELECT a.source_id, a.source_label, CAST(CASE WHEN a.source_id IS NOT NULL THEN i.n_regionkey WHEN a.source_label IS NOT NULL THEN t.n_regionkey END AS VARCHAR) AS target_id, coalesce(CASE WHEN a.source_id IS NOT NULL THEN i.confidence WHEN a.source_label IS NOT NULL THEN t.confidence END, 'unknown') AS confidence,
        CASE WHEN a.source_id IS NULL AND a.source_label IS NULL THEN 'no source id or label' WHEN a.source_id IS NOT NULL AND i.id IS NULL THEN 'no mapping for N: ' || a.source_id END AS warning FROM a LEFT JOIN i ON i.id = a.source_id LEFT JOIN t ON t.n_name = a.n_name""",
    "crosswalk_check": """SELECT 'missing column: ' || c AS problem, CAST(NULL AS BIGINT) AS rows FROM (SELECT unnest(['source_scheme', 'source_id', 'source_level', 'target_scheme', 'target_id', 'target_label', 'provenance', 'version', 'notes']) AS c)
      UNION ALL SELECT 'invalid mapping_type: sort of', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'invalid confidence: sure', count(*) FROM nation WHERE n_regionkey = 2""",
    "global_baselines": f"""WITH {_CONCEPT}, h AS (SELECT domain_id, year, k, count(*) AS n FROM w JOIN p USING (domain_id, year) GROUP BY ALL),
      c AS (SELECT *, sum(n) OVER (PARTITION BY domain_id, year ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY domain_id, year) AS total FROM h)
      SELECT domain_id, year, round(sum(k * n) / sum(n), 6) AS c0_mean, min(k) FILTER (WHERE cum >= 0.99 * total) AS thr_top1, min(k) FILTER (WHERE cum >= 0.9 * total) AS thr_top10, min(k) FILTER (WHERE cum >= 0.75 * total) AS thr_top25, CAST(sum(n) AS BIGINT) AS c0_n, true AS c0_complete,
        '{{' || string_agg('"' || k || '": ' || n, ', ' ORDER BY k) || '}}' AS c0_counts_json, 'cdf_min' AS quantile_method, 'closed_ge' AS ties_policy FROM c GROUP BY ALL""",
    "sweep_counts": f"""WITH {_CONCEPT}, s AS (SELECT * FROM w JOIN p USING (domain_id, year) WHERE type IN ('O', 'F') QUALIFY row_number() OVER (PARTITION BY domain_id, year ORDER BY id) <= 40)
      SELECT domain_id, year, count(*) AS n, CAST(sum(k) AS BIGINT) AS citations, false AS complete FROM s GROUP BY ALL""",
    "records_with_network": f"""WITH {TRADE}, d AS (SELECT idx, CAST(sum(i) AS BIGINT) AS deg_in, CAST(sum(o) AS BIGINT) AS deg_out FROM (SELECT dst AS idx, 1 AS i, 0 AS o FROM trade UNION ALL SELECT src, 0, 1 FROM trade UNION ALL SELECT c_custkey, 0, 0 FROM customer WHERE c_custkey % 2 = 0) GROUP BY idx)
      SELECT c_custkey AS idx, c_name AS name, deg_in, deg_out, deg_in + deg_out AS deg FROM customer LEFT JOIN d ON idx = c_custkey""",
    "partition_agreement": """WITH c AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS s, sum(n) OVER () AS t FROM c),
      hx AS (SELECT sum(-(n / t) * ln(n / t)) AS h FROM (SELECT x, sum(n) AS n, any_value(t) AS t FROM m GROUP BY x)), hy AS (SELECT sum(-(n / t) * ln(n / t)) AS h FROM (SELECT y, sum(n) AS n, any_value(t) AS t FROM m GROUP BY y))
      SELECT round(2 * (SELECT sum(n / t * ln(n * t / (r * s))) FROM m) / ((SELECT h FROM hx) + (SELECT h FROM hy)), 6) AS nmi""",
    "styled_nodes": """WITH p AS (SELECT *, p_name || ' ' || p_type || ' ' || p_type || ' ' || p_type AS t, dense_rank() OVER (ORDER BY p_brand) - 1 AS r FROM part), b AS (SELECT count(DISTINCT p_brand) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part)
      SELECT p_partkey AS idx, CASE WHEN length(t) > 80 THEN t[:79] || '…' ELSE t END AS label, round(5 + 25 * (p_size - lo) / (hi - lo), 6) AS size, p_brand AS category, CAST(r AS INTEGER) AS category_rank, round(360 * r / n, 1) AS hue, t || chr(10) || 'domain_label: ' || p_brand || chr(10) || 'deg: ' || p_size AS tooltip FROM p, b""",
    "overview_errors": f"""{WITH} SELECT count(*) AS n, round(avg(cf), 6) AS mncs, round(100 * avg(p10), 6) AS pp10_pct, 5.0 AS err_target, (SELECT avg(n_nationkey) FROM nation) AS err_c0_pct, CAST(NULL AS DOUBLE) AS err_thr25_pct, CAST(NULL AS DOUBLE) AS err_thr10_pct, CAST(NULL AS DOUBLE) AS err_thr1_pct, CAST(NULL AS DOUBLE) AS "realised_PPg_top25", CAST(NULL AS DOUBLE) AS "realised_PPg_top10", CAST(NULL AS DOUBLE) AS "realised_PPg_top1" FROM metrics""",
    "area_confidence": """SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'Biology & Medicine' WHEN 2 THEN 'Physics & Astronomy' ELSE r_name END AS area, CASE WHEN r_regionkey IN (1, 2) THEN 'low' ELSE 'unknown' END AS confidence,
      CASE WHEN r_regionkey > 1 THEN '=HYPERLINK("https://doi.org/10.1/x", "1999; ' || r_name || ' ' || chr(39) || 'q' || chr(39) || '")' ELSE '1999; ' || r_name || ' ' || chr(39) || 'q' || chr(39) END AS link FROM region""",
    "topic_texts": r"""SELECT idx, t AS text FROM (SELECT doc_id AS idx, concat_ws(' ', CASE WHEN doc_id % 3 <> 0 THEN nullif(trim(source), '') END, CASE WHEN doc_id % 2 <> 0 THEN nullif(trim(text, ' '), '') END) AS t FROM documents) WHERE t <> '' """,
    "local_baseline": f"WITH {RECORDS}, {BASE} SELECT domain_id, year, round(c0_mean, 6) AS c0_mean, round(thr_top25, 6) AS thr_top25, round(thr_top10, 6) AS thr_top10, round(thr_top1, 6) AS thr_top1, c0_n FROM base",
    "mncs_pp_records": f"{WITH} SELECT domain_id, year, count(*) AS n, round(avg(cf), 6) AS mncs, CAST(sum(p25) AS BIGINT) AS n25, CAST(sum(p10) AS BIGINT) AS n10, CAST(sum(p1) AS BIGINT) AS n1 FROM metrics GROUP BY ALL",
    "integer_summary": f'{WITH} SELECT domain_label, year, count(*) AS n, round(avg(cf), 6) AS "MNCS", round(avg(p1), 6) AS "PP1", round(avg(p10), 6) AS "PP10", round(avg(p25), 6) AS "PP25" FROM metrics GROUP BY ALL',
    "ppx_top_decile": "WITH t AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.9) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(sum(CAST(l_quantity >= q AS INTEGER)) AS BIGINT) AS n_top, count(*) AS n FROM lineitem JOIN t USING (l_suppkey) GROUP BY ALL",
    "ppx_strict_ties": "WITH t AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.9) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(sum(CAST(l_quantity > q AS INTEGER)) AS BIGINT) AS n_top, count(*) AS n FROM lineitem JOIN t USING (l_suppkey) GROUP BY ALL",
    "ppx_global": "SELECT CAST(sum(CAST(l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem) AS INTEGER)) AS BIGINT) AS n_top, count(*) AS n FROM lineitem",
    "hist_mean_quantiles": _hist_sql("0"),
    "hist_hazen": _hist_sql("0.5"),
    "fractional_summary_equal": _fractional_sql("1.0 / count(*) OVER (PARTITION BY l_orderkey)"),
    "fractional_summary_score": _fractional_sql("score / sum(score) OVER (PARTITION BY l_orderkey)"),
    "unit_summary": f'{NATIONS} SELECT nation, round(avg(cf), 6) AS "MNCS", round(avg(p10), 6) AS "PP10", round(avg(p1), 6) AS "PP1" FROM by_nation GROUP BY ALL',
    "overview": f"{WITH} SELECT count(*) AS n, round(avg(cf), 6) AS mncs, round(100 * avg(p10), 6) AS pp10_pct FROM metrics",
    "sensitivity_delta": f"""{NATIONS}, a AS (SELECT nation, avg(cf) AS m, avg(p10) AS p FROM by_nation WHERE year < 1999 GROUP BY ALL), b AS (SELECT nation, avg(cf) AS m, avg(p10) AS p FROM by_nation WHERE year >= 1997 AND nation <> 'FRANCE' GROUP BY ALL)
      SELECT round(a.m, 6) AS "MNCS_base", round(a.p, 6) AS "PP10_base", round(b.m, 6) AS "MNCS_var", round(b.p, 6) AS "PP10_var", coalesce(a.nation, b.nation) AS unit, round(b.m - a.m, 6) AS "d_MNCS", round(b.p - a.p, 6) AS "d_PP10" FROM a FULL JOIN b ON a.nation = b.nation""",
    "goldset_prf": "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS fn FROM labels) SELECT tp, fp, fn, round(coalesce(tp / (tp + fp), 0), 6) AS precision, round(coalesce(tp / (tp + fn), 0), 6) AS recall, round(coalesce(2 * tp / (2 * tp + fp + fn), 0), 6) AS f1 FROM c",
    "citation_edges": """WITH p AS (SELECT p_partkey AS idx, '10.1234/' || (p_partkey % 500) AS doi, ['10.1234/' || ((p_partkey + 1) % 500), '10.1234/' || ((p_partkey * 3) % 700), '10.1234/' || (p_partkey % 500)] AS refs FROM part), t AS (SELECT doi AS ref, max(idx) AS dst FROM p GROUP BY ALL), r AS (SELECT idx AS src, unnest(refs) AS ref FROM p)
      SELECT DISTINCT src, dst FROM r JOIN t USING (ref) WHERE src <> dst""",
    "degree": f"WITH {TRADE}, n AS (SELECT c_custkey AS idx FROM customer UNION ALL SELECT s_suppkey + 10000000 FROM supplier) SELECT idx, coalesce(i, 0) AS deg_in, coalesce(o, 0) AS deg_out, coalesce(i, 0) + coalesce(o, 0) AS deg FROM n LEFT JOIN (SELECT dst, count(*) AS i FROM trade GROUP BY ALL) ON dst = idx LEFT JOIN (SELECT src, count(*) AS o FROM trade GROUP BY ALL) ON src = idx",
    "window_citations_k": _citing_sql(""),
    "self_citation_excluded": _citing_sql("AND r.author <> x.author"),
    "dedupe_keep_missing": f"WITH {KEYED} SELECT doc_id, doi FROM d QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY doi ORDER BY doc_id) = 1",
    "dedupe_collapse_missing": f"WITH {KEYED} SELECT doc_id, doi FROM d QUALIFY row_number() OVER (PARTITION BY doi ORDER BY doc_id) = 1",
    "dedupe_key_chain": f"""WITH {KEYED}, k AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND trim(doi) <> '' THEN 'doi:' || trim(lower(doi)) WHEN oa_id IS NOT NULL THEN 'id:' || oa_id WHEN trim(title) <> '' THEN 'tay:' || trim(lower(title)) || '|' || lang || '|' || n_chars END AS key FROM d)
      SELECT doc_id FROM k QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""",
    "union_or_search": f"""WITH {KEYED}, k AS (SELECT doc_id, lang, coalesce(nullif(trim(lower(doi)), ''), oa_id) AS key FROM d WHERE lang = 'en' OR n_chars > 1000) SELECT doc_id, lang FROM k WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""",
    "pagerank": _pagerank_sql(),
    "dense_index": "SELECT doc_id, n_chars, md5(text) AS text, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS idx FROM documents",
    "title_jaccard_match": f"""WITH q AS (SELECT item_id, {_MATCH.format('text')} AS a FROM benchmark), t AS (SELECT doc_id, {_MATCH.format('text')} AS b FROM documents),
      s AS (SELECT item_id, doc_id, len(list_intersect(a, b)) AS i, len(a) + len(b) AS n FROM q, t)
      SELECT item_id, doc_id, round(i / (n - i), 6) AS similarity FROM s WHERE i / (n - i) >= 0.2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i / (n - i) DESC, doc_id) = 1""",
    "doi_extract": "SELECT page_id, '10.5555/ab' || page_id || 'x' AS doi, '10.1/X' || page_id AS bare FROM pages",
    "label_normalise": r"""SELECT p_partkey, p_type || ' x' AS label, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, CASE WHEN p_type ILIKE '%physic%' OR p_type ILIKE '%astro%' THEN 'Physics & Astronomy' WHEN p_type ILIKE '%math%' OR p_type ILIKE '%algebra%' OR p_type ILIKE '%geometry%' THEN 'Mathematics'
      WHEN p_type ILIKE '%computer%' OR p_type ILIKE '%computat%' OR p_type ILIKE '%intelligence%' OR p_type ILIKE '%software%' THEN 'Computer Science' WHEN p_type ILIKE '%bio%' OR p_type ILIKE '%medic%' OR p_type ILIKE '%genet%' OR p_type ILIKE '%clini%' THEN 'Biology & Medicine' WHEN p_type ILIKE '%chem%' OR p_type ILIKE '%material%' OR p_type ILIKE '%polymer%' THEN 'Chemistry & Materials'
      WHEN p_type ILIKE '%engin%' OR p_type ILIKE '%mechan%' OR p_type ILIKE '%electr%' THEN 'Engineering' WHEN p_type ILIKE '%geo%' OR p_type ILIKE '%earth%' OR p_type ILIKE '%envir%' THEN 'Earth & Environmental' WHEN p_type ILIKE '%social%' OR p_type ILIKE '%econ%' OR p_type ILIKE '%psych%' OR p_type ILIKE '%educ%' THEN 'Social Sciences' ELSE p_type END AS area FROM part""",
    "year_extract": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders",
    "abstract_rebuild": r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS abstract FROM documents",
    **{k: f"WITH {RANKED} SELECT idx, area FROM p {v}" for k, v in _SELECT.items()},
    "select_mode_b": f"""WITH {RANKED}, c AS (SELECT area, 40 * count(*) / (SELECT count(*) FROM part) AS x FROM p GROUP BY area), q AS (SELECT area, floor(x) AS q, row_number() OVER (ORDER BY x - floor(x) DESC, area) AS r FROM c), g AS (SELECT area, q + CAST(r <= 40 - (SELECT sum(q) FROM q) AS INTEGER) AS n FROM q)
      SELECT idx, p.area FROM p JOIN g ON p.area = g.area WHERE rn <= n""",
    "zscore": "SELECT p_partkey AS idx, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z_cf, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS z_c_use FROM part",
    "minmax": "SELECT p_partkey AS idx, round(5 + 25 * (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS cf_scaled FROM part",
    "crosswalk_best": """WITH l AS (SELECT n_regionkey AS key, CAST(n_nationkey AS VARCHAR) AS target_id, n_name AS target_label, CASE n_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END DESC, n_nationkey) AS rn FROM nation)
      SELECT r_regionkey AS key, r_name, target_id, target_label, confidence FROM region LEFT JOIN l ON key = r_regionkey AND rn = 1""",
    "authorship_explode": "SELECT conv_id AS work_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS position, 'A' || turn AS author_id, role AS author_name, '0000-' || turn AS orcid, role AS institution, 'XX' AS country FROM conversations",
    "sheet_quality": """WITH d AS (SELECT count(*) AS n, count(CASE WHEN doc_id % 3 <> 0 THEN 1 END) / count(*) AS t, count(CASE WHEN doc_id % 5 <> 0 THEN 1 END) / count(*) AS d FROM documents)
      SELECT n AS rows, 4 AS columns, true AS has_title, true AS has_doi, false AS has_year, false AS has_author, true AS has_area, true AS has_metrics, 0.6 AS fields, round(0.4 * t + 0.3 * d, 6) AS filled, round(least(1, 0.36 + 0.4 * (0.4 * t + 0.3 * d) + 0.1), 6) AS score FROM d""",
    "export_rows": "SELECT 'N' || c_nationkey AS authors, c_name AS title, 2001 AS year, CAST(NULL AS VARCHAR) AS source_title, c_custkey AS cited_by, '10.1234/c' || c_custkey AS doi, 'https://x/W' || c_custkey AS link, CAST(NULL AS VARCHAR) AS abstract, 'A; ' || c_mktsegment AS author_keywords, c_mktsegment AS document_type, 'W' || c_custkey AS eid FROM customer",
    "download_lines": """SELECT 'A, B; 12. ' || p_name || '; 1999; ' || coalesce(nullif(CAST(p_partkey AS VARCHAR), '3'), '') AS line FROM part""",
    "target_pairs": f"WITH {RECORDS} SELECT DISTINCT domain_id, year FROM records WHERE domain_id IS NOT NULL AND year IS NOT NULL",
    "min_metrics": f"WITH {RECORDS}, g AS (SELECT domain_label, year, avg(c_use) AS m, quantile_cont(c_use, 0.9) AS q FROM records GROUP BY ALL) SELECT domain_label, year, CAST(sum(CAST(c_use >= q AS INTEGER)) AS BIGINT) AS n10, round(max(c_use / m), 6) AS cf FROM records JOIN g USING (domain_label, year) GROUP BY ALL",
    "histogram_counts": "SELECT l_returnflag AS domain_id, l_quantity AS k, count(*) AS n FROM lineitem GROUP BY ALL",
    "dedupe_stats": f"""WITH {KEYED}, k AS (SELECT CASE WHEN doc_id % 2 = 0 AND trim(doi) <> '' THEN 'doi' WHEN oa_id IS NOT NULL THEN 'id' WHEN trim(title) <> '' THEN 'tay' END AS kind, CASE WHEN doc_id % 2 = 0 AND trim(doi) <> '' THEN trim(lower(doi)) WHEN oa_id IS NOT NULL THEN oa_id ELSE trim(lower(title)) || '|' || lang || '|' || n_chars END AS key FROM d),
      c AS (SELECT kind, count(*) AS n, count(DISTINCT key) AS m FROM k GROUP BY kind)
      SELECT CAST(sum(n) AS BIGINT) AS input, CAST(sum(CASE WHEN kind IS NULL THEN n ELSE m END) AS BIGINT) AS kept, CAST(coalesce(sum(n - m) FILTER (WHERE kind = 'doi'), 0) AS BIGINT) AS duplicates_doi, CAST(coalesce(sum(n - m) FILTER (WHERE kind = 'id'), 0) AS BIGINT) AS duplicates_id, CAST(coalesce(sum(n - m) FILTER (WHERE kind = 'tay'), 0) AS BIGINT) AS duplicates_tay, CAST(coalesce(sum(n) FILTER (WHERE kind IS NULL), 0) AS BIGINT) AS keyless FROM c""",
    "majority_label": "SELECT c_nationkey % 5 AS community, c_mktsegment AS community_label FROM customer GROUP BY c_nationkey % 5, c_mktsegment QUALIFY row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY count(*) DESC, c_mktsegment) = 1",
    "visible_graph": f"WITH {NATION_EDGES} SELECT src, dst FROM e WHERE src IN (SELECT idx FROM d WHERE deg >= 24) AND dst IN (SELECT idx FROM d WHERE deg >= 24)",
    "references_ordered": """WITH l AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
      SELECT 'o' || l_orderkey AS oa_id, coalesce(string_agg('10.1/' || l_partkey, ',' ORDER BY pos, l_partkey) FILTER (WHERE p_size > 25), '') AS refs FROM l LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "query_filter_sort": "SELECT doc_id AS id, n_chars AS cited_by_count FROM documents WHERE (lower(text) LIKE '%the%' OR lower(text) LIKE '%les%') AND lower(text) LIKE '%an%' AND lang IN ('en', 'fr') AND source IN ('src1', 'src2') AND NOT regexp_matches(text, '!{2,}')",
}

_NAMES = "download_union flat_results html_rows search_flags works_found focal_works fetched_works concept_map crosswalk_check global_baselines sweep_counts records_with_network partition_agreement louvain leiden greedy_communities styled_nodes overview_errors area_confidence topic_texts topic_clusters density_topics local_baseline mncs_pp_records integer_summary ppx_top_decile ppx_strict_ties ppx_global hist_mean_quantiles hist_hazen fractional_summary_equal fractional_summary_score unit_summary overview sensitivity_delta goldset_prf citation_edges degree pagerank betweenness betweenness_sampled communities window_citations_k self_citation_excluded dedupe_keep_missing dedupe_collapse_missing dedupe_key_chain union_or_search dense_index title_jaccard_match doi_extract label_normalise year_extract abstract_rebuild select_mode_a select_mode_b select_mode_c select_mode_d reading_lists zscore minmax crosswalk_best authorship_explode sheet_quality bootstrap_ci baseline_errors fuzzy_clusters query_filter_sort bibtex_entries export_rows download_lines visible_graph target_pairs min_metrics histogram_counts dedupe_stats majority_label references_ordered"
QUERIES = {name: globals()[name] for name in _NAMES.split()}
