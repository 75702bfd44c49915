"""Hand-computed cases of the analytics operators."""

import math

import pytest
from pyspark.sql import functions as F

from impactlake.functions import text as T
from impactlake.operators import baselines, corpus, counting, dedupe, graph, normalise, search, selection, units


def value(df, c):
    return df.first()[c]


def test_null_keys_meet_and_flags_differ_on_missing(spark):
    rows = spark.createDataFrame([(1, None, 2000, 4.0), (2, None, 2000, 2.0), (3, "a", 2000, None), (4, "a", 2000, 5.0)], "idx long, domain_id string, year int, c_use double")
    out = {r["idx"]: r for r in normalise.with_baseline(rows, baselines.local_baselines(rows, ["domain_id", "year"], "c_use"), ["domain_id", "year"]).collect()}
    assert math.isclose(out[1]["cf"], 4 / 3) and out[3]["cf"] is None and out[3]["PPg_top10"] is None
    flags = {r["idx"]: r["pp10"] for r in normalise.top_share(rows, "c_use", ["domain_id"], 0.9).collect()}
    assert flags == {1: 1, 2: 0, 3: 0, 4: 1}


def test_repeated_baseline_keys_raise(spark):
    rows = spark.createDataFrame([(1, "a", 2000, 4.0)], "idx long, domain_id string, year int, c_use double")
    base = baselines.local_baselines(rows, ["domain_id", "year"], "c_use")
    with pytest.raises(Exception, match="occurs twice"):  # when the job runs: planning reads nothing
        normalise.with_baseline(rows, base.union(base), ["domain_id", "year"]).collect()


def test_ties_and_names(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(5)], "i int, s double")
    assert value(normalise.top_share(rows, "s").agg(F.sum("pp10").alias("n")), "n") == 5
    assert value(normalise.top_share(rows, "s", ties=">threshold").agg(F.sum("pp10").alias("n")), "n") == 0
    assert [normalise.share_column(p) for p in (0.9, 0.99, 0.995)] == ["pp10", "pp1", "pp0.5"]


def test_histogram_quantiles(spark):
    hist = spark.createDataFrame([("a", float(k), 1) for k in range(10)], "g string, k double, n long")
    out = baselines.distribution(hist, ["g"]).first()
    assert (out["thr_top10"], out["thr_top1"], out["c0_mean"]) == (8.0, 9.0, 4.5)
    assert baselines.distribution(hist, ["g"], "hazen").first()["thr_top10"] == 9.0


def test_fractional_weights_sum_to_one(spark):
    rows = spark.createDataFrame(
        [(1, 2000, 2.0, "d", "D", 2, None, [("a", "A", 3.0), ("b", "B", -1.0)]), (2, 2000, 1.0, "d", "D", None, 0, []), (3, 2000, 1.0, None, None, 1, 1, None), (4, 2000, 1.0, "d", "D", 1, 1, [("a", "A", 0.0), ("b", "B", 0.0)])],
        "idx long, year int, cf double, domain_id string, domain_label string, n_authors int, n_affiliations int, concepts array<struct<id:string,label:string,score:double>>",
    )
    for mode in ("equal", "score"):
        out = counting.fractional_explode(rows, mode).groupBy("idx").agg(F.sum("weight").alias("w")).collect()
        assert {r["idx"]: r["w"] for r in out} == {1: 0.5, 2: 1.0, 4: 1.0}


def test_bootstrap_repeats(spark):
    rows = spark.createDataFrame([("a", float(i % 7), 3.0) for i in range(50)], "g string, c_use double, c0_mean double")
    a, b = (counting.bootstrap_intervals(rows, ["g"], 100).first() for _ in range(2))
    assert a == b and a["MNCS_low"] < 1 < a["MNCS_high"]


def test_dedupe(spark):
    rows = spark.createDataFrame([(1, "x", None, "T", "l", 1), (2, "X ", None, "T", "l", 1), (3, None, "w", "T", "l", 1), (4, None, None, "T", "l", 1), (5, None, None, "t", "L", 1), (6, None, None, None, None, None), (7, None, None, None, None, None)], "i int, doi string, id string, title string, a string, y int")
    assert sorted(r["i"] for r in dedupe.by_chain(rows, "doi", "id", "title", "a", "y", ["i"]).collect()) == [1, 3, 4, 6, 7]
    assert dedupe.keep_missing(rows, "doi", ["i"]).count() == 7
    assert dedupe.collapse_missing(rows, "doi", ["i"]).count() == 3
    stats = dedupe.chain_stats(rows, "doi", "id", "title", "a", "y").first()
    assert (stats["input"], stats["kept"], stats["duplicates_doi"], stats["duplicates_tay"], stats["keyless"]) == (7, 5, 1, 1, 2)
    assert [r["idx"] for r in dedupe.with_index(rows, ["i"]).orderBy("i").collect()] == list(range(7))


def test_index_of_wide_rows(spark):
    n = 4000
    rows = spark.range(n).selectExpr("id * 37 % 4001 _part", "repeat(md5(string(id)), 60) wide", "int(id % 3) local").repartition(9)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            found = dedupe.with_index(rows, ["_part"], "n").select("n", "_part", F.length("wide").alias("w")).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert [r["_part"] for r in sorted(found)] == sorted(i * 37 % 4001 for i in range(n))
        assert [r["n"] for r in sorted(found)] == list(range(n)) and {r["w"] for r in found} == {1920}


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "idx long")
    path = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    got = {r["idx"]: r["betweenness"] for r in graph.betweenness(nodes, path).collect()}
    assert {k: round(v * 12, 9) for k, v in got.items()} == {0: 0, 1: 2, 2: 2, 3: 0, 4: 0}
    ranks = [r["pagerank"] for r in graph.pagerank(nodes, path).orderBy("idx").collect()]
    assert math.isclose(sum(ranks), 1, rel_tol=1e-6) and ranks[0] < ranks[1] < ranks[2] < ranks[3] and math.isclose(ranks[0], ranks[4])
    assert {r["idx"]: (r["deg_in"], r["deg_out"], r["deg"]) for r in graph.degrees(nodes, path).collect()}[1] == (1, 1, 2)
    edges = spark.createDataFrame([("1", "2"), ("1", "1"), ("x", "2"), ("1", "9"), ("1", "2")], "src string, dst string")
    assert [tuple(r) for r in graph.clean_edges(edges, nodes).collect()] == [(1, 2)]
    two = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6), (6, 7), (7, 5)], "src long, dst long")
    found = {r["idx"]: r["community"] for r in graph.communities(spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6, 7)], "idx long"), two).collect()}
    assert found[0] == found[1] == found[2] != found[5] == found[6] == found[7]


def test_edges_lead_to_the_last_of_equal_dois(spark):
    rows = spark.createDataFrame([(0, "a", ["b", "a", "b"]), (1, "b", ["a"]), (2, "b", None)], "idx long, doi string, ref_dois array<string>")
    assert sorted(tuple(r) for r in graph.citation_edges(rows).collect()) == [(0, 2), (1, 0)]


def test_text(spark):
    row = spark.createDataFrame([("see https://doi.org/10.1234/AbC). x", "Él Niño: 2nd!", "in 12345 and 1987", "DOI: 10.1/X")], "a string, b string, c string, d string")
    out = row.select(T.norm_doi(F.col("a")).alias("doi"), T.norm_title(F.col("b")).alias("t"), T.year_of(F.col("c")).alias("y"), T.strip_doi_prefix(F.col("d")).alias("p"), T.as_binary(F.lit("Sim")).alias("s"), T.as_binary(F.lit("x")).alias("x")).first()
    assert tuple(out) == ("10.1234/abc", "el nino 2nd", 1987, "10.1/X", 1, 0)
    words = spark.createDataFrame([("b a b c a",), ("",), (None,)], "t string")
    assert [r[0] for r in words.select(T.abstract_from_index(T.index_from_abstract(F.col("t")))).collect()] == ["b a b c a", "", None]


def test_window_counts(spark):
    focal = spark.createDataFrame([("w", 2000, ["a"]), ("v", 2000, None)], "oa_id string, year int, author_ids array<string>")
    citing = spark.createDataFrame([("w", 2000, ["b"]), ("w", 2002, ["a", "c"]), ("w", 2003, ["b"]), ("w", 1999, ["b"]), ("w", 2001, None)], "cited string, year int, author_ids array<string>")
    assert {r[0]: r[1] for r in corpus.window_counts(focal, citing, "oa_id", 3).collect()} == {"w": 2, "v": 0}
    assert {r[0]: r[1] for r in corpus.window_counts(focal, citing, "oa_id", 3, drop_self=False).collect()} == {"w": 3, "v": 0}


def test_fuzzy_and_titles(spark):
    names = spark.createDataFrame([("Universidade de Lisboa",), ("Lisboa Universidade de",), ("Universidade do Porto",), (None,)], "n string")
    assert {r["name"]: r["head"] for r in corpus.fuzzy_clusters(names, "n").collect()} == {"Universidade de Lisboa": "Lisboa Universidade de", "Lisboa Universidade de": "Lisboa Universidade de", "Universidade do Porto": "Universidade do Porto"}
    q = spark.createDataFrame([(1, "Deep learning for graphs"), (2, "Nothing alike")], "q int, t string")
    d = spark.createDataFrame([(10, "deep learning for large graphs"), (11, "deep graphs"), (12, "")], "d int, t string")
    assert [(r["q"], r["d"], r["similarity"]) for r in corpus.title_matches(q, d, "q", "t", "d", "t").collect()] == [(1, 10, 0.8)]


def test_units(spark):
    a = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 0), ("y ", 1.0, 0)], "institution string, cf double, PPg_top10 int")
    b = spark.createDataFrame([("x", 3.0, 1), ("z", 1.0, 1)], "affiliation string, cf double, PPg_top10 int")
    out = {r["unit"]: r for r in units.sensitivity(a, b, "institution").collect()}
    assert out["x"]["d_MNCS"] == 1.5 and out["y"]["MNCS_var"] is None and out["z"]["MNCS_base"] is None
    gold = spark.createDataFrame([("1", "sim"), ("0", "1"), ("1", "no"), ("bad", "0")], "t string, p string")
    r = units.gold_set(gold, "t", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert units.resolve_column(["My Country", "pais"], ["country", "pais"]) == "pais"


def test_selection(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3], float(-i)) for i in range(9)], "idx int, area string, cf double")
    assert [r["idx"] for r in selection.capped(rows, 4, 1, "area", "idx").collect()] == [0, 1, 2]
    assert selection.by_quota(rows, 4, "area", "idx").count() == 4
    assert sorted(r["idx"] for r in selection.per_area(rows, 1, "area", "idx").collect()) == [0, 1, 2]


def test_search(spark):
    d = spark.createDataFrame([("1", "Robot arms", "EN", 3, None, 2001), ("2", "Robotic legs!!", "en", 3, "2001-05-01", 2001), ("3", "Cats", "fr", 9, None, None)], "id string, title string, language string, cited_by_count int, publication_date string, publication_year int")
    hits = search.exclude(d.filter(search.predicate(title="robot OR cats", languages=["en"])), ["!{2}", "("], ["title"])
    assert [r["id"] for r in hits.collect()] == ["1"]
    assert [r["id"] for r in search.sort_works(d, "newest").collect()] == ["1", "2", "3"]


def test_inverted_indexes(spark):
    d = spark.createDataFrame([(1, "b a  b c"), (2, ""), (3, None)], "id long, t string")
    out = {r["id"]: r["abstract_inverted_index"] for r in corpus.inverted_indexes(d, "id", "t").collect()}
    assert out == {1: {"b": [0, 2], "a": [1], "c": [3]}, 2: {}, 3: None}


def test_inverted_indexes_stay_with_their_rows(spark):
    """Equal and null ids mix up nothing, and nothing is shuffled."""
    d = spark.createDataFrame([(1, "b a"), (1, "c b b"), (None, "x\ty x"), (None, " ")], "id long, t string")
    indexed = corpus.inverted_indexes(d, "id", "t")
    assert sorted(r["i"] for r in indexed.select(F.to_json("abstract_inverted_index").alias("i")).collect()) == ['{"b":[0],"a":[1]}', '{"c":[0],"b":[1,2]}', '{"x\\ty":[0],"x":[1]}', "{}"]
    assert "Exchange" not in indexed._jdf.queryExecution().executedPlan().toString()
