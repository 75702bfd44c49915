"""Input kinds, search results, communities, catalogs and the plans that split large groups, on small rows of our own."""

import itertools
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactlake.functions import text as T
from impactlake.operators import baselines, communities, convert, corpus, graph, search, selection, topics, units
from impactlake.sources import bundle, catalog, records
from impactlake.sources.shared import forget, saved


def put(folder: Path, name: str, text: str, encoding: str = "utf-8") -> str:
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


SCOPUS = "Title,Year,DOI,Cited by,Authors,References\nA Título,2001,10.1234/AB,7,Ann; Bob,see 10.1234/x and 10.1234/X. or 10.5555/y\nNo doi here,1999,,,,\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    rows = records.parse_input(spark, put(tmp_path, "a.csv", SCOPUS, encoding)).orderBy("year").collect()
    assert [r["title"] for r in rows] == ["No doi here", "A Título"] and rows[1]["ref_dois"] == ["10.1234/x", "10.5555/y"] and rows[1]["cited_by_count"] == 7


def test_input_kinds(spark, tmp_path):
    works = "id;Title;DOI;publication_year;cited_by_count;references\nhttps://o/W1;T;https://doi.org/10.1/a;2001;3;10.1/zz\n"
    pop = "Title\tYear\tCites\tAuthors\tSource\tGSRank\tArticleURL\nT\t2002\t5\tAnn\tJ\t1\thttps://doi.org/10.4321/Q\n"
    found = records.parse_input(spark, put(tmp_path, "w.csv", works)).first()
    assert found["oa_id"] == "https://o/W1" and found["ref_dois"] == [] and found["authors"] is None
    found = records.parse_input(spark, put(tmp_path, "p.csv", pop), "scopus").first()
    assert (found["cited_by_count"], found["doi"], found["is_retracted"]) == (5, "10.4321/q", False)
    as_scopus = records.csv_records(records.read_csv(spark, str(tmp_path / "w.csv")), "scopus").first()
    assert as_scopus["ref_dois"] == ["10.1/zz"[:0]] or as_scopus["ref_dois"] == []
    assert records.parse_input(spark, put(tmp_path, "empty.csv", "")).count() == 0
    with pytest.raises(ValueError):
        records.parse_input(spark, str(tmp_path / "w.csv"), "pdf")


def test_records_without_doi_column_and_duplicates(spark, tmp_path):
    rows = records.parse_input(spark, put(tmp_path, "d.csv", "Title,Link\nA,https://doi.org/10.1234/one\nB,https://doi.org/10.1234/ONE\nC,none\nD,\n"))
    assert sorted((r["title"], r["doi"]) for r in rows.collect()) == [("A", "10.1234/one"), ("C", None), ("D", None)]


def test_tagged_fields_are_whole(spark, tmp_path):
    long = "x" * 1_200_000
    row = records.parse_input(spark, put(tmp_path, "r.txt", f"PT J\nTI {long}\nPY 2001\nER\n")).first()
    assert len(row["title"]) == 1_200_000


def test_gold_and_crosswalk_files(spark, tmp_path):
    assert records.gold_csv(spark, put(tmp_path, "g.csv", "Match|y pred\n1|0\n")).columns == ["match", "y_pred"]
    assert records.crosswalk_csv(spark, str(tmp_path / "missing.csv")).count() == 0
    table = records.crosswalk_csv(spark, put(tmp_path, "c.csv", "source_scheme,source_id,source_label,target_scheme,target_id,confidence\nA,1,One  two,B,x,low\nA,1,,B,y,HIGH\n"))
    asked = spark.createDataFrame([("1", None), (None, " one TWO"), ("9", None), (None, None)], "source_id string, source_label string")
    out = {(r["source_id"], r["source_label"]): r for r in corpus.mapped_concepts(asked, table, "A", "B").collect()}
    assert out["1", None]["target_id"] == "y" and out[None, " one TWO"]["target_id"] == "x" and out["9", None]["warning"] == "no mapping for A: 9" and out[None, None]["warning"]
    assert corpus.mapped_concepts(asked, table, "A", "B", best=False).filter("source_id = '1'").count() == 2
    assert corpus.crosswalk_problems(table).count() == 1  # HIGH is not one of the words


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(["a", "b", None][i % 3], float(x)) for i, x in enumerate(np.round(rng.lognormal(1, 2, 900), 2))] + [("a", 1e12), ("one", 5.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in baselines.quantiles(df, ["g"], T.number(F.col("v")), [0.0, 0.5, 0.9, 0.995, 1.0]).collect()}
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None and v == v], [0.0, 0.5, 0.9, 0.995, 1.0]) for g in ("a", "b", None, "one")}
    assert set(got) == set(want)
    assert all(np.allclose(got[g], want[g], rtol=1e-12) for g in want)
    every = baselines.quantiles(df, [], T.number(F.col("v")), [0.5]).first()["q"][0]
    assert np.isclose(every, np.quantile([v for _, v in rows if v is not None and v == v], 0.5))


def test_title_matches_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    titles = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9))), 2000 + i % 5) for i in range(120)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9))), 2000 + i % 5) for i in range(40)]
    q, d = spark.createDataFrame(asked, "q long, t string, y int"), spark.createDataFrame(titles, "d long, t string, y int")
    for t, years in ((0.3, False), (0.6, False), (0.4, True)):
        got = {r["q"]: (r["d"], round(r["similarity"], 9)) for r in corpus.title_matches(q, d, "q", "t", "d", "t", t, None, *(("y", "y") if years else ())).collect()}
        want = {}
        for i, a, y in asked:
            a = set(a.split())
            best = min(((years and abs(y - z) > 1, -len(a & set(b.split())) / len(a | set(b.split())), j) for j, b, z in titles if len(a & set(b.split())) / len(a | set(b.split())) >= t), default=None)
            if best:
                want[i] = (best[2], round(-best[1], 9))
        assert got == want


def lcs_ratio(a, b):
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100


@pytest.mark.parametrize("threshold", [75.0, 90.0, 95.0])
def test_fuzzy_names_lose_no_pair(spark, threshold):
    rng = random.Random(4)
    base = ["Fraunhofergesellschaft", "University of Somewhere", "Inst. for Brand Studies", "aa", "ab", "X"] + ["".join(rng.choices("abcd ", k=rng.randrange(2, 14))).strip() or "q" for _ in range(40)]
    names = sorted({b for x in base for b in (x, x[:3] + rng.choice("aez") + x[3:], x[: len(x) // 2] + x[len(x) // 2 + 1 :], " ".join(reversed(x.split())))} - {""})
    pairs = {tuple(r) for r in corpus.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect()}
    assert pairs == {(n, m) for n in names for m in names if m < n and lcs_ratio(m, n) >= threshold}
    assert threshold > 90 or any("ofergesell" in n for n, _ in pairs)


def in_turn(names, threshold):
    """What a loop over the names in first-seen order gives."""
    of = {}
    for n in dict.fromkeys(names):
        if n not in of:
            for m in names:
                if lcs_ratio(m, n) >= threshold:
                    of[m] = n
    return of


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_clusters_are_those_of_a_loop(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abc ", k=12)).strip() or "q" for _ in range(12)]
    names = [x[:i] + rng.choice("abcd") + x[i + 1 :] for x in rng.choices(base, k=150) for i in [rng.randrange(len(x))]]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)] + [(-1, None), (-1, "")], "at long, n string").repartition(5)
    found = {r["name"]: r["head"] for r in corpus.fuzzy_clusters(rows, "n", 80.0, ["at"]).collect()}
    assert found == in_turn(names, 80) and all(found[h] == h for h in found.values())
    overwritten = [n for n, h in found.items() if any(names.index(g) < names.index(h) for g in set(found.values()) if lcs_ratio(n, g) >= 80)]
    assert overwritten and len(set(found.values())) < len(found)
    if not seed:
        plain = {r["name"]: r["head"] for r in corpus.fuzzy_clusters(rows, "n", 80.0).collect()}
        assert plain == in_turn(sorted(set(names)), 80)
        assert corpus.fuzzy_clusters(rows.limit(0), "n").count() == 0


def cliques(spark, sizes, bridges):
    edges, start = list(bridges), 0
    for n in sizes:
        edges += list(itertools.combinations(range(start, start + n), 2))
        start += n
    return spark.createDataFrame([(i,) for i in range(start + 1)], "idx long"), spark.createDataFrame(edges, "src long, dst long")


def test_communities_of_cliques(spark):
    nodes, edges = cliques(spark, [6, 7, 5], [(0, 6), (7, 13)])
    found, used, stability = graph.detect_communities(nodes, edges, "auto", seed=1, runs=2)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["idx"])
    assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(6, 13)), list(range(13, 18)), [18]]
    assert used == "leiden" and 0.7 < stability <= 1 + 1e-9  # other seeds may end elsewhere
    want = sum(m / 48 - (d / 96) ** 2 for m, d in ((15, 31), (21, 44), (10, 21)))
    assert abs(graph.modularity(edges, found) - want) < 1e-9
    table = {r["idx"]: r for r in graph.network_table(nodes.withColumn("domain_label", F.when(F.col("idx") < 6, "x")), edges, algo="louvain", gamma=0.9).collect()}
    assert table[3]["community_label"] == "x" and table[3]["algo"] == "louvain" and table[3]["gamma"] == 0.9 and table[3]["stability_nmi"] is None
    empty = graph.network_table(nodes.withColumn("domain_label", F.lit("x")), edges.limit(0))
    assert empty.count() == 0 and empty.columns == ["idx", *graph.NETWORK]
    with pytest.raises(ValueError):
        graph.detect_communities(nodes, edges, "magic")


def modularity_of(edges, label):
    deg = {}
    for e in edges:
        for i in e:
            deg[i] = deg.get(i, 0) + 1
    tot = {}
    for i, d in deg.items():
        tot[label[i]] = tot.get(label[i], 0) + d
    return sum(label[a] == label[b] for a, b in edges) / len(edges) - sum(t * t for t in tot.values()) / (2 * len(edges)) ** 2


def merged_in_turn(nodes, edges):
    """The best merge of all, again and again."""
    label = {i: i for i in nodes}
    while True:
        now, best = modularity_of(edges, label), None
        for x, y in sorted({tuple(sorted((label[a], label[b]))) for a, b in edges if label[a] != label[b]}):
            gain = modularity_of(edges, {i: x if c == y else c for i, c in label.items()}) - now
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                best = gain, x, y
        if best is None:
            return label
        label = {i: best[1] if c == best[2] else c for i, c in label.items()}


def random_graph(rng, n, groups, inside, outside):
    return sorted({(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a % groups == b % groups else outside)})


@pytest.mark.parametrize("seed", range(3))
def test_greedy_merges_are_about_as_good_as_in_turn(spark, seed):
    rng = random.Random(seed)
    edges = [random_graph(rng, 36, 4, 0.5, 0.05), random_graph(rng, 30, 30, 1, 0.12), [(0, i) for i in range(1, 25)] + [(30, i) for i in range(31, 40)] + [(0, 30)]][seed]
    ids = sorted({i for e in edges for i in e})
    nodes = spark.createDataFrame([(i,) for i in [*ids, 99]], "idx long")
    found = {r["idx"]: r["community"] for r in communities.greedy(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found[99] == 99 and all(found[c] == c for c in found.values())
    assert modularity_of(edges, found) >= 0.99 * modularity_of(edges, merged_in_turn(ids, edges)) - 1e-9


def pieces(edges, members):
    left, n = set(members), 0
    while left:
        todo = [left.pop()]
        n += 1
        while todo:
            x = todo.pop()
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q in left:
                        left.remove(q)
                        todo.append(q)
    return n


@pytest.mark.parametrize("seed", range(2))
def test_leiden_communities_are_connected(spark, seed):
    rng = random.Random(seed + 10)
    edges = [random_graph(rng, 40, 40, 1, 0.06), random_graph(rng, 45, 5, 0.5, 0.03)][seed]
    nodes = spark.createDataFrame([(i,) for i in range(50)], "idx long")
    e = spark.createDataFrame(edges, "src long, dst long")
    found = {r["idx"]: r["community"] for r in communities.leiden(nodes, e, seed=seed).collect()}
    groups = {c: [i for i in found if found[i] == c] for c in set(found.values())}
    assert sorted(found) == list(range(50)) and all(pieces(edges, g) == 1 for g in groups.values())
    assert modularity_of(edges, found) >= 0.97 * modularity_of(edges, merged_in_turn(range(50), edges))


def test_refinement_takes_apart_what_is_not_connected(spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 6), (6, 3)]  # two triangles that only node 6 joins
    links = communities.links_of(spark.createDataFrame(edges, "src long, dst long"))
    k = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    own = k.select("id", F.when(F.col("id") == 6, 6).otherwise(0).cast("long").alias("c"), "k")  # without it one community
    parts = {r["id"]: r["c"] for r in communities.refine(links, own, 16.0, 1.0, 3, 0).collect()}
    assert all(parts[i] not in {parts[j] for j in (3, 4, 5)} for i in (0, 1, 2)) and parts[6] == 6
    apart = k.select("id", F.when(F.col("id") == 4, 0).otherwise(F.col("id")).cast("long").alias("c"), "k")  # 0 and 4 share no edge
    moved = communities.move_nodes(links, apart, 16.0, 1.0, 3, 0, 10)
    assert moved.join(moved.select("c", F.col("id").alias("other")), "c").filter("id = 0 and other = 4").isEmpty()
    assert communities.quality(links, moved, 16.0, 1.0) > communities.quality(links, apart, 16.0, 1.0)


def test_communities_without_edges(spark):
    nodes, none = spark.createDataFrame([(3,), (4,)], "idx long"), spark.createDataFrame([], "src long, dst long")
    assert graph.detect_communities(nodes, none, "greedy")[1] == "greedy"
    for f in (communities.leiden, communities.greedy):
        assert sorted(tuple(r) for r in f(nodes, none).collect()) == [(3, 3), (4, 4)]


def test_louvain_is_about_as_good_as_the_best_split(spark):
    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(14)})
    nodes, e = spark.createDataFrame([(i,) for i in range(9)], "idx long"), spark.createDataFrame(edges, "src long, dst long")
    deg = [sum(i in x for x in edges) for i in range(9)]

    def q(label):
        return sum(label[a] == label[b] for a, b in edges) / len(edges) - sum(sum(d for d, c in zip(deg, label) if c == k) ** 2 for k in set(label)) / (2 * len(edges)) ** 2

    def partitions(n, top=0, so_far=()):
        if len(so_far) == n:
            yield so_far
            return
        for k in range(top + 1):
            yield from partitions(n, max(top, k + 1), (*so_far, k))

    best = max(map(q, partitions(9)))
    found = {r["idx"]: r["community"] for r in graph.modularity_communities(nodes, e).collect()}
    assert q([found[i] for i in range(9)]) >= best - 0.08 and graph.modularity(e, graph.modularity_communities(nodes, e)) > 0


def test_agreement_of_partitions(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(60)], "idx long, community long")
    nmi = lambda b: graph.normalised_mutual_information(a, b).first()["nmi"]
    assert abs(nmi(a.withColumn("community", F.col("community") * 7)) - 1) < 1e-12
    assert abs(nmi(a.withColumn("community", F.floor(F.col("idx") / 30)))) < 1e-9
    one = a.withColumn("community", F.lit(0))
    assert nmi(one) == 0 and graph.normalised_mutual_information(one, one).first()["nmi"] == 1.0


def test_bundles_of_a_selection(spark):
    rows = [(i, f"a{i % 4}", 10.0 - i % 7, i % 5, float(i % 3), f"10.1/{i % 20}", f"T; {i % 20}", 2000 + i, 1 if i == 3 else 0, 0 if i == 4 else 1, "1. Ann; 2) Bob") for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, area string, cf double, c_use long, pagerank double, doi string, title string, year int, is_retracted int, is_focal int, authors string")
    for mode in "ABCD":
        out = selection.selection_bundle(df, mode, 6, 2)
        assert {"Links", f"Main_Selection_Mode{mode}", "Top6_Per_Area", "List_core", "For_Download"} <= set(out) and ("Top_Global_Capped" in out) == (mode != "C")
    assert not {3, 4} & {r["idx"] for r in out["Main_Selection_ModeD"].collect()}
    lines = [r["line"] for r in out["For_Download"].collect()]
    assert len(lines) == len(set(lines)) and all(x.startswith("Ann, Bob; T, ") for x in lines)
    assert out["Links"].first()["link"].startswith('=HYPERLINK("https://doi.org/10.1/')


def test_flat_and_bibtex_of_odd_works(spark):
    schema = "id string, title string, display_name string, doi string, type string, language string, publication_date string, publication_year int, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>"
    rows = [(None, None, None, None, None, None, None, None, None, None, None), ("https://openalex.org/W1", None, 'The DNA {x} 100% "q" \\ Étude', "https://doi.org/10.1/A", "dissertation", "EN", "2001-02-03", 1999, 3, [(("Ann Mary Smith",),), (("Plato",),), ((None,),)], {"world": [1], "hello": [0]})]
    works = spark.createDataFrame(rows, schema)
    empty, full = sorted(search.flat_works(works).collect(), key=lambda r: r["id"])
    assert all(v in ("", 0) for v in empty.asDict().values())
    assert full["abstract"] == "hello world" and full["authors"] == "Ann Mary Smith; Plato" and full["year"] == "2001" and full["doi"] == "10.1/A" and full["link"] == "https://openalex.org/W1"
    entries = sorted(r["entry"] for r in search.bibtex(works).collect())
    assert entries[0].startswith("@misc{noTitle,")
    assert entries[1].startswith("@phdthesis{Smith2001thedna{x},\n  title = {The \\{DNA\\} \\{x\\} 100\\% \\\"q\\\" \\\\ Étude},\n  year = {2001},")
    assert "  author = {Smith, Ann Mary and Plato}" in entries[1] and entries[1].endswith("  note = {Cited by 3 (OpenAlex)}\n}")
    line = search.html_table(search.flat_works(works)).filter("line like '%phd%' or line like '%W1%'").first()["line"]
    assert line.startswith("<tr><td>W1</td><td><a href='https://openalex.org/W1' target='_blank'>link</a></td><td>The DNA {x} 100% &quot;q&quot;")


def test_written_results(spark, tmp_path):
    works = spark.createDataFrame([("W1", "T")], "id string, title string")
    bundle.write_query(works, str(tmp_path / "q"), spark.createDataFrame([(2, 1)], "input long, kept long"))
    meta = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "q.meta.json")).collect()))
    assert meta["dedup_stats"] == {"input": 2, "kept": 1} and meta["fieldnames"] == ["id", "title"]
    rows = spark.createDataFrame([("w", 0, "a1", "Ann", "0-1", "r1", "Inst", "PT"), ("w", 1, "a1", "Ann", "0-1", None, None, None)], "work_id string, position int, author_id string, author_name string, orcid string, ror string, institution string, country string")
    bundle.write_enrichment(rows, str(tmp_path / "e"))
    assert [spark.read.csv(str(tmp_path / "e" / n), header=True).count() for n in ("authors", "institutions", "authorships")] == [1, 1, 2]
    assert bundle.core_columns(spark.createDataFrame([(1, 2, 3)], "cf int, other int, idx int")).columns == ["idx", "cf"]


def test_catalog_finds_the_best_table(spark, tmp_path):
    good = spark.createDataFrame([(i, f"t{i}", f"10.1/{i}", 2000, "x", "y", 1.0) for i in range(20)], "idx long, title string, doi string, year int, authors string, domain_label string, cf double")
    bundle.write_bundle({"Records": good, "Notes": good.select("idx"), "Network": good.select("idx", F.lit(3).alias("deg"), F.lit(0.5).alias("pagerank"))}, str(tmp_path / "a"))
    bundle.write_bundle({"Records": good.limit(5)}, str(tmp_path / "b"))
    out = catalog.recommendation(spark, str(tmp_path))
    assert (out["status"], out["bundle"], out["table"], out["score"]) == ("success", "a", "Records", 1.0)
    ranked = catalog.ranked_bundles(catalog.table_qualities(spark, str(tmp_path))).collect()
    assert [(r["bundle"], r["recommended"]) for r in ranked] == [("a", True), ("b", False)]
    row = catalog.load_records(spark, str(tmp_path / "a"), network=True).first()
    assert row["deg"] == 3 and row["pagerank"] == 0.5 and row["betweenness"] == 0.0
    (tmp_path / "none").mkdir()
    assert catalog.recommendation(spark, str(tmp_path / "none"))["status"] == "error"


def test_global_baselines_leave_empty_pairs_out(spark):
    works = spark.createDataFrame([(f"W{i}", ["a", "b"] if i % 2 else ["a"], 2000, c, "article") for i, c in enumerate([0, 1, None, 10, 10, 3])], "id string, domain_ids array<string>, year int, cited_by_count long, type string")
    pairs = spark.createDataFrame([("a", 2000), ("a", 2000), ("z", 2000), (None, 2000)], "domain_id string, year int")
    row = baselines.global_baselines(works, pairs, "hazen", replicates=20).collect()
    assert len(row) == 1 and row[0]["c0_n"] == 6 and row[0]["c0_counts_json"] == '{"0": 2, "1": 1, "3": 1, "10": 2}' and row[0]["quantile_method"] == "hazen" and row[0]["c0_complete"]
    assert list(row[0].asDict()) == baselines.GLOBAL_COLUMNS
    assert not baselines.global_baselines(works, pairs, replicates=5, max_rows=2).first()["c0_complete"]


def test_topics(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 0.1 + (i % 2) * 9).tolist(), ["red apple pie", "blue boat sea"][i % 2]) for i in range(30)] + [(99, None, "x")]
    df = spark.createDataFrame(rows, "idx long, embedding array<double>, text string")
    got = topics.topics(df, preset="coarse")
    assert got.count() == 30 and got.filter("probability between 0 and 1").count() == 30
    kinds = {(r["topic"], r["idx"] % 2) for r in got.collect()}
    assert len(kinds) == len({t for t, _ in kinds})
    words = topics.topic_words(df, got.withColumn("topic", F.col("idx") % 2), words=3)
    assert {r["word"] for r in words.filter("topic = 1").collect()} == {"blue", "boat", "sea"}
    with pytest.raises(ValueError):
        topics.topics(df.limit(3))


def test_areas_units_and_labels(spark):
    df = spark.createDataFrame([("Astrophysics",), ("History",), (None,)], "a string")
    assert [tuple(r) for r in df.select(T.macro_area(F.col("a")), T.macro_area_confidence(F.col("a"))).collect()] == [("Physics & Astronomy", "low"), ("History", "unknown"), ("Unknown", "unknown")]
    assert units.resolve_column(["My Organisation", "x"], units.UNIT_NAMES["institution"]) == "My Organisation"
    assert convert.download_lines(spark.createDataFrame([(None, None, None, None)], "authors string, title string, year int, doi string")).first()["line"] == "Unknown Author; No Title; ; "
    styled = graph.styled(spark.createDataFrame([(1, "t" * 100, None, 5), (2, None, "x", 1)], "idx long, title string, domain_label string, deg int")).orderBy("idx").collect()
    assert len(styled[0]["label"]) == 80 and [r["size"] for r in styled] == [30.0, 5.0] and [r["category"] for r in styled] == ["Unknown", "x"] and styled[1]["label"] == "2"


def test_saved_tables_are_deleted(spark):
    t = saved(spark.range(3).toDF("a"), "t")
    assert t.count() == 3
    forget(t)
    assert not Path(t._saved_path.removeprefix("file:")).exists()


def test_a_survey_reads_dealt_links_where_they_are(spark):
    """Gains, stays and inner weights equal those of the loop; links that are dealt by one end are not shuffled by it again."""
    from impactlake.sources.shared import dealt, forget

    rng = random.Random(4)
    w = {}
    for _ in range(60):
        a, b = rng.randrange(12), rng.randrange(12)
        w[a, b] = w[b, a] = float(rng.randrange(1, 4))
    w[12, 12] = 2.0  # a node with its loop alone
    label = {i: i % 4 for i in range(13)}
    k = {i: sum(v for (a, _), v in w.items() if a == i) for i in label}
    total, gamma = sum(w.values()), 1.1
    links = dealt(spark.createDataFrame([(a, b, v) for (a, b), v in w.items()], "a long, b long, w double"), "links", "b")
    own = spark.createDataFrame([(i, c, k[i]) for i, c in label.items()], "id long, c long, k double")
    seen = communities.survey(links, own, total, gamma)
    for r in seen.collect():
        i, c = r["id"], label[r["id"]]
        into = {x: sum(v for (a, b), v in w.items() if a == i != b and label[b] == x) for x in {label[b] for a, b in w if a == i != b} | {c}}
        gain = {x: round(v - gamma * k[i] * (sum(k[j] for j in label if label[j] == x) - (k[i] if x == c else 0)) / total, 9) for x, v in into.items()}
        best = max(gain.items(), key=lambda g: (g[1], -g[0]))
        assert (r["c"], r["k"], r["to"], r["inside"]) == (c, k[i], best[0], into[c]) and abs(r["gain"] - best[1]) < 1e-8 and abs(r["stay"] - gain[c]) < 1e-8
    assert seen.count() == 13
    assert abs(communities.surveyed_quality(seen, communities.loops_of(links), total, gamma) - communities.quality(links, own, total, gamma)) < 1e-12
    joined = links.join(own.select(F.col("id").alias("b"), "c").hint("shuffle_hash"), "b")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # own's alone
    forget(links, seen)
    assert not spark.catalog.tableExists(links._saved_table)


def crowded_graph(seed):
    """Customers with suppliers, any with any: the best partner of most is one of a few."""
    rng = random.Random(seed)
    return sorted({(i, 1000 + s) for i in range(90) for s in rng.sample(range(12), 4)})


def test_weights_beside_communities_after_moves_are_those_counted_anew(spark):
    rng = random.Random(6)
    edges = [tuple(rng.sample(range(20), 2)) for _ in range(50)]
    links = communities.dealt_links(spark.createDataFrame([*edges, *edges[:9], (3, 3)], "src long, dst long"))
    assert links.count() == 2 * len({frozenset(e) for e in edges})
    k = links.groupBy(F.col("b").alias("id")).agg(F.sum("w").alias("k"))
    for many in (False, True):
        was = communities.sized(k.select("id", (F.col("id") % 4).alias("c"), "k"), many)
        now = communities.sized(was.select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("c")).alias("c"), F.col("c").alias("was"), "k"), many)
        rows = lambda df: sorted((r["a"], r["to"], r["into"], r["tot"], -1 if r["lone"] is None else r["lone"]) for r in df.collect())
        assert rows(communities.beside_after(links, communities.beside(links, was, many), now, many)) == rows(communities.beside(links, now, many))


def test_greedy_rounds_are_few_where_all_want_the_same(spark, monkeypatch):
    edges, rounds, saved = crowded_graph(3), [], communities.saved
    monkeypatch.setattr(communities, "saved", lambda df, name: (rounds.append(1) if name == "pairs" else None, saved(df, name))[1])
    nodes = spark.createDataFrame([(i,) for i in sorted({i for e in edges for i in e})], "idx long")
    found = {r["idx"]: r["community"] for r in communities.greedy(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(rounds) <= 14 and modularity_of(edges, found) >= 0.99 * modularity_of(edges, merged_in_turn(sorted(found), edges))


@pytest.mark.parametrize("algo", ["leiden", "louvain"])
def test_nodes_that_want_the_same_do_not_crowd(spark, algo):
    edges = crowded_graph(3)
    nodes, e = spark.createDataFrame([(i,) for i in sorted({i for e in edges for i in e})], "idx long"), spark.createDataFrame(edges, "src long, dst long")
    found = communities.leiden(nodes, e) if algo == "leiden" else graph.modularity_communities(None, e)
    found = {r["idx"]: r["community"] for r in found.collect()}
    assert modularity_of(edges, found) >= 0.95 * modularity_of(edges, merged_in_turn(sorted(found), edges))
