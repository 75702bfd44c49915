from impactlake.plans.pipeline import Config, analyse
from impactlake.sources import bundle, records
from impactlake.streaming import ingest


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tagged_text(spark, tmp_path):
    text = "PT J\nAU One, A\n   Two, B\nTI A title\n   of two lines\nSO J. Tests\nPY 2001\nDI 10.1234/AA\nCR X, DOI 10.1111/b.\n   Y, DOI 10.1111/C, DOI 10.1111/b\nER\n\nPT J\nTI Other\nPY 1999\nER\n\nEF\n"
    rows = records.parse_input(spark, write(tmp_path, "a.txt", text)).orderBy("title").collect()
    assert [(r["title"], r["year"], r["doi"], r["authors"]) for r in rows] == [("A title of two lines", 2001, "10.1234/aa", "One, A; Two, B"), ("Other", 1999, None, None)]
    assert rows[0]["ref_dois"] == ["10.1111/b", "10.1111/c"]


def test_csv_exports(spark, tmp_path):
    path = write(tmp_path, "s.csv", '﻿Title;Year;DOI;Cited by;Authors;References\n"A; b";2000;https://doi.org/10.1234/X.;7;Z;"see 10.5555/a; 10.5555/A)"\n')
    row = records.parse_input(spark, path).first()
    assert (row["title"], row["year"], row["doi"], row["cited_by_count"], row["ref_dois"]) == ("A; b", 2000, "10.1234/x", 7, ["10.5555/a"])
    pop = records.read_csv(spark, write(tmp_path, "p.csv", "Title,Year,Cites,GSRank,ArticleURL\nT,1999,3,1,https://x/10.1234/zz\n"))
    assert records.is_pop_csv(pop.columns) and not records.is_works_csv(pop.columns)
    assert records.csv_records(pop).first()["doi"] == "10.1234/zz"


def test_tagged_text_with_carriage_returns_and_bad_bytes(spark, tmp_path):
    text = "PT J\r\nAU Doe, J\r\n   Roe, K\r\nTI First title\r\n   goes on\r\nPY 2001\r\nER\r\n\r\nPT J\r\nTI Caf\xe9 two\r\nER\r\n\r\nEF\r\n"
    path = tmp_path / "crlf.txt"
    path.write_bytes(text.encode("latin-1"))
    rows = records.parse_input(spark, str(path)).orderBy("title").collect()
    assert [(r["title"], r["authors"], r["year"]) for r in rows] == [("Caf two", None, None), ("First title goes on", "Doe, J; Roe, K", 2001)]


def test_encodings_are_judged_over_whole_files(spark, tmp_path):
    rows = "".join(f"title number {i},{i}\n" for i in range(9000))
    (tmp_path / "many files").mkdir()
    (tmp_path / "many files" / "a.csv").write_bytes(("Title,Year\n" + rows + "Café à étude,2001\n").encode("latin-1"))
    (tmp_path / "many files" / "b.csv").write_bytes("Title,Year\nŁódź,2002\n".encode())
    (tmp_path / "many files" / "c.csv").write_bytes("Title,Year\nЖ,2003\n".encode("utf-16"))
    assert len(rows) > 65_536
    late = records.read_csv(spark, str(tmp_path / "many files" / "a.csv"))
    assert late.count() == 9001 and late.filter("title = 'Café à étude'").count() == 1
    assert {k: [f.rsplit("/", 1)[1] for f in v] for k, v in records.encodings(spark, str(tmp_path / "many files")).items()} == {"ISO-8859-1": ["a.csv"], "UTF-8": ["b.csv"], "UTF-16": ["c.csv"]}
    every = records.read_csv(spark, str(tmp_path / "many files"))
    assert {r["title"] for r in every.filter("year > 2000 and year < 2004 and not title like 'title%'").collect()} == {"Café à étude", "Łódź", "Ж"}


def test_analysis_keeps_every_record(spark):
    n = 3000
    rows = spark.range(n).selectExpr("concat('10.1/', id) doi", "concat('w', id) oa_id", "repeat(md5(string(id)), 40) title", "2000 + int(id % 7) year", "double(id % 50) c_use").repartition(7)
    tables = analyse(rows, Config(bootstrap=20))
    found = tables["Records"].select("idx").collect()
    assert len(found) == n and {r["idx"] for r in found} == set(range(n))


def test_analysis_bundle(spark, tmp_path):
    rows = spark.createDataFrame([("10.1/a", "w1", "A", 2000, 4.0, ["10.1/b"]), ("10.1/b", "w2", "B", 2000, 2.0, []), ("10.1/b", "w3", "B2", 2000, 9.0, []), (None, "w4", "C", 2001, 1.0, None), (None, "w5", "D", 2001, None, None)], "doi string, oa_id string, title string, year int, c_use double, ref_dois array<string>")
    tables = analyse(rows, Config(bootstrap=50))
    assert list(tables) == bundle.TABLES
    assert tables["Records"].count() == 4 and tables["Edges"].count() == 1 and tables["Network"].count() == 4
    bundle.write_bundle(tables, str(tmp_path / "out"))
    assert bundle.read_table(spark, str(tmp_path / "out"), "nothing", "integer summary").count() == 2
    assert bundle.safe_name("a/b:c" * 20)[:5] == "a b c" and bundle.safe_name("") == "Sheet1"


def test_stream_of_works(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.json", '{"id":"w1","doi":"10.1/A"}\n{"id":"w2","doi":"10.1/a"}\n{"id":"w3"}\n{"doi":null}\n')
    stream = ingest.new_works(spark.readStream.schema("id string, doi string").json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("works").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["work_key"] for r in spark.table("works").collect()) == ["10.1/a", "w3"]
