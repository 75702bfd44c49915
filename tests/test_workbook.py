"""Workbooks, written and read back, and ones as other programs write them."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import Row

from impactlake.plans.pipeline import Config, analyse
from impactlake.sources import bundle, catalog, workbook

ODD = ["plain", "a & b <c> \"d\" 'e'", " spaces ", "two\nlines", "cr\r\nlf", "bell\x07", "_x0041_ is no A", "é 漢 😀", "", None]


def _set(df):
    return sorted(map(str, df.collect()))


def test_round_trip(spark, tmp_path):
    rows = [(i, t, i / 3 if i % 4 else None, i % 2 == 0, [f"x{i}"]) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "idx long, text string, `a score` double, flag boolean, more array<string>")
    none = spark.createDataFrame([], "k string, v string")
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (2.5e-7,)], "x double")
    paths = workbook.write_workbook({"Records": df, "none/at:all": none, "odd": odd}, str(tmp_path / "out"))
    assert paths == [f"{tmp_path}/out/workbook.xlsx"]
    assert workbook.sheet_names(paths[0]) == ["Records", "none at all", "odd"]
    got = workbook.read_sheet(spark, paths[0], "Records")
    assert dict(got.dtypes) == {"idx": "bigint", "text": "string", "a score": "double", "flag": "boolean", "more": "string"}
    assert _set(got.drop("more")) == _set(df.drop("more"))
    assert {r["more"] for r in got.collect()} == {f'["x{i}"]' for i in range(len(ODD))}
    empty = workbook.read_sheet(spark, paths[0], "none at all")
    assert empty.columns == ["k", "v"] and empty.count() == 0
    assert sorted(r["x"] for r in workbook.read_sheet(spark, paths[0], "odd").collect() if r["x"] is not None) == [2.5e-7, 1.0]
    assert _set(spark.read.format("workbook").schema("flag boolean, idx double").load(paths[0]))[0] == str(Row(flag=False, idx=1.0))


def test_tables_over_several_workbooks(spark, tmp_path):
    big = spark.range(25).selectExpr("id", "concat('t', id) AS t")
    paths = workbook.write_workbook({"big": big, "small": spark.range(3)}, str(tmp_path), "w", rows=10)
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["w.xlsx", "w-2.xlsx", "w-3.xlsx"]
    assert [r["id"] for r in workbook.read_sheet(spark, paths[1], "big").collect()] == list(range(10, 20))
    assert _set(workbook.read_sheet(spark, str(tmp_path), "big")) == _set(big)
    assert workbook.read_sheet(spark, str(tmp_path), "small").count() == 3
    assert not list(tmp_path.glob(".w*"))
    with pytest.raises(ValueError):
        workbook.write_workbook({"big": big}, str(tmp_path), rows=2_000_000)


def test_other_programs_workbooks(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S1" sheetId="1" r:id="r9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r9" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t xml:space="preserve">ch </t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="str"><v>when</v></c><c r="D2" t="s"><v>0</v></c><c r="AA2" t="str"><v>far</v></c></row>'
                   '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="1"><v>43831.5</v></c><c r="D3" s="2"><v>7</v></c><c r="AA3"><f>1/0</f><v>2</v></c></row><row r="4"/>'
                   '<row r="5"><c r="D5"><v>1.5</v></c><c r="AA5" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')  # fmt: skip
    got = workbook.read_sheet(spark, str(tmp_path / "b.xlsx"))
    assert len(got.columns) == 27 and got.columns[:4] == ["name", "_c1", "when", "name_3"]
    rows = got.select("name", "when", "name_3", "far").collect()
    assert [tuple(r) for r in rows] == [("rich ", dt.datetime(2020, 1, 1, 12), 7.0, 2), (None, None, 1.5, None)]


def test_seven_tables_and_catalog(spark, tmp_path):
    records = spark.createDataFrame([(f"10.1/{i}", f"W{i}", f"Title {i}", 2020, float(i), [f"10.1/{(i + 1) % 12}"]) for i in range(12)], "doi string, oa_id string, title string, year int, c_use double, ref_dois array<string>")
    tables = analyse(records, Config(bootstrap=20, communities="label_propagation"))
    (path,) = workbook.write_workbook(tables, str(tmp_path), "result")
    assert workbook.sheet_names(path) == bundle.TABLES
    for name in ("Records", "Edges", "Baselines", "Run_Metadata"):
        got, want = bundle.read_table(spark, path, name), tables[name]
        assert got.columns == want.columns and got.count() == want.count()
    titles = lambda df: {(r["idx"], r["title"], r["c_use"]) for r in df.collect()}
    assert titles(bundle.read_table(spark, path, "Records+Metrics", "Records")) == titles(tables["Records"])
    assert bundle.read_table(spark, path, "nothing") is None
    assert catalog.load_records(spark, path, network=True).count() == 12
    assert {t for _, t, _ in catalog.find_tables(spark, str(tmp_path))} == set(bundle.TABLES)
