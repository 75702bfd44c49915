"""Records of CSV files with line feeds in quotes, read over splits that are cut anywhere."""

import random

import pytest

from impactlake.sources.quoted import ends_inside
from impactlake.sources.records import parse_input, read_csv
from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _field(rng):
    body = "".join(rng.choice(["a", "b", "é", " ", "7", "x"]) for _ in range(rng.randrange(8)))
    kind = rng.randrange(6)
    if kind == 0:
        return '"' + "".join(rng.choice(["a", "\n", '""', ",", " ", "é"]) for _ in range(rng.randrange(30))) + '"'
    if kind == 1:
        return 'q5" ' + body  # a quote within an unquoted field
    if kind == 2:
        return '""'
    return body.replace(" ", "_") + "z"


def _rows(df):
    return sorted(tuple("" if x is None else "=" + x for x in r) for r in df.collect())


@pytest.mark.parametrize("seed,end,encoding", [(1, "\n", "utf-8"), (2, "\r\n", "utf-8"), (3, "\n", "latin-1")])
def test_splits_equal_one_task(small_splits, tmp_path, seed, end, encoding):
    rng = random.Random(seed)
    rows = [",".join(_field(rng) for _ in range(4 if rng.random() < 0.95 else 3)) for _ in range(150)]
    for at in range(0, 150, 17):
        rows[at] += end  # blank lines
    (tmp_path / "f").mkdir()
    for n in (0, 1):
        (tmp_path / "f" / f"{n}.csv").write_bytes(("one,two,three,four" + end + end.join(rows[n::2]) + (end if seed % 2 else "")).encode(encoding))
    want = read_csv(small_splits, str(tmp_path / "f"))
    got = read_csv(small_splits, str(tmp_path / "f"), split_bytes=0)
    assert got.columns == want.columns == ["one", "two", "three", "four"]
    assert _rows(got) == _rows(want) and len(_rows(got)) > 100
    assert got.select("two").count() == want.select("two").count() == got.count() == want.count() == len(_rows(got))


def test_state_of_lines(spark):
    lines = ["", 'a,"b', 'a"b,"', '"a""', '"a"",b', '"a"b"c,"', '",x', '"",x', '","', "plain", 'x "y', '"a","b",c', '""",x']
    want_out = [False, True, True, True, True, True, True, False, False, False, False, False, True]

    def inside(line, state):
        i, begin = 0, True
        while i < len(line):
            c = line[i]
            if state and c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state = False
            elif not state and c == '"' and begin:
                state = True
            begin = not state and c == ","
            i += 1
        return state

    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = df.select("i", ends_inside(F.col("line"), ",", False).alias("a"), ends_inside(F.col("line"), ",", True).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in got] == [inside(x, False) for x in lines] == want_out
    assert [r["b"] for r in got] == [inside(x, True) for x in lines]


def test_records_of_large_files(small_splits, tmp_path):
    path = tmp_path / "works.csv"
    body = "".join(f'"Title {i}\nsecond ""line""",{2000 + i % 20},10.1/x{i}\r\n' for i in range(60))
    path.write_text("Title,Year,DOI\r\n" + body, newline="")
    df = read_csv(small_splits, str(path), split_bytes=100)
    assert {r["title"] for r in df.collect()} == {f'Title {i}\nsecond "line"' for i in range(60)}
    assert parse_input(small_splits, str(path), "scopus").count() == 60


def test_only_header_and_lone_carriage_returns(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "h.csv"), split_bytes=0).columns == ["a", "b"]
    assert read_csv(spark, str(tmp_path / "h.csv"), split_bytes=0).count() == 0
    (tmp_path / "m.csv").write_bytes(b"a,b\r1,2\r3,4\r")
    assert _rows(read_csv(spark, str(tmp_path / "m.csv"), split_bytes=0)) == [("=1", "=2"), ("=3", "=4")]
