"""Workbooks (.xlsx): a data source with a partition a sheet, and a writer with a task a file.

A file holds at most 1,048,576 rows a sheet by its format, which bounds what a task reads or writes.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from impactlake.operators.dedupe import with_index

#: Rows of a sheet, with its header; name spaces of the format; formats of numbers that are dates.
SHEET_ROWS = 1_048_576
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system as pyarrow knows it, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def workbook_files(path: str) -> list[str]:
    """The .xlsx files that a path or folder stands for, in order."""
    system, inside = _place(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if n.lower().endswith(".xlsx") and not n.startswith(("~", ".", "_"))]


def _unescaped(text: str) -> str:
    """Text with the format's marks _xHHHH_ turned back into characters."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its own or its runs', without phonetic hints."""
    parts = [t for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else [])]
    return _unescaped("".join(t.text or "" for t in parts))


class Book:
    """An open workbook: sheet names in order, and the rows of a sheet one after another."""

    def __init__(self, path: str):
        system, inside = _place(path)
        self.zip = zipfile.ZipFile(system.open_input_file(inside))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        target = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): target(links[s.get(LINK)]) for s in root.iter(f"{MAIN}sheet") if "worksheets/" in links[s.get(LINK)]}
        settings = root.find(f"{MAIN}workbookPr")
        late = settings is not None and settings.get("date1904") in ("1", "true")
        self.first_day = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{MAIN}si":
                    out.append(_text(node))
                    node.clear()
        return out

    def _dates(self) -> set[int]:
        """The styles that show a number as a date."""
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "")
        own = {int(n.get("numFmtId")) for n in root.iter(f"{MAIN}numFmt") if re.search("[dmyhs]", plain(n.get("formatCode")).lower().replace("general", ""))}
        styles = root.find(f"{MAIN}cellXfs")
        return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def rows(self, sheet: str) -> Iterator[dict[int, object]]:
        """The cells of each row that has any, by column from 0: text, bool, int, float or datetime; errors are left out."""
        strings, dates = self._strings(), self._dates()
        with self.zip.open(self.sheets[sheet]) as f:
            events = ElementTree.iterparse(f, events=("start", "end"))
            data = None
            for event, node in events:
                if event == "start":
                    data = node if node.tag == f"{MAIN}sheetData" else data
                elif node.tag == f"{MAIN}row":
                    row, at = {}, -1
                    for cell in node:
                        at = _column(cell.get("r")) if cell.get("r") else at + 1
                        value = self._value(cell, strings, dates)
                        if value is not None:
                            row[at] = value
                    data.clear()  # rows that were read
                    if row:
                        yield row

    def _value(self, cell: ElementTree.Element, strings: list[str], dates: set[int]) -> object:
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            own = cell.find(f"{MAIN}is")
            return _text(own) if own is not None else None
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(v.text)]
        if kind == "b":
            return v.text.strip() in ("1", "true")
        if kind == "n":
            whole = re.fullmatch(r"\s*[+-]?\d+\s*", v.text)
            number = int(v.text) if whole else float(v.text)
            if int(cell.get("s", 0)) in dates:
                return self.first_day + dt.timedelta(milliseconds=round(number * 86_400_000))
            return number
        return dt.datetime.fromisoformat(v.text) if kind == "d" else _unescaped(v.text)


def _column(reference: str) -> int:
    """The column of a cell such as AB12, from 0."""
    return reduce(lambda n, c: n * 26 + ord(c) - 64, re.match("[A-Z]+", reference)[0], 0) - 1


def _header(row: dict[int, object]) -> list[str]:
    """Names of all columns up to the last; empty ones by their place, repeated ones with a number."""
    names: list[str] = []
    for i in range(max(row) + 1):
        name = str(row.get(i, f"_c{i}"))
        names.append(name if name.lower() not in {n.lower() for n in names} else f"{name}_{i}")
    return names


_RANK = {bool: 1, int: 2, float: 4, dt.datetime: 8, str: 16}
_TYPES = {0: StringType(), 1: BooleanType(), 2: LongType(), 4: DoubleType(), 6: DoubleType(), 8: TimestampType()}


@dataclass
class _Sheet(InputPartition):
    path: str
    sheet: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        files = workbook_files(self.options["path"])
        sheets = [(f, self.options.get("sheet") or next(iter(Book(f).sheets))) for f in files]
        return [_Sheet(f, s) for f, s in sheets if s in Book(f).sheets]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        rows = Book(partition.path).rows(partition.sheet)
        head = next(rows, None)
        place = {n.lower(): i for i, n in enumerate(_header(head))} if head else {}
        at = [(place.get(f.name.lower(), -1), f.dataType) for f in self.schema]
        for row in rows:
            yield tuple(_as(row.get(i), kind) for i, kind in at)


def _as(value: object, kind) -> object:
    """A cell's value in a column's type; null where it has none there."""
    if value is None or isinstance(kind, StringType):
        return value if value is None or isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, TimestampType):
        return value if isinstance(value, dt.datetime) else None
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, (int, float)):
        return float(value) if isinstance(kind, DoubleType) else int(value) if value == int(value) else None
    return None


class Workbook(DataSource):
    """spark.read.format("workbook").load(path of a file or folder), option sheet (else each file's first).

    The first row that has cells gives the names; without a schema each column's type is what all its cells are
    (whole numbers, numbers, booleans, times, else text), from one pass over the sheets.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        names: dict[str, str] = {}
        kinds: dict[str, int] = {}
        for part in _Reader(StructType(), self.options).partitions():
            rows = Book(part.path).rows(part.sheet)
            head = _header(next(rows, {0: "_c0"}))
            for n in head:
                names.setdefault(n.lower(), n)
            for row in rows:
                for i, v in row.items():
                    if i < len(head):
                        kinds[head[i].lower()] = kinds.get(head[i].lower(), 0) | _RANK[type(v)]
        if not names:
            raise ValueError(f"no sheet {self.options.get('sheet', '')} in {self.options['path']}")
        return StructType([StructField(n, _TYPES.get(kinds.get(k, 0), StringType())) for k, n in names.items()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def sheet_names(path: str) -> list[str]:
    """The sheets of a workbook, or all those of a folder's workbooks, in order."""
    return list(dict.fromkeys(s for f in workbook_files(path) for s in Book(f).sheets))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook, or of all workbooks of a folder."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def _cell(c: Column, kind: str) -> Column:
    """A value as a cell; null is an empty one. Characters that XML forbids, and CR, become the format's marks."""
    if kind == "boolean":
        full = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        full = F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))
    elif kind in ("float", "double"):
        finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c.cast("string"))
        full = F.concat(F.lit("<c><v>"), finite, F.lit("</v></c>"))
    else:
        text = c.cast("string") if not kind.startswith(("array", "struct", "map")) else F.to_json(c)
        bad = "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"
        mark = lambda x: F.when(x.rlike(bad), F.concat(F.lit("_x"), F.lpad(F.hex(F.ascii(x)), 4, "0"), F.lit("_"))).otherwise(x)
        text = F.regexp_replace(text, "_(x[0-9A-Fa-f]{4}_)", "_x005F_$1")
        text = F.when(text.rlike(bad), F.array_join(F.transform(F.split(text, ""), mark), "")).otherwise(text)
        text = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        full = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
    return F.coalesce(full, F.lit("<c/>"))


def write_workbook(tables: dict[str, DataFrame], folder: str, name: str = "workbook", rows: int = SHEET_ROWS - 1) -> list[str]:
    """Workbooks name.xlsx, name-2.xlsx, ... in a folder, with a sheet a table in each; gives the paths.

    A table of more than `rows` rows goes on in the next workbook, so that a task writes a bounded file from its rows in
    order (that of the columns). Cells are made where the rows are. A file is written under a name of its own and moved
    to its place when whole, so a task that runs again does no harm. Times, arrays and structs become text; texts of over
    32,767 characters are written whole, though spreadsheet programs may cut them.
    """
    from impactlake.sources.bundle import safe_name

    if not 0 < rows < SHEET_ROWS:
        raise ValueError(f"a sheet has up to {SHEET_ROWS - 1} rows and a header")
    titles: list[str] = []
    for t in tables:
        base = safe_name(t)
        titles.append(base if base.lower() not in {x.lower() for x in titles} else f"{base[:27]}_{len(titles)}")
    heads = ["<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in df.columns) + "</row>" for df in tables.values()]
    parts = []
    for k, df in enumerate(tables.values()):
        cells = F.concat(F.lit("<row>"), *[_cell(F.col(f"`{c}`"), kind) for c, kind in df.dtypes], F.lit("</row>"))
        order = [c for c, kind in df.dtypes if "map<" not in kind]
        made = with_index(df.select(cells.alias("_xml"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)]), [f"_o{i}" for i in range(len(order))] or ["_xml"], "_at")
        parts.append(made.select(F.floor(F.col("_at") / rows).cast("int").alias("file"), F.lit(k).alias("sheet"), F.col("_at").cast("long").alias("at"), F.col("_xml").alias("xml")))
    spark = parts[0].sparkSession
    every = reduce(DataFrame.unionByName, parts, spark.createDataFrame([(0, -1, -1, "")], "file int, sheet int, at long, xml string"))
    target, run = folder.rstrip("/"), uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _place(target)
        system.create_dir(place, recursive=True)
        current, out = None, None
        done: list[str] = []

        def finish() -> None:
            out.close()
            final = f"{place}/{name}{'' if not current else f'-{current + 1}'}.xlsx"
            system.move(out.path, final)
            done.append(final.rsplit("/", 1)[-1])

        for batch in batches:
            for file, sheet, xml in zip(*(batch[c].to_pylist() for c in ("file", "sheet", "xml"))):
                if file != current:
                    if out is not None:
                        finish()
                    current, out = file, _Out(system, f"{place}/.{name}-{run}-{uuid.uuid4().hex}", titles, heads)
                if sheet >= 0:
                    out.add(sheet, xml)
        if out is not None:
            finish()
        yield pa.record_batch([pa.array(done, pa.string())], names=["path"])

    written = every.repartition("file").sortWithinPartitions("file", "sheet", "at").mapInArrow(write, "path string")
    return sorted((f"{target}/{r['path']}" for r in written.collect()), key=lambda p: (len(p), p))  # a row a file


class _Out:
    """A workbook being written, sheet by sheet."""

    def __init__(self, system: fs.FileSystem, path: str, titles: list[str], heads: list[str]):
        self.path, self.heads, self.at, self.sheet = path, heads, -1, None
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)
        head, main, doc = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n', MAIN.strip("{}"), LINK[1:].split("}")[0]
        numbers = range(1, len(titles) + 1)
        package, content = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
        sheets = "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(numbers, titles))
        links = "".join(f'<Relationship Id="rId{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{content}.worksheet+xml"/>' for i in numbers)
        self.zip.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{content}.sheet.main+xml"/>{kinds}</Types>')
        self.zip.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{doc}"><sheets>{sheets}</sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        self.start = f'{head}<worksheet xmlns="{main}"><sheetData>'

    def _to(self, sheet: int) -> None:
        """Close the sheets before one and begin it; sheets without rows have their header."""
        while self.at < sheet:
            if self.sheet is not None:
                self.sheet.write(b"</sheetData></worksheet>")
                self.sheet.close()
                self.sheet = None
            self.at += 1
            if self.at < len(self.heads):
                self.sheet = self.zip.open(f"xl/worksheets/sheet{self.at + 1}.xml", "w", force_zip64=True)
                self.sheet.write((self.start + self.heads[self.at]).encode())

    def add(self, sheet: int, xml: str) -> None:
        self._to(sheet)
        self.sheet.write(xml.encode())

    def close(self) -> None:
        self._to(len(self.heads))
        self.zip.close()
        self.stream.close()
