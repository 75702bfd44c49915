"""Records of large CSV files with line feeds in quotes, found in parallel over the splits of a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impactlake.sources.shared import saved


def ends_inside(line: Column, sep: str, inside: bool) -> Column:
    """Whether a line ends within a quoted field, if it starts within one or not.

    A quote opens a field only right after a separator or at the start of a line, elsewhere in an unquoted field it is a
    character; two in a quoted field are one character. The fold goes over the pieces between quotes: 0 is outside,
    1 inside, 2 right after a quote inside, which the next piece makes an end or, if it is empty, half a pair.
    """
    start = F.struct(F.lit(1 if inside else 0).alias("state"), F.lit(0).alias("i"))
    pieces = F.split(line, '"', -1)
    last = F.size(pieces) - 1

    def step(acc: Column, piece: Column) -> Column:
        first = acc["i"] == 0
        opens = F.when((first & (piece == "")) | piece.endswith(sep), 1).otherwise(0)
        # the piece is followed by a quote: what that quote does
        quoted = F.when(acc["state"] == 0, opens).when(acc["state"] == 1, 2).otherwise(F.when(piece == "", 1).otherwise(opens))
        ended = F.when(acc["state"] == 1, 1).otherwise(0)
        return F.struct(F.when(acc["i"] < last, quoted).otherwise(ended).cast("int").alias("state"), (acc["i"] + 1).alias("i"))

    return F.when(~line.contains('"'), F.lit(inside)).otherwise(F.aggregate(pieces, start, step)["state"] == 1)


def _after(order: Window, maps: tuple[Column, Column], before: bool) -> tuple[list[Column], list[Column]]:
    """What a window's rows make of each start, composed in order: helper columns, then the composed maps.

    A row that maps both starts to one value decides; after the last such row only swaps count.
    """
    lo, hi = maps
    rows = order.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    constant = lo == hi
    swaps = F.sum(F.when(lo & ~hi, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen, at = F.last(F.when(constant, lo), True).over(rows), F.last(F.when(constant, F.col("_swaps")), True).over(rows)
    now = F.last("_swaps").over(rows)
    odd = F.coalesce(F.pmod(F.coalesce(now, F.lit(0)) - F.coalesce(at, F.lit(0)), F.lit(2)) == 1, F.lit(False))
    composed = [F.coalesce(seen, F.lit(start)) != odd for start in (False, True)]
    return [swaps.alias("_swaps")], composed


def quoted_lines(spark: SparkSession, files: list[str], sep: str, encoding: str) -> DataFrame:
    """file, block, at, line, map (whether it ends inside, for both starts), before (the same for all lines of its split before it), first (the first line of its record, for both starts of the split; null if that is in an earlier split).

    Lines are read in splits, as Spark cuts files; one shuffle brings a split's lines together in order.
    """
    raw = spark.read.option("lineSep", "\n").text(files)
    line = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), line.alias("line"))
    rows = rows.select("*", ends_inside(F.col("line"), sep, False).alias("_lo"), ends_inside(F.col("line"), sep, True).alias("_hi"))
    order = Window.partitionBy("file", "block").orderBy("at")
    helpers, composed = _after(order, (F.col("_lo"), F.col("_hi")), before=True)
    rows = rows.select("*", *helpers).select("*", F.array(*composed).alias("before"))
    blank = F.rtrim(F.regexp_replace("line", "\r$", "")) == ""
    begin = [F.last(F.when(~F.col("before")[h] & ~blank, F.col("at")), True).over(order) for h in (0, 1)]
    return rows.select("file", "block", "at", "line", F.array("_lo", "_hi").alias("map"), "before", F.array(*begin).alias("first"))


def quoted_records(spark: SparkSession, files: list[str], sep: str, encoding: str = "UTF-8") -> DataFrame:
    """file, record: the text of each record but a file's first, line feeds in quotes kept, a CR at a record's end taken off.

    Whether a split starts within quotes follows from the splits before it (a row a split); lines that are whole
    records go no further, only the parts of records of several lines are brought together. Blank lines between records
    are left out. A quote that is never closed makes one record of the rest of its file.
    """
    lines = saved(quoted_lines(spark, files, sep, encoding), "lines")
    through = lambda h: F.when(F.col("last.before")[h], F.col("last.map")[1]).otherwise(F.col("last.map")[0])
    splits = lines.groupBy("file", "block").agg(F.max(F.struct("at", "before", "map", "first")).alias("last"))
    splits = splits.select("file", "block", through(0).alias("_lo"), through(1).alias("_hi"), F.col("last.first").alias("newest"))
    order = Window.partitionBy("file").orderBy("block")
    helpers, (inside, _) = _after(order, (F.col("_lo"), F.col("_hi")), before=True)  # a file starts outside
    splits = splits.select("*", *helpers).select("*", inside.alias("inside"))
    own = F.when(F.col("inside"), F.col("newest")[1]).otherwise(F.col("newest")[0])
    splits = splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "inside", F.last(own, True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    heads = lines.filter(F.rtrim(F.regexp_replace("line", "\r$", "")) != "").groupBy(F.col("file").alias("_of")).agg(F.min(F.struct("block", "at"))["at"].alias("head"))
    pick = lambda c: F.when(F.col("inside"), F.col(c)[1]).otherwise(F.col(c)[0])
    placed = lines.join(splits, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).join(heads, F.col("file") == F.col("_of"))
    placed = placed.select("file", "block", "at", "line", "head", pick("before").alias("inside"), F.coalesce(pick("first"), "carried").alias("first"), "map")
    placed = placed.withColumn("open", F.when(F.col("inside"), F.col("map")[1]).otherwise(F.col("map")[0])).filter("first is not null and first != head")
    tidy = lambda c: F.regexp_replace(c, "\r$", "")
    whole = placed.filter("not inside and not open").select("file", tidy("line").alias("record"))
    parts = placed.filter("inside or open").groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("x"))
    several = parts.select("file", tidy(F.array_join(F.col("x.line"), "\n")).alias("record"))
    return whole.filter(F.rtrim("record") != "").unionByName(several)


def read_quoted(spark: SparkSession, files: list[str], sep: str, encoding: str, names: list[str]) -> DataFrame:
    """The named columns of quoted_records(), all text; records with more or fewer fields are dropped."""
    schema = ", ".join(f"`c{i}` string" for i in range(len(names))) + ", `_broken` string"
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": "_broken"}
    parsed = quoted_records(spark, files, sep, encoding).select(F.from_csv("record", schema, options).alias("r")).filter("r._broken is null")
    return parsed.select(*[F.col(f"r.c{i}") for i in range(len(names))]).toDF(*names)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
