"""Which bundle and table of a folder of bundles is best to work with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impactlake.operators.graph import with_network
from impactlake.operators.units import completeness, resolve_column
from impactlake.sources.bundle import read_table
from impactlake.sources.workbook import read_sheet, sheet_names


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(f.getPath().toString() for f in fs.listStatus(path) if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))


def _workbooks(spark: SparkSession, folder: str) -> list[str]:
    """The workbooks of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = sorted(f.getPath().toString() for f in fs.listStatus(path) if f.isFile() and not f.getPath().getName().startswith(("_", ".", "~")))
    return [f for f in files if f.lower().endswith(".xlsx")]


def find_tables(spark: SparkSession, folder: str) -> list[tuple[str, str, str]]:
    """(bundle, table, path) of all Parquet tables two levels below a folder, and of the sheets of the workbooks in it."""
    tables = [(b.rsplit("/", 1)[-1], t.rsplit("/", 1)[-1], t) for b in _children(spark, folder) for t in _children(spark, b)]
    return tables + [(w.rsplit("/", 1)[-1], sheet, w) for w in _workbooks(spark, folder) for sheet in sheet_names(w)]


def table_qualities(spark: SparkSession, folder: str) -> DataFrame | None:
    """bundle, table, path and completeness() of each table; None without tables. All rows count."""
    read = lambda t, p: read_sheet(spark, p, t) if p.lower().endswith(".xlsx") else spark.read.parquet(p)
    parts = [completeness(read(t, p)).select(F.lit(b).alias("bundle"), F.lit(t).alias("table"), F.lit(p).alias("path"), "*") for b, t, p in find_tables(spark, folder)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def ranked_bundles(qualities: DataFrame) -> DataFrame:
    """Each bundle with its best table (ties by name), best bundles first; recommended: a score over 0.5, more than 10 rows, a title and an area."""
    best = F.row_number().over(Window.partitionBy("bundle").orderBy(F.col("score").desc(), "table"))
    rows = qualities.withColumn("_rn", best).filter("_rn = 1").drop("_rn")
    rows = rows.withColumn("recommended", (F.col("score") > 0.5) & (F.col("rows") > 10) & F.col("has_title") & F.col("has_area"))
    return rows.orderBy(F.col("score").desc(), "bundle")


def recommendation(spark: SparkSession, folder: str) -> dict:
    """status (success, warning or error), message, and the best bundle and table with their quality and the reasons."""
    found = table_qualities(spark, folder)
    if found is None:
        return {"status": "error", "message": "no tables found", "bundle": None}
    best = ranked_bundles(found).orderBy(F.col("recommended").desc(), F.col("score").desc(), "bundle").first().asDict()  # a row a bundle
    if not best["recommended"]:
        return {"status": "warning", "message": "no bundle is good enough", "bundle": best["bundle"], "score": best["score"]}
    reasons = [f"bundle {best['bundle']} scores {best['score']:.2%}", f"table {best['table']} has {best['rows']} rows", *[f"has {k.removeprefix('has_')}" for k, v in best.items() if k.startswith("has_") and v]]
    return {"status": "success", "message": "ok", **best, "reasons": reasons}


#: Names of the metrics that a selection needs.
METRICS = {"cf": ["cf", "mncs", "c_f", "field_weighted_citation_impact"], "c_use_window": ["c_use_window", "use_window", "usage_window"], "c_use": ["c_use", "usage", "cited_by_count"], "pagerank": ["pagerank", "pr", "page_rank"], "betweenness": ["betweenness", "btw", "centrality"]}


def load_records(spark: SparkSession, bundle: str, table: str = "Records", network: bool = False) -> DataFrame:
    """A bundle's records with all of METRICS as numbers (0 where missing), optionally joined with its network table."""
    rows = read_table(spark, bundle, table, "Records+Metrics", "Records")
    if rows is None:
        raise ValueError(f"no table {table} in {bundle}")
    metrics = read_table(spark, bundle, "Network", "Network Metrics") if network else None
    key = resolve_column(rows.columns, ["idx", "id", "eid"])
    if metrics is not None and key:
        rows = with_network(rows, metrics, key, resolve_column(metrics.columns, ["idx", "id", "eid"]))
    found = {k: resolve_column(rows.columns, names) for k, names in METRICS.items()}
    return rows.withColumns({k: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) if c else F.lit(0.0) for k, c in found.items()})
