"""Duplicates by identifier, by a chain of keys, and over unions. Order columns make the winner certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlake.functions.text import blank_to_null, norm_doi
from impactlake.sources.shared import saved


def _first_of(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row per key, the first in order; rows with a null key all stay and are not shuffled into one group."""
    keyed = df.withColumn("_key", key)
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    first = keyed.filter("_key is not null").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return first.unionByName(keyed.filter("_key is null")).drop("_key")


def keep_missing(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per non-null key; every row without a key stays."""
    return _first_of(df, F.col(key), [F.col(c) for c in order])


def collapse_missing(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, and one for all rows without a key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def with_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """A dense number from 0 in the given order; rows that are equal in it get theirs in any order.

    Ranges of the order are numbered each for itself and offset by the rows before them, so no task gets all rows. The
    ranges are drawn from samples and may be merged at run time, so the table is written with each row's range once
    and both sides read that: planned twice they need not be the same.
    """
    part, local, base, rows = _free(df, "part", "local", "base", "rows")
    ranged = saved(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(part).agg(F.count("*").alias(rows))
    before = F.sum(rows).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offset = sizes.select(part, F.coalesce(before, F.lit(0)).alias(base))
    numbered = ranged.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return numbered.join(F.broadcast(offset), part).withColumn(name, F.col(base) + F.col(local) - 1).drop(part, local, base)


def _free(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df does not have."""
    have = {c.lower() for c in df.columns}
    return [next(n for n in (f"{'_' * k}{w}" for k in range(1, len(have) + 2)) if n not in have) for w in wanted]


def work_key(doi: Column, work_id: Column) -> Column:
    """The DOI, else the id."""
    return F.coalesce(blank_to_null(F.lower(doi)), blank_to_null(work_id))


def chain_key(doi: Column, work_id: Column, title: Column, author: Column, year: Column) -> Column:
    """DOI, else id, else title with author and year; null if there is no title either. The kind is part of the key."""
    part = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    last = F.concat_ws("|", blank_to_null(F.lower(title)), F.coalesce(blank_to_null(F.lower(author)), F.lit("")), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(part("doi", blank_to_null(F.lower(doi))), part("id", blank_to_null(work_id)), F.when(blank_to_null(title).isNotNull(), part("tay", last)))


def by_chain(df: DataFrame, doi: str, work_id: str, title: str, author: str, year: str, order: list[str]) -> DataFrame:
    key = chain_key(*(F.col(c) for c in (doi, work_id, title, author, year)))
    return _first_of(df, key, [F.col(c) for c in order])


def chain_stats(df: DataFrame, doi: str, work_id: str, title: str, author: str, year: str) -> DataFrame:
    """One row: input, kept, duplicates by kind of key, rows without a key."""
    keys = df.select(chain_key(*(F.col(c) for c in (doi, work_id, title, author, year))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    kind = F.split("key", ":")[0]
    extra = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("n") - 1)), F.lit(0)).alias(f"duplicates_{k}")
    kept = F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(1)), F.lit(0))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input"), kept.alias("kept"), extra("doi"), extra("id"), extra("tay"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("keyless"))


def union_search(results: list[DataFrame], doi: str, work_id: str, order: list[str], limit: int | None = None) -> DataFrame:
    """The union of several searches, one row per work; rows without a key are dropped; optionally the first `limit` in order."""
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    key = work_key(F.col(doi), F.col(work_id))
    out = _first_of(out.filter(key.isNotNull()), key, [F.col(c) for c in order])
    return out.orderBy(*order).limit(limit) if limit else out


def corpus(focal: DataFrame, citers: DataFrame, doi: str = "doi", work_id: str = "oa_id") -> DataFrame:
    """Focal works and citers together, once per DOI and then once per id; focal works win."""
    both = focal.withColumn("is_focal", F.lit(True)).unionByName(citers.withColumn("is_focal", F.lit(False)), allowMissingColumns=True)
    order = [F.col("is_focal").desc(), F.col(work_id).asc_nulls_last(), F.col(doi).asc_nulls_last()]
    return _first_of(_first_of(both, norm_doi(F.col(doi)), order), blank_to_null(F.col(work_id)), order)
