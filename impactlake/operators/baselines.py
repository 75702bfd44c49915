"""Expected citation counts and top-share thresholds of a field and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlake.functions.text import number
from impactlake.operators.resampling import ranked, resampled

TOPS = {"top25": 0.75, "top10": 0.90, "top1": 0.99}


def local_baselines(records: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean, count and linear quantiles of a score per group, null groups included; all from one table of counted values."""
    rows = _counted(records, by, number(F.col(score)))
    n = F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))
    out = rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("_v") * F.col("_n")), n).alias("c0_mean"), F.coalesce(n, F.lit(0)).alias("c0_n"), *_rank_values(list(TOPS.values())))
    thresholds = [_between(i, p).alias(f"thr_{k}") for i, (k, p) in enumerate(TOPS.items())]
    return out.select(*by, "c0_mean", *thresholds, "c0_n", F.lit(True).alias("c0_complete"), F.lit("linear").alias("quantile_method"))


def quantiles(records: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """by, q: linear quantiles of a group's values, exact; groups without a value are left out.

    Values are counted and ranked over ranges of group and value (resampling.ranked): no task holds a group, whatever
    its distribution, and the records are read once.
    """
    found = _counted(records, by, value).filter("_v is not null").groupBy(*by).agg(*_rank_values(shares))
    return found.select(*by, F.array(*[_between(i, p) for i, p in enumerate(shares)]).alias("q"))


def _counted(records: DataFrame, by: list[str], value: Column) -> DataFrame:
    return ranked(records.select(*by, value.alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_n")), by, "_v", "_n")


def _rank_values(shares: list[float]) -> list[Column]:
    """The values below and above each share's place among the group's records."""
    place = lambda p, f: f(F.lit(p) * (F.col("_all") - 1))
    at = lambda r: F.max(F.when((r >= F.col("_at")) & (r < F.col("_at") + F.col("_n")) & F.col("_v").isNotNull(), F.col("_v")))
    return [F.max("_all").alias("_total"), *[at(place(p, f)).alias(f"_{k}{i}") for i, p in enumerate(shares) for k, f in (("a", F.floor), ("b", F.ceil))]]


def _between(i: int, p: float) -> Column:
    place = F.lit(p) * (F.col("_total") - 1)
    a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
    return F.when(a == b, a).otherwise(a + (b - a) * (place - F.floor(place)))


def histogram(records: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, k, n): how many records of a group have the count k."""
    return records.withColumn("k", number(F.col(score))).filter("k is not null").groupBy(*by, "k").agg(F.count("*").alias("n"))


def distribution(hist: DataFrame, by: list[str], method: str = "cdf_min") -> DataFrame:
    """Mean and discrete quantiles of a histogram(by, k, n).

    cdf_min: the first k whose cumulated n reaches p * N; hazen: p * N + 0.5; past the end the largest k.
    """
    w = Window.partitionBy(*by).orderBy("k")
    cum = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(*by))
    extra = {"cdf_min": 0.0, "hazen": 0.5}[method]
    rows = hist.withColumn("cum", cum).withColumn("total", total)
    quantile = lambda p: F.coalesce(F.min(F.when(F.col("cum") >= p * F.col("total") + extra, F.col("k"))), F.max("k"))
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("k") * F.col("n")), F.sum("n")).alias("c0_mean"), *[quantile(p).alias(f"thr_{k}") for k, p in TOPS.items()], F.sum("n").alias("c0_n"))


def baseline_errors(hist: DataFrame, by: list[str], replicates: int = 800, seed: int = 42, method: str = "cdf_min") -> DataFrame:
    """Relative errors in percent of mean and thresholds: the deviation over multinomial draws from each group's histogram, over the estimate itself (resampling.resampled)."""
    drawn = resampled(hist, by, replicates, seed, tuple(TOPS.values()), {"cdf_min": 0.0, "hazen": 0.5}[method])
    spread = drawn.groupBy(*by).agg(F.stddev_samp("mean").alias("_c0"), *[F.stddev_samp(F.col("q")[i]).alias(f"_{k}") for i, k in enumerate(TOPS)])
    known = distribution(hist, by, method).select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("c0_mean").alias("_hat_c0"), *[F.col(f"thr_{k}").alias(f"_hat_{k}") for k in TOPS])
    both = spread.join(known, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or F.lit(True))
    return both.select(*by, *[(100 * F.col(f"_{k}") / F.greatest(F.abs(F.col(f"_hat_{k}")), F.lit(1e-12))).alias(f"err_{k}_pct") for k in ("c0", *TOPS)])


COUNTS_JSON = "c0_counts_json"
GLOBAL_COLUMNS = ["domain_id", "year", "c0_mean", "thr_top1", "thr_top10", "thr_top25", "c0_n", "c0_complete", COUNTS_JSON, "err_c0_pct", "err_thr25_pct", "err_thr10_pct", "err_thr1_pct", "quantile_method", "ties_policy"]


def swept(works: DataFrame, pairs: DataFrame, types: list[str] | None = None, domains: str = "domain_ids", year: str = "year", count: str = "cited_by_count", max_rows: int | None = None, order: str = "id") -> tuple[DataFrame, Column]:
    """(domain_id, year, k, n: how many works of a wanted field and year have k citations, whether all were counted).

    Missing counts are 0. With max_rows a sweep ends after so many works of a field and year, in order, as a report
    that is limited on purpose; without it all works count.
    """
    rows = works.filter(F.col("type").isin(types)) if types else works
    rows = rows.select(F.explode(F.array_distinct(domains)).alias("domain_id"), F.col(year).try_cast("int").alias("year"), F.coalesce(F.col(count).try_cast("long"), F.lit(0)).alias("k"), F.col(order).alias("_order"))
    rows = rows.join(pairs.select(F.col("domain_id").cast("string"), F.col("year").try_cast("int").alias("year")).dropna().distinct(), ["domain_id", "year"], "left_semi")
    if max_rows is not None:
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("domain_id", "year").orderBy("_order"))).filter(F.col("_rn") <= max_rows)
    return rows.groupBy("domain_id", "year", "k").agg(F.count("*").alias("n")), F.lit(max_rows is None)


def global_baselines(works: DataFrame, pairs: DataFrame, ties: str = "closed_ge", types: list[str] | None = None, replicates: int = 800, **sweep) -> DataFrame:
    """GLOBAL_COLUMNS for each wanted field and year that has works: pairs are taken once, those without works have no row."""
    hist, complete = swept(works, pairs, types, **sweep)
    method, by = "hazen" if ties == "hazen" else "cdf_min", ["domain_id", "year"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat(F.lit('"'), x["k"], F.lit('": '), x["n"]))
    counts = hist.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}")).alias(COUNTS_JSON))
    errors = baseline_errors(hist, by, replicates, method=method).withColumnsRenamed({f"err_{k}_pct": f"err_thr{k[3:]}_pct" for k in TOPS})
    out = distribution(hist, by, method).join(counts, by).join(errors, by)
    return out.withColumns({"c0_complete": complete, "quantile_method": F.lit(method), "ties_policy": F.lit(ties)}).select(*GLOBAL_COLUMNS)
