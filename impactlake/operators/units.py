"""Summaries by unit, comparison of variants, agreement with a gold set, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.functions.text import as_binary, norm_key, number

#: Names under which units are known.
UNIT_NAMES = {
    "institution": ["institution", "instituição", "instituicao", "affiliation", "affiliations", "organization", "organisation", "org", "unit", "unit_name", "unit_id", "inst", "inst_name"],
    "author": ["author", "authors", "autor", "autores"],
    "country": ["country", "país", "pais"],
}


def resolve_column(columns: list[str], wanted: list[str]) -> str | None:
    """The first wanted name that a column equals (case ignored), else the first column that contains one."""
    low = {c.lower(): c for c in reversed(columns)}
    for w in wanted:
        if w.lower() in low:
            return low[w.lower()]
    return next((c for c in columns for w in wanted if w.lower() in c.lower()), None)


def unit_means(df: DataFrame, unit: str, cf: str = "cf", flags: tuple[str, ...] = ("PPg_top10",)) -> DataFrame:
    return df.groupBy(unit).agg(F.avg(number(F.col(cf))).alias("MNCS"), *[F.avg(number(F.col(c))).alias(c.replace("PPg_top", "PP")) for c in flags])


def unit_summary(df: DataFrame, unit: str, cf: str = "cf", flag: str = "PPg_top10") -> DataFrame:
    """n, MNCS to 3 and PP10 percent to 1 places (half to even), best first."""
    out = df.groupBy(unit).agg(F.count("*").alias("n"), F.bround(F.avg(number(F.col(cf))), 3).alias("mncs"), F.bround(100 * F.avg(number(F.col(flag))), 1).alias("pp10_pct"))
    return out.orderBy(F.col("mncs").desc_nulls_last(), F.col("pp10_pct").desc_nulls_last(), F.col(unit))


def export_unit_summary(df: DataFrame, unit: str) -> DataFrame:
    """Without retracted records: n, MNCS, PP10, PP1 and citations."""
    rows = df.filter(~F.coalesce(F.col("is_retracted"), F.lit(False))) if "is_retracted" in df.columns else df
    out = rows.groupBy(unit).agg(F.count("*").alias("n"), F.avg("cf").alias("mncs"), F.avg("PPg_top10").alias("pp10"), F.avg("PPg_top1").alias("pp1"), F.sum("c_use").alias("citations"))
    return out.orderBy(F.col("mncs").desc_nulls_last(), F.col("pp10").desc_nulls_last(), F.col("pp1").desc_nulls_last(), F.col("n").desc(), F.col(unit))


def sensitivity(baseline: DataFrame, variant: DataFrame, unit: str) -> DataFrame:
    """Units' MNCS and PP10 on either side and their differences; units of one side only have nulls on the other."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        own = resolve_column(df.columns, UNIT_NAMES.get(unit, [unit]))
        means = unit_means(df, own)
        return means.select(norm_key(F.col(own)).alias(f"_{tag}"), F.col("MNCS").alias(f"MNCS_{tag}"), F.col("PP10").alias(f"PP10_{tag}"))

    a, b = side(baseline, "base"), side(variant, "var")
    out = a.join(b, F.col("_base").eqNullSafe(F.col("_var")), "full").withColumn("unit", F.coalesce("_base", "_var")).drop("_base", "_var")
    out = out.withColumns({"d_MNCS": F.col("MNCS_var") - F.col("MNCS_base"), "d_PP10": F.col("PP10_var") - F.col("PP10_base")})
    return out.orderBy(F.col("d_MNCS").desc_nulls_last(), F.col("d_PP10").desc_nulls_last(), F.col("unit"))


def gold_set(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1; 0 where the denominator is 0."""
    t, p = as_binary(F.col(truth)) == 1, as_binary(F.col(predicted)) == 1
    counts = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


ERRORS = ["err_c0_pct", "err_thr25_pct", "err_thr10_pct", "err_thr1_pct"]


def mean_of(df: DataFrame, column: str) -> Column:
    """The mean of the values that are numbers, null without one or without the column."""
    return F.avg(number(F.col(column))) if column in df.columns else F.lit(None).cast("double")


def overview(df: DataFrame, cf: str = "cf", flag: str = "PPg_top10") -> DataFrame:
    """One row: n, mean cf, PP10 percent."""
    return df.agg(F.count("*").alias("n"), F.avg(number(F.col(cf))).alias("mncs"), (100 * F.avg(number(F.col(flag)))).alias("pp10_pct"))


def overview_with_errors(df: DataFrame, baselines: DataFrame, cf: str = "cf", target: float = 5.0) -> DataFrame:
    """overview(), the error target, the baselines' mean errors and, where there is none, the realised shares of the top flags."""
    flags = [c for c in ("PPg_top25", "PPg_top10", "PPg_top1") if c in df.columns]
    own = df.agg(F.count("*").alias("n"), mean_of(df, cf).alias("mncs"), (100 * mean_of(df, "PPg_top10")).alias("pp10_pct"), *[(100 * mean_of(df, c)).alias(f"_{c}") for c in flags])
    errors = baselines.agg(*[mean_of(baselines, c).alias(c) for c in ERRORS])
    none = F.coalesce(*ERRORS).isNull()
    both = own.crossJoin(errors)  # one row each
    return both.select("n", "mncs", "pp10_pct", F.lit(target).alias("err_target"), *ERRORS, *[F.when(none, F.col(f"_{c}")).alias(f"realised_{c}") for c in flags])


def min_max(c: str, low: float = 5.0, high: float = 30.0):
    """DataFrame -> DataFrame with c scaled to low..high: null as 0, the middle if all are equal."""

    def apply(df: DataFrame) -> DataFrame:
        v = F.coalesce(number(F.col(c)), F.lit(0.0))
        limits = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))  # one row
        scaled = F.when(F.col("_hi") > F.col("_lo"), low + (high - low) * (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise((low + high) / 2)
        return df.crossJoin(F.broadcast(limits)).withColumn(f"{c}_scaled", scaled).drop("_lo", "_hi")

    return apply


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column> by mean and population deviation; 0 where they do not vary or the value is missing."""
    stats = df.agg(*[f(number(F.col(c))).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row

    def z(c: str) -> Column:
        return F.coalesce(F.when(F.col(f"_s_{c}") > 0, (number(F.col(c)) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")), F.lit(0.0))

    return df.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": z(c) for c in columns}).drop(*stats.columns)


#: Names under which a table's fields are known, and how much the filled share of three of them counts.
TABLE_FIELDS = {
    "title": ["title", "document title", "ti", "titulo"],
    "doi": ["doi", "doi number", "pr_doi"],
    "year": ["year", "py", "publication year", "date", "ano"],
    "author": ["authors", "author_names", "authors_list", "creator", "autores"],
    "area": ["domain_label", "domain_id", "community_label", "area", "field", "ASJC", "WC"],
}
FILLED = {"title": 0.4, "doi": 0.3, "year": 0.3}
METRIC_NAMES = ["cf", "mncs", "c_f", "c_use", "usage", "pagerank", "pr", "betweenness", "btw"]


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, columns, which fields the table has, their share, the weighted filled share, the quality score.

    The score is 0.6 times the share of the five fields plus 0.4 times the filled share of title, DOI and year (0.4,
    0.3, 0.3); a table with a metric gets 0.1 more, then 1 at most. A table without rows scores 0.
    """
    found = {k: resolve_column(df.columns, names) for k, names in TABLE_FIELDS.items()}
    rows = F.count("*")
    share = sum((w * F.try_divide(F.count(F.col(f"`{found[k]}`")).cast("double"), rows.cast("double")) for k, w in FILLED.items() if found[k]), F.lit(0.0))
    fields = sum(c is not None for c in found.values()) / len(found)
    metrics = any(resolve_column(df.columns, [m]) for m in METRIC_NAMES)
    out = df.agg(rows.alias("rows"), F.lit(len(df.columns)).alias("columns"), *[F.lit(c is not None).alias(f"has_{k}") for k, c in found.items()], F.lit(metrics).alias("has_metrics"), F.lit(fields).alias("fields"), F.coalesce(share, F.lit(0.0)).alias("filled"))
    score = 0.6 * F.col("fields") + 0.4 * F.col("filled")
    return out.withColumn("score", F.when(F.col("rows") == 0, 0.0).otherwise(F.least(F.lit(1.0), score + 0.1) if metrics else score))
