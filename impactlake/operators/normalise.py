"""Normalised citation scores and top-share flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.functions.text import number
from impactlake.operators.baselines import TOPS, quantiles

STRICT = "open_gt"


def effective_count(df: DataFrame, raw: str = "c_use", window: str = "c_use_window") -> Column:
    """The count within the citation window if there is one, else the raw one."""
    own = [number(F.col(c)) for c in (window, raw) if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("double")


def top_flag(count: Column, threshold: Column, ties: str = "closed_ge") -> Column:
    """1 or 0, null if either side is missing; ties count unless the policy is open_gt."""
    return (count > threshold if ties == STRICT else count >= threshold).cast("int")


def with_baseline(records: DataFrame, baselines: DataFrame, keys: list[str], ties: str = "closed_ge", raw: str = "c_use") -> DataFrame:
    """records with baseline columns, cf and PPg flags; null keys match null keys.

    Baselines have one row a key; a repeated key fails the job. Catalyst broadcasts them when their size allows it.
    """
    own = [c for c in baselines.columns if c not in keys]
    counted = baselines.groupBy(*keys).agg(*[F.first(c).alias(c) for c in own], F.count("*").alias("_n"))
    single = F.assert_true(F.col("_n") == 1, F.lit("a baseline key occurs twice")).isNull()
    right = counted.filter(single).select(*[F.col(c).alias(f"_b_{c}") for c in keys], *own)
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in keys]
    count = effective_count(records, raw)
    joined = records.withColumn("c_use", count).join(right, on, "left").drop(*[f"_b_{c}" for c in keys])
    c, c0 = F.col("c_use"), F.col("c0_mean")
    return joined.withColumns({"cf": F.when(c0 > 0, c / c0), **{f"PPg_{k}": top_flag(c, F.col(f"thr_{k}"), ties) for k in TOPS}})


def share_column(p: float) -> str:
    """pp10 for p = .9, pp1 for .99, pp0.5 for .995."""
    return f"pp{round(100 * (1 - p), 6):g}"


def top_share(records: DataFrame, score: str, by: list[str] | None = None, p: float = 0.9, ties: str = ">=threshold") -> DataFrame:
    """records with a 0/1 flag for scores at or above their group's linear quantile; missing scores get 0.

    Thresholds come from counts of values and are joined back, so a large group is not held in one task. Null groups
    are groups.
    """
    if not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    if score not in records.columns:
        raise ValueError(f"no column {score}")
    if ties not in (">=threshold", ">threshold"):
        raise ValueError("ties must be >=threshold or >threshold")
    by = by or []
    v = number(F.col(score))
    thresholds = quantiles(records, by, v, [p]).select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("q")[0].alias("_thr"))
    if by:
        joined = records.join(thresholds, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], "left")
    else:
        joined = records.join(F.broadcast(thresholds), F.lit(True), "left")  # one row
    hit = v >= F.col("_thr") if ties == ">=threshold" else v > F.col("_thr")
    return joined.withColumn(share_column(p), F.coalesce(hit, F.lit(False)).cast("int")).drop("_thr", *[f"_k_{c}" for c in by])


def target_pairs(records: DataFrame, domain: str = "domain_id", year: str = "year") -> DataFrame:
    """The distinct fields and years that baselines are needed for; pairs with a missing part are left out."""
    return records.select(F.col(domain).cast("string").alias("domain_id"), F.col(year).try_cast("int").alias("year")).dropna().distinct()


def with_min_metrics(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """df with cf and PPg_top10 where it lacks them: by the group's own mean, and its top tenth over two keys at most."""
    out = df
    if "PPg_top10" not in df.columns:
        out = top_share(out, score, by[:2], 0.9).withColumnRenamed("pp10", "PPg_top10")
    if "cf" not in df.columns:
        means = df.groupBy(*by).agg(F.avg(number(F.col(score))).alias("_m")).select(*[F.col(c).alias(f"_g_{c}") for c in by], "_m")
        out = out.join(means, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by], "left")
        out = out.withColumn("cf", F.when(F.col("_m") > 0, number(F.col(score)) / F.col("_m"))).drop("_m", *[f"_g_{c}" for c in by])
    return out
