"""Integer and fractional counting, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.functions.text import number
from impactlake.operators.resampling import resampled

FLAGS = ("PPg_top1", "PPg_top10", "PPg_top25")


def integer_summary(df: DataFrame, label: str = "domain_label", year: str = "year", keep_null_keys: bool = False) -> DataFrame:
    """n, MNCS and top shares by label and year; rows with null keys are left out unless asked for."""
    rows = df if keep_null_keys else df.dropna(subset=[label, year])
    return rows.groupBy(label, year).agg(F.count("*").alias("n"), F.avg(number(F.col("cf"))).alias("MNCS"), *[F.avg(number(F.col(c))).alias(c.replace("PPg_top", "PP")) for c in FLAGS if c in df.columns])


def summary_with_intervals(df: DataFrame, intervals: DataFrame, label: str = "domain_label", domain: str = "domain_id", year: str = "year") -> DataFrame:
    """integer_summary with the intervals of every domain id that a label has: a label of several ids gives several rows."""
    ids = df.select(label, domain, year).dropna().distinct()
    return integer_summary(df, label, year).join(ids, [label, year], "left").join(intervals, [domain, year], "left").drop(domain).distinct()


def concept_weights(concepts: Column, mode: str) -> Column:
    """concepts array<struct<id, label, score>> with a weight each that sums to 1: equal, or by score (negatives count 0, no score at all: equal)."""
    n = F.size(concepts)
    score = lambda x: F.greatest(F.coalesce(x["score"].cast("double"), F.lit(0.0)), F.lit(0.0))
    total = F.aggregate(concepts, F.lit(0.0), lambda a, x: a + score(x))
    share = lambda x: F.when(F.lit(mode == "score") & (total > 0), F.try_divide(score(x), total)).otherwise(F.try_divide(F.lit(1.0), n))
    return F.transform(concepts, lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), share(x).alias("w")))


def fractional_explode(records: DataFrame, mode: str = "equal", concepts: str = "concepts", domain: str = "domain_id", label: str = "domain_label") -> DataFrame:
    """A row per record and concept: frac_id, frac_label and weight, the concept's share of 1 / authors / affiliations.

    Without concepts the record's own domain counts whole; without either it has no row. Counts that are missing,
    not numbers or below 1 are 1.
    """
    if mode not in ("equal", "score"):
        raise ValueError("mode must be equal or score")
    own = F.array(F.struct(F.col(domain).alias("id"), F.col(label).alias("label"), F.lit(1.0).alias("w")))
    weights = F.when(F.coalesce(F.size(F.col(concepts)) > 0, F.lit(False)), concept_weights(F.col(concepts), mode)).when(F.col(domain).isNotNull() | F.col(label).isNotNull(), own)
    divisor = F.lit(1.0)
    for c in ("n_authors", "n_affiliations"):
        if c in records.columns:
            divisor = divisor * F.greatest(F.coalesce(number(F.col(c)), F.lit(1.0)), F.lit(1.0))
    rows = records.withColumn("_d", divisor).withColumn("_w", F.explode(weights))
    return rows.withColumns({"frac_id": F.col("_w.id"), "frac_label": F.col("_w.label"), "weight": F.col("_w.w") / F.col("_d")}).drop("_w", "_d")


def fractional_summary(exploded: DataFrame, label: str = "frac_label", year: str = "year") -> DataFrame:
    """Sum of weights and weighted means; a mean takes the rows where both weight and value are there."""

    def mean(c: str) -> Column:
        v = number(F.col(c))
        w = F.when(v.isNotNull(), F.col("weight"))
        return F.when(F.sum(w) > 0, F.sum(w * v) / F.sum(w))

    return exploded.dropna(subset=[label, year]).groupBy(label, year).agg(F.sum("weight").alias("W"), mean("cf").alias("MNCS"), *[mean(c).alias(c.replace("PPg_top", "PP")) for c in FLAGS if c in exploded.columns])


def bootstrap_intervals(df: DataFrame, by: list[str], replicates: int = 1000, seed: int = 12345, most_drawn: int = 10_000) -> DataFrame:
    """2.5 and 97.5 % limits of each group's mean c_use over its c0_mean, by a seeded multinomial bootstrap; null if c0_mean is not positive.

    Where df says that a baseline is not complete (c0_complete) and has its histogram (c0_counts_json), the denominator
    is drawn too: each replicate's is the mean of as many draws from that histogram as it has works, most_drawn at most;
    one that is not positive is replaced by c0_mean. Draws go down a tree (resampling.resampled), so no task
    holds replicates times values.
    """
    rows = df.withColumn("c_use", number(F.col("c_use"))).dropna(subset=["c_use", "c0_mean"])
    means = resampled(rows.groupBy(*by, F.col("c_use").alias("k")).agg(F.count("*").alias("n")), by, replicates, seed)
    known = rows.groupBy(*by).agg(F.avg("c0_mean").alias("_c0"))
    renamed = lambda x, tag: x.select(*[F.col(c).alias(f"{tag}{c}") for c in by], *[c for c in x.columns if c not in by])
    same = lambda tag: [F.col(c).eqNullSafe(F.col(f"{tag}{c}")) for c in by]
    drawn = means.join(renamed(known, "_k_"), same("_k_"))
    below = F.col("_c0")
    if {"c0_complete", "c0_counts_json"} <= set(df.columns):
        open_ = rows.groupBy(*by).agg(F.bool_and(F.coalesce("c0_complete", F.lit(False))).alias("_done"), F.first("c0_counts_json", ignorenulls=True).alias("_json")).filter("not _done")
        hist = open_.select(*by, F.explode(F.from_json("_json", "map<string,long>")).alias("k", "n")).withColumn("k", F.col("k").try_cast("double")).filter("n > 0")
        other = resampled(hist, by, replicates, seed + 1, most=most_drawn).select(*by, F.col("r").alias("_r"), F.col("mean").alias("_below"))
        drawn = drawn.join(renamed(other, "_h_"), [*same("_h_"), F.col("r") == F.col("_r")], "left")
        below = F.when(F.col("_below") > 0, F.col("_below")).otherwise(below)
    limits = F.percentile(F.when(F.col("_c0") > 0, F.col("mean") / below), F.array(F.lit(0.025), F.lit(0.975)))  # of the replicates
    return drawn.groupBy(*by).agg(limits.alias("_l")).select(*by, F.col("_l")[0].alias("MNCS_low"), F.col("_l")[1].alias("MNCS_high"))
