"""The analysis from records to result tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.operators import baselines, counting, dedupe, graph, normalise
from impactlake.sources import bundle
from impactlake.sources.shared import saved


@dataclass(frozen=True)
class Config:
    ties: str = "closed_ge"
    level_weight: str = "equal"
    window: int = 5
    drop_self_citations: bool = True
    drop_retracted: bool = True
    concept_level: int = 1
    bootstrap: int = 800
    communities: str = "auto"
    gamma: float = 1.0
    seed: int = 42


def analyse(records: DataFrame, config: Config = Config(), reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """The result tables of records(doi, oa_id, year, c_use, ...): baselines are the records' own unless given.

    Missing domains are "unknown"; records are taken once per DOI, those without DOI all.
    """
    rows = records
    if config.drop_retracted and "is_retracted" in rows.columns:
        rows = rows.filter(~F.coalesce("is_retracted", F.lit(False)))
    for name, kind, value in (("domain_id", "string", "unknown"), ("domain_label", "string", "unknown"), ("ref_dois", "array<string>", None), ("concepts", "array<struct<id:string,label:string,score:double>>", None)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value).cast(kind))
    rows = dedupe.keep_missing(rows, "doi", ["oa_id", "title"])
    rows = saved(dedupe.with_index(rows, ["doi", "oa_id", "title"]), "records")
    base = baselines.local_baselines(rows, ["domain_id", "year"], "c_use") if reference is None else reference
    metrics = normalise.with_baseline(rows, base, ["domain_id", "year"], config.ties)
    edges = saved(graph.citation_edges(rows), "edges")
    intervals = counting.bootstrap_intervals(metrics, ["domain_id", "year"], config.bootstrap)
    values = {**asdict(config), "quantile_method": "linear" if reference is None else "cdf_min"}
    return {
        "Records": bundle.core_columns(metrics.withColumn("is_focal", F.lit(True)) if "is_focal" not in metrics.columns else metrics),
        "Edges": edges.select(F.col("src").alias("citer_idx"), F.col("dst").alias("cited_idx")),
        "Network": graph.network_table(rows, edges, algo=config.communities, gamma=config.gamma, seed=config.seed),
        "Integer_Summary": counting.summary_with_intervals(metrics, intervals),
        "Fractional_Summary": counting.fractional_summary(counting.fractional_explode(metrics, config.level_weight)),
        "Baselines": base,
        "Run_Metadata": bundle.run_metadata(rows.sparkSession, values),
    }
