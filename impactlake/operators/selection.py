"""Selection of texts: ranked, per area, by quota, capped; reading lists. Every order ends in an id, so results are certain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impactlake.functions.text import hyperlink
from impactlake.operators.convert import download_lines
from impactlake.operators.units import z_scores

RANKING = ("cf", "c_use_window", "c_use", "pagerank", "betweenness")


def best_first(df: DataFrame, idx: str, ranking: tuple[str, ...] = RANKING) -> list:
    return [F.col(c).desc_nulls_last() for c in ranking if c in df.columns] + [F.col(idx).asc()]


def _ranked(df: DataFrame, area: str, idx: str, ranking) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(area).orderBy(*best_first(df, idx, ranking))))


def one_per_area(df: DataFrame, n: int, area: str, idx: str, ranking=RANKING) -> DataFrame:
    """The best row of each area, the n best of those."""
    return _ranked(df, area, idx, ranking).filter("_rn = 1").drop("_rn").orderBy(*best_first(df, idx, ranking)).limit(n)


def by_quota(df: DataFrame, n: int, area: str, idx: str, ranking=RANKING) -> DataFrame:
    """n rows shared out to areas in proportion to their size, largest remainders first (ties by area), best rows of each."""
    counts = df.groupBy(area).agg(F.count("*").alias("m"))
    total = counts.agg(F.sum("m")).first()[0] or 0  # one row
    share = counts.withColumn("x", F.lit(n) * F.col("m") / F.lit(max(1, total))).withColumn("q", F.floor("x")).withColumn("rest", F.col("x") - F.col("q"))
    given = share.agg(F.sum("q")).first()[0] or 0
    extra = F.row_number().over(Window.orderBy(F.col("rest").desc(), F.col(area))) <= n - given  # a row an area
    quota = share.select(F.col(area).alias("_area"), (F.col("q") + extra.cast("int")).alias("_q"))
    rows = _ranked(df, area, idx, ranking)
    return rows.join(quota, F.col(area).eqNullSafe(F.col("_area"))).filter("_rn <= _q").drop("_rn", "_q", "_area")


def capped(df: DataFrame, n: int, per_area: int, area: str, idx: str, ranking=RANKING) -> DataFrame:
    """The n best rows with at most per_area of one area."""
    return _ranked(df, area, idx, ranking).filter(F.col("_rn") <= per_area).drop("_rn").orderBy(*best_first(df, idx, ranking)).limit(n)


def per_area(df: DataFrame, n: int, area: str, idx: str, ranking=RANKING) -> DataFrame:
    """The n best rows of each area."""
    return _ranked(df, area, idx, ranking).filter(F.col("_rn") <= n).drop("_rn")


#: Rows an area may have in each reading list, and the weights of the last list's score.
READING_CAPS = {"core": 2, "recent": 2, "bridge": 1, "diversity": 1}
DIVERSITY = {"cf": 0.5, "c_use_window": 0.3, "pagerank": 0.2}


def reading_lists(df: DataFrame, area: str, idx: str, limit: int = 15, year: str = "year") -> DataFrame:
    """list, position and the rows of four lists, each the best `limit` under a cap per area.

    core goes by cf and then pagerank, recent by the citations in the window and then the year, bridge by betweenness,
    diversity by a weighted sum of z-scores; ties go to the smaller id. Columns that are missing count as 0.
    """
    need = ["cf", "pagerank", "c_use_window", "betweenness", year]
    full = df.withColumns({c: F.lit(0.0) for c in need if c not in df.columns})
    scored, out = z_scores(full, list(DIVERSITY)), None
    mixed = F.round(sum((w * F.col(f"z_{c}") for c, w in DIVERSITY.items()), F.lit(0.0)), 9)
    orders = {"core": ["cf", "pagerank"], "recent": ["c_use_window", year], "bridge": ["betweenness"], "diversity": [mixed]}
    for name, keys in orders.items():
        order = [*((F.col(k) if isinstance(k, str) else k).desc_nulls_last() for k in keys), F.col(idx)]
        rows = scored.withColumn("_rn", F.row_number().over(Window.partitionBy(area).orderBy(*order))).filter(F.col("_rn") <= READING_CAPS[name])
        top = rows.orderBy(*order).limit(limit)
        part = top.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("position"), *df.columns)  # `limit` rows
        out = part if out is None else out.unionByName(part)
    return out


def eligible(df: DataFrame) -> DataFrame:
    """Without retracted works and, where that is known, focal works only."""
    for column, keep in (("is_retracted", 0), ("is_focal", 1)):
        if column in df.columns:
            flag = F.col(column).cast("int")
            df = df.filter(flag == 1 if keep else F.coalesce(flag, F.lit(0)) != 1)
    return df


def for_download(parts: list[DataFrame], doi: str = "doi", title: str = "title") -> DataFrame:
    """The parts one below the other, the first of each (doi, title) in order of part and position; nulls are equal."""
    out = None
    for i, part in enumerate(parts):
        rows = part.withColumn("_part", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    order = [F.col("_part"), *([F.col("position").asc_nulls_first()] if "position" in out.columns else []), F.xxhash64(*[c for c in out.columns if c != "_part"])]
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy(doi, title).orderBy(*order))).filter("_rn = 1").drop("_rn", "_part")


def selection_bundle(df: DataFrame, mode: str, n: int, most_per_area: int, area: str = "area", idx: str = "idx", lists: bool = True) -> dict[str, DataFrame]:
    """The tables of a selection: links, the main selection of a mode A to D, the best of each area, the capped list, reading lists, download lines."""
    rows = eligible(df)
    modes = {"A": lambda: one_per_area(rows, n, area, idx), "B": lambda: by_quota(rows, n, area, idx), "C": lambda: capped(rows, n, most_per_area, area, idx), "D": lambda: per_area(rows, n, area, idx)}
    main = modes[mode]()
    out = {"Links": main.select(hyperlink(F.col("doi"), F.col("year"), F.col("title")).alias("link")), f"Main_Selection_Mode{mode}": main, f"Top{n}_Per_Area": modes["D"]()}
    if mode != "C":
        out["Top_Global_Capped"] = modes["C"]()
    parts = [main]
    if lists:
        read = reading_lists(rows, area, idx)
        for name in READING_CAPS:
            out[f"List_{name}"] = read.filter(F.col("list") == name).drop("list")
            parts.append(out[f"List_{name}"])
    out["For_Download"] = download_lines(for_download(parts))
    return out
