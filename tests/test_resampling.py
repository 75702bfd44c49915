"""Ranks over ranges, and draws down a tree against numpy's multinomial."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactlake.operators import baselines, counting
from impactlake.operators.resampling import ranked, resampled


def histogram(seed, kinds=300):
    rng = np.random.default_rng(seed)
    k = np.sort(rng.choice(5000, kinds, replace=False)).astype(float)
    return k, np.maximum(1, (rng.lognormal(1, 1.5, kinds)).astype(int))


def test_ranks_are_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("if(id % 10 = 0, 'small', 'big') g", "exp(pmod(xxhash64(id), 1000) / 25.0) v").groupBy("g", "v").agg(F.count("*").alias("n"))
        out = ranked(rows, ["g"], "v", "n").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, part in out.groupby("g"):
        part = part.sort_values("v")
        assert (part["_at"] == part["n"].cumsum() - part["n"]).all() and (part["_i"] == range(len(part))).all()
        assert set(part["_all"]) == {part["n"].sum()} and set(part["_kinds"]) == {len(part)}


def test_a_null_value_counts_nothing(spark):
    rows = spark.createDataFrame([(None, None, 4), (None, 1.0, 2), ("a", None, 3), (None, 3.0, 1)], "g string, v double, n long")
    got = {(r["g"], r["v"]): (r["_at"], r["_i"], r["_all"], r["_kinds"]) for r in ranked(rows, ["g"], "v", "n").collect()}
    assert got[None, 1.0] == (0, 0, 3, 2) and got[None, 3.0] == (2, 1, 3, 2) and got["a", None][2:] == (0, 0)


@pytest.mark.parametrize("fan", [1024, 7])
def test_draws_are_those_of_a_multinomial(spark, fan):
    k, n = histogram(1)
    replicates, shares = 3000, (0.5, 0.9, 0.99)
    hist = spark.createDataFrame([("a", float(x), int(m)) for x, m in zip(k, n)] + [(None, 2.0, 5)], "g string, k double, n long")
    found = resampled(hist, ["g"], replicates, 5, shares, fan=fan).toPandas()
    alone, own = found[found["g"].isna()], found[found["g"] == "a"]
    assert sorted(alone["r"]) == list(range(replicates)) and set(alone["mean"]) == {2.0} and all(set(q) == {2.0} for q in alone["q"])
    draws = np.random.default_rng(9).multinomial(n.sum(), n / n.sum(), size=replicates)
    means = draws @ k / n.sum()
    assert len(own) == replicates and abs(own["mean"].mean() - means.mean()) < 5 * means.std() / replicates**0.5
    assert abs(own["mean"].std() / means.std() - 1) < 0.08
    at = [k[np.minimum((draws.cumsum(axis=1) < s * n.sum()).sum(axis=1), len(k) - 1)] for s in shares]
    for j, want in enumerate(at):
        got = np.array([q[j] for q in own["q"]])
        assert abs(got.mean() - want.mean()) < 5 * max(want.std(), 1e-9) / replicates**0.5 * 2**0.5 + 1e-9
        assert abs(np.median(got) - np.median(want)) <= want.std() * 0.2 + 1e-9
    again = resampled(hist, ["g"], 20, 5, shares, fan=fan).orderBy("g", "r").collect()
    assert again == resampled(hist.repartition(5), ["g"], 20, 5, shares, fan=fan).orderBy("g", "r").collect()


def test_quantiles_of_a_draw_belong_to_the_draw(spark):
    """With one record all of a draw's quantiles are its mean; deep trees, ends of the range."""
    hist = spark.createDataFrame([("a", float(i), 1) for i in range(200)], "g string, k double, n long")
    for r in resampled(hist, ["g"], 200, 1, (0.01, 0.5, 1.0), most=1, fan=3).collect():
        assert set(r["q"]) == {r["mean"]}
    rows = resampled(hist, ["g"], 200, 1, (0.0, 1.0), fan=3).collect()
    assert all(0 <= r["q"][0] <= r["mean"] <= r["q"][1] < 200 for r in rows) and len({r["q"][1] for r in rows}) > 3


def test_interval_limits_are_near_numpys(spark):
    k, n = histogram(2, 100)
    rows = [("a", float(x), 40.0) for x, m in zip(k, n) for _ in range(m)]
    got = counting.bootstrap_intervals(spark.createDataFrame(rows, "g string, c_use double, c0_mean double"), ["g"], 4000).first()
    boots = np.random.default_rng(3).multinomial(n.sum(), n / n.sum(), size=4000) @ k / n.sum() / 40
    low, high = np.quantile(boots, [0.025, 0.975])
    assert abs(got["MNCS_low"] - low) < 0.05 * (high - low) + 0.02 * low and abs(got["MNCS_high"] - high) < 0.05 * (high - low) + 0.02 * high


def test_denominators_of_incomplete_baselines_are_drawn(spark):
    base = {2: 30, 4: 30, 60: 3}
    mean = sum(k * n for k, n in base.items()) / sum(base.values())
    rows = [(g, 10.0, mean, done, text) for g, done, text in (("complete", True, json.dumps(base)), ("open", False, json.dumps(base)), ("no counts", False, None), ("empty", False, "{}"), ("zero", False, '{"0": 5}')) for _ in range(20)]
    df = spark.createDataFrame(rows, "g string, c_use double, c0_mean double, c0_complete boolean, c0_counts_json string")
    got = {r["g"]: (r["MNCS_low"], r["MNCS_high"]) for r in counting.bootstrap_intervals(df, ["g"], 3000).collect()}
    fixed = 10 / mean
    assert all(np.allclose(got[g], (fixed, fixed)) for g in ("complete", "no counts", "empty", "zero"))
    k, n = np.array(list(base), float), np.array(list(base.values()))
    want = np.quantile(10 / (np.random.default_rng(1).multinomial(n.sum(), n / n.sum(), size=3000) @ k / n.sum()), [0.025, 0.975])
    assert got["open"][0] < fixed < got["open"][1] and np.allclose(got["open"], want, rtol=0.08)


def test_errors_of_baselines_are_near_numpys(spark):
    k, n = histogram(4, 150)
    hist = spark.createDataFrame([("a", float(x), int(m)) for x, m in zip(k, n)] + [("one", 3.0, 9), ("zero", 0.0, 9)], "g string, k double, n long")
    got = {r["g"]: r for r in baselines.baseline_errors(hist, ["g"], 2000).collect()}
    draws = np.random.default_rng(5).multinomial(n.sum(), n / n.sum(), size=2000)
    c0 = (n @ k) / n.sum()
    assert abs(got["a"]["err_c0_pct"] / (100 * (draws @ k / n.sum()).std(ddof=1) / c0) - 1) < 0.1
    at = lambda d, p: k[np.minimum((d.cumsum(axis=-1) < p * n.sum()).sum(axis=-1), len(k) - 1)]
    for name, p in baselines.TOPS.items():
        want = 100 * at(draws, p).std(ddof=1) / at(n, p)
        assert abs(got["a"][f"err_{name}_pct"] - want) < 0.15 * want + 0.1
    assert got["one"]["err_c0_pct"] == 0 and got["zero"]["err_top1_pct"] == 0
