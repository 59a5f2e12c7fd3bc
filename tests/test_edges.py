"""Values that are easy to get wrong: NaN, infinity, truth values, large degrees of freedom, short periods."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeglass.functions.distributions import _uniform_tail, chi2_tail
from lodeglass.operators import documents, periods, profile, quantiles, statistics
from lodeglass.plans.chaid import chaid_tree
from lodeglass.plans.cleaning import Step, clean_dataset
from lodeglass.streaming import incremental

NAN, INF = float("nan"), float("inf")


def cleaned(spark, kind, values, **options):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    step = Step("winsorise" if "low" in options else "fill", ["v"], options)
    return [r["v"] for r in clean_dataset(rows, [step])[0].collect()]


def test_fills_ignore_nan_and_round_integers(spark):
    got = cleaned(spark, "double", [1.0, 3.0, NAN, None], **{"with": "mean"})
    assert sorted(map(str, got)) == ["1.0", "2.0", "3.0", "nan"]
    assert sorted(cleaned(spark, "int", [1, 2, None], **{"with": "median"})) == [1, 2, 2]


def test_winsorising_leaves_nan(spark):
    got = cleaned(spark, "double", [0.0, 1.0, 2.0, 3.0, 100.0, NAN, None], low=0.25, high=0.75)
    assert sorted(map(str, got)) == ["1.0", "1.0", "2.0", "3.0", "3.0", "None", "nan"]


def test_infinite_values_have_bins_of_their_own(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 3.0, INF, -INF, INF, NAN, None)], "v double")
    rows = {r["bin"]: tuple(r)[1:] for r in statistics.histogram(df, "v", 2).collect()}
    assert rows == {0: (-INF, -INF, 1), 1: (1.0, 2.0, 1), 2: (2.0, 3.0, 1), 3: (INF, INF, 2)}
    only = spark.createDataFrame([(INF,)], "v double")
    assert [tuple(r) for r in statistics.histogram(only, "v", 2).collect()] == [(3, INF, INF, 1)]


def test_truth_values_as_target(spark):
    rows = [(f"g{i % 2}", i % 2 == 0 or i % 10 == 1) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, hit boolean")
    root = chaid_tree(df, "hit", True, ["g"]).nodes[0]
    assert root.rate == pytest.approx(0.6)
    with pytest.raises(ValueError, match="maybe"):
        chaid_tree(df, "hit", "maybe", ["g"])


@pytest.mark.parametrize("df", [1, 2, 3, 10, 99, 100])
@pytest.mark.parametrize("x", [0.01, 0.5, 3.0, 50.0, 130.0])
def test_chi_squared_tail_by_finite_sums(x, df):
    half = x / 2
    start, total = (0.0, 0.0) if df % 2 == 0 else (0.5, math.erfc(math.sqrt(half)))
    while start < df / 2:
        total += math.exp(start * math.log(half) - half - math.lgamma(start + 1))
        start += 1
    assert chi2_tail(x, df) == pytest.approx(min(total, 1.0), rel=1e-9, abs=1e-15)


def test_chi_squared_tail_of_many_degrees_is_quick_and_continuous():
    for df in (10**5, 10**6 - 1, 10**6, 10**10):
        assert chi2_tail(float(df), df) == pytest.approx(0.5, abs=2e-3)
        assert chi2_tail(df + 3 * math.sqrt(2 * df), df) == pytest.approx(0.00135, abs=1e-4)
    assert chi2_tail(1e6, 10**6 - 1) == pytest.approx(chi2_tail(1e6, 10**6), abs=1e-3)
    for z in (-5, -1, -0.01, 0, 0.01, 1, 5):  # both formulas at the seam
        x = 999_999 + z * math.sqrt(2 * 999_999)
        assert _uniform_tail(999_999 / 2, x / 999_999 - 1) == pytest.approx(chi2_tail(x, 999_999), rel=1e-8)
    assert (chi2_tail(INF, 3), chi2_tail(0.0, 3), chi2_tail(NAN, 3), chi2_tail(1.0, 0)) == (0.0, 1.0, None, None)


def test_units_below_a_day_are_refused(spark):
    df = spark.createDataFrame([(1,)], "v int").select(F.current_timestamp().alias("ts"), "v")
    with pytest.raises(ValueError, match="hour"):
        periods.trend(df, F.lit("s"), F.col("ts"), F.col("v"), "hour")


def test_headings_stand_on_the_first_part_wherever_it_starts(spark):
    rows = spark.createDataFrame([("p", 1001, "a"), ("p", 2500, "b"), ("q", 1, "c")], "project string, seq long, task string")
    got = {(r["project"], r["part"]): r["digest"] for r in documents.task_digest(rows, "project", "seq", "task").collect()}
    titled = {k for k, v in got.items() if v.startswith(documents.DIGEST_HEADING)}
    assert titled == {("p", 0), ("q", 0)} == got.keys()


def test_fences_of_infinite_and_all_null_columns(spark):
    rows = [(float(i), None, INF if i == 3 else -INF if i == 4 else float(i)) for i in range(12)] + [(NAN, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for method in ("iqr", "zscore"):
        got = {r["column"]: r for r in statistics.outlier_flags(df, ["a", "b", "c"], method).collect()}
        assert (got["a"]["n_low"], got["a"]["n_high"]) == (0, 0)
        assert tuple(got["b"]) == ("b", None, None, 0, 0)
        assert math.isfinite(got["c"]["low"]) and (got["c"]["n_low"], got["c"]["n_high"]) == (1, 1)
        flagged = {(r["column"], r["value"]) for r in statistics.outlier_rows(df, "a", ["a", "b", "c"], method).collect()}
        assert flagged == {("c", INF), ("c", -INF)}
    by = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", None), (None, 3.0)], "g string, v double")
    got = {r["g"]: tuple(r)[2:] for r in statistics.outlier_flags(by, ["v"], by=["g"]).collect()}
    assert got == {"x": (0.5, 2.5, 0, 0), "y": (None, None, 0, 0), None: (3.0, 3.0, 0, 0)}


def test_extremes_in_their_own_type(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "1.50", INF), (-big, "-2.25", 1.0), (None, None, None)], "a long, b string, c double")
    df = df.withColumn("b", F.col("b").cast("decimal(30,2)"))
    got = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert (got["a"]["min_exact"], got["a"]["max_exact"]) == (str(-big), str(big))
    assert (got["b"]["min_exact"], got["b"]["max_exact"]) == ("-2.25", "1.50")
    assert (got["c"]["min_exact"], got["c"]["max"], got["c"]["mean"], got["c"]["std"]) == (None, INF, INF, None)
    stats = incremental.merge_stats(incremental.batch_stats(df, ["a", "b", "c"])).collect()
    exact = {r["column"]: (r["min_exact"], r["max_exact"]) for r in stats}
    assert exact["a"] == (-big, big) and float(exact["b"][1]) == 1.5 and exact["c"] == (None, None)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_of_small_sketches_and_skewed_groups(spark, accuracy):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.lognormal(size=4000)] + [("same", 7.0)] * 500 + [("one", 1.0), (None, 2.0)]
    rows += [("wide", v) for v in (-INF, -1e308, 1e308, INF, 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r for r in quantiles.quantiles_by(df, ["g"], "v", probs, accuracy=accuracy).collect()}
    for g in ("hot", "same", "one", None):
        mine = [v for k, v in rows if k == g]
        want = np.quantile(mine, probs)
        assert [got[g][quantiles.quantile_name(p)] for p in probs] == pytest.approx(list(want))
    assert (got["wide"]["q0"], got["wide"]["q0_5"], got["wide"]["q1"]) == (-INF, 0.0, INF)
