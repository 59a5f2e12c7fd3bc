"""Profiles on edge frames, exact quantiles, positions and totals."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeglass.operators import ordering, profile, sampling
from lodeglass.operators.quantiles import quantiles_by
from lodeglass.plans import overview

NAN = float("nan")


def rows_by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a int, b string, c timestamp, d boolean")
    assert profile.dataset_shape({"x": df}).first().asDict() == {"dataset": "x", "n_rows": 0, "n_cols": 4}
    assert rows_by_column(profile.null_counts(df))["a"] == {"column": "a", "null_count": 0, "null_pct": None}
    numeric = profile.numeric_profile(df).first().asDict()
    assert numeric["count"] == 0 and numeric["p50"] is None and numeric["mean"] is None
    assert profile.numeric_profile(df).first()["p50"] is None
    assert profile.string_profile(df).first()["n_unique"] == 0
    assert profile.temporal_profile(df).first()["min"] is None
    assert profile.boolean_profile(df).first()["true_share"] is None
    assert sampling.json_sample(df, ["a"]).first()["json"] == "[]"


def test_nan_is_counted_and_left_out(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (3.0,), (None,)], "a double")
    got = profile.numeric_profile(df).first().asDict()
    assert (got["count"], got["null_count"], got["nan_count"]) == (3, 1, 1)
    assert (got["mean"], got["min"], got["p50"], got["max"]) == (2.0, 1.0, 2.0, 3.0)
    assert got["std"] == pytest.approx(math.sqrt(2))


def test_one_row_all_null_and_constant(spark):
    one = spark.createDataFrame([(5, None, 2)], "a int, b int, c int")
    got = rows_by_column(profile.numeric_profile(one))
    assert got["a"]["std"] is None and got["a"]["p25"] == 5.0
    assert got["b"]["count"] == 0 and got["b"]["max"] is None
    constant = spark.createDataFrame([(7,)] * 5, "a int")
    assert profile.numeric_profile(constant).first()["std"] == 0.0


def test_count_plus_nulls_is_rows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.nullif("event_type", F.lit("error")).alias("kind"), F.when(F.col("value") > 5, F.col("value")).alias("v")
    )
    n = events.count()
    both = profile.string_profile(events).collect() + profile.numeric_profile(events).collect()
    assert all(r["count"] + r["null_count"] == n for r in both)


def test_dotted_and_spaced_names(spark):
    df = spark.createDataFrame([(1, "x")], ["a.b", "c d"])
    assert set(rows_by_column(profile.null_counts(df))) == {"a.b", "c d"}
    assert profile.numeric_profile(df).first()["column"] == "a.b"
    assert profile.schema_listing(df).count() == 2


def test_batches_of_columns_agree(spark):
    df = spark.range(20).select(*[(F.col("id") * i).alias(f"c{i:03d}") for i in range(120)])
    got = rows_by_column(profile.null_counts(df))
    assert len(got) == 120 and all(r["null_count"] == 0 for r in got.values())


def test_json_sample_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(3, None), (1, 'q"é'), (2, "b")], "a int, b string")
    assert sampling.json_sample(df, ["a"], 3).first()["json"] == '[{"a":1,"b":"q\\"é"},{"a":2,"b":"b"},{"a":3,"b":null}]'


def test_scatter_sample_is_repeatable(spark):
    df = spark.range(1000).withColumn("y", F.col("id") * 2)
    a = sampling.chart_data_scatter(df, "id", "id", "y", n=50).collect()
    b = sampling.chart_data_scatter(df.repartition(7), "id", "id", "y", n=50).collect()
    assert len(a) == 50 and sorted(a) == sorted(b)


def test_combined_profile_has_every_kind(spark):
    df = spark.createDataFrame([(1, "a", True)], "n int, s string, b boolean")
    texts = spark.createDataFrame([("t.txt", "x" * 300)], "name string, text string")
    out = overview.combined_profile({"d": df}, overview.texts_long(texts, F.col("name"), "text"))
    got = {(r["kind"], r["stat"]): r for r in out.collect()}
    assert got[("text", "text_length")]["value_num"] == 300
    assert got[("text", "snippet")]["value_str"] == "x" * 200 + "..."
    assert got[("boolean", "true_share")]["value_num"] == 1.0
    assert ("numeric", "p50") in got and ("string", "min") in got


# ---- exact quantiles without an in-memory value map --------------------------------------------

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


def both_ways(df, group, accuracy):
    """By brackets, and by the built-in that holds whole groups."""
    order = group or ["n"]
    wide = quantiles_by(df, group, "v", PROBS, accuracy=accuracy).orderBy(*order).collect()
    kept = df.where("v is not null and not isnan(v)").groupBy(*group)
    cuts = F.array(*[F.lit(p) for p in PROBS])
    found = kept.agg(F.count("*").alias("n"), F.percentile("v", cuts).alias("q")).orderBy(*order)
    plain = found.select(*group, "n", *[F.col("q")[i] for i in range(len(PROBS))]).collect()
    return [tuple(r) for r in wide], [tuple(r) for r in plain]


@pytest.mark.parametrize("accuracy", [100, 10000])
def test_quantiles_with_skew_and_ties(spark, accuracy):
    random.seed(7)
    rows = [("hot", float(random.choice([1, 1, 1, 2, 5]))) for _ in range(4000)]
    rows += [(f"g{i % 7}", random.gauss(0, 100)) for i in range(4000)]
    rows += [("one", 3.5), (None, 1.0), (None, 2.0), ("nan", NAN), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    wide, plain = both_ways(df, ["g"], accuracy)
    assert len(wide) == 10
    for a, b in zip(wide, plain):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
    wide, plain = both_ways(df, [], accuracy)
    assert wide[0] == pytest.approx(plain[0], abs=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=400))
def test_quantiles_match_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wide, plain = both_ways(df, [], 50)
    assert wide[0] == pytest.approx(plain[0], rel=1e-12, abs=1e-9)


# ---- positions ---------------------------------------------------------------------------------


def test_number_within_matches_window_with_a_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        F.hash("id").alias("o"),
        "id",
    )
    df = df.withColumn("g", F.when(F.col("g") != 7, F.col("g")))
    got = ordering.number_within(df, ["g"], [F.col("o"), F.col("id")], "at")
    wanted = got.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert got.count() == 20000
    assert wanted.where("at <> w").count() == 0


def test_running_total_matches_window(spark):
    df = spark.range(5000).select("id", (F.hash("id") % 100).cast("long").alias("w"))
    got = ordering.running_total(df, [F.col("id").desc()], "w", "upto")
    wanted = got.withColumn("x", F.sum("w").over(Window.orderBy(F.col("id").desc())))
    assert got.count() == 5000 and wanted.where("upto <> x").count() == 0


def test_number_rows_of_an_empty_frame(spark):
    assert ordering.number_rows(spark.range(0), [F.col("id")], "at").count() == 0


def test_approximate_profile_covers_all_numbers(spark, tmp_path):
    """Keys and prices are profiled and their sketched quartiles judged, not only columns of few values."""
    from lodeglass.workload import tables

    n = F.col("id")
    spark.range(9_000).select(
        n.alias("l_orderkey"), (n % 3_000).alias("l_partkey"), (n % 10).alias("l_suppkey"),
        (n % 7 + 1).cast("int").alias("l_linenumber"), (n % 50 + 1.0).alias("l_quantity"), (n * 1.5).alias("l_extendedprice"),
        (n % 11 / 100).alias("l_discount"), (n % 9 / 100).alias("l_tax"), F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.lit("1996-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows_by_column(tables.numeric_profile_approx(spark, str(tmp_path)))
    assert got.keys() == set(tables.GAPPY_NUMBERS) and all(r["close"] for r in got.values())
    assert got["l_extendedprice"]["max"] == 8_999 * 1.5 and got["l_orderkey"]["mean"] == 4_499.5
    assert got["l_linenumber"]["p50"] == 4.0 and got["l_orderkey"]["p50"] is None
