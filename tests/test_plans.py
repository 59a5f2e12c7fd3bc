"""Plans: what reaches the scan, what is shuffled, and where rows could pile up."""

import re

import pytest
from pyspark.sql import functions as F

from lodeglass.operators import documents, profile, quality, replies, sampling, statistics
from lodeglass.plans import cleaning


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def read_columns(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


def test_profile_reads_its_columns_once(lineitem):
    plan = plan_of(profile.numeric_profile(lineitem, ["l_tax", "l_discount"], mode="approx"))
    assert read_columns(plan) == [{"l_tax", "l_discount"}]
    assert plan.count("Exchange ") == 1


def test_distinct_counts_do_not_expand_rows(lineitem):
    plan = plan_of(profile.n_unique(lineitem, ["l_partkey", "l_suppkey"]))
    assert "Expand" not in plan
    assert read_columns(plan) == [{"l_partkey", "l_suppkey"}]


def test_correlation_is_one_narrow_scan(lineitem, monkeypatch):
    seen = []
    real = statistics.materialise
    monkeypatch.setattr(statistics, "materialise", lambda df, label="step": seen.append(plan_of(df)) or real(df, label))
    statistics.correlation_matrix(lineitem, ["l_tax", "l_discount", "l_quantity"])
    assert len(seen) == 1 and read_columns(seen[0]) == [{"l_tax", "l_discount", "l_quantity"}]
    assert "Exchange" not in seen[0] and "Generate" not in seen[0]


def test_filters_reach_the_scan(lineitem):
    plan = plan_of(statistics.two_sample_test(lineitem, "l_returnflag", "l_tax", "A", "R"))
    assert "In(l_returnflag, [A,R])" in plan
    assert read_columns(plan) == [{"l_returnflag", "l_tax"}]


def test_head_sample_keeps_n_per_task(lineitem):
    plan = plan_of(sampling.head_sample(lineitem, ["l_orderkey", "l_linenumber"]))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_top_items_limits_groups_before_the_shuffle(lineitem):
    plan = plan_of(statistics.top_items(lineitem, "l_returnflag", "l_partkey", F.sum("l_tax"), 3))
    assert plan.count("WindowGroupLimit") == 2


def test_texts_are_cut_without_a_shuffle(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    for df in (replies.task_blocks(talk, "conv_id", "text"), replies.response_sections(talk, "conv_id", "text")):
        assert "Exchange" not in plan_of(df)


def test_features_are_one_projection(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    df = cleaning.feature_columns(orders, dates=["o_orderdate"], bins={"b": ("o_totalprice", [1.0, 2.0])})
    assert "Exchange" not in plan_of(df)


def test_fragments_group_by_bounded_parts(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    plan = plan_of(documents.fragment_concat(talk, "conv_id", "turn", "text"))
    assert re.search(r"keys=\[doc#\d+L, part#\d+L\]", plan)


def test_unique_rows_are_shuffled_as_hashes_only(spark, sf, monkeypatch):
    seen = []
    real = quality.materialise
    monkeypatch.setattr(quality, "materialise", lambda df, label="step": seen.append(plan_of(df)) or real(df, label))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = quality.duplicate_rows(docs, ["text"])
    assert re.search(r"Exchange hashpartitioning\(_h#\d+L", seen[0])
    assert not re.search(r"Exchange hashpartitioning\(text", seen[0])
    # rows reach the second shuffle through the broadcast bit map, merged before it
    plan = plan_of(found)
    exchange = plan.index("Exchange hashpartitioning(text")
    assert plan.index("HashAggregate(keys=[text", exchange) < plan.index("BroadcastHashJoin", exchange)
    rows = found.collect()
    assert all(r["n"] > 1 for r in rows)
    unique = docs.groupBy("text").count().where("count = 1").count()
    passed = found._jdf.queryExecution().optimizedPlan()  # the filter that only suspects pass
    assert "shiftright" in passed.toString() and unique > 0


def test_table_profile_is_one_scan(lineitem):
    from lodeglass.plans.overview import profile_long

    plan = plan_of(profile_long(lineitem, "lineitem"))
    assert plan.count("Scan parquet") == 1
