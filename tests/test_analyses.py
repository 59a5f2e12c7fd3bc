"""Statistics, quality, cleaning, documents and the tree on small frames with known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeglass.functions.distributions import chi2_tail
from lodeglass.operators import documents, periods, quality, statistics
from lodeglass.operators.profile import dataset_shape
from lodeglass.plans import chaid, cleaning, overview, segments
from lodeglass.plans.cleaning import Step


def test_chi2_tail_known_values():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi2_tail(16.918977604620448, 9) == pytest.approx(0.05)
    assert chi2_tail(0.0, 4) == 1.0
    assert chi2_tail(5000.0, 3) == pytest.approx(0.0)
    assert chi2_tail(1.0, 0) is None and chi2_tail(None, 2) is None


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1, 2.0, 5, None), (2, 4.0, 5, 1), (3, 6.0, 5, None)], "a int, b double, c int, d int")
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in statistics.correlation_matrix(df, ["d", "c", "b", "a"]).collect()}
    assert len(got) == 6
    assert got[("a", "b")] == (3, pytest.approx(1.0))
    assert got[("a", "c")] == (3, None)
    assert got[("a", "d")] == (1, None)
    assert statistics.correlation_matrix(df.limit(0), ["a", "b"]).first().asDict() == {
        "x": "a",
        "y": "b",
        "n": 0,
        "r": None,
    }


def masked_pearson(x, y):
    both = np.isfinite(x) & np.isfinite(y)
    x, y = x[both], y[both]
    if not len(x) or np.ptp(x) == 0 or np.ptp(y) == 0:
        return len(x), None
    return len(x), np.corrcoef(x, y)[0, 1]


@pytest.mark.parametrize("block", [1024, 7, 3])
def test_two_hundred_columns_pairwise_complete(spark, block):
    rng = np.random.default_rng(1)
    k = 200 if block == 1024 else 20
    values = rng.normal(size=(400, k)).cumsum(axis=1) + rng.choice([0.0, 1e9, -1e6], k)
    values[rng.random(values.shape) < 0.3] = np.nan
    values[:, 3], values[:, 5], values[5, 7] = np.nan, 0.1, np.inf
    names = [f"c{i:03}" for i in range(k)]
    rows = [[None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)] for r in values]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(6)
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in statistics.correlation_matrix(df, names, block).collect()}
    assert len(got) == k * (k - 1) // 2
    for i, j in itertools.combinations(range(k), 2):
        n, r = got[names[i], names[j]]
        want_n, want = masked_pearson(values[:, i], values[:, j])
        assert n == want_n and (r is None) == (want is None)
        assert r is None or r == pytest.approx(want, abs=1e-6)


def test_correlation_of_few_columns(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    assert statistics.correlation_matrix(df, ["a"]).count() == statistics.correlation_matrix(df, []).count() == 0


def test_frequency_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), (None,), ("c",)], "v string")
    full = statistics.frequency_counts(df, "v").orderBy("rank").collect()
    assert [(r["value"], r["n"], r["rank"]) for r in full] == [("b", 2, 1), (None, 2, 2), ("a", 1, 3), ("c", 1, 4)]
    assert sum(r["share"] for r in full) == pytest.approx(1.0)
    top = statistics.frequency_counts(df, "v", top_k=2).orderBy("rank").collect()
    assert [tuple(r) for r in top] == [tuple(r) for r in full[:2]]


def test_histogram_edges(spark):
    values = [0.0, 0.5, 9.9, 10.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = statistics.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 0, 0, 0, 2]
    constant = spark.createDataFrame([(3,)] * 4, "v int")
    assert [tuple(r) for r in statistics.histogram(constant, "v").collect()] == [(1, 3.0, 3.0, 4)]
    assert statistics.histogram(df.limit(0), "v").count() == 0


def test_linear_fit_constant_x(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["group"]: r for r in statistics.linear_fit(df, F.col("x"), F.col("y"), F.col("g")).collect()}
    assert got["a"]["slope"] is None and got["a"]["n"] == 2
    assert (got["b"]["slope"], got["b"]["intercept"], got["b"]["r2"]) == (2.0, 0.0, 1.0)


def test_zscore_without_spread_flags_nothing(spark):
    df = spark.createDataFrame([(5,)] * 4, "v int")
    row = statistics.outlier_flags(df, ["v"], "zscore").first()
    assert (row["low"], row["n_low"], row["n_high"]) == (None, 0, 0)


def test_chi2_degenerate_and_independent(spark):
    one = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "a string, b string")
    row = statistics.contingency_chi2(one, "a", "b").first()
    assert (row["chi2"], row["df"], row["n"], row["p_value"]) == (None, None, 2, None)
    even = spark.createDataFrame([(a, b) for a in "pq" for b in "xyz"] * 5, "a string, b string")
    row = statistics.contingency_chi2(even, "a", "b").first()
    assert row["chi2"] == pytest.approx(0.0, abs=1e-12) and row["p_value"] == pytest.approx(1.0)
    sparse = spark.createDataFrame([("p", "x")] * 10 + [("q", "y")] * 10, "a string, b string")
    row = statistics.contingency_chi2(sparse, "a", "b").first()
    assert row["chi2"] == pytest.approx(20.0) and row["cramers_v"] == pytest.approx(1.0)


def test_two_sample_needs_two_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    row = statistics.two_sample_test(df, "g", "v", "a", "b").first()
    assert (row["n_a"], row["n_b"], row["mean_diff"], row["t"]) == (1, 2, -2.0, None)


def test_crosstab_margins(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "a string, b string")
    got = statistics.crosstab_shares(df, "a", "b").collect()
    assert sum(r["total_share"] for r in got) == pytest.approx(1.0)
    assert len(got) == 3


def test_compare_items_with_one_category(spark):
    df = spark.range(3000).select(F.lit("c").alias("cat"), (F.col("id") % 300).alias("item"), F.lit(1.0).alias("v"))
    got = statistics.compare_items(df, "cat", "item", {"total": F.sum("v")}, "total").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 301))
    assert [r["item"] for r in got] == list(range(300))
    assert sum(r["share"] for r in got) == pytest.approx(1.0)


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "y")], "a int, b string")
    assert [tuple(r) for r in quality.duplicate_rows(df).collect()] == [(1, None, 2)]


def test_key_coverage_null_keys(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k int")
    row = quality.key_coverage(left, right, ["k"]).first().asDict()
    assert row == {"matched_left": 2, "left_only": 3, "right_only": 3, "left_dup_keys": 1, "right_dup_keys": 1}
    with pytest.raises(ValueError):
        quality.relate_datasets(left, right, ["k"], "cross")


def test_trend_fills_gaps(spark):
    rows = [("a", "2024-01-15", 1.0), ("a", "2024-04-02", 3.0), ("b", "2024-02-01", 2.0), ("a", None, 9.0)]
    df = spark.createDataFrame(rows, "s string, d string, v double").withColumn("d", F.col("d").cast("date"))
    got = periods.trend(df, F.col("s"), F.col("d"), F.col("v")).orderBy("series", "period").collect()
    assert [(str(r["period"]), r["total"], r["change"]) for r in got if r["series"] == "a"] == [
        ("2024-01-01", 1.0, None),
        ("2024-02-01", 0.0, -1.0),
        ("2024-03-01", 0.0, 0.0),
        ("2024-04-01", 3.0, 3.0),
    ]
    zero = df.withColumn("v", F.lit(0.0))
    assert periods.seasonal_index(zero, F.col("s"), F.col("d"), F.col("v")).first()["index"] is None


# ---- cleaning ----------------------------------------------------------------------------------


def test_cleaning_steps_and_log(spark):
    rows = [(1, " a ", "5"), (2, "N/A", "x"), (3, "a", None), (4, "b", "7"), (5, "b", "100")]
    df = spark.createDataFrame(rows, "k int, s string, v string")
    steps = [
        Step("trim", ["s"]),
        Step("null_tokens", ["s"], {"tokens": ["n/a"]}),
        Step("cast", ["v"], {"type": "int"}),
        Step("fill", ["v"], {"with": "median"}),
        Step("drop_null", ["s"]),
        Step("dedup", ["s"], {"order": ["k"]}),
        Step("winsorise", ["v"], {"low": 0.0, "high": 0.5}),
    ]
    cleaned, log = cleaning.clean_dataset(df, steps)
    assert sorted(tuple(r) for r in cleaned.collect()) == [(1, "a", 5), (4, "b", 6)]
    assert dict(cleaned.dtypes) == {"k": "int", "s": "string", "v": "int"}
    got = [(r["step"].split(". ")[1], r["rows_before"], r["rows_after"], r["cells_changed"]) for r in log.collect()]
    assert got == [
        ("trim s", 5, 5, 1),
        ("null_tokens s", 5, 5, 1),
        ("cast v", 5, 5, 1),
        ("fill v", 5, 5, 2),
        ("drop_null s", 5, 4, 0),
        ("dedup s", 4, 2, 0),
        ("winsorise v", 2, 2, 1),
    ]


def test_features_guard_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0, "a"), (4, 2, None), (None, 1, "z")], "n int, d int, c string")
    got = cleaning.feature_columns(
        df, bins={"band": ("n", [1.0, 3.0])}, ratios={"r": ("n", "d")}, flags={"is_": ("c", ["a", "b"])}
    ).collect()
    assert [(r["band"], r["r"], r["is_0"], r["is_1"]) for r in got] == [(1, None, 1, 0), (2, 2.0, 0, 0), (None, None, 0, 0)]


# ---- documents ---------------------------------------------------------------------------------


def test_long_documents_come_in_parts(spark):
    df = spark.range(25).select(F.lit("d").alias("doc"), "id", F.concat(F.lit("p"), "id").alias("text"))
    got = documents.fragment_concat(df.repartition(5), "doc", "id", "text", span=10).orderBy("part").collect()
    assert [r["part"] for r in got] == [0, 1, 2]
    assert "\n".join(r["text"] for r in got) == "\n".join(f"p{i}" for i in range(25))


@pytest.mark.parametrize("span", [1, 3, 10, 1000, None])
def test_parts_hold_any_positions_in_order(spark, span):
    rng = np.random.default_rng(3)
    rows = []
    for doc in range(6):
        places = sorted({int(p) for p in rng.choice([0, 1, 2, 3, 50, 51, 5000, -7, 10**12], rng.integers(1, 9))})
        rows += [(doc, p, f"{doc}:{p}") for p in places]
    rows += [(9, p, str(p)) for p in range(25)]
    df = spark.createDataFrame(rows, "doc int, s long, t string").repartition(5)
    parts = documents.fragment_concat(df, "doc", "s", "t", span=span).collect()
    for doc in {r[0] for r in rows}:
        mine = sorted((r["part"], r["text"]) for r in parts if r["doc"] == doc)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert "\n".join(t for _, t in mine) == "\n".join(t for d, _, t in sorted(rows) if d == doc)
        assert span is None or all(t.count("\n") + 1 < 2 * span or span == 1 for _, t in mine)
    if span == 10:
        assert len([r for r in parts if r["doc"] == 9]) == 3


@pytest.mark.parametrize("span", [1000, None])
def test_null_and_repeated_positions_are_refused(spark, span):
    for rows, message in (([(1, None)], "null"), ([(1, 4), (1, 4)], "twice")):
        df = spark.createDataFrame([(*r, "t") for r in rows], "doc int, s long, t string")
        with pytest.raises(Exception, match=message):
            documents.fragment_concat(df, "doc", "s", "t", span=span).collect()
    empty = spark.createDataFrame([], "doc int, s long, t string")
    assert documents.fragment_concat(empty, "doc", "s", "t", span=span).count() == 0


def test_one_context_of_tables_and_texts(spark):
    texts = spark.createDataFrame([(7, "b"), (3, "a")], "position long, block string")
    datasets = {"x": spark.range(2)}
    shapes = dataset_shape(datasets)
    row = documents.context_render(datasets, shapes, texts, span=None).collect()
    assert [tuple(r) for r in row] == [(0, 0, "\nFile: x\n- Columns: ['id']\n- Shape: (2, 1)\nab")]
    assert documents.context_render({}, None).first()["context"] == documents.NO_FILES


def test_summary_of_nothing_and_of_empty_tables(spark):
    assert overview.profile_summary({}).first()["summary"] == overview.NO_SUMMARY
    empty = spark.createDataFrame([], "a double, b string")
    text = overview.profile_summary({"e": empty}).first()["summary"]
    assert text == "\n## Profile: e\nShape: (0, 2)\nColumns: a, b\n- a (double): 0 missing\n- b (string): 0 missing\n"


def test_task_prompts_need_every_placeholder(spark):
    tasks = spark.createDataFrame([("p", 1, "do {it}")], "project string, seq long, task_to_execute string")
    digests = spark.createDataFrame([], "project string, digest string")
    data = {"x": spark.range(3)}
    row = overview.task_prompts(tasks, "{task_to_execute}|{previous_results_summary}|{data_sample}|{available_columns}|{file_names}",
                                data, ["id"], digests, "none", 2).first()
    assert row["prompt"] == 'do {it}|none|[{"id":0},{"id":1}]|id|x'
    with pytest.raises(KeyError):
        overview.task_prompts(tasks, "{mood}", data, ["id"], digests, "none")


def test_empty_fragments(spark):
    df = spark.createDataFrame([("d", 0, "a"), ("d", 1, ""), ("d", 2, None), ("d", 3, "b")], "doc string, s int, t string")
    assert documents.fragment_concat(df, "doc", "s", "t").first()["text"] == "a\n\n\nb"
    assert documents.fragment_concat(df, "doc", "s", "t", "pages").first()["text"] == "a\nb\n"


def test_results_markdown_rules(spark):
    rows = [
        ("p", 1, None, [], " a \n", "", None, "i", None),
        ("p", 2, "Title", ["x", "y"], None, "c\n", "r", "", "fig.html"),
    ]
    schema = (
        "project string, seq long, task string, files array<string>, approach string, code string, "
        "results_text string, insights string, figure_file string"
    )
    results = spark.createDataFrame(rows, schema)
    wanted = (
        "## Analysis Results Summary\n\n### Task 1: Task 1\n**Approach:**\na\n**Key Insights:**\ni\n\n---\n\n"
        "### Task 2: Title\n**Files Used:** x, y\n**Python Code:**\n```python\nc\n```\n**Results:**\nr\n"
        "**Figure File:** fig.html\n\n---"
    )
    assert documents.results_markdown(results).first()["markdown"] == wanted
    halves = documents.results_markdown(results, span=1).orderBy("part").collect()
    assert "\n\n".join(r["markdown"] for r in halves) == wanted


def test_results_field_falls_back_to_results(spark):
    results = spark.createDataFrame([("p", 1, "", "old")], "project string, seq long, results_text string, results string")
    assert "**Results:**\nold" in documents.results_markdown(results).first()["markdown"]


def test_digest_and_empty_projects(spark):
    results = spark.createDataFrame([("p", 1, "x" * 70), ("p", 2, None)], "project string, seq long, task string")
    parts = documents.task_digest(results, "project", "seq", "task")
    projects = spark.createDataFrame([("p",), ("q",)], "project string")
    got = documents.with_empty_projects(parts, projects, "digest", documents.NO_PREVIOUS_TASKS)
    assert {r["project"]: r["digest"] for r in got.collect()} == {
        "p": "Summary of Previous Tasks:\n- Task 1: " + "x" * 60 + "...\n- Task 2: N/A...",
        "q": "No previous analysis tasks completed in this session.",
    }


def test_context_without_files(spark):
    none = spark.createDataFrame([], "position long, block string")
    for texts in (None, none):
        assert [r["context"] for r in documents.context_render({}, None, texts).collect()] == ["No data files loaded."]


# ---- tree and segments -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def loans(spark):
    return spark.range(3000).select(
        "id",
        (F.col("id") % 100).cast("double").alias("income"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("r"), F.col("id") % 3)).alias("region"),
        F.when((F.col("id") % 100 < 20) | (F.col("id") % 50 == 3), 1).otherwise(0).alias("bad"),
    )


@pytest.fixture(scope="module")
def tree(loans):
    return chaid.chaid_tree(loans, "bad", 1, ["income", "region"], max_depth=2)


def test_tree_splits_on_what_matters(tree):
    root = tree.nodes[0]
    children = [n for n in tree.nodes if n.parent_id == 0]
    assert root.n == 3000 and not root.leaf
    assert {n.split_column for n in children} == {"income"}
    assert sum(n.n for n in children) == root.n
    assert sum(n.n * n.rate for n in tree.leaves()) == pytest.approx(root.n * root.rate)
    assert all(n.adj_p <= 0.05 for n in children)
    assert all(n.n >= 30 for n in tree.leaves())


def test_leaves_partition_the_rows(loans, tree):
    routed = chaid.apply_policy(loans, "id", tree, 0.2, 0.5)
    sizes = {r["leaf_id"]: r["count"] for r in routed.groupBy("leaf_id").count().collect()}
    assert sizes == {n.node_id: n.n for n in tree.leaves()}
    assert routed.where("decision is null").count() == 0
    policy = {r["leaf_id"]: r["decision"] for r in chaid.risk_policy(loans, tree, 0.2, 0.5).collect()}
    assert set(policy.values()) >= {"approve", "decline"}
    assert {(r["leaf_id"], r["decision"]) for r in routed.select("leaf_id", "decision").distinct().collect()} == set(
        policy.items()
    )


def test_tree_without_signal_is_a_root(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), F.col("id").cast("string").substr(1, 1).alias("x"))
    df = df.withColumn("x", F.lit("same"))
    assert len(chaid.chaid_tree(df, "y", 1, ["x"]).nodes) == 1


def test_too_many_categories_is_an_error(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), F.col("id").cast("string").alias("x"))
    with pytest.raises(ValueError):
        chaid.chaid_tree(df, "y", 1, ["x"])


def test_limits_are_exact(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("y"), (F.col("id") % 21).cast("string").alias("x"))
    with pytest.raises(ValueError, match="21 categories"):
        chaid.chaid_tree(df, "y", 1, ["x"])
    assert len(chaid.chaid_tree(df, "y", 1, ["x"], max_categories=21).nodes) == 1
    with pytest.raises(ValueError, match="more than 1 classes"):
        chaid.chaid_tree(df, "y", 1, ["x"], max_categories=21, max_classes=1)


def all_cuts(categories, ordered):
    known = [c for c in categories if c != chaid.MISSING]
    for k in range(1, len(categories)):
        for left in itertools.combinations(categories, k):
            right = [c for c in categories if c not in left]
            places = [known.index(c) for c in left if c in known]
            whole = [known.index(c) for c in right if c in known]
            if ordered and places and whole and not (max(places) < min(whole) or max(whole) < min(places)):
                continue
            yield left, right


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_resplit_finds_the_best_of_all_cuts(ordered, seed):
    rng = np.random.default_rng(seed)
    names = tuple(f"b{i:02}" for i in range(rng.integers(3, 7))) + ((chaid.MISSING,) if seed % 2 else ())
    counts = {c: [int(v) for v in rng.integers(1, 60, 2)] for c in names}
    best = max(chaid._chi2([chaid._sum(counts, a), chaid._sum(counts, b)])[0] for a, b in all_cuts(names, ordered))
    group = (names, chaid._sum(counts, names))
    found = chaid._resplit(counts, group, ordered, 1.0, 1)
    assert chaid._chi2([g[1] for g in found])[0] == pytest.approx(best)
    assert sorted(c for g in found for c in g[0]) == sorted(names)
    assert chaid._resplit(counts, group, ordered, 0.0, 1) == [group]
    assert chaid._resplit(counts, group, ordered, 1.0, 10_000) == [group]


def test_merged_groups_are_cut_again():
    # b and c join first, being most alike; a then joins them, until its difference from c shows
    counts = {"a": [40, 60], "b": [50, 50], "c": [53, 47], "d": [58, 42], "e": [20, 80]}
    plain = {g[0] for g in chaid._merge(counts, True, 0.05, 1)}
    for alpha in (0.04, 0.049):
        cut = chaid._merge(counts, True, 0.05, 1, alpha)
        for group in cut:  # a fixed point: no group can be cut, or its cuts were tried
            assert len(group[0]) < 3 or len(chaid._resplit(counts, group, True, 0.001, 1)) == 1
        assert sorted(c for g in cut for c in g[0]) == list("abcde")
    assert plain


@pytest.mark.parametrize("seed", range(30))
def test_resplitting_ends(seed):
    rng = np.random.default_rng(seed)
    names = [f"b{i:02}" for i in range(10)] + [chaid.MISSING]
    counts = {c: [int(v) for v in rng.integers(20, 60, 3)] for c in names}
    for ordered in (True, False):
        groups = chaid._merge(counts, ordered, 0.05, 1, 0.2)  # a level above the merging one would go round for ever
        assert sorted(c for g in groups for c in g[0]) == sorted(names)


def test_routing_is_a_join_for_each_level(loans, tree):
    routed = chaid.apply_policy(loans, "id", tree, 0.2, 0.5)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == max(n.depth for n in tree.nodes)
    assert "NestedLoop" not in routed._jdf.queryExecution().executedPlan().toString()
    alone = chaid.Tree([chaid.Node(0, None, 0, {}, n=3, rate=0.7)], tree.bins, tree.predictors)
    assert {tuple(r)[1:] for r in chaid.apply_policy(loans, "id", alone, 0.2, 0.5).collect()} == {(0, "decline")}
    strange = loans.limit(1).withColumn("region", F.lit("nowhere")).withColumn("income", F.lit(None).cast("double"))
    row = chaid.apply_policy(strange, "id", tree, 0.2, 0.5).first()
    assert row["leaf_id"] is None and row["decision"] is None


def test_missing_category_joins_any_group():
    counts = {"b00": [50, 0], "b01": [50, 1], "b02": [0, 50], chaid.MISSING: [0, 40]}
    groups = chaid._merge(counts, True, 0.05, 10)
    assert [sorted(g[0]) for g in groups] == [["b00", "b01"], sorted(["b02", chaid.MISSING])]


def test_kmeans_separates_two_clouds(spark):
    centre = F.when(F.col("id") < 100, 0.0).otherwise(50.0)
    df = spark.range(200).select("id", (centre + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    assigned, centres = segments.segment_kmeans(df, "id", ["x", "y"], k=2)
    got = {r["key"]: r["cluster"] for r in assigned.collect()}
    assert len({got[i] for i in range(100)}) == 1 and len({got[i] for i in range(100, 200)}) == 1
    assert got[0] != got[150]
    assert sorted(r["n"] for r in centres.collect()) == [100, 100]


def test_kmeans_of_few_null_and_no_rows(spark):
    rows = [(1, 0.0, 1.0), (2, 10.0, 1.0), (3, None, 1.0), (4, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, constant double")
    assigned, centres = segments.segment_kmeans(df, "id", ["x", "constant"], k=5)
    assert {r["key"] for r in assigned.collect()} == {1, 2}
    assert [r["n"] for r in centres.orderBy("cluster").collect()] == [1, 1]
    for columns in (["x"], ["x", "constant"]):
        assigned, centres = segments.segment_kmeans(df.limit(0), "id", columns, k=2)
        assert assigned.count() == centres.count() == 0
    arrays = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, None), (4, [None, 1.0])], "id long, v array<double>")
    assert segments.segment_kmeans(arrays, "id", ["v"], k=2)[0].count() == 2


def test_segment_scores_share_ties(spark):
    rows = [(k, "2024-01-01", 10.0) for k in range(4)] + [(9, "2024-02-01", 99.0)]
    df = spark.createDataFrame(rows, "k int, d string, v double").withColumn("d", F.col("d").cast("date"))
    got = {r["key"]: r.asDict() for r in segments.segment_quantile(df, "k", "d", F.col("v")).collect()}
    assert len({got[k]["segment"] for k in range(4)}) == 1
    assert got[9]["recency"] == 0 and got[0]["recency"] == 31
    assert got[9]["m"] > got[0]["m"]
    assert math.isclose(got[9]["monetary"], 99.0)
