"""Frequencies, distributions, dependence and group comparisons."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions.distributions import chi2_p_value
from lodeglass.operators.joins import join_on
from lodeglass.operators.ordering import number_rows, number_within
from lodeglass.operators.profile import melt, quoted, union_all
from lodeglass.operators.quantiles import quantiles_by
from lodeglass.session import materialise

#: Columns of one block of the correlation matrix; a task holds five matrices of twice as many rows and columns at most.
CORRELATION_BLOCK = 1024
_MOMENTS = ["n", "mx", "my", "cxx", "cyy", "cxy"]


def _pair_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two columns the count, means and centred products of a task's rows in which both are finite numbers.

    Values are taken relative to the column's first one, so that large means lose no digits and constants stay exact.
    """
    shift: np.ndarray | None = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        held = np.isfinite(x)
        if shift is None:
            shift = np.full(x.shape[1], np.nan)
            n, sums, squares, products = (np.zeros((x.shape[1],) * 2) for _ in range(4))
        new = np.isnan(shift) & held.any(axis=0)
        shift[new] = x[held.argmax(axis=0)[new], np.flatnonzero(new)]
        x = np.where(held, x - np.where(np.isnan(shift), 0.0, shift), 0.0)
        there = held.astype(float)
        n += there.T @ there
        sums += x.T @ there
        squares += (x * x).T @ there
        products += x.T @ x
    if shift is None:
        return
    i, j = np.triu_indices(len(shift), 1)
    i, j = (v[n[i, j] > 0] for v in (i, j))
    both, sx, sy = n[i, j], sums[i, j], sums[j, i]
    columns = [both.astype(np.int64), shift[i] + sx / both, shift[j] + sy / both]
    columns += [squares[i, j] - sx * sx / both, squares[j, i] - sy * sy / both, products[i, j] - sx * sy / both]
    arrays = [pa.array(c) for c in (i.astype(np.int32), j.astype(np.int32), *columns)]
    yield pa.RecordBatch.from_arrays(arrays, ["i", "j", *_MOMENTS])


def _blocks(k: int, size: int) -> list[tuple[list[int], Column]]:
    """Sets of columns in which every two columns meet, each with the pairs ``i, j`` that are taken from it.

    All columns together, or every two blocks of ``size``; a block's own pairs are taken from its first set.
    """
    parts = [list(range(s, min(s + size, k))) for s in range(0, k, size)]
    if len(parts) < 2:
        return [(p, F.lit(True)) for p in parts]
    of_i, of_j = (F.floor(F.col(c) / size) for c in "ij")
    out = []
    for a, b in combinations(range(len(parts)), 2):
        own = of_i == b if (a, b) != (0, 1) else F.lit(True)
        out.append((parts[a] + parts[b], (of_i != of_j) | own if a == 0 else of_i != of_j))
    return out


def correlation_matrix(df: DataFrame, columns: list[str], block: int = CORRELATION_BLOCK) -> DataFrame:
    """x, y, n, r for every column pair x < y over the rows where both are finite numbers; a constant gives null.

    One scan computes all pairs: each task keeps matrices of counts, sums and products and returns a row per pair; the rows are
    merged as deviations within the tasks plus those between their means. More than ``block`` columns are worked off by two
    blocks at a time, a scan each.
    """
    names, spark = sorted(set(columns)), df.sparkSession
    cells = [quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]
    found = []
    for mine, taken in _blocks(len(names), block):
        where = F.array(*[F.lit(m) for m in mine])
        moments = df.select(*[cells[m] for m in mine]).mapInArrow(
            _pair_moments, "i int, j int, n long, mx double, my double, cxx double, cyy double, cxy double"
        )
        found.append(moments.withColumns({c: F.get(where, F.col(c)) for c in "ij"}).where(taken))
    if not found:
        return spark.createDataFrame([], "x string, y string, n long, r double")
    moments = materialise(union_all(found), "moments")
    least = moments.groupBy("i", "j").agg(F.min("mx").alias("x0"), F.min("my").alias("y0"))
    dx, dy = F.col("mx") - F.col("x0"), F.col("my") - F.col("y0")
    n = F.col("n")
    sums = moments.join(least, ["i", "j"]).groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(n * dx).alias("sx"),
        F.sum(n * dy).alias("sy"),
        F.sum(F.col("cxx") + n * dx * dx).alias("xx"),
        F.sum(F.col("cyy") + n * dy * dy).alias("yy"),
        F.sum(F.col("cxy") + n * dx * dy).alias("xy"),
    )
    sx, sy = F.col("sx"), F.col("sy")
    spread = (F.col("xx") - sx * sx / n) * (F.col("yy") - sy * sy / n)
    r = F.when(spread > 0, (F.col("xy") - sx * sy / n) / F.sqrt(spread))
    pairs = [(i, j, x, y) for (i, x), (j, y) in combinations(enumerate(names), 2)]
    listed = spark.createDataFrame(pairs, "i int, j int, x string, y string")
    return listed.join(sums.select("i", "j", "n", r.alias("r")), ["i", "j"], "left").select(
        "x", "y", F.coalesce("n", F.lit(0)).alias("n"), "r"
    )


def frequency_counts(df: DataFrame, column: str, top_k: int | None = None) -> DataFrame:
    """value, n, share, rank. Null is a value of its own; ties go by value, null last."""
    counts = df.groupBy(quoted(column).alias("value")).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    if top_k is not None:
        counts = materialise(counts)
        first = counts.orderBy(*order).limit(top_k)
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        numbered = number_rows(counts, order, "_at")
        ranked = numbered.withColumn("rank", F.col("_at") + 1)
        counts = numbered
    total = counts.agg(F.sum("n")).scalar()
    return ranked.select("value", "n", (F.col("n") / total).alias("share"), "rank")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, lo, hi, n over equal-width bins from the least to the greatest finite value; empty bins are kept.

    Infinite values are counted in rows of their own: bin 0 below all others, bin ``bins + 1`` above.
    """
    value = F.nanvl(quoted(column).cast("double"), F.lit(None).cast("double"))
    filled = df.select(value.alias("v")).where(F.col("v").isNotNull())
    endless = F.abs("v") == F.lit(float("inf"))
    values = filled.where(~endless)
    low, high, below, above = filled.agg(
        F.min(F.when(~endless, F.col("v"))),
        F.max(F.when(~endless, F.col("v"))),
        F.count_if(endless & (F.col("v") < 0)),
        F.count_if(endless & (F.col("v") > 0)),
    ).first()
    spark = df.sparkSession
    if below or above:
        inf = float("inf")
        ends = [r for r in ((0, -inf, -inf, below), (bins + 1, inf, inf, above)) if r[3]]
        rest = histogram(values.select(F.col("v").alias(column)), column, bins)
        return rest.unionByName(spark.createDataFrame(ends, "bin long, lo double, hi double, n long"))
    if low is None:
        return spark.createDataFrame([], "bin long, lo double, hi double, n long")
    if low == high:
        return values.agg(F.count("*").alias("n")).select(
            F.lit(1).cast("long").alias("bin"), F.lit(low).alias("lo"), F.lit(high).alias("hi"), "n"
        )
    # The maximum falls one past the end; it belongs to the last bin.
    at = F.least(F.width_bucket("v", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("long")
    counted = values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edges = spark.range(1, bins + 1).select(F.col("id").alias("bin"))
    width = F.lit((high - low) / bins)
    return edges.join(counted, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * width).alias("lo"),
        (F.lit(low) + F.col("bin") * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def linear_fit(df: DataFrame, x: Column, y: Column, group: Column) -> DataFrame:
    """group, n, slope, intercept, r2 of y on x. A constant x gives nulls."""
    fit = df.groupBy(group.alias("group")).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    varies = F.col("_sxx") > 0
    return fit.select("group", "n", *[F.when(varies, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def linear_fit_multiple(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coefficient by least squares; one pass of normal equations inside Spark ML."""
    rows = df.select(quoted(y).cast("double").alias("label"), *[quoted(x).cast("double").alias(x) for x in xs])
    points = VectorAssembler(inputCols=xs, outputCol="features", handleInvalid="skip").transform(
        rows.where(F.col("label").isNotNull())
    )
    model = LinearRegression(solver="normal").fit(points.select("features", "label"))
    terms = [("intercept", float(model.intercept))]
    terms += [(x, float(c)) for x, c in zip(xs, model.coefficients)]
    return df.sparkSession.createDataFrame(terms, "term string, coefficient double")


def outlier_fences(
    df: DataFrame,
    columns: list[str],
    method: str = "iqr",
    by: list[str] | None = None,
) -> DataFrame:
    """by columns, column, low, high. ``iqr``: quartiles -/+ 1.5 spreads; ``zscore``: mean -/+ 3 deviations.

    Fences come from the finite values; a column (of a group) without any has null fences.
    """
    keys = [*(by or []), "column"]
    values = melt(df, columns, by)
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    values = values.withColumn("value", finite)
    if method == "iqr":
        cuts = quantiles_by(values, keys, "value", [0.25, 0.75], keep_empty=True)
        reach = (F.col("q0_75") - F.col("q0_25")) * 1.5
        fences = cuts.select(*keys, (F.col("q0_25") - reach).alias("low"), (F.col("q0_75") + reach).alias("high"))
    elif method == "zscore":
        moments = values.groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
        # No spread, no flags: a null fence never compares true.
        reach = F.when(F.col("s") > 0, F.col("s") * 3)
        fences = moments.select(*keys, (F.col("m") - reach).alias("low"), (F.col("m") + reach).alias("high"))
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return materialise(fences, "fences")


def _fenced(df: DataFrame, columns: list[str], fences: DataFrame, keep: list[str]) -> DataFrame:
    """Every cell with its fences; NaN, which would compare as the largest number, as null."""
    keys = [c for c in fences.columns if c not in ("low", "high")]
    kept = list(dict.fromkeys([*keep, *[k for k in keys if k != "column"]]))
    values = melt(df, columns, kept).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    return join_on(values, fences, keys)


def outlier_flags(
    df: DataFrame,
    columns: list[str],
    method: str = "iqr",
    by: list[str] | None = None,
) -> DataFrame:
    """by columns, column, low, high, n_low, n_high; both comparisons are strict, infinite values lie outside all fences."""
    fences = outlier_fences(df, columns, method, by)
    return (
        _fenced(df, columns, fences, [])
        .groupBy(*[*(by or []), "column", "low", "high"])
        .agg(
            F.count_if(F.col("value") < F.col("low")).alias("n_low"),
            F.count_if(F.col("value") > F.col("high")).alias("n_high"),
        )
    )


def outlier_rows(
    df: DataFrame,
    key: str,
    columns: list[str],
    method: str = "iqr",
    by: list[str] | None = None,
) -> DataFrame:
    """key, column, value, method of every flagged cell."""
    fences = outlier_fences(df, columns, method, by)
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return (
        _fenced(df, columns, fences, [key])
        .where(outside)
        .select(F.col(key).alias("key"), "column", "value", F.lit(method).alias("method"))
    )


def contingency_chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, df, n, cramers_v, p_value of the two-way table of the rows where both are filled."""
    both = df.where(quoted(a).isNotNull() & quoted(b).isNotNull())
    cells = materialise(both.groupBy(quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count("*").alias("o")))
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    n = cells.agg(F.sum("o")).scalar()
    expected = cells.join(rows, "a").join(cols, "b").withColumn("e", F.col("r") * F.col("c") / n)
    # Cells nobody falls in have o = 0 and add their e; together that is n less the e of filled cells.
    filled = expected.agg(
        F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("s"),
        F.sum("e").alias("e"),
        F.sum("o").alias("n"),
    )
    n_rows = rows.agg(F.count("*")).scalar()
    n_cols = cols.agg(F.count("*")).scalar()
    table = filled.select(
        (F.col("s") + F.greatest(F.col("n") - F.col("e"), F.lit(0.0))).alias("s"),
        "n",
        n_rows.alias("n_rows"),
        n_cols.alias("n_cols"),
    ).withColumn("free", (F.col("n_rows") - 1) * (F.col("n_cols") - 1))
    usable = F.col("free") > 0
    side = F.least(F.col("n_rows"), F.col("n_cols")) - 1
    measured = table.select(
        F.when(usable, F.col("s")).alias("chi2"),
        F.when(usable, F.col("free")).alias("df"),
        "n",
        F.when(usable, F.sqrt(F.try_divide(F.col("s"), F.col("n") * side))).alias("cramers_v"),
    )
    return measured.withColumn("p_value", chi2_p_value("chi2", "df"))


def two_sample_test(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t test of group a against group b as one row.

    group_a, group_b, n_a, n_b, mean_diff, t, df, effect (difference over the pooled deviation).
    """
    number = quoted(value).cast("double")
    in_a, in_b = F.when(quoted(group) == a, number), F.when(quoted(group) == b, number)
    s = df.where(quoted(group).isin(a, b)).agg(
        F.count(in_a).alias("n_a"),
        F.count(in_b).alias("n_b"),
        F.avg(in_a).alias("m_a"),
        F.avg(in_b).alias("m_b"),
        F.var_samp(in_a).alias("v_a"),
        F.var_samp(in_b).alias("v_b"),
    )
    usable = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (F.col("v_a") + F.col("v_b") > 0)
    e_a, e_b = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    free = F.pow(e_a + e_b, 2) / (F.pow(e_a, 2) / (F.col("n_a") - 1) + F.pow(e_b, 2) / (F.col("n_b") - 1))
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (
        F.col("n_a") + F.col("n_b") - 2
    )
    diff = F.col("m_a") - F.col("m_b")
    return s.select(
        F.lit(a).alias("group_a"),
        F.lit(b).alias("group_b"),
        "n_a",
        "n_b",
        diff.alias("mean_diff"),
        F.when(usable, diff / F.sqrt(e_a + e_b)).alias("t"),
        F.when(usable, free).alias("df"),
        F.when(usable, diff / F.sqrt(pooled)).alias("effect"),
    )


def crosstab_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, row_share, col_share, total_share; nulls are a category of their own."""
    cells = materialise(df.groupBy(quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count("*").alias("n")))
    rows = cells.groupBy("a").agg(F.sum("n").alias("_row"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("_col"))
    total = cells.agg(F.sum("n")).scalar()
    return join_on(join_on(cells, rows, ["a"]), cols, ["b"]).select(
        "a",
        "b",
        "n",
        (F.col("n") / F.col("_row")).alias("row_share"),
        (F.col("n") / F.col("_col")).alias("col_share"),
        (F.col("n") / total).alias("total_share"),
    )


def crosstab_wide(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """One row per a, one count column per listed value of b."""
    wide = df.groupBy(quoted(a).alias("a")).pivot(b, values).agg(F.count(F.lit(1)))
    return wide.select("a", *[F.coalesce(quoted(v), F.lit(0)).alias(v) for v in values])


def compare_items(
    df: DataFrame, category: str, item: str, metrics: dict[str, Column], rank_by: str
) -> DataFrame:
    """category, item, metrics, share, rank: ``rank_by``'s share of its category and place in it.

    Ties are ordered by item. Ranking goes through range partitions, so one huge category is fine.
    """
    totals = df.groupBy(quoted(category).alias("category"), quoted(item).alias("item")).agg(
        *[m.alias(name) for name, m in metrics.items()]
    )
    ranked = number_within(totals, ["category"], [F.col(rank_by).desc_nulls_last(), F.col("item")], "rank")
    whole = materialise(ranked.groupBy("category").agg(F.sum(rank_by).alias("_whole")))
    share = F.try_divide(F.col(rank_by), F.col("_whole"))
    return join_on(ranked, whole, ["category"]).select("category", "item", *metrics, share.alias("share"), "rank")


def top_items(df: DataFrame, category: str, item: str, metric: Column, k: int) -> DataFrame:
    """category, item, metric, rank: the k best items of each category.

    Spark limits each group to k rows before the shuffle, so no task sees a whole category.
    """
    totals = df.groupBy(quoted(category).alias("category"), quoted(item).alias("item")).agg(metric.alias("metric"))
    best = Window.partitionBy("category").orderBy(F.col("metric").desc_nulls_last(), "item")
    return totals.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
