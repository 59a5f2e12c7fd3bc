"""Exact quantiles with linear interpolation, the same way for tables of every size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here one pass brackets each
wanted rank with ``percentile_approx``. A second pass counts the values inside the brackets (a sliver of the table) in ``BUCKETS`` equal
parts each, and lumps the rest into gap counts. Totals of the parts tell which one holds a wanted rank; only the values of those parts are put in
order, so that no task sorts more than a part of a sliver however large its group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from lodeglass.operators.joins import join_on
from lodeglass.session import materialise

ACCURACY = 10_000
#: Parts of a bracket whose values are counted apart.
BUCKETS = 512


def quantile_name(p: float) -> str:
    return "q" + f"{p:.6f}".rstrip("0").rstrip(".").replace(".", "_")


def quantiles_by(
    df: DataFrame,
    group: list[str],
    value: str,
    probs: list[float],
    mode: str = "exact",
    accuracy: int = ACCURACY,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per group: the group columns, ``n`` and one column per probability.

    Null and NaN values are left out. ``mode='approx'`` returns ``percentile_approx`` values. With ``keep_empty`` a group
    without any value has a row too, with nulls for its quantiles.
    """
    probs = sorted(probs)
    number = F.col(value).cast("double")
    every = df.select(*group, F.nanvl(number, F.lit(None)).alias("_v"))
    kept = every.where(F.col("_v").isNotNull())
    names = [quantile_name(p) for p in probs]
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    if mode == "approx":
        found = kept.groupBy(*group).agg(
            F.count("*").alias("n"), F.percentile_approx("_v", wanted, accuracy).alias("_q")
        )
    else:
        keys = group or ["_all"]
        kept = kept if group else kept.withColumn("_all", F.lit(1))
        stats = bracket_stats(F.col("_v"), probs, accuracy)
        if not (keep_empty and group):
            brackets = materialise(kept.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()]), "brackets")
            return quantiles_in(kept, keys, "_v", brackets, probs, accuracy).select(*group, "n", *names)
        brackets = materialise(every.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()]), "brackets")
        found = quantiles_in(kept, keys, "_v", brackets, probs, accuracy).drop("n")
        return join_on(brackets.select(*keys, F.col("_n").alias("n")), found, keys, "left").select(*group, "n", *names)
    return found.select(*group, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)])


def _reach(probs: list[float], accuracy: int) -> tuple[list[float], list[float]]:
    """Twice the sketch error to either side of each probability."""
    slack = 2.0 / accuracy
    return [max(p - slack, 0.0) for p in probs], [min(p + slack, 1.0) for p in probs]


def bracket_stats(value: Column, probs: list[float], accuracy: int = ACCURACY) -> dict[str, Column]:
    """Pass 1, as aggregates that fit into any scan: size, extremes and sketched bracket ends."""
    low, high = _reach(probs, accuracy)
    ends = F.array(*[F.lit(e) for e in low + high])
    return {
        "_n": F.count(value),
        "_min": F.min(value),
        "_max": F.max(value),
        "_ends": F.percentile_approx(value, ends, accuracy),
    }


def quantiles_in(
    kept: DataFrame, keys: list[str], value: str, brackets: DataFrame, probs: list[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Pass 2: the exact quantiles, given ``bracket_stats`` per key of the very same rows, as a written table.

    ``probs`` must be sorted. Values must be filled numbers.
    """
    k = len(probs)
    low, high = _reach(probs, accuracy)
    # Small groups keep all their values; so do probabilities close to either end.
    whole = F.col("_n") <= accuracy
    lows = F.array(*[F.when(whole | F.lit(low[i] <= 0), F.col("_min")).otherwise(F.col("_ends")[i]) for i in range(k)])
    highs = F.array(
        *[F.when(whole | F.lit(high[i] >= 1), F.col("_max")).otherwise(F.col("_ends")[k + i]) for i in range(k)]
    )
    brackets = brackets.where("_n > 0").select(*keys, lows.alias("_lo"), highs.alias("_hi"))

    # A value belongs to the first bracket that it is not above; below that bracket it lies in the gap before it.
    v, at = F.col(value), F.lit(k)
    for i in range(k - 1, -1, -1):
        at = F.when(v <= F.col("_hi")[i], i).otherwise(at)
    low_at, high_at = F.get("_lo", F.col("_at")), F.get("_hi", F.col("_at"))
    width = high_at - low_at
    share = F.when((width > 0) & (width < float("inf")), (v - low_at) / width * BUCKETS).otherwise(0.0)
    inside = F.coalesce(v >= low_at, F.lit(False))
    part = F.when(inside, F.least(F.floor(share), F.lit(BUCKETS - 1))).otherwise(-1).cast("int")
    placed = join_on(kept.select(*keys, value), brackets, keys).withColumn("_at", at)
    counted = placed.select(*keys, "_at", part.alias("_part"), F.when(inside, v).alias("_v")).groupBy(
        *keys, "_at", "_part", "_v"
    ).agg(F.count("*").alias("_c"))
    counted = materialise(counted, "counted")

    parts = counted.groupBy(*keys, "_at", "_part").agg(F.sum("_c").alias("_size"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_size").over(group.orderBy("_at", "_part").rowsBetween(Window.unboundedPreceding, 0))
    ranks = []
    for i, p in enumerate(probs):
        rank = (F.col("n") - 1) * F.lit(float(p))
        ranks += [F.struct(F.lit(f"{side}{i}").alias("slot"), r.cast("long").alias("rank"))
                  for side, r in (("a", F.floor(rank)), ("b", F.ceil(rank)))]
    summed = parts.withColumns({"n": F.sum("_size").over(group), "_from": upto - F.col("_size"), "_to": upto})
    held = F.filter(F.array(*ranks), lambda r: (r["rank"] >= F.col("_from")) & (r["rank"] < F.col("_to")))
    wanted = summed.select(*keys, "_at", "_part", "_from", "n", held.alias("_ranks")).where(F.size("_ranks") > 0)
    values = join_on(wanted, counted, [*keys, "_at", "_part"])
    inner = Window.partitionBy(*keys, "_at", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_from") + F.sum("_c").over(inner)
    mine = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_last") - F.col("_c")) & (r["rank"] < F.col("_last")))
    found = values.withColumn("_last", last).withColumn("_mine", mine).where(F.size("_mine") > 0)
    slots = [f"{side}{i}" for i in range(k) for side in "ab"]
    picked = found.select(*keys, "n", "_v", F.explode("_mine.slot").alias("_slot")).groupBy(*keys).agg(
        F.first("n").alias("n"), *[F.max(F.when(F.col("_slot") == s, F.col("_v"))).alias(f"_{s}") for s in slots]
    )
    out = []
    for i, p in enumerate(probs):
        rank = (F.col("n") - 1) * F.lit(float(p))
        share = rank - F.floor(rank)
        a, c = F.col(f"_a{i}"), F.col(f"_b{i}")
        exact = F.when(share == 0, a).otherwise(a * (1 - share) + c * share)
        # A rank outside its bracket would leave a pick empty: fail loudly, never return a wrong value.
        lost = F.raise_error(F.lit("quantile rank left its bracket")).cast("double")
        out.append(F.when(a.isNull() | c.isNull(), lost).otherwise(exact).alias(quantile_name(p)))
    return picked.select(*keys, "n", *out)
