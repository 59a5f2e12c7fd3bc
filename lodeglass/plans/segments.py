"""Customer segments: recency/frequency/monetary scores and k-means clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.operators.profile import melt, quoted
from lodeglass.operators.quantiles import quantile_name, quantiles_by
from lodeglass.session import materialise

FIFTHS = [0.2, 0.4, 0.6, 0.8]


def segment_quantile(
    df: DataFrame,
    key: str,
    ts: str,
    amount: Column,
    probs: list[float] | None = None,
) -> DataFrame:
    """key, recency (days before the last date seen), frequency, monetary, r, f, m, segment.

    A score is 1 plus the number of cut points below the value, so equal values share a score.
    """
    probs = sorted(probs or FIFTHS)
    per_key = materialise(
        df.groupBy(quoted(key).alias("key")).agg(
            F.max(quoted(ts).cast("date")).alias("last"),
            F.count("*").alias("frequency"),
            F.sum(amount).cast("double").alias("monetary"),
        )
    )
    newest = per_key.agg(F.max("last")).scalar()
    measured = per_key.select(
        "key", F.datediff(newest, F.col("last")).cast("long").alias("recency"), "frequency", "monetary"
    )
    names = ["recency", "frequency", "monetary"]
    # Three rows of cut points, whatever the number of keys.
    cuts = {
        row["column"]: row
        for row in quantiles_by(melt(measured, names), ["column"], "value", probs).collect()
    }
    scores = {}
    for name in names:
        score = F.lit(1)
        for p in probs:
            if name in cuts:
                score = score + F.when(F.col(name) > cuts[name][quantile_name(p)], 1).otherwise(0)
        scores[name[0]] = score
    return measured.withColumns(scores).withColumn("segment", F.concat(*[F.col(s).cast("string") for s in scores]))


def _features(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and one array of doubles: an array column as it is, numeric columns scaled to mean 0 and deviation 1.

    Rows with a null or NaN among them are left out; a constant column is 0 throughout.
    """
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.ArrayType):
        filled = df.where(quoted(columns[0]).isNotNull())
        points = filled.select(quoted(key).alias("key"), quoted(columns[0]).cast("array<double>").alias("features"))
        return points.where(~F.exists("features", lambda v: v.isNull() | F.isnan(v)))
    numbers = df.select(quoted(key).alias("key"), *[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    whole = numbers
    for n in names:
        whole = whole.where(F.col(n).isNotNull() & ~F.isnan(n))
    moments = whole.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_samp(n).alias("s")).alias(n) for n in names]).first()
    scaled = [
        (F.col(n) - F.lit(moments[n]["m"])) / F.lit(moments[n]["s"]) if moments[n]["s"] else F.lit(0.0) for n in names
    ]
    return whole.select("key", F.array(*scaled).alias("features"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, the first of equally near ones."""
    gaps = np.column_stack([((x - c) ** 2).sum(axis=1) for c in centres])
    return gaps.argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def segment_kmeans(
    df: DataFrame, key: str, columns: list[str], k: int, seed: int = 42, max_iter: int = 20, runs: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(key, cluster) for every row and (cluster, n, centre) for the k clusters, numbered in the order of their centres.

    Lloyd's steps from ``runs`` choices of k rows by a seeded hash of their key; the run whose rows are closest to their centres counts, so the
    result can be repeated anywhere. Each step of all runs is one pass: a task assigns its rows and returns a sum per run and cluster. A cluster
    that loses all rows keeps its centre. Steps end when no centre moves.
    """
    points = materialise(_features(df, key, columns), "points")
    spark = df.sparkSession
    listed = "cluster int, n long, centre array<double>"
    starts = []
    for run in range(runs):
        by_hash = F.md5(F.concat(F.lit(f"{seed}:{run}:"), F.col("key").cast("string")))
        chosen = points.orderBy(by_hash, "key").limit(k).select("features").collect()
        starts.append([r["features"] for r in chosen])
    if not starts[0]:
        return points.select("key", F.lit(None).cast("int").alias("cluster")), spark.createDataFrame([], listed)
    centres = np.array(starts)  # run, cluster, place

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, gap = np.zeros(centres.shape[:2]), np.zeros(centres.shape), np.zeros(len(centres))
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                for run, own in enumerate(centres):
                    near = _nearest(x, own)
                    count[run] += np.bincount(near, minlength=len(own))
                    np.add.at(total[run], near, x)
                    gap[run] += ((x - own[near]) ** 2).sum()
        for run in range(len(centres)):
            values = np.concatenate([count[run][:, None], total[run]], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([gap[run]]), pa.array([values])], ["run", "gap", "sums"])

    for _ in range(max_iter):
        rows = points.select("features").mapInArrow(sums, "run int, gap double, sums array<double>")
        merged = rows.select("run", F.posexplode("sums").alias("place", "v")).groupBy("run", "place").agg(F.sum("v").alias("v"))
        found = np.zeros((len(centres), centres.shape[1] * (centres.shape[2] + 1)))
        for r in merged.collect():  # runs and centres
            found[r["run"], r["place"]] = r["v"]
        found = found.reshape(len(centres), centres.shape[1], -1)
        count, total = found[..., :1], found[..., 1:]
        moved = np.where(count > 0, total / np.maximum(count, 1), centres)
        still = np.allclose(moved, centres, rtol=0, atol=1e-12)
        centres = moved
        if still:
            break
    gaps = points.select("features").mapInArrow(sums, "run int, gap double, sums array<double>").groupBy("run").agg(F.sum("gap").alias("gap"))
    best = centres[gaps.orderBy("gap", "run").first()["run"]]
    best = best[np.lexsort(best.T[::-1])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch.column(1)), best) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32))], ["key", "cluster"])

    kept = T.StructType([points.schema["key"], T.StructField("cluster", T.IntegerType())])
    assigned = points.mapInArrow(assign, kept)
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(best)]
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    found = spark.createDataFrame(rows, "cluster int, centre array<double>").join(sizes, "cluster", "left")
    return assigned, found.select("cluster", F.coalesce("n", F.lit(0)).alias("n"), "centre")
