"""Mergeable statistics, replays and late data."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lodeglass.sinks.commits import CommitLog
from lodeglass.streaming import incremental as inc

COLUMNS = ["user_id", "value"]


@pytest.fixture
def files(spark, sf, tmp_path):
    """Events as four files, oldest first."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = tmp_path / "events"
    for i in range(4):
        part = events.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250))
        part.coalesce(1).write.mode("append").parquet(str(path))
    return events, str(path)


def test_batches_merge_to_the_whole(spark, files, tmp_path):
    events, path = files
    stream = inc.file_stream(spark, path, events.schema, files_per_batch=1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    inc.incremental_profile(stream, COLUMNS, out, state)
    assert inc._profile_log(spark, out).head().number == 4
    got = {r["column"]: r for r in inc.read_profile(spark, out).collect()}
    for c in COLUMNS:
        row = events.agg(F.count(c), F.avg(c), F.stddev(c), F.min(c), F.max(c), F.count_distinct(c)).first()
        g = got[c]
        assert (g["n"], g["min"], g["max"]) == (row[0], row[3], row[4])
        assert g["mean"] == pytest.approx(row[1]) and g["std"] == pytest.approx(row[2])
        assert g["approx_unique"] == pytest.approx(row[5], rel=0.05)
    # Nothing new: nothing changes. A new file: one more batch.
    inc.incremental_profile(stream, COLUMNS, out, state)
    assert inc._profile_log(spark, out).head().number == 4
    events.limit(10).coalesce(1).write.mode("append").parquet(path)
    inc.incremental_profile(inc.file_stream(spark, path, events.schema), COLUMNS, out, state)
    got = {r["column"]: r["n"] for r in inc.read_profile(spark, out).collect()}
    assert got["value"] == 1010


def test_many_batches_are_read_from_few_folders(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events.repartition(20).write.parquet(path)
    stream = inc.file_stream(spark, path, events.schema, files_per_batch=1)
    inc.incremental_profile(stream, COLUMNS, out, state, fan=3)
    head = inc._profile_log(spark, out).head()
    assert head.number == 20 and sorted(f.generation for f in head.parts["stats"]) == [0, 0, 2, 2]
    got = {r["column"]: r for r in inc.read_profile(spark, out).collect()}
    row = events.agg(F.count("value"), F.avg("value"), F.stddev("value"), F.min("value"), F.max("value")).first()
    assert got["value"]["n"] == row[0] and (got["value"]["min"], got["value"]["max"]) == (row[3], row[4])
    assert got["value"]["mean"] == pytest.approx(row[1]) and got["value"]["std"] == pytest.approx(row[2])
    assert got["user_id"]["approx_unique"] == pytest.approx(events.select("user_id").distinct().count(), rel=0.05)


def test_a_replayed_batch_changes_nothing(spark, files, tmp_path):
    events, path = files
    out = str(tmp_path / "out")
    for state in ("one", "two"):  # the same files under another checkpoint are other batches
        inc.incremental_profile(inc.file_stream(spark, path, events.schema), COLUMNS, out, str(tmp_path / state))
    assert {r["n"] for r in inc.read_profile(spark, out).collect()} == {2000}
    log = inc._profile_log(spark, out)
    state = str(tmp_path / "two")
    assert log.append(f"{state}#0", lambda _: {"stats": inc.batch_stats(events, COLUMNS)}) == 2
    assert log.append(f"{tmp_path / 'one'}#0", lambda _: {"stats": inc.batch_stats(events, COLUMNS)}) == 1
    assert {r["n"] for r in inc.read_profile(spark, out).collect()} == {2000}


def test_merge_keeps_digits_of_large_means(spark):
    df = spark.range(1000).select((F.col("id") % 10 + F.lit(1e9)).alias("v"), (F.col("id") % 4).alias("part"))
    stats = None
    for p in range(4):
        one = inc.batch_stats(df.where(F.col("part") == p), ["v"])
        stats = one if stats is None else stats.unionByName(one)
    merged = inc.merge_stats(stats).first()
    # A batch mean near 1e9 is itself only stored to about 1e-7; sums of squares would lose everything.
    assert merged["std"] == pytest.approx(df.agg(F.stddev("v")).first()[0], rel=1e-7)


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "v double")
    row = inc.merge_stats(inc.batch_stats(df, ["v"])).first()
    assert (row["n"], row["null_count"], row["mean"], row["std"]) == (1, 1, 1.0, None)


def day(d, h=0):
    return dt.datetime(2024, 1, d, h)


def test_windows_close_and_late_rows_count(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string"
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(day(1), "a"), (day(1, 5), "a"), (day(2), "b"), (day(5), "a"), (None, "a")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)

    def run():
        found = inc.windowed_counts(inc.file_stream(spark, path, df.schema), "ts", "kind", out, state)
        return [tuple(r) for r in found.collect()]

    none = (None, "a", 1, None)
    for _ in range(2):  # the second time there is nothing new
        assert set(run()) == {(day(1), "a", 2, True), (day(2), "b", 1, True), (day(5), "a", 1, False), none}
    assert inc.late_rows(spark, out, df.schema, "kind").count() == 0
    late = spark.createDataFrame([(day(1, 9), "a"), (day(9), "a"), (day(4, 2), "b")], schema)
    late.coalesce(1).write.mode("append").parquet(path)
    assert set(run()) == {
        (day(1), "a", 3, True), (day(2), "b", 1, True), (day(4), "b", 1, True), (day(5), "a", 1, True), (day(9), "a", 1, False), none,
    }
    # day 4 ended on the newest day of the first batch, so that it was not yet closed then
    assert [tuple(r) for r in inc.late_rows(spark, out, df.schema, "kind").collect()] == [(day(1, 9), "a")]


@pytest.mark.parametrize("newest_first", [True, False])
def test_no_row_depends_on_the_order_of_files(spark, sf, tmp_path, newest_first):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    order = F.col("ts").desc() if newest_first else F.col("ts").asc()
    events.repartitionByRange(7, order).write.parquet(path)
    for n, file in enumerate(sorted((tmp_path / "in").glob("part-*"))):
        os.utime(file, (n + 1, n + 1))  # files are taken by their time
    stream = inc.file_stream(spark, path, events.schema, files_per_batch=1)
    found = inc.windowed_counts(stream, "ts", "event_type", out, state, fan=2)
    want = events.groupBy(F.date_trunc("day", "ts").alias("w"), "event_type").count()
    assert {(r[0].replace(tzinfo=None), r[1], r[2]) for r in want.collect()} == {tuple(r)[:3] for r in found.collect()}
    newest = events.agg(F.max("ts")).first()[0]
    assert all(r["closed"] == (r["window_start"] + dt.timedelta(days=2) <= newest) for r in found.collect())
    late = inc.late_rows(spark, out, events.schema, "event_type").count()
    assert late > 0 if newest_first else late == 0


def test_empty_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events.limit(0).write.parquet(path)
    stream = inc.file_stream(spark, path, events.schema)
    assert inc.windowed_counts(stream, "ts", "event_type", out, state).count() == 0
    assert inc.read_profile(spark, str(tmp_path / "never")).count() == 0


def test_only_one_writer_gets_a_version(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), {"rows": lambda rows: rows})
    inner = []

    def outer(head):
        if not inner:  # another writer commits while this one is at work
            inner.append(log.append("other", lambda _: {"rows": spark.range(1)}))
        return {"rows": spark.range(head.number, head.number + 1)}

    assert log.append("mine", outer) == 2 and inner == [1]
    assert sorted(r[0] for r in log.read("rows", "id long").collect()) == [0, 1]


def test_a_writer_that_ended_before_its_note(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), {"rows": lambda rows: rows})
    for name in ("a", "b"):
        log.append(name, lambda _: {"rows": spark.range(1)})
    for note in (tmp_path / "log" / "_batches").iterdir():
        if not note.name.startswith("."):
            note.unlink()
    (tmp_path / "log" / "_log" / "_last").unlink()
    assert log.append("b", lambda _: {"rows": spark.range(1)}) == 2
    assert log.read("rows", "id long").count() == 2


def test_instants_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 0, 123456),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = df.select(F.unix_micros(inc.utc_instant(F.col("t"))), inc.utc_reading(inc.utc_instant(F.col("t")))).first()
            assert tuple(row) == (1711852200123456, dt.datetime(2024, 3, 31, 2, 30, 0, 123456))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_distinct_counts_cover_whole_columns(spark, tmp_path):
    """Columns of more values than a sketch remembers are judged too, not only classes made from them."""
    from lodeglass.workload import models

    ids = F.col("id")
    spark.range(20_000).select(
        ids.alias("event_id"), (ids % 7_000).alias("user_id"), (ids / 8).alias("value"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["column"]: r for r in models.incremental_unique(spark, str(tmp_path)).collect()}
    assert {c: got[c]["n_unique"] for c in ("event_id", "user_id", "value")} == {"event_id": 20_000, "user_id": 7_000, "value": 20_000}
    assert got["user_group"]["approx_unique"] == got["user_group"]["n_unique"] == 97
    assert all(r["close"] and r["n"] == 20_000 for r in got.values())
