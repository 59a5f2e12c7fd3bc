"""Readers, outcomes, round trips and refusals."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.session import materialise, scratch_path, scratch_root
from lodeglass.sinks import exports
from lodeglass.sources import tables as sources

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())]
)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_quarantine(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,x,s\n1,2.5,a\n2,zz,b\n3,1\n4,5,c,d\n5,,""\n')
    good, bad = sources.csv_scan(spark, path, SCHEMA)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5, "a"), (5, None, "")]
    assert sorted(r["raw_line"] for r in bad.collect()) == ["2,zz,b", "3,1", "4,5,c,d"]
    assert {r["source"] for r in bad.collect()} == {"a.csv"}
    # The verdict does not change when a query keeps fewer columns.
    assert sorted(r["id"] for r in good.select("id").collect()) == [1, 5]
    assert good.count() == 2 and bad.count() == 3


def test_csv_inference(spark, tmp_path):
    path = write(tmp_path / "b.csv", "d,n,f,t\n2024-01-02,1,NaN,\n2024-01-03,2,1.5,x\n")
    df = sources.read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["date", "int", "double", "string"]
    assert df.where("t is null").count() == 1


def test_outcomes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    paths = [
        str(tmp_path / "p.parquet"),
        str(tmp_path / "none.parquet"),
        write(tmp_path / "t.TXT", "hello\nyou"),
        write(tmp_path / "blank.txt", ""),
        write(tmp_path / "broken.parquet.csv", "a\n1\n"),
        write(tmp_path / "bad.parquet", "this is no parquet"),
        str(tmp_path / "gone.json"),
        str(tmp_path / "x.pdf"),
    ]
    datasets, outcomes = sources.ingest(spark, paths)
    got = {r["name"]: (r["kind"], r["status"]) for r in outcomes.collect()}
    assert got == {
        "p.parquet": ("tabular", "ok"),
        "none.parquet": ("tabular", "empty"),
        "t.TXT": ("text", "ok"),
        "blank.txt": ("text", "empty"),
        "broken.parquet.csv": ("tabular", "ok"),
        "bad.parquet": ("tabular", "failed"),
        "gone.json": ("tabular", "failed"),
        "x.pdf": (None, "unsupported"),
    }
    text = datasets["t.TXT"].first().asDict()
    assert (text["name"], text["file_type"], text["text"], text["text_length"]) == ("t.TXT", "txt", "hello\nyou", 9)
    with pytest.raises(ValueError):
        sources.ingest(spark, [paths[0], str(tmp_path / "other" / "p.parquet")])


SPANNING = 'id,x,s\r\n1,2.5,"a\r\n""b"",\nc"\r\n2,zz,"bad\nrow"\r\n\r\n3,1,plain\r\n4,,"\n\n\n"\r\n5,1,""\r\n6,1'


@pytest.mark.parametrize("block", [7, 40, 1 << 20])
def test_cells_over_lines_whatever_the_blocks(spark, tmp_path, block):
    """A record may begin, go on and end in different blocks of the file."""
    path = tmp_path / "span.csv"
    path.write_bytes(SPANNING.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        good, bad = sources.csv_scan(spark, str(path), SCHEMA, spanning=True)
        got = sorted((r["id"], r["x"], r["s"]) for r in good.collect())
        raw = sorted(r["raw_line"] for r in bad.collect())
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{name}", value)
    assert got == [(1, 2.5, 'a\r\n"b",\nc'), (3, 1.0, "plain"), (4, None, "\n\n\n"), (5, 1.0, "")]
    assert raw == ['2,zz,"bad\nrow"', "6,1"] and {r["source"] for r in bad.collect()} == {"span.csv"}


def test_many_files_in_a_handful_of_jobs(spark, tmp_path):
    paths = [write(tmp_path / f"n{i}.csv", f"a,b\n{i},x\n{i + 1},{i}\n") for i in range(40)]
    paths += [write(tmp_path / f"t{i}.txt", "x" * (i % 2)) for i in range(10)]
    paths.append(write(tmp_path / "other.csv", "d,t,v,w\n2024-01-02,2024-01-02 03:04:05,1,\n2024-01-03,2024-01-02,99999999999,\n"))
    paths.append(write(tmp_path / "span.csv", 'a,b\n1,"x\ny"\n2,z\n3\n'))
    paths.append(write(tmp_path / "title.csv", "a,b\n"))
    paths.append(write(tmp_path / "nothing.csv", ""))
    paths.append(write(tmp_path / "odd name é.csv", "a,b\n1.5,NaN\n,2\n"))

    def ingested(some):
        spark.sparkContext.setJobGroup(f"of {len(some)}", "ingest")
        found = sources.ingest(spark, some)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return *found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"of {len(some)}"))

    assert ingested(paths[:2])[2] < 20 and ingested(paths[:40])[2] < 20  # whatever the number of files
    datasets, outcomes, jobs = ingested(paths)
    got = {r["name"]: tuple(r)[1:] for r in outcomes.collect()}
    assert jobs < len(paths)  # seven kinds of file
    assert all(got[f"n{i}.csv"] == ("tabular", "ok", None, 2, 0) for i in range(40))
    assert all(got[f"t{i}.txt"] == ("text", "ok" if i % 2 else "empty", None, i % 2, 0) for i in range(10))
    assert got["other.csv"] == ("tabular", "ok", None, 2, 0)
    assert datasets["other.csv"].dtypes == [("d", "date"), ("t", "timestamp"), ("v", "bigint"), ("w", "string")]
    assert got["span.csv"] == ("tabular", "quarantined", None, 2, 1)
    assert sorted(map(tuple, datasets["span.csv"].collect())) == [(1, "x\ny"), (2, "z")]
    assert got["title.csv"] == got["nothing.csv"] == ("tabular", "empty", None, 0, 0)
    assert datasets["title.csv"].columns == ["a", "b"] and datasets["nothing.csv"].count() == 0
    assert got["odd name é.csv"] == ("tabular", "ok", None, 2, 0)
    assert datasets["odd name é.csv"].dtypes == [("a", "double"), ("b", "double")]
    assert datasets["n3.csv"].dtypes == [("a", "int"), ("b", "string")] and len(datasets) == len(paths)


def test_csv_round_trip_of_awkward_cells(spark, tmp_path):
    rows = [(1, 0.1, 'say "hi", you'), (2, None, ""), (3, -1.5, None), (4, 1e300, "é\U0001f600")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "out")
    exports.export_csv(df, path, single_file=True)
    good, bad = sources.csv_scan(spark, path, SCHEMA)
    assert sorted(tuple(r) for r in good.collect()) == rows and bad.count() == 0
    with pytest.raises(AnalysisException):
        exports.export_csv(df, path)


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny {1}"), ("b", None)], "name string, text string")
    exports.export_texts_json(df, str(tmp_path / "t"))
    back = sources.read_json(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def result(project, task):
    return (project, task, ["f"], "a", "c", "r", "i")


RESULT = (
    "project string, task string, files array<string>, approach string, code string, "
    "results_text string, insights string"
)


def test_ledger_numbers_on(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert exports.read_ledger(spark, path).count() == 0
    exports.append_results(spark.createDataFrame([result("p", "b"), result("p", "a")], RESULT), path, ["task"])
    exports.append_results(spark.createDataFrame([result("p", "0"), result("q", "z")], RESULT), path, ["task"])
    got = sorted((r["project"], r["seq"], r["task"]) for r in exports.read_ledger(spark, path).collect())
    assert got == [("p", 1, "a"), ("p", 2, "b"), ("p", 3, "0"), ("q", 1, "z")]


def test_two_writers_and_retries_leave_no_gap(spark, tmp_path):
    path = str(tmp_path / "ledger")

    def write(n):
        rows = spark.createDataFrame([result("p", f"{n}-{i}") for i in range(3)] + [result(None, str(n))], RESULT)
        for _ in range(2):  # tried twice
            exports.append_results(rows, path, ["task"], batch=f"writer {n}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    got = exports.read_ledger(spark, path).collect()
    assert sorted(r["seq"] for r in got if r["project"] == "p") == list(range(1, 13))
    assert sorted(r["seq"] for r in got if r["project"] is None) == [1, 2, 3, 4]
    for n in range(4):  # the rows of one append follow one another
        mine = sorted(r["seq"] for r in got if r["project"] and r["task"].startswith(f"{n}-"))
        assert mine == list(range(mine[0], mine[0] + 3))


def test_appending_does_not_read_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for n in range(3):
        exports.append_results(spark.createDataFrame([result("p", str(n))], RESULT), path, ["task"])
    for folder in (tmp_path / "ledger" / "rows").iterdir():
        for file in folder.glob("*.parquet"):
            file.chmod(0o600)
            file.write_bytes(b"not a table")
    exports.append_results(spark.createDataFrame([result("p", "3")], RESULT), path, ["task"])


def test_conversations_as_json_in_order(spark, tmp_path):
    path, copy = str(tmp_path / "talk"), tmp_path / "json"
    said = spark.createDataFrame([(c, t, "user", f"{c}{t}") for c in (2, 1) for t in (1, 0)], "conv_id long, at int, role string, content string")
    exports.append_conversations(said, path, ["at"])
    exports.export_conversations_json(exports.read_conversations(spark, path), str(copy))
    lines = [json.loads(x) for f in sorted(copy.glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x["conv_id"], x["seq"], x["content"]) for x in lines] == [(1, 1, "10"), (1, 2, "11"), (2, 1, "20"), (2, 2, "21")]


def test_reports_under_their_names(spark, tmp_path):
    rows = [("p/1", 0, "a\n\nb\n"), ("p/1", 1, "c"), ("q", 0, ""), (None, 0, "nobody's")]
    path = str(tmp_path / "named")
    parts = spark.createDataFrame(rows, "project string, part int, text string")
    exports.report_sink(parts, "text", path, ["project", "part"], name="project")
    got = sorted(map(tuple, exports.read_reports(spark, path, "project").collect()), key=str)
    assert got == sorted([("p/1", "a"), ("p/1", ""), ("p/1", "b"), ("p/1", ""), ("p/1", "c"), ("q", ""), (None, "nobody's")], key=str)


def test_conversation_content_becomes_text(spark, tmp_path):
    path = str(tmp_path / "talk")
    said = spark.createDataFrame([(1, 0, "user", 5), (1, 1, "system", 7)], "conv_id long, at int, role string, content int")
    exports.append_conversations(said, path, ["at"])
    got = [tuple(r) for r in exports.read_conversations(spark, path).orderBy("seq").collect()]
    assert got == [(1, 1, "user", "5"), (1, 2, "system", "7")]


def test_report_parts_follow_one_another(spark, tmp_path):
    line = F.concat(F.lit("l"), F.col("id").cast("string"))
    parts = spark.range(30).select(F.lit("p").alias("project"), F.col("id").alias("part"), line.alias("t"))
    path = str(tmp_path / "report")
    exports.report_sink(parts.repartition(6), "t", path, ["project", "part"])
    lines = []
    for file in sorted((tmp_path / "report").glob("part-*")):
        lines += file.read_text().split("\n")[:-1]
    assert lines == [f"l{i}" for i in range(30)]
    with pytest.raises(AnalysisException):
        exports.report_sink(parts, "t", path, ["project", "part"])


def test_scratch_paths_are_new(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(scratch_root(spark))


def test_materialise_freezes_rows(spark):
    df = materialise(spark.range(100).withColumn("r", F.rand()))
    assert df.collect() == df.collect()


def test_tables_are_exported_under_their_names(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(2).select(F.lit("x").alias("s"))}
    (tmp_path / "all" / "c").mkdir(parents=True)
    paths, failed = exports.export_tables({**tables, "c": spark.range(1)}, str(tmp_path / "all"))
    assert list(failed) == ["c"] and "c" not in paths
    assert {n: sources.read_csv(spark, p, tables[n].schema).count() for n, p in paths.items()} == {"a": 3, "b": 2}


def test_csv_ingest_keeps_the_good_rows_and_counts_the_others(spark, tmp_path):
    path = write(tmp_path / "ragged.csv", "x,y\n1,2\n3\n4,5,6\n7,8\n")
    for schemas in ({}, {"ragged.csv": T.StructType.fromDDL("x int, y int")}):
        datasets, outcomes = sources.ingest(spark, [path], schemas)
        assert outcomes.first().asDict() == {
            "name": "ragged.csv", "kind": "tabular", "status": "quarantined", "error": None, "n_rows": 2, "n_quarantined": 2,
        }
        assert sorted(map(tuple, datasets["ragged.csv"].collect())) == [(1, 2), (7, 8)]
    path = write(tmp_path / "typed.csv", "x\n1\noops\n")
    _, outcomes = sources.ingest(spark, [path], {"typed.csv": T.StructType.fromDDL("x int")})
    assert tuple(outcomes.first())[2:] == ("quarantined", None, 1, 1)


def test_csv_export_of_line_ends_and_nested_cells(spark, tmp_path):
    rows = [
        (1, "two\nlines\r\nand \\n a backslash \\", [1.5, None], {"k": 1}, bytearray(b"\x00\xff")),
        (2, None, None, None, None),
        (3, "", [], {}, bytearray(b"")),
        (4, "\\N", [0.1], {"a": None}, bytearray(b"x")),
    ]
    df = spark.createDataFrame(rows, "id int, t string, a array<float>, m map<string, int>, b binary")
    path = str(tmp_path / "cells")
    exports.export_csv(df, path)
    back = sources.read_exported_csv(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.text(path).count() == len(rows) + spark.read.text(path).where("value like 'id,%'").count()
