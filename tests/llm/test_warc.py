import gzip
import hashlib
import io
import uuid

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeglass.llm import warc
from lodeglass.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def by_hand(rows):
    holders = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and key is not None:
            holders[data] = max(key, holders.get(data, key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        again = data in holders and key != holders[data]
        kind = ("revisit", holders[data]) if again else ("response", None)
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), *kind))
    return sorted(out, key=str)


def listed(rows):
    assert rows.where("problem IS NOT NULL").count() == 0
    named = rows.select("key", "payload_bytes", "sha1", "type", "refers_to")
    return sorted(map(tuple, named.collect()), key=str)


def test_query_by_hand(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    again = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000))
    again.write.parquet(str(tmp_path / "pages.parquet"))
    for folder in (sf, str(tmp_path)):
        found = QUERIES["op11_segment_reassembly"](spark, folder)
        rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()
        assert sorted(map(tuple, found.select(*NAMES).collect()), key=str) == by_hand(rows)
        assert found.where("problem IS NOT NULL").count() == 0 and found.where("n_segments > 1").count() > 0


ROWS = [
    (1, "http://a/", "é" * 30_000), (2, "http://b/\n x", "é" * 30_000), (3, None, None), (4, "http://d/", ""),
    (5, "u", "z" * 999), (6, "u", "z" * 999), (None, "n", "y" * 2000), (7, "w", "y" * 2000), (7, "w", "y" * 2000),
    (8, "x", "Content-Length: 3\r\n\r\nWARC/1.1\r\n" * 90), (None, "lone", "v" * 5000),
]


def test_segments_over_files_nulls_ties_and_empty_table(spark, make):
    df = make([(*r, "k") for r in ROWS], SCHEMA + ", key string")
    folder = warc.new_folder(spark)
    manifest = warc.write_archives(df, folder, segment=700, most=1500)
    assert manifest.count() > 10  # the long page is spread over many files
    payloads = warc.read_payloads(spark, manifest, keep=True)
    assert listed(warc.resolve(payloads)) == by_hand(ROWS)
    bodies = {r["key"]: r["payload"] for r in payloads.where("type = 'response'").collect()}
    assert bodies[2] == ("é" * 30_000).encode() and bodies[3] == bodies[4] == b""
    assert payloads.where("type = 'warcinfo'").count() == manifest.count()
    empty = warc.write_archives(make([], SCHEMA), warc.new_folder(spark))
    assert warc.resolve(warc.read_payloads(spark, empty)).count() == 0


def stored(spark, records):
    """A file of the given records, as a table of paths."""
    path = f"{warc.new_folder(spark)}-{uuid.uuid4().hex}.warc.gz"
    files, at = pafs.FileSystem.from_uri(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(at, compression=None) as out:
        out.write(b"".join(records))
    return spark.createDataFrame([(path,)], "path string")


def problems(spark, records):
    rows = warc.read_payloads(spark, stored(spark, records)).collect()
    return [r["problem"] for r in rows]


def test_broken_chains_are_reported(spark):
    whole = warc.response(b"abc" * 1000, "2020-01-01T00:00:00Z", {"Row-Key": 1}, 500)
    assert len(whole) > 4
    assert problems(spark, whole[::-1] + whole) == [None]  # any order, and each segment twice
    assert problems(spark, whole[1:]) == ["segment 1 is missing"]
    assert problems(spark, whole[:2] + whole[3:]) == ["segment 3 is missing"]
    assert problems(spark, whole[:-1]) == ["the last segment is missing"]
    other = warc.response(b"abd" * 1000, "2020-01-01T00:00:00Z", {"Row-Key": 1}, 500)
    name = next(iter(warc.Archive(io.BytesIO(whole[0]))))[0]["warc-record-id"]
    swapped = gzip.decompress(other[2]).replace(
        next(iter(warc.Archive(io.BytesIO(other[0]))))[0]["warc-record-id"].encode(), name.encode()
    )
    assert problems(spark, [*whole[:2], swapped and gzip.compress(swapped), *whole[3:]]) == ["another digest"]
    short = warc.record("continuation", {
        "WARC-Record-ID": "x", "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": len(whole),
        "WARC-Segment-Total-Length": 9,
    }, b"0\r\n\r\n")
    assert "instead of 9" in problems(spark, [*whole[:-1], short])[0]


def test_broken_files_and_revisits(spark):
    one = warc.response(b"q" * 50, "d", {"Row-Key": 1})
    found = problems(spark, [one[0], b"no gzip"])
    assert len(found) == 2 and found.count(None) == 1
    assert [bool(p) for p in problems(spark, [one[0][:-20]])] == [True]
    alone = warc.read_payloads(spark, stored(spark, [warc.revisit("00", "d", {"Row-Key": 5})]))
    row = warc.resolve(alone).first()
    assert (row["key"], row["refers_to"], row["problem"]) == (5, None, "no record holds the payload")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40), st.data())
def test_any_payload_through_the_framing(payload, chunk, data):
    message = warc.HTTP_HEAD + warc.framed(payload, chunk)
    body = warc.Body(keep=True)
    while message:
        step = data.draw(st.integers(1, len(message)))
        body.feed(message[:step])
        message = message[step:]
    assert body.close(f"sha1:{hashlib.sha1(payload).hexdigest()}")[4] == payload


@pytest.mark.parametrize("message, problem", [
    (b"HTTP/1.1 200 OK\r\nX: y", "ends in head"),
    (warc.HTTP_HEAD + b"zz\r\n", "no chunk size"),
    (warc.HTTP_HEAD + b"-3\r\n", "no chunk size"),
    (warc.HTTP_HEAD + b"5\r\nabc", "ends in chunk"),
    (warc.HTTP_HEAD + b"2\r\nabc\r\n0\r\n\r\n", "a chunk longer than its size"),
    (warc.HTTP_HEAD + b"0\r\n\r\nmore", "bytes behind the last chunk"),
])
def test_broken_framing(message, problem):
    body = warc.Body()
    body.feed(message)
    assert body.close(None)[3] == problem


def test_framing_with_extensions_trailers_and_plain_bodies():
    body = warc.Body(keep=True)
    body.feed(warc.HTTP_HEAD + b"3;a=b\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n")
    assert body.close(None)[4] == b"abc"
    body = warc.Body(keep=True)
    body.feed(b"HTTP/1.1 200 OK\r\nContent-Type: x\r\n\r\nabc")
    assert body.close(None)[4] == b"abc"
    plain = list(warc.Archive(io.BytesIO(b"WARC/1.0\r\nContent-Length: 2\r\nA: b\r\n c\r\n\r\nhi\r\n\r\n")))
    assert plain[0][0] == {"content-length": "2", "a": "b c"}
