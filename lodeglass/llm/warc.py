"""Web archives (WARC/1.1): writing responses in segments, and reassembling them when they are read.

A record whose block is longer than ``SEGMENT`` is written in segments: the first keeps its type and is number 1, the others are
``continuation`` records that name the first by ``WARC-Segment-Origin-ID``, are numbered, and the last states the total length.
Segments may lie in several files. Payloads travel in chunked transfer framing, each record is a gzip member of its own. A payload that
another record holds already is written as a ``revisit`` with its digest and no body.

*Reassembly*: reading tasks decode whole records in place and pass on segments in pieces; Spark groups the pieces by origin, sorts
them by segment number, and a task feeds them through the HTTP and chunk decoder one after the other, so no task holds a whole
payload unless it is asked for. A set of segments is whole if the numbers run from 1 without a gap, the last states a total and the
lengths add up to it; the digest that a record declares must be that of the decoded payload. What fails is returned as a row
with its ``problem`` and without a payload, never dropped.

Files are written by tasks under names that are never reused and returned in a manifest; only files in a manifest are read, so repeated or
lost tasks do no harm. The folder must be one that every executor can reach.

Null bodies count as empty; null keys and addresses are left out of the records and come back as null. Rows with the same key and the same
payload are each a response when that key is the largest of the payload. A very long body is only a longer chain of
segments. An empty table writes no file and reads as an empty result. Other columns of the input do not matter.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.columns import require
from lodeglass.session import materialise, scratch_path

#: Bytes of a record's block above which it is written in segments of that length.
SEGMENT = 8192
#: Bytes of payload in one chunk of the transfer framing.
CHUNK = 4096
#: Payloads of fewer bytes are always written out.
REVISIT_FROM = 1000
#: Bytes of a file after which a task begins the next one, with whatever record comes then.
MOST_BYTES = 256 << 20
#: Bytes that are read, passed on and decoded at a time; bounds memory only.
PIECE = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
BLANK_LINE = b"\r\n\r\n"
#: Name of the field that carries a row's key; the format lets readers ignore fields they do not know.
KEY_FIELD = "Row-Key"


# ---- the format ----


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [payload[i : i + chunk] for i in range(0, len(payload), chunk)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    lines = {"WARC-Type": kind, **fields, "Content-Length": len(block)}
    head = b"".join([f"{k}: {v}\r\n".encode() for k, v in lines.items() if v is not None])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head + b"\r\n" + block + BLANK_LINE) + packer.flush()


def _new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def response(payload: bytes, date: str, fields: dict[str, object], segment: int = SEGMENT) -> list[bytes]:
    """The records of one response: one, or the first segment and its continuations."""
    block, name = HTTP_HEAD + framed(payload), _new_id()
    first = {"WARC-Record-ID": name, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", **fields}
    first["WARC-Payload-Digest"] = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    if len(block) <= segment:
        return [record("response", first, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record("response", {**first, "WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        later = {"WARC-Record-ID": _new_id(), "WARC-Date": date, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n}
        later["WARC-Segment-Total-Length"] = len(block) if n == len(parts) else None
        out.append(record("continuation", later, part))
    return out


def revisit(digest: str, date: str, fields: dict[str, object]) -> bytes:
    """A record that stands for a payload another record holds."""
    own = {"WARC-Record-ID": _new_id(), "WARC-Date": date, "Content-Type": "application/http; msgtype=response", **fields}
    return record("revisit", {**own, "WARC-Profile": PROFILE, "WARC-Payload-Digest": f"sha256:{digest}"}, HTTP_HEAD)


class Body:
    """Takes an HTTP message piece by piece, undoes the transfer framing and digests the payload."""

    def __init__(self, keep: bool = False, http: bool = True) -> None:
        self.length, self.problem = 0, None
        self._kept = [] if keep else None
        self._sums = {name: hashlib.new(name) for name in ("sha1", "sha256")}
        self._step, self._held, self._left = ("head" if http else "plain"), b"", 0

    def feed(self, data: bytes) -> None:
        if self._step == "plain":
            return self._take(data)
        data = self._held + data
        at = 0
        while self.problem is None and at < len(data):
            if self._step == "chunk":
                part = data[at : at + self._left]
                self._take(part)
                at, self._left = at + len(part), self._left - len(part)
                if not self._left:
                    self._step = "after"
                continue
            if self._step == "plain":
                self._take(data[at:])
                at = len(data)
                continue
            if self._step == "done":
                self.problem = "bytes behind the last chunk"
                continue
            mark = BLANK_LINE if self._step == "head" else b"\r\n"
            end = data.find(mark, at)
            if end < 0:
                break
            line, at = data[at:end], end + len(mark)
            self._line(line)
        self._held = data[at:] if self.problem is None else b""
        if len(self._held) > PIECE:
            self.problem = f"no end of {self._step}"

    def _line(self, line: bytes) -> None:
        if self._step == "head":
            fields = [f.partition(b":") for f in line.lower().split(b"\r\n")[1:]]
            coding = [v.strip() for k, _, v in fields if k.strip() == b"transfer-encoding"]
            self._step = "size" if coding and coding[-1].endswith(b"chunked") else "plain"
        elif self._step == "size":
            digits = line.partition(b";")[0].strip()
            try:
                self._left = int(digits, 16)
            except ValueError:
                self._left = -1
            if self._left < 0 or not digits.isalnum():
                self.problem = "no chunk size"
            self._step = "chunk" if self._left else "trailer"
        elif self._step == "after":
            if line:
                self.problem = "a chunk longer than its size"
            self._step = "size"
        elif not line:  # trailer fields end with an empty line
            self._step = "done"

    def _take(self, data: bytes) -> None:
        self.length += len(data)
        for s in self._sums.values():
            s.update(data)
        if self._kept is not None:
            self._kept.append(data)

    def close(self, declared: str | None) -> tuple:
        """(bytes, sha1, sha256, problem, payload) at the end of the message."""
        if self.problem is None and self._step not in ("plain", "done"):
            self.problem = f"ends in {self._step}"
        sums = {name: s for name, s in self._sums.items()}
        if self.problem is None and declared:
            label, _, value = declared.partition(":")
            if label.lower() in sums:
                found = sums[label.lower()]
                if value.lower() not in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower()):
                    self.problem = "another digest"
        if self.problem is not None:
            return None, None, None, self.problem, None
        payload = None if self._kept is None else b"".join(self._kept)
        return self.length, sums["sha1"].hexdigest(), sums["sha256"].hexdigest(), None, payload


class Archive:
    """The records of one file, plain or gzipped, from a stream."""

    def __init__(self, stream) -> None:
        start = io.BufferedReader(stream, PIECE) if not isinstance(stream, io.BufferedReader) else stream
        # read member by member: what stands before a broken one comes out
        self._in = gzip.GzipFile(fileobj=start) if start.peek(2)[:2] == b"\x1f\x8b" else start

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        """Fields in lower case, and the block in pieces; whatever of a block is not taken is skipped."""
        while True:
            line = self._in.readline()
            while line in (b"\r\n", b"\n"):
                line = self._in.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError("no record where one should begin")
            fields: dict[str, str] = {}
            last = None
            while (line := self._in.readline()) not in (b"\r\n", b"\n"):
                if not line:
                    raise EOFError("ends in the fields of a record")
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[0] in " \t" and last:
                    fields[last] += " " + text.strip()
                    continue
                name, _, value = text.partition(":")
                last = name.strip().lower()
                fields[last] = value.strip()
            pieces = self._block(int(fields["content-length"]))
            yield fields, pieces
            for _ in pieces:
                pass

    def _block(self, left: int) -> Iterator[bytes]:
        while left:
            piece = self._in.read(min(left, PIECE))
            if not piece:
                raise EOFError("ends in a block")
            left -= len(piece)
            yield piece


# ---- writing on Spark ----

MANIFEST = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
)


def new_folder(spark: SparkSession) -> str:
    """A folder nobody has used yet, under the shared one."""
    path = scratch_path(spark, "archives")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def mark_revisits(pages: DataFrame, key: str, body: str) -> DataFrame:
    """``key, url, payload`` rows with ``digest`` and ``held``: whether another key's record holds the payload.

    Only digests and keys are grouped; a payload with any number of copies is one row of the small side.
    """
    marked = pages.withColumn("digest", F.sha2(F.col(body), 256))
    long = marked.where(F.octet_length(body) >= REVISIT_FROM).select("digest", key)
    copies = long.groupBy("digest").agg(F.count("*").alias("copies"), F.max(key).alias("holder")).where("copies > 1")
    known = materialise(copies.where(F.col("holder").isNotNull()).select("digest", "holder"), "copies")
    held = F.col("holder").isNotNull() & ~F.col(key).eqNullSafe(F.col("holder"))
    return marked.join(known, "digest", "left").select(key, "url", body, "digest", held.alias("held"))


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", segment: int = SEGMENT,
    most: int = MOST_BYTES, date: str | None = None,
) -> DataFrame:
    """One record per row, in files of about ``most`` bytes; returns the manifest."""
    require(pages, key, url, body)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    narrow = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), payload.alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        part, seq, out, name, records, size = TaskContext.get().partitionId(), 0, None, "", 0, 0
        about = b"software: lodeglass\r\nformat: WARC File Format 1.1\r\n"

        def close() -> pa.RecordBatch:
            nonlocal seq, out
            out.close()
            out = None
            row = [part, seq, f"{folder}/{name}", records, size]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, MANIFEST, strict=True)], schema=MANIFEST)

        for batch in batches:
            for row in batch.to_pylist():
                address = quote(row["url"], safe="%/:=&?~#+!$,;'@()*[]") if row["url"] else f"urn:uuid:{uuid.uuid4()}"
                fields = {"WARC-Target-URI": address, KEY_FIELD: row["key"]}
                if row["held"]:
                    made = [revisit(row["digest"], date, fields)]
                else:
                    made = response(row["payload"], date, fields, segment)
                for data in made:
                    if out is None:
                        name, records, size = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{at}/{name}", compression=None)
                        info = {"WARC-Record-ID": _new_id(), "WARC-Date": date, "Content-Type": "application/warc-fields"}
                        data = record("warcinfo", info, about) + data
                        records += 1
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= most:
                        yield close()
        if out is not None:
            yield close()

    schema = "part int, seq int, path string, records bigint, bytes bigint"
    return materialise(mark_revisits(narrow, "key", "payload").mapInArrow(write, schema), "manifest")


# ---- reading on Spark ----

_OUT = [
    ("type", pa.string()), ("record_id", pa.string()), ("key", pa.int64()), ("uri", pa.string()), ("digest", pa.string()),
    ("n_segments", pa.int32()), ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("sha256", pa.string()),
    ("problem", pa.string()), ("payload", pa.binary()),
]
_READ = [
    *_OUT, ("path", pa.string()), ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()),
    ("piece", pa.int32()), ("data", pa.binary()),
]
_SQL = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
PAYLOADS = ", ".join(f"{n} {_SQL[t]}" for n, t in _OUT)
RECORDS = ", ".join(f"{n} {_SQL[t]}" for n, t in _READ)


class _Rows:
    """Rows gathered into Arrow batches of bounded bytes."""

    def __init__(self, schema: list) -> None:
        self._schema = pa.schema(schema)
        self._rows, self._size = [], 0

    def add(self, **row) -> None:
        self._rows.append(row)
        self._size += 500 + len(row.get("data") or b"") + len(row.get("payload") or b"")

    def full(self) -> bool:
        return self._size > 4 * PIECE

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist(self._rows, schema=self._schema)
        self._rows, self._size = [], 0
        return made


def _whole(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def read_records(spark: SparkSession, files: DataFrame, keep: bool = False) -> DataFrame:
    """The records of the files in column ``path``: whole ones decoded, segments in pieces (``origin``, ``segment``, ``piece``, ``data``).

    A file that breaks off gives the records before that and one row with its ``problem``.
    """
    tasks = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(_READ)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = pafs.FileSystem.from_uri(path)
                try:
                    with system.open_input_file(at) as file:
                        for fields, pieces in Archive(file):
                            for row in _rows_of(path, fields, pieces, keep):
                                rows.add(**row)
                                if rows.full():
                                    yield rows.batch()
                except (EOFError, ValueError, KeyError, zlib.error, gzip.BadGzipFile) as broken:
                    rows.add(path=path, problem=f"{type(broken).__name__}: {broken}")
        yield rows.batch()

    return files.select("path").repartition(tasks).mapInArrow(read, RECORDS)


def _rows_of(path: str, fields: dict[str, str], pieces: Iterator[bytes], keep: bool) -> Iterator[dict]:
    kind, name, segment = fields.get("warc-type"), fields.get("warc-record-id"), _whole(fields.get("warc-segment-number"))
    row = {"path": path, "type": kind, "record_id": name, "uri": fields.get("warc-target-uri")}
    row |= {"key": _whole(fields.get(KEY_FIELD.lower())), "digest": fields.get("warc-payload-digest")}
    if segment is not None:
        row |= {"segment": segment, "origin": fields.get("warc-segment-origin-id", name)}
        row["total"] = _whole(fields.get("warc-segment-total-length"))
        n = -1
        for n, piece in enumerate(pieces):  # noqa: B007
            yield {**row, "piece": n, "data": piece}
        if n < 0:
            yield {**row, "piece": 0, "data": b""}
    elif kind in ("response", "resource"):
        body = Body(keep, http=kind == "response")
        for piece in pieces:
            body.feed(piece)
        yield row | dict(zip(_RESULT, body.close(row["digest"]), strict=True)) | {"n_segments": 1}
    else:
        yield row


_RESULT = ("payload_bytes", "sha1", "sha256", "problem", "payload")


class _Chain:
    """The segments of one origin, fed in order of number, record and piece."""

    def __init__(self, origin: str, keep: bool) -> None:
        self.origin, self._keep = origin, keep
        self._first: dict | None = None
        self._body: Body | None = None
        self._segment, self._record, self._piece, self._bytes, self._total, self._problem = 0, None, -1, 0, None, None

    def feed(self, row: dict) -> None:
        if row["segment"] == self._segment:
            if row["record_id"] != self._record or row["piece"] <= self._piece:
                return  # the same segment again
        elif row["segment"] == self._segment + 1:
            self._segment, self._record = row["segment"], row["record_id"]
            if self._first is None:
                self._first = row
                self._body = Body(self._keep, http=row["type"] == "response")
        else:
            self._problem = self._problem or f"segment {self._segment + 1} is missing"
            return
        self._piece = row["piece"]
        self._bytes += len(row["data"])
        self._total = row["total"] if row["total"] is not None else self._total
        self._body.feed(row["data"])

    def close(self) -> dict:
        first = self._first or {"record_id": self.origin}
        out = {k: first.get(k) for k in ("type", "record_id", "key", "uri", "digest")} | {"n_segments": self._segment}
        problem = self._problem
        if problem is None and self._total is None:
            problem = "the last segment is missing"
        if problem is None and self._total != self._bytes:
            problem = f"{self._bytes} bytes instead of {self._total}"
        if problem is not None:
            return out | {"problem": problem}
        return out | dict(zip(_RESULT, self._body.close(first["digest"]), strict=True))


def reassemble(records: DataFrame, keep: bool = False) -> DataFrame:
    """One row per origin of the segments among ``records``: its payload's length and digests, or what is wrong with it."""
    segments = records.where(F.col("segment").isNotNull())
    order = ["origin", "segment", "record_id", "piece"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chain = _Rows(_OUT), None
        for batch in batches:
            for row in batch.to_pylist():
                if chain is None or chain.origin != row["origin"]:
                    if chain is not None:
                        rows.add(**chain.close())
                        if rows.full():
                            yield rows.batch()
                    chain = _Chain(row["origin"], keep)
                chain.feed(row)
        if chain is not None:
            rows.add(**chain.close())
        yield rows.batch()

    needed = segments.select("type", "record_id", "key", "uri", "digest", "origin", "segment", "total", "piece", "data")
    return needed.repartition("origin").sortWithinPartitions(*order).mapInArrow(join, PAYLOADS)


def read_payloads(spark: SparkSession, files: DataFrame, keep: bool = False) -> DataFrame:
    """All records of the files, segments put together; with ``keep`` the payloads themselves too."""
    records = materialise(read_records(spark, files, keep), "records")
    names = [n for n, _ in _OUT]
    return records.where(F.col("segment").isNull()).select(*names).unionByName(reassemble(records, keep).select(*names))


def resolve(payloads: DataFrame) -> DataFrame:
    """Responses and revisits; a revisit has the length and digests of the response with its digest, whose key it ``refers_to``.

    Of several responses with one digest the largest key counts. Only digests that some revisit asks for are grouped.
    """
    plain = materialise(payloads.drop("payload").where(F.col("type").isin("response", "revisit") | F.col("problem").isNotNull()), "payloads")
    revisits = plain.where("type = 'revisit'").drop("payload_bytes", "sha1", "sha256", "problem")
    asked = revisits.select("digest").distinct()
    held = plain.where("type = 'response' AND problem IS NULL").join(asked, "digest", "left_semi")
    targets = held.groupBy("digest").agg(
        F.max("key").alias("refers_to"), *[F.min(c).alias(c) for c in ("payload_bytes", "sha1", "sha256")]
    )
    found = revisits.join(materialise(targets, "targets"), "digest", "left").withColumn(
        "problem", F.when(F.col("sha256").isNull(), F.lit("no record holds the payload"))
    )
    others = plain.where(~F.col("type").eqNullSafe("revisit")).withColumn("refers_to", F.lit(None).cast("long"))
    return others.unionByName(found)
