"""Token ids in directly addressable files.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the lowest chunk of every id; a continuation bitmap says which ids go on, and
level 1 holds the next chunk of only those, and so on. The place of an id's chunk in the next level is the number of
continuation bits before it, found from a rank directory (a count every 512 bits) and at most eight words. Any id is
read by touching one byte and one rank per level; no block is decoded.

Files are written by range: documents are range-partitioned and sorted by id, each task writes its own files (a new one after
``most`` ids, which bounds its memory) and returns one manifest row per file. A file name is never reused, and only files in
the manifest are read, so repeated or lost tasks do no harm. The target must be a folder that every executor can reach.

Texts are encoded as the library's plain call does, so the strings of added tokens in them become those tokens. Null text counts as empty and
yields the end id only. Null ids sort first, equal ones by a hash of their text. Repeated rows are written each, an empty table gives an
empty manifest, other columns of the input do not matter.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.llm.columns import require
from lodeglass.llm.pieces import PATTERN, Remembered, byte_letters, chunks
from lodeglass.llm.prefix_bpe import read_vocabulary
from lodeglass.session import materialise, scratch_path

MAGIC = b"DACS"
_WORD, _BLOCK = 64, 512  # bits
#: Ids in one file at most, unless one document has more; bounds a task's memory, never what is written.
MOST_IDS = 16_000_000
#: Encoded chunks, and pieces of them, that a worker remembers, twice at most.
REMEMBERED = 500_000
#: Below this letter all versions of Unicode agree on what is a letter; chunks beyond it are cut by the library.
_SETTLED = "\u0250"


# ---- the format ----


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap words, rank directory)."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        goes_on = rest > 0xFF
        bits = np.zeros(-(-len(rest) // _BLOCK) * _BLOCK, dtype=np.uint8)
        bits[: len(rest)] = goes_on
        words = np.packbits(bits, bitorder="little").view("<u8")
        blocks = bits.reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([np.zeros(1, np.uint64), np.cumsum(blocks, dtype=np.uint64)]).astype("<u8")
        levels.append(((rest & 0xFF).astype(np.uint8), words, directory))
        if not goes_on.any():
            return levels
        rest = rest[goes_on] >> 8


def to_bytes(ids: np.ndarray, keys: list[int | None], starts: np.ndarray) -> bytes:
    """A whole file: header, levels, then the directory of documents (null flags, ids, starts)."""
    levels = pack(ids)
    header = {"tokens": len(ids), "documents": len(keys), "levels": [len(c) for c, _, _ in levels]}
    head = json.dumps(header).encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head)) % 8)
    out = [MAGIC, np.uint32(len(head)).tobytes(), head]
    for chunk, words, directory in levels:
        out += [chunk.tobytes(), b"\0" * (-len(chunk) % 8), words.tobytes(), directory.tobytes()]
    nulls = np.array([k is None for k in keys], dtype=np.uint8)
    out += [nulls.tobytes(), b"\0" * (-len(keys) % 8)]
    out += [np.array([k or 0 for k in keys], "<i8").tobytes(), np.asarray(starts, "<u8").tobytes()]
    return b"".join(out)


class TokenFile:
    """A file's contents (bytes or a memory map), addressed in place."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a token file")
        size = int(np.frombuffer(view[4:8], "<u4")[0])
        header = json.loads(bytes(view[8 : 8 + size]))
        self.n_tokens, at = header["tokens"], 8 + size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(view, kind, count, at)
            at += -(-found.nbytes // 8) * 8
            return found

        self._levels = []
        for count in header["levels"]:
            blocks = -(-count // _BLOCK)
            self._levels.append((take("u1", count), take("<u8", blocks * (_BLOCK // _WORD)), take("<u8", blocks + 1)))
        n = header["documents"]
        nulls, keys = take("u1", n), take("<i8", n)
        self.keys = [None if null else int(k) for null, k in zip(nulls, keys, strict=True)]
        self.starts = take("<u8", n + 1)

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        value = 0
        for level, (chunk, words, directory) in enumerate(self._levels):
            value |= int(chunk[at]) << (8 * level)
            word, bit = divmod(at, _WORD)
            if not int(words[word]) >> bit & 1:
                break
            block = at // _BLOCK
            before = sum(int(w).bit_count() for w in words[block * 8 : word])
            at = int(directory[block]) + before + (int(words[word]) & ((1 << bit) - 1)).bit_count()
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: one rank per level, then the chunks in a row."""
        values, where = np.zeros(stop - start, dtype=np.uint32), np.arange(stop - start)
        for level, (chunk, words, directory) in enumerate(self._levels):
            if start >= stop:
                break
            values[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            block = start // _BLOCK
            piece = words[block * 8 : -(-stop // _WORD)].view("u1")
            bits = np.unpackbits(piece, bitorder="little")
            lead = start - block * _BLOCK
            before = int(directory[block]) + int(bits[:lead].sum(dtype=np.int64))
            goes_on = bits[lead : lead + stop - start].astype(bool)
            where = where[goes_on]
            start, stop = before, before + len(where)
        return values

    def document(self, n: int) -> np.ndarray:
        return self.range(int(self.starts[n]), int(self.starts[n + 1]))


# ---- encoding with the tokenizers library ----


@cache
def _tokenizer(data: bytes):
    """Encoder of one worker: whole text to little-endian ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    spec = json.loads(data)
    added = spec.get("added_tokens") or []
    marks = [t["content"] for t in added]  # the library cuts texts at these first
    plain = {"type": "ByteLevel", "add_prefix_space": False}
    pre = {k: (spec.get("pre_tokenizer") or {}).get(k) for k in plain}
    apart = pre == plain and (spec["pre_tokenizer"].get("use_regex", True)) and not spec.get("normalizer")
    apart = apart and not spec.get("truncation")
    apart = apart and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)

    def whole(part: str) -> bytes:
        return np.array(tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    if not apart:  # chunks of another kind of tokenizer may depend on one another
        return lambda text: whole(text) if text else b""
    letters, model, split = byte_letters(), tokenizer.model, regex.compile(PATTERN).findall
    marked = regex.compile("|".join(map(regex.escape, marks)) or r"(?!)").search

    def piece(part: str) -> bytes:
        merged = model.tokenize(part.encode().decode("latin-1").translate(letters))
        return array("I", [t.id for t in merged]).tobytes()

    def chunk(part: str) -> bytes:
        if (part.isascii() or max(part) < _SETTLED) and not marked(part):
            if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):  # one piece by the pattern
                return piece(part)
            found = split(part)
            return b"".join(map(known.__getitem__, found)) if len(found) > 1 else piece(part)  # a piece is a chunk of one piece
        return whole(part)

    known = Remembered(chunk, REMEMBERED)
    return lambda text: b"".join(map(known.__getitem__, chunks(text)))


# ---- on Spark ----

MANIFEST = "part int, seq int, path string, documents bigint, tokens bigint"


def write_tokens(
    documents: DataFrame, tokenizer: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text",
    most: int = MOST_IDS,
) -> DataFrame:
    """Encode every text, append ``end_id`` to each, write files in ascending key order; returns the manifest.

    ``tokenizer`` is the path of a tokenizers JSON file on the driver; its bytes, of checked size, go with the tasks.
    """
    require(documents, key, text)
    spec = read_vocabulary(tokenizer)
    narrow = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    # equal keys tie by text, so that a repeated task writes the same order
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(spec), np.uint32(end_id).tobytes()
        files, at = pafs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        keys, held, starts = [], [], [0]

        def flush() -> pa.RecordBatch:
            nonlocal seq, keys, held, starts
            name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            ids = np.frombuffer(b"".join(held), "<u4")
            with files.open_output_stream(f"{at}/{name}") as out:
                out.write(to_bytes(ids, keys, np.array(starts)))
            row = [[part], [seq], [f"{folder}/{name}"], [len(keys)], [len(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            seq, keys, held, starts = seq + 1, [], [], [0]
            names = [f.split()[0] for f in MANIFEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for n in range(len(batch)):
                found = encode(batch.column(1)[n].as_py() or "") + end
                keys.append(batch.column(0)[n].as_py())
                held.append(found)
                starts.append(starts[-1] + len(found) // 4)
                if starts[-1] >= most:
                    yield flush()
        if keys:
            yield flush()

    return materialise(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document: key, start (ids before it in all files), n_tokens, ids_crc32, read from the files."""
    ahead = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, at = pafs.FileSystem.from_uri(path)
                with system.open_input_file(at) as file:
                    tokens = TokenFile(file.read_buffer())
                sums = [zlib.crc32(tokens.document(n).astype("<u4").tobytes()) for n in range(len(tokens.keys))]
                starts = tokens.starts.astype(np.int64)
                columns = [
                    pa.array(tokens.keys, pa.int64()),
                    pa.array(starts[:-1] + start),
                    pa.array(np.diff(starts)),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32"])

    rows = files.select("path", "start").repartition(tasks)
    return rows.mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    """A folder nobody has used yet, under the shared one."""
    path = scratch_path(spark, "tokens")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
