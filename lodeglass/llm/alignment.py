"""Which tokens of one tokenizer cover the bytes of which tokens of another, over whole texts.

A byte-level BPE of the tokenizers library (A) encodes a blank and the text; a sentencepiece BPE (B) encodes the text and puts that
blank before it itself. Both token sequences tile the same bytes. *Interval coalescing* aligns them: all tokens are put in order of
their start, the running maximum of the ends is taken, and a group breaks where a start reaches that maximum. Inside the groups the
overlapping pairs of tokens are the links.

On Spark: a task reads its documents in blocks of about ``BLOCK`` characters and aligns the distinct chunks of a block at once;
texts are cut into chunks at blanks where neither vocabulary has a token across (checked, otherwise a text is one chunk). Each
block counts its own id pairs, so a pair that stands in every document meets the corpus-wide sums once per block, not once per link.
The sums go back to the blocks by the same key, and every document adds up its chunks. No group is larger than a block.

Null and empty texts, and texts whose tokens do not spell the text (the sign U+2581 in it, for example), have no tokens: zeros and
an empty digest. Repeated rows and null ids are kept as they are, an empty table gives an empty result, other columns of the
input do not matter. A very long text is a block of its own; links whose counts tie for the highest of their B id are all best.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.columns import require
from lodeglass.llm.pieces import byte_letters, chunks
from lodeglass.llm.prefix_bpe import read_vocabulary
from lodeglass.session import materialise

#: Characters of text that a block gathers before it is aligned; bounds a task's memory, never what is aligned.
BLOCK = 4_000_000
#: Encoded chunks that a worker remembers, twice at most; bounds its memory, changes speed only.
REMEMBERED = 200_000
#: Chunks that the libraries encode in one call, and rows of a batch that are Python objects at once.
AT_ONCE, ROWS = 4096, 512
#: The sign that stands for a blank in sentencepiece models, and the separators of the written groups.
BLANK = "▁"
_SAME, _OTHER, _NEXT = b",|;"


class Tokenizers:
    """Both tokenizers of one worker: distinct chunks to the ids of A and of B."""

    def __init__(self, spec: bytes, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_buffer(spec)
        self._a.encode_special_tokens = True  # their strings in a text are plain text
        self._b = SentencePieceProcessor(model_proto=model)
        if not self._b.id_to_piece(self._b.encode("a")[0]).startswith(BLANK):
            raise ValueError("the sentencepiece model must put a blank before a text")
        value = {letter: byte for byte, letter in byte_letters().items()}
        entries = {i: t for t, i in self._a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [b""] * (max(entries) + 1)
        for i, t in entries.items():
            known = all(c in value for c in t)
            self.bytes_a[i] = bytes(value[c] for c in t) if known else t.encode()
        pieces = [self._b.id_to_piece(i) for i in range(len(self._b))]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self._apart = _cuts_at_blanks(json.loads(spec)) and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self._lone = self._b.piece_to_id(BLANK)
        self._new: dict[str, tuple[bytes, bytes, bool]] = {}
        self._old: dict[str, tuple[bytes, bytes, bool]] = {}

    def cut(self, text: str) -> list[str]:
        """The chunks of a blank and the text; both tokenizers encode them apart."""
        if not self._apart:
            return [" " + text]
        first, *rest = chunks(text)
        return [" " + first, *rest]

    def encode(self, names: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """For each chunk the ids of A, the ids of B (little-endian) and whether both spell the chunk."""
        if len(self._new) > REMEMBERED:
            self._old, self._new = self._new, {}
        held = [self._new.get(n) or self._old.get(n) for n in names]
        asked = [n for n, h in zip(names, held, strict=True) if h is None]
        found = (made for at in range(0, len(asked), AT_ONCE) for made in self._ask(asked[at : at + AT_ONCE]))
        out = [next(found) if h is None else h for h in held]
        self._new.update(zip(names, out, strict=True))
        return out

    def _ask(self, names: list[str]) -> list[tuple[bytes, bytes, bool]]:
        of_a = [e.ids for e in self._a.encode_batch_fast(names, add_special_tokens=False)]
        of_b = self._b.encode([n[1:] for n in names], num_threads=1)
        out = []
        for name, a, b in zip(names, of_a, of_b, strict=True):
            if name == " ":  # the library takes an empty text for no text
                b = [self._lone]
            raw = name.encode()
            spelt = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
            out.append((array("i", a).tobytes(), array("i", b).tobytes(), True) if spelt else (b"", b"", False))
        return out


def _cuts_at_blanks(spec: dict) -> bool:
    """Whether the byte-level tokenizer cuts texts by the usual pattern, so that chunks encode apart."""
    plain = {"type": "ByteLevel", "add_prefix_space": False}
    pre = spec.get("pre_tokenizer") or {}
    same = {k: pre.get(k) for k in plain} == plain and pre.get("use_regex", True)
    return bool(same and not spec.get("normalizer") and not spec.get("truncation"))


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of two tilings of the same bytes: tokens (A first, then B) in order of start, and the group of each."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in A, place in B) whose byte ranges overlap, in order."""
    low = np.searchsorted(b_end, a_start, "right")
    many = np.searchsorted(b_start, a_end, "left") - low
    before = np.cumsum(many) - many
    return np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(before - low, many)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below ``n`` in decimal, one row each with room for a separator, and their lengths."""
    width = len(str(n)) + 1
    table = np.frombuffer("".join(str(i).ljust(width) for i in range(n)).encode(), np.uint8).reshape(n, width)
    return table, np.array([len(str(i)) for i in range(n)])


class Block:
    """The alignment of the distinct chunks of a block, laid end to end."""

    def __init__(self, encoded: list[tuple[bytes, bytes, bool]], lengths_a, lengths_b, decimals) -> None:
        k = len(encoded)
        self.spelt = np.array([e[2] for e in encoded], bool)
        a, b = (np.frombuffer(b"".join([e[s] for e in encoded]), "<i4") for s in (0, 1))
        self.n_a, self.n_b = (np.array([len(e[s]) // 4 for e in encoded], np.int64) for s in (0, 1))
        a_end, b_end = np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b])
        a_start, b_start = a_end - lengths_a[a], b_end - lengths_b[b]
        order, group = coalesce(a_start, a_end, b_start, b_end)
        chunk = np.concatenate([np.repeat(np.arange(k), self.n_a), np.repeat(np.arange(k), self.n_b)])
        first = np.flatnonzero(np.diff(group, prepend=-1))
        self.n_groups = np.bincount(chunk[order[first]], minlength=k)
        at_a, at_b = overlaps(a_start, a_end, b_start, b_end)
        self.link_chunk = chunk[at_a]
        self.n_links = np.bincount(self.link_chunk, minlength=k)
        self.pairs, self.link_pair = np.unique(a[at_a].astype(np.int64) << 32 | b[at_b], return_inverse=True)
        self.written = self._written(np.concatenate([a, b]), chunk, order, group, len(a), decimals)

    def _written(self, ids, chunk, order, group, n_a, decimals) -> list[bytes]:
        """Each chunk's groups as ``a1,a2|b1;a3|b2,b3``."""
        side = (order >= n_a).astype(np.int8)
        inside = np.lexsort((side, group))  # A before B in each group, each in text order
        order, group, side = order[inside], group[inside], side[inside]
        table, lengths = decimals
        ids, n = ids[order], len(order)
        mark = np.full(n, _NEXT, np.uint8)
        same_group = group[1:] == group[:-1]
        mark[:-1][same_group] = np.where(side[1:] == side[:-1], _SAME, _OTHER)[same_group]
        rows, size = table[ids], lengths[ids]
        rows[np.arange(n), size] = mark
        flat = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
        ends = np.cumsum(np.bincount(chunk[order], weights=size + 1, minlength=len(self.n_a)).astype(np.int64)).tolist()
        return [flat[s : e - 1] if e > s else b"" for s, e in zip([0, *ends], ends, strict=False)]


FOUND = (
    "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, "
    "pairs array<struct<place:int,a:int,b:int,n:long>>, link_chunk binary, link_pair binary"
)
_ARROW = pa.schema(
    [("block", pa.string()), *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
     ("groups_sha256", pa.string()), ("codes", pa.binary()),
     ("pairs", pa.list_(pa.struct([("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))),
     ("link_chunk", pa.binary()), ("link_pair", pa.binary())]
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@cache
def _worker(spec: bytes, proto: bytes) -> tuple[Tokenizers, tuple]:
    """The tokenizers of one worker, kept from task to task with what they remember, and the tables of a block."""
    both = Tokenizers(spec, proto)
    lengths = [np.array([len(b) for b in table], np.int64) for table in (both.bytes_a, both.bytes_b)]
    return both, (*lengths, _decimals(max(len(both.bytes_a), len(both.bytes_b))))


def _align_block(tokenizers: Tokenizers, keys: list, texts: list[str | None], tables: tuple) -> Iterator[pa.RecordBatch]:
    """One row per document, then one row with what the whole block shares."""
    places: dict[str, int] = {}
    coded, ends = [], []
    for text in texts:
        if text:
            coded += [places.setdefault(c, len(places)) for c in tokenizers.cut(text)]
        ends.append(len(coded))
    block = Block(tokenizers.encode(list(places)), *tables)
    codes, ends = np.array(coded, np.int64), np.array(ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]])

    def summed(per_chunk: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(per_chunk[codes])])
        return running[ends] - running[starts]

    good = summed(~block.spelt) == 0
    sums = [summed(n) * good for n in (block.n_a, block.n_b, block.n_groups, block.n_links)]
    digests, kept = [], []
    for start, end, fine in zip(starts.tolist(), ends.tolist(), good.tolist(), strict=True):
        mine = codes[start:end] if fine else codes[:0]
        whole = b";".join([block.written[c] for c in mine.tolist()])
        digests.append(hashlib.sha256(whole).hexdigest() if len(mine) else "")
        kept.append(mine.astype("<i4").tobytes())
    used = np.bincount(codes[np.repeat(good, ends - starts)], minlength=len(places))
    n = np.bincount(block.link_pair, weights=used[block.link_chunk], minlength=len(block.pairs)).astype(np.int64)
    name, none = uuid.uuid4().hex, [None] * len(keys)
    yield pa.RecordBatch.from_arrays(
        [pa.array([name] * len(keys)), pa.array(keys, pa.int64()), *map(pa.array, sums), pa.array(digests, pa.string()),
         pa.array(kept, pa.binary()), *[pa.array(none, f.type) for f in list(_ARROW)[8:]]],
        schema=_ARROW,
    )
    if len(block.pairs):
        listed = pa.StructArray.from_arrays(
            [pa.array(np.arange(len(n), dtype=np.int32)), pa.array((block.pairs >> 32).astype(np.int32)),
             pa.array((block.pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n)],
            fields=list(_ARROW.field("pairs").type.value_type),
        )
        shared = [b.astype("<i4").tobytes() for b in (block.link_chunk, block.link_pair)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), *[pa.array([None], f.type) for f in list(_ARROW)[1:8]],
             pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), listed), *[pa.array([s], pa.binary()) for s in shared]],
            schema=_ARROW,
        )


def _add_up(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links."""
    place = counts.column("place").to_numpy()
    count, best = np.zeros((2, len(place)), np.int64)
    count[place] = counts.column("count").to_numpy()
    best[place] = counts.column("best").to_numpy()
    of_chunk = np.zeros((2, 0), np.int64)
    shared = rows.filter(pc.is_valid(rows.column("link_chunk")))
    for chunk, pair in zip(*(shared.column(c).to_pylist() for c in ("link_chunk", "link_pair")), strict=True):
        chunk, pair = (np.frombuffer(x, "<i4") for x in (chunk, pair))
        size = int(chunk.max()) + 1
        of_chunk = np.zeros((2, size), np.int64)
        for total, value in zip(of_chunk, (best, count), strict=True):
            running = np.concatenate([[0], np.cumsum(value[pair])])  # links stand in order of their chunks
            edges = np.searchsorted(chunk, np.arange(size + 1))
            total[:] = running[edges[1:]] - running[edges[:-1]]
    documents = rows.filter(pc.is_valid(rows.column("codes")))
    sums = np.array([of_chunk[:, np.frombuffer(c, "<i4")].sum(axis=1) for c in documents.column("codes").to_pylist()], np.int64)
    sums = sums.reshape(-1, 2)
    for name, values in (("n_best", sums[:, 0]), ("count_sum", sums[:, 1])):
        documents = documents.append_column(name, pa.array(values))
    return documents.select([f.split()[0] for f in RESULT.split(", ")])


def align(documents: DataFrame, tokenizer: str, model: str, text: str = "text") -> DataFrame:
    """Tokens, groups and links of every document, with how common its links are in the whole corpus.

    ``tokenizer`` (tokenizers JSON, A) and ``model`` (sentencepiece, B) are paths on the driver; their bytes, of checked
    size, go with the tasks.
    """
    require(documents, "doc_id", text)
    spec, proto = read_vocabulary(tokenizer), read_vocabulary(model)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, tables = _worker(spec, proto)
        keys, texts, held = [], [], 0
        for batch in (part.slice(at, ROWS) for part in batches for at in range(0, len(part), ROWS)):
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(value)
                held += len(value or "")
                if held >= BLOCK:
                    yield from _align_block(both, keys, texts, tables)
                    keys, texts, held = [], [], 0
        if keys:
            yield from _align_block(both, keys, texts, tables)

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = materialise(narrow.mapInArrow(blocks, FOUND), "aligned")
    each = found.where(F.col("pairs").isNotNull()).select("block", F.inline("pairs"))
    counted = materialise(each.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = counted.groupBy("b").agg(F.max("count").alias("highest"))
    scored = counted.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    wanted = each.join(scored, ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    return found.drop("pairs").groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(_add_up, RESULT)


_GROUPS = re.compile(r"[|;]")


def read_groups(written: str) -> list[tuple[list[int], list[int]]]:
    """Written groups as lists of A ids and B ids."""
    parts = [[int(i) for i in p.split(",")] for p in _GROUPS.split(written)] if written else []
    return list(zip(parts[::2], parts[1::2], strict=True))
