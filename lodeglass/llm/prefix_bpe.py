"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece of text has one valid encoding, so one valid *last token*. A token ending at a byte is the last token of that
prefix exactly when BPE would leave it next to the last token of the shorter prefix before it. The table of last tokens therefore grows
byte by byte, never changes behind the cursor, and gives the encoding of every prefix by walking back. Appending
extends the table of the last piece; an edit re-encodes the pieces around it and keeps the rest.

On Spark: each task encodes its own rows; vocabulary bytes travel with the task (bounded, checked). No shuffle.
Null text counts as empty and has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodeglass.llm.columns import require
from lodeglass.llm.pieces import Remembered, chunks

#: Vocabulary files above this size are refused: they are sent to every task.
MOST_VOCABULARY_BYTES = 32 << 20
#: Encoded chunks and pieces that a worker remembers (see Remembered).
REMEMBERED = 500_000


class Vocabulary:
    """Token ranks, which order the merges, and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no token")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._above = max(self.bytes_of) + 2
        self._ending = self._by_ending()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._beside: dict[tuple[int, int], bool] = {}

    def _by_ending(self) -> dict[bytes, tuple[tuple[int, int | None], ...]]:
        """Which tokens can end at a byte, longest first, by the last bytes (four; fewer at a start or where no longer token ends so).

        Up to four bytes the token itself is known; of longer ones the size, to be looked up.
        """
        longer: dict[bytes, set[int]] = {}
        endings: set[bytes] = set()
        for token in self.ranks:
            if len(token) > 3:
                longer.setdefault(token[-4:], set()).add(len(token))
            endings.add(token[-3:])
            endings.add(token[-2:])
        out = {}
        for ending in endings | longer.keys():
            found = [(size, None) for size in sorted(longer.get(ending, set()) - {4}, reverse=True)]
            found += [(n, token) for n in range(len(ending), 0, -1) if (token := self.ranks.get(ending[-n:])) is not None]
            out[ending] = tuple(found)
        return out

    @staticmethod
    def read_ranks(data: bytes) -> dict[bytes, int]:
        """Lines of base64 bytes, a blank and a rank."""
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition. Used on single tokens to learn their halves, and in tests."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            options = [
                (self.ranks[joined], i)
                for i in range(len(parts) - 1)
                if (joined := parts[i] + parts[i + 1]) in self.ranks and joined != piece
            ]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for single bytes, and () where merging never makes it."""
        if token not in self._halves:
            whole = self.bytes_of[token]
            parts = self.merged(whole) if len(whole) > 1 else None
            self._halves[token] = None if parts is None else tuple(parts) if len(parts) == 2 else ()
        return self._halves[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as they are when they meet.

        The merges inside both are undone, last first. At each step the parts at the seam could be joined; if that
        join has a lower rank than all merges undone so far, merging would have made it instead.
        """
        key = (left, right)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) >= 2_000_000:
                self._beside.clear()
            known = self._beside[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        bound = self._above
        if self.halves(right) == ():
            return False
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < bound:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if not of_left and not of_right:
                return True
            if of_left and (left > right or not of_right):
                bound, left = left, of_left[1]  # an equal merge at the seam lies to the right of it: later
            else:
                bound, right = right + 1, of_right[0]  # an equal merge at the seam lies to the left: sooner

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Complete ``last``, the last tokens of the prefixes of ``piece`` known so far, in place."""
        rank_of, known, ending = self.ranks.get, self._beside.get, self._ending.get
        for end in range(len(last) + 1, len(piece) + 1):
            options = ending(piece[end - 4 : end]) if end > 3 else None
            if options is None:
                options = ending(piece[max(end - 3, 0) : end]) or ending(piece[max(end - 2, 0) : end]) or ending(piece[end - 1 : end])
            for size, token in options:
                if token is None:
                    if size > end or (token := rank_of(piece[end - size : end])) is None:
                        continue
                if size == end:
                    fits = self.halves(token) != ()
                else:
                    pair = (last[end - size - 1], token)
                    fits = known(pair)
                    if fits is None:
                        fits = self.beside(*pair)
                if fits:
                    last.append(token)
                    break
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the whole prefix that a table covers."""
        tokens, end = [], len(last)
        while end:
            tokens.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return tokens[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is itself a token is that token, also where merging would not make it."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.extend(piece, []))


class Encoder:
    """Whole texts to ids and back, remembering chunks and pieces."""

    def __init__(self, vocabulary: Vocabulary, most: int = REMEMBERED) -> None:
        self.vocabulary = vocabulary
        self._pieces = pieces = Remembered(lambda p: vocabulary.encode_piece(p.encode()), most)
        self._split = split = vocabulary.pattern.findall
        self._chunks = Remembered(lambda c: [i for p in split(c) for i in pieces[p]], most)
        top = max(vocabulary.bytes_of) + 1
        self._bytes = [vocabulary.bytes_of.get(i, b"") for i in range(top)]
        self._decimals = [str(i) for i in range(top)]
        self._written = Remembered(lambda c: self._write([i for p in split(c) for i in pieces[p]]), most)

    def learn(self, texts: list[str | None]) -> None:
        """Encode the new pieces of many texts in order of their bytes: each goes on with the table of the one before it as far as
        they begin alike. What is learnt is only remembered; it changes no result."""
        new = {c for t in texts if t for c in chunks(t) if c not in self._written and c not in self._chunks}
        pieces = {p for c in new for p in self._split(c) if p not in self._pieces}
        table, before = [], b""
        for data in sorted(p.encode() for p in pieces):
            whole = self.vocabulary.ranks.get(data)
            if whole is not None:
                self._pieces[data.decode()] = [whole]
                continue
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del table[same:]
            self._pieces[data.decode()] = self.vocabulary.walk(self.vocabulary.extend(data, table))
            before = data

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self._chunks.__getitem__, chunks(text or ""))))

    def _write(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), self.decimals(ids).encode(), self.decode(ids)

    def written(self, text: str | None) -> tuple[int, bytes, bytes]:
        """How many ids a text has, the ids as decimals joined by commas, and the bytes that they decode to."""
        found = [self._written[c] for c in chunks(text or "")]
        return sum([f[0] for f in found]), b",".join([f[1] for f in found]), b"".join([f[2] for f in found])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def decimals(self, ids: list[int]) -> str:
        """The ids as text, joined by commas."""
        return ",".join(map(self._decimals.__getitem__, ids))


class EditableText:
    """An encoded text that takes appends and edits, re-encoding only what they can change.

    A piece is settled by the characters up to two behind its end, or three from its start (contractions), so pieces further ahead of an
    edit stay; behind it, pieces stay from the first old boundary that the new cut meets. Appending to the last piece
    extends its table of last tokens.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary, self.text = vocabulary, ""
        self._pieces: list[str] = []
        self._tables: list[list[int]] = []
        self.reencoded = 0  # bytes put through the table so far
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to ``end``."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("outside the text")
        at, keep = 0, 0
        for piece in self._pieces:
            if max(at + len(piece) + 2, at + 3) > start:
                break
            at, keep = at + len(piece), keep + 1
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        old, begin = {}, at
        for n, piece in enumerate(self._pieces[keep:], keep):
            if begin >= end:
                old[begin + shift] = n
            begin += len(piece)
        pieces, tables, cursor = [], [], at
        rest = len(self._pieces)
        while cursor < len(text):
            if cursor in old and cursor >= start + len(new):
                rest = old[cursor]
                break
            piece = self.vocabulary.pattern.match(text, cursor)[0]
            data, table = piece.encode(), []
            if not pieces and keep < len(self._pieces) and piece.startswith(self._pieces[keep]):
                table = list(self._tables[keep])  # the same piece, longer: go on with its table
            self.reencoded += len(data) - len(table)
            pieces.append(piece)
            tables.append(self.vocabulary.extend(data, table))
            cursor += len(piece)
        self._pieces[keep:rest], self._tables[keep:rest] = pieces, tables
        self.text = text

    def ids(self) -> list[int]:
        ranks, walk = self.vocabulary.ranks, self.vocabulary.walk
        return [
            i
            for piece, table in zip(self._pieces, self._tables, strict=True)
            for i in ([ranks[piece.encode()]] if piece.encode() in ranks else walk(table))
        ]


_ENCODERS: dict[str, Encoder] = {}  # of this worker, by vocabulary and pattern


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(Vocabulary.read_ranks(data), pattern))
    return _ENCODERS[key]


def read_vocabulary(path: str) -> bytes:
    """The bytes of a vocabulary file on the driver; refused beyond the size that every task may be sent."""
    with open(path, "rb") as file:
        data = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return data


def map_texts(
    documents: DataFrame, vocabulary: str, pattern: str, fields: dict[str, tuple[str, pa.DataType]],
    row: Callable[[Encoder, str | None], tuple], key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key`` and what ``row`` makes of each text; ``fields`` names its values with their SQL and Arrow types."""
    require(documents, key, text)
    data = read_vocabulary(vocabulary)
    narrow = documents.select(key, text)
    of_key = narrow.schema[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data, pattern)
        for batch in batches:
            for at in range(0, len(batch), 512):  # results of long texts stay small in memory
                part = batch.slice(at, 512)
                values = part.column(1).to_pylist()
                if pa.types.is_string(part.schema.field(1).type):
                    encoder.learn(values)
                made = list(zip(*[row(encoder, v) for v in values], strict=True))
                columns = [pa.array(v, kind) for v, (_, kind) in zip(made, fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, *fields])

    listed = ", ".join(f"`{n}` {kind}" for n, (kind, _) in fields.items())
    return narrow.mapInArrow(encode, f"`{key}` {of_key.dataType.simpleString()}, {listed}")


def encode(documents: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, the tokens of each whole text."""
    ids = {"ids": ("array<int>", pa.list_(pa.int32()))}
    return map_texts(documents, vocabulary, pattern, ids, lambda e, t: (e.encode(t),), key, text)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``bytes``, what the ids stand for; null ids give no bytes."""
    made = {"bytes": ("binary", pa.binary())}
    return map_texts(tokens, vocabulary, pattern, made, lambda e, i: (e.decode(i or []),), key, ids)


def round_trip(documents: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256, in one pass."""

    def digests(encoder: Encoder, text: str | None) -> tuple:
        n, decimals, decoded = encoder.written(text)
        return n, hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded).hexdigest()

    fields = {
        "n_tokens": ("bigint", pa.int64()),
        "ids_sha256": ("string", pa.string()),
        "decoded_sha256": ("string", pa.string()),
    }
    return map_texts(documents, vocabulary, pattern, fields, digests, key, text)
