"""Spelling variants: words one edit apart, and the frequent form that each rare one stands for.

An edit changes a word's letter counts little: the squared distance of the count vectors is 1 for an inserted or deleted
letter and at most 2 for a replaced one. Those distances come from *blocked Gram matrices*: |x|² + |y|² − 2·x·y as one NumPy product per
pair of blocks; a block holds words of one length or of the next. Pairs at most two apart are kept and their edit is verified
letter by letter.

Blocks are narrowed without losing a pair. The letters are dealt into three classes; one edit touches at most two letters, so two
near words have equal counts in at least one class. A cell is a length, a class and the counts in it; each word stands in three cells
of its own length and in three of the length below, and a pair is kept by the first class in which it agrees. A cell of more
words than ``TILE`` is dealt into tiles, and every two tiles meet in a task of their own, so that no task holds more than two tiles
however many words a cell has. All words meet this way; there is no limit on partners.

Words are counted by Spark over whole texts, merged before the shuffle. Roots come from pointer doubling over written tables: a form is at
least ``TIMES`` as frequent as its word, so chains are as long as the logarithm of the largest count at most.

Null and empty texts hold no words, repeated rows count again, null ids count as ids without digits, an empty table gives an empty
result, other columns of the input do not matter. Ties for the most frequent near word go to the smallest in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.columns import require
from lodeglass.session import materialise

#: What a word is made of, and which letters are folded.
LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Classes of letters; two letters at most change, so three classes always leave one untouched.
CLASSES = 3
#: Words of a cell that one side of a task's Gram matrix holds, on average.
TILE = 2048
#: Rows of a Gram matrix at a time; bounds memory only.
ROWS = 512
#: A form is at least so many times as frequent as its variant.
TIMES = 2

_SLOT = np.full(0x110000, -1, np.int16)
_SLOT[LETTERS] = np.arange(len(LETTERS))
_CLASS = np.array(LETTERS) % CLASSES


def words(documents: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 0) -> DataFrame:
    """Every run of letters, with A to Z in lower case: one row per occurrence.

    With ``one_in`` the runs whose checksum of ``<key>:<run>`` is divisible by it lose one letter, at the checksum modulo the length.
    """
    require(documents, key, text)
    folded = F.translate(F.col(text), UPPER, LOWER)
    runs = documents.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(folded, F.lit(f"({RUN})"), F.lit(1))).alias("word"),
    )
    if not one_in:
        return runs.select("word")
    sum_ = F.crc32(F.concat_ws(":", "key", "word"))
    at = (F.col("sum") % F.length("word")).cast("int")
    cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return runs.select("word", sum_.alias("sum")).select(
        F.when(F.col("sum") % one_in == 0, cut).otherwise(F.col("word")).alias("word")
    )


def vocabulary(occurrences: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n``: the distinct words of at least ``shortest`` letters that occur at least ``least`` times."""
    long = occurrences.where(F.length("word") >= shortest)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letters_of(word: Column, which: int) -> Column:
    """The letters of one class in a word, sorted: its counts in that class."""
    others = "".join(chr(c) for c in LETTERS if c % CLASSES != which)
    return F.array_join(F.array_sort(F.split(F.translate(word, others, ""), "")), "")


def _cells(vocab: DataFrame) -> DataFrame:
    """Each word in its cells: of its own length (``longer`` 0) and of the length below (``longer`` 1)."""
    places = [
        F.struct(
            (F.length("word") - longer).alias("size"),
            F.lit(which).alias("class"),
            F.xxhash64(_letters_of(F.col("word"), which)).alias("counts"),
            F.lit(longer).alias("longer"),
        )
        for which in range(CLASSES)
        for longer in (0, 1)
    ]
    return vocab.select("word", "n", F.inline(F.array(*places)))


_CELL = ["size", "class", "counts"]
_TASK = [*_CELL, "i", "j"]
PAIRS = "word string, n_near long, best_n long, best string"


class _Tile:
    """The words of two tiles of a cell that meet in a task."""

    def __init__(self, letters: np.ndarray, words_: list[str], n: np.ndarray, longer: np.ndarray, tile: np.ndarray, size: int) -> None:
        order = np.argsort(longer, kind="stable")
        self.words, self.n, self.tile = [words_[i] for i in order], n[order], tile[order]
        self.rank = order  # the rows come sorted by word
        self.shorter, self.size = int(len(longer) - longer.sum()), size
        spans = np.where(longer == 1, size + 1, size)
        offsets = np.cumsum(spans) - spans
        width = np.arange(size + 1)
        self.same = letters[offsets[order[: self.shorter], None] + width[:size]]
        self.above = letters[offsets[order[self.shorter :], None] + width]

    def counts(self) -> np.ndarray:
        """Letter counts, in a type that holds all their products exactly."""
        kind = np.float32 if 2 * (self.size + 1) ** 2 < 1 << 24 else np.float64
        out = np.zeros((len(self.words), len(LETTERS)), kind)
        for part, start in ((self.same, 0), (self.above, self.shorter)):
            rows = np.repeat(np.arange(len(part)), part.shape[1])
            flat = np.bincount(rows * len(LETTERS) + part.ravel(), minlength=len(part) * len(LETTERS))
            out[start : start + len(part)] = flat.reshape(len(part), len(LETTERS))
        return out

    def near(self, which: int, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place, place) one edit apart that agree in class ``which`` and in none before it."""
        x = self.counts()
        squares = (x * x).sum(axis=1)
        found = [np.zeros((2, 0), np.int64)]
        for start in range(0, self.shorter, ROWS):
            stop = min(start + ROWS, self.shorter)
            # a pair is met from its shorter word, or from the first of two of one length
            gap = squares[start:stop, None] + squares[None, start:] - 2 * (x[start:stop] @ x[start:].T)
            p, q = np.nonzero(gap <= 2)
            keep = q > p
            p, q = p[keep] + start, q[keep] + start
            if apart:
                keep = self.tile[p] != self.tile[q]
                p, q = p[keep], q[keep]
            found.append(np.array(self._verified(p, q)))
        p, q = np.concatenate(found, axis=1)
        differs = x[p] != x[q]
        keep = ~differs[:, _CLASS == which].any(axis=1)
        for before in range(which):
            keep &= differs[:, _CLASS == before].any(axis=1)
        return p[keep], q[keep]

    def _verified(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        equal = q < self.shorter
        ps, qs = p[equal], q[equal]
        one = (self.same[ps] != self.same[qs]).sum(axis=1) == 1
        pl, ql = p[~equal], q[~equal]
        short, long = self.same[pl], self.above[ql - self.shorter]
        unlike = short != long[:, :-1]
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), self.size)
        behind = np.arange(self.size) >= first[:, None]
        inserted = ~((short != long[:, 1:]) & behind).any(axis=1)
        return np.concatenate([ps[one], pl[inserted]]), np.concatenate([qs[one], ql[inserted]])

    def summary(self, which: int, apart: bool) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
        """Per word with near words in this task: how many, the largest count among them, and the smallest such word."""
        p, q = self.near(which, apart)
        own, other = np.concatenate([p, q]), np.concatenate([q, p])
        order = np.lexsort((self.rank[other], -self.n[other], own))
        own, other = own[order], other[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        many = np.diff(np.append(first, len(own)))
        best = other[first]
        return [self.words[i] for i in own[first]], many, self.n[best], [self.words[i] for i in best]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task and word; the rows of one task are gathered and their words compared."""
    held: list[pa.Table] = []

    def close() -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held).combine_chunks()
        held.clear()
        tasks = np.array([rows.column(c).to_numpy() for c in _TASK])
        starts = np.flatnonzero(np.append(True, (tasks[:, 1:] != tasks[:, :-1]).any(axis=0)))
        words_ = rows.column("word").to_pylist()
        lengths = np.array([len(w) for w in words_])
        letters = _SLOT[np.frombuffer("".join(words_).encode("utf-32-le"), "<u4")]
        at = np.append(0, np.cumsum(lengths))
        n, longer, tile = (rows.column(c).to_numpy() for c in ("n", "longer", "tile"))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(words_)], strict=True):
            size, which, _, i, j = (int(v) for v in tasks[:, s])
            mine = _Tile(letters[at[s] : at[e]], words_[s:e], n[s:e], longer[s:e], tile[s:e], size)
            for column, values in zip(out, mine.summary(which, i != j), strict=True):
                column.extend(values)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], [f.split()[0] for f in PAIRS.split(", ")]
        )

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        tasks = np.array([rows.column(c).to_numpy() for c in _TASK])
        last = np.flatnonzero((tasks != tasks[:, -1:]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0  # where the batch's last task begins
        if held and (cut or any(held[-1].column(c)[-1].as_py() != rows.column(c)[0].as_py() for c in _TASK)):
            if cut:
                held.append(rows.slice(0, cut))
                rows = rows.slice(cut)
            yield from close()
        elif cut:
            held.append(rows.slice(0, cut))
            rows = rows.slice(cut)
            yield from close()
        held.append(rows)
    if held:
        yield from close()


def near_words(vocab: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of ``word, n`` that has a word one edit away."""
    cells = _cells(vocab)
    sizes = cells.groupBy(*_CELL).agg(F.count("*").alias("all"), F.sum(1 - F.col("longer")).alias("same"))
    used = sizes.where((F.col("same") >= 1) & (F.col("all") >= 2))
    tiles = F.ceil(F.col("all") / TILE).cast("int")
    dealt = cells.join(used, _CELL).withColumn("tile", F.pmod(F.xxhash64("word", F.lit("tile")), tiles).cast("int"))
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    met = dealt.select(*_CELL, "word", "n", "longer", "tile", other.alias("other")).select(
        *_CELL, "word", "n", "longer", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    )
    found = met.repartition(*_TASK).sortWithinPartitions(*_TASK, "word").mapInArrow(_meet, PAIRS)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best")
    )


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form`` without cycles: each step doubles how far a word sees along its chain."""
    now = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        step = materialise(moved, "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(vocab: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``word, n``; ``vocab`` is read several times."""
    frequent = F.col("best_n") >= TIMES * F.col("n")
    found = materialise(
        vocab.join(near_words(vocab), "word", "left").select(
            "word",
            F.when(frequent, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    followed = roots(found.where(F.col("form").isNotNull()))
    return found.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
