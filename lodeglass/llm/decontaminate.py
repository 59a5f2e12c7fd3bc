"""Benchmark decontamination: an inverted index of test items, searched by every passage of every document.

Items are the indexed side, passages the queries. The score of an item is BM25 over the distinct words it shares with the passage, as
a part of the item's score against itself, so one threshold fits items of any length. The index is a block-max index:
each posting list is cut into blocks of ``BLOCK`` consecutive items with the greatest impact in each. A passage first
adds the block maxima of its words; where no block can reach the threshold the search is over. The others are searched by block-max
WAND, which returns every item at or above the threshold. Those are verified on the passage itself: five-word
shingles of the question, and words of the answer, 0.8 of each.

Passages are windows of twice the longest item and a half, moved by half of that, over whole texts, so every run as long as a changed
item lies in one of them. The index travels with the tasks; a benchmark beyond ``most_bytes`` is cut into several
indexes of bounded size, searched in turn, with document frequencies of the whole benchmark. One narrow pass per index.

Null and empty texts have no passages; items without a word are never found. An item's answer is its last sentence unless given; an item
of one sentence is all question. Repeated documents and repeated items are found each. A very long text is searched in slices of windows.
Ties between passages keep the greatest score and overlaps; an empty table on either side finds nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.columns import require

SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.6
BLOCK = 2
#: Text of the items in one index at most; the index is sent to every task.
MOST_BYTES = 4 << 20
#: Bounds (windows times blocks) that are held at a time; bounds memory only.
CELLS = 2_000_000
_K1, _B = 1.2, 0.75
_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[str, str]:
    """The last sentence with a word is the answer, all before it the question."""
    parts = [p for p in _SENTENCE_END.split(text or "") if _WORD.search(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (" ".join(parts), "")


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; fewer words are one run."""
    size = min(SHINGLE, len(tokens))
    return {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if size else set()


class Index:
    """The inverted index of some items, with impacts, block maxima and term maxima."""

    def __init__(self, items: list[tuple[object, str, str]], frequency: dict[str, int], total: int, mean: float) -> None:
        self.keys, self.questions, self.answers, texts = [], [], [], []
        for key, question, answer in items:
            tokens = words(question) + words(answer)
            if tokens:
                self.keys.append(key)
                texts.append(tokens)
                self.questions.append(shingles(words(question)))
                self.answers.append(set(words(answer)))
        self.longest = max(map(len, texts), default=0)
        listed: dict[str, list[tuple[int, float]]] = {}
        for n, tokens in enumerate(texts):
            counts: dict[str, int] = {}
            for w in tokens:
                counts[w] = counts.get(w, 0) + 1
            weigh = _K1 * (1 - _B + _B * len(tokens) / mean)
            part = {
                w: math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (_K1 + 1) / (c + weigh)
                for w, c in counts.items()
            }
            whole = sum(part.values())
            for w, impact in part.items():
                listed.setdefault(w, []).append((n, impact / whole))
        self.term = {w: t for t, w in enumerate(listed)}
        self.items = [[n for n, _ in postings] for postings in listed.values()]
        self.impacts = [[i for _, i in postings] for postings in listed.values()]
        self.blocks = -(-len(texts) // BLOCK)
        self.most = np.array([max(i) for i in self.impacts], dtype=np.float64)
        self.block_most: list[dict[int, float]] = []
        for postings in listed.values():
            most: dict[int, float] = {}
            for n, impact in postings:
                most[n // BLOCK] = max(most.get(n // BLOCK, 0.0), impact)
            self.block_most.append(most)
        # words of many items go into every block's bound as they are; the rest by block
        self.common = np.array([len(m) > max(64, self.blocks // 8) for m in self.block_most], dtype=bool)
        sizes = [0 if c else len(m) for m, c in zip(self.block_most, self.common, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        kept = [m for m, c in zip(self.block_most, self.common, strict=True) if not c]
        self.block_ids = np.array([b for m in kept for b in m], dtype=np.int64)
        self.block_values = np.array([v for m in kept for v in m.values()], dtype=np.float64)

    def bounds(self, window: np.ndarray, term: np.ndarray, windows: int) -> np.ndarray:
        """For each window and block the most that an item of the block can score; ``window`` and ``term`` list the
        distinct words of all windows."""
        base = np.bincount(window, self.most[term] * self.common[term], windows)
        count = self.starts[term + 1] - self.starts[term]
        owner = np.repeat(window, count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.starts[term], count)
        cells = np.bincount(owner * self.blocks + self.block_ids[at], self.block_values[at], windows * self.blocks)
        return base[:, None] + cells.reshape(windows, self.blocks)

    def _alive(
        self, window: np.ndarray, term: np.ndarray, windows: int, least: float
    ) -> Iterator[tuple[int, list[int], list[int]]]:
        """Windows with a block that can reach ``least``: number, terms, such blocks. Bounds are taken for as many windows at a time as
        fit into ``CELLS``, so a text of any length needs no more memory."""
        at_once = max(1, CELLS // max(self.blocks, 1))
        for first in range(0, windows, at_once):
            many = min(at_once, windows - first)
            edges = np.searchsorted(window, np.arange(first, first + many + 1))
            part = slice(edges[0], edges[-1])
            alive = self.bounds(window[part] - first, term[part], many) >= least
            for w in np.flatnonzero(alive.any(axis=1)):
                yield first + int(w), term[edges[w] : edges[w + 1]].tolist(), np.flatnonzero(alive[w]).tolist()

    def search(self, terms: list[int], threshold: float, alive: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose impacts over ``terms`` sum to ``threshold`` or more.

        ``alive`` are the blocks whose maxima over ``terms`` reach the threshold; cursors skip the others.
        """
        found = []
        slack = threshold - 1e-9

        def move(entry: list, to: int) -> bool:
            """Put a cursor on the first item of a living block that is not before ``to``."""
            ids = self.items[entry[2]]
            while True:
                entry[1] = bisect_left(ids, to, entry[1])
                if entry[1] == len(ids):
                    return False
                entry[0] = ids[entry[1]]
                block = entry[0] // BLOCK
                at = bisect_left(alive, block)
                if at == len(alive):
                    return False
                if alive[at] == block:
                    return True
                to = alive[at] * BLOCK

        lists = [[0, 0, t] for t in terms]  # item at the cursor, cursor, term
        lists = [e for e in lists if move(e, 0)]
        lists.sort()
        while lists:
            bound, pivot = 0.0, -1
            for n, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= slack:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most[t].get(block, 0.0) for _, _, t in lists[: pivot + 1]) < slack:
                # nothing up to the next list's item, or in the rest of this block, can reach the threshold
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                to = max(to, item + 1)
                lists = [e for n, e in enumerate(lists) if n > pivot or e[0] >= to or move(e, to)]
            elif lists[0][0] == item:
                score = sum(self.impacts[t][c] for at, c, t in lists[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                lists = [e for n, e in enumerate(lists) if n > pivot or move(e, item + 1)]
            else:
                lists = [e for n, e in enumerate(lists) if n > pivot or e[0] >= item or move(e, item)]
            lists.sort()
        return found

    def leaks(self, text: str | None, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """Items found in a text: number -> (score, question overlap, answer overlap) of the best passage."""
        tokens = words(text)
        if not tokens or not self.keys:
            return {}
        size = 2 * (self.longest + self.longest // 2 + 1)
        step = size // 2
        ids = np.fromiter(map(self.term.get, tokens, repeat(-1)), np.int64, len(tokens))
        places = np.flatnonzero(ids >= 0)
        if not len(places):
            return {}
        windows = max(1, -(-len(tokens) // step) - 1)
        # a word lies in the window that starts in its half, and in the one before
        late = np.minimum(places // step, windows - 1)
        early = np.maximum(places // step - 1, 0)
        pairs = np.unique(np.concatenate([late, early]) * len(self.term) + np.concatenate([ids[places], ids[places]]))
        window, term = pairs // len(self.term), pairs % len(self.term)
        found: dict[int, tuple[float, float, float]] = {}
        for w, of_window, blocks in self._alive(window, term, windows, threshold - 1e-9):
            hits = self.search(of_window, threshold, blocks)
            if not hits:
                continue
            passage = tokens[w * step : w * step + size]
            have, bag = shingles(passage), set(passage)
            if len(passage) >= SHINGLE:
                short = {len(next(iter(self.questions[n]))) for n, _ in hits if self.questions[n]} - {SHINGLE}
                for k in short:
                    have |= {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
            for n, score in hits:
                asked, answer = self.questions[n], self.answers[n]
                by_question = len(asked & have) / len(asked) if asked else 1.0
                by_answer = len(answer & bag) / len(answer) if answer else 1.0
                if by_question >= overlap and by_answer >= overlap:
                    found[n] = max(found.get(n, (0.0, 0.0, 0.0)), (score, by_question, by_answer))
        return found


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", most_bytes: int = MOST_BYTES) -> Iterator[Index]:
    """Indexes of bounded size over all items. ``items`` may have ``question`` and ``answer`` instead of ``text``."""
    given = {"question", "answer"} <= set(items.columns)
    require(items, key, *(["question", "answer"] if given else [text]))
    parts = [F.col("question"), F.col("answer")] if given else [F.col(text), F.lit(None).cast("string")]
    rows = items.select(F.col(key).alias("key"), parts[0].alias("a"), parts[1].alias("b")).withColumn(
        "all", F.lower(F.concat_ws(" ", "a", "b"))
    )
    found = F.regexp_extract_all(F.col("all"), F.lit(r"(?U)\w+"), F.lit(0))
    counted = rows.select(F.size(found).alias("n"), F.octet_length("all").alias("bytes"), found.alias("w"))
    total, mean, size = counted.where("n > 0").agg(F.count("*"), F.avg("n"), F.sum("bytes")).first()
    if not total:
        return
    shards = -(-size // most_bytes)
    for shard in range(shards):
        own = rows.where(F.pmod(F.xxhash64("all"), F.lit(shards)) == shard)
        # about most_bytes of text, by hash; equal items share a shard
        held = [(r["key"], *((r["a"], r["b"]) if given else question_and_answer(r["a"]))) for r in own.orderBy("key", "all").collect()]
        mine = sorted({w for _, q, a in held for w in words(q) + words(a)})
        if shards == 1:
            frequency: dict[str, int] = {}
            for _, q, a in held:
                for w in set(words(q) + words(a)):
                    frequency[w] = frequency.get(w, 0) + 1
        else:
            asked = items.sparkSession.createDataFrame([(w,) for w in mine], "word string")
            per = counted.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            frequency = {r["word"]: r["n"] for r in per.join(asked, "word").collect()}
            for w in mine:  # where the two word patterns differ
                frequency.setdefault(w, 1)
        yield Index(held, frequency, total, mean)


def find_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    threshold: float = THRESHOLD, overlap: float = OVERLAP, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """A row per document and item found in it: key, item key, score, question_overlap, answer_overlap."""
    require(documents, key, text)
    narrow = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"`{key}` {narrow.schema['_key'].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"

    def searcher(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys = [], []
                for n in range(len(batch)):
                    for item, scores in index.leaks(batch.column(1)[n].as_py(), threshold, overlap).items():
                        keys.append(n)
                        rows.append((index.keys[item], *scores))
                if rows:
                    columns = [pa.array(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(keys)), *columns],
                        [key, item_key, "score", "question_overlap", "answer_overlap"],
                    )

        return run

    found = None
    for index in indexes(items, item_key, most_bytes=most_bytes):
        one = narrow.mapInArrow(searcher(index), schema)
        found = one if found is None else found.unionByName(one)
    return documents.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(
    documents: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
    threshold: float = THRESHOLD, overlap: float = OVERLAP, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """The documents in which no item is found, all columns as they are."""
    require(documents, text)
    place = documents.columns.index(text)

    def keeper(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not index.leaks(t.as_py(), threshold, overlap) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    kept = documents
    for index in indexes(items, item_key, most_bytes=most_bytes):
        kept = kept.mapInArrow(keeper(index), documents.schema)
    return kept
