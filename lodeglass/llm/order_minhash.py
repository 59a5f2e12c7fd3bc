"""Near-duplicate documents by Order MinHash.

A document's k-mers are its runs of five words, each labelled with how often it has occurred before in the text. One sketch takes the ``TUPLE``
labelled k-mers that a hash function orders first, and writes them down in the order of the text, so two documents
agree on it when they share those k-mers *and* their order: agreement follows edit similarity, not only shared content. ``ROWS`` sketches
form a band; documents that agree on a whole band are compared. With bands of one sketch a pair that shares J of its k-mers meets with a
probability of about 1 - (1 - J^3)^64.

Comparison is banded alignment: the word-level edit distance, given up beyond the band that the threshold allows
(words are coded as single characters, so the banded Levenshtein distance of Spark does it in the JVM). Documents are linked at
1 - edits / longer length >= 0.8, and linked groups are classes, named by their smallest document id.

Equal texts are first folded into one representative, so a text with any number of copies is sketched per row but linked once. Buckets
are worked off in rounds (see ``links``): no bucket is paired off whole, none is capped. Texts that share a bucket and were not linked in the first
round meet again only if they share one of their rarest runs of two words: of two texts that align, the longer has at most 0.4 of its runs broken,
so the rarest 0.4 of either's runs and two more cannot all be missing in the other's. Texts around one common passage thus do not meet in pairs.

Null text counts as empty. Equal texts are one class also when empty; a text without words has no other duplicates. Fewer than five words are one k-mer.
Rows equal in id and text repeat their result. Document ids must be integers; a class of null ids only is named null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.columns import require
from lodeglass.llm.links import connect
from lodeglass.session import materialise

K = 5
TUPLE, ROWS, BANDS = 3, 1, 64
SIMILARITY = 0.8

_WORD = re.compile(r"\w+")
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words are coded as characters above the surrogates; two words share one by a chance of one in a million.
_FIRST_CODE, _CODES = 0x10000, 0xFFFFF
#: So many of the most frequent runs are put in order of frequency, all others come before them. Any one order finds every pair.
RANKED = 20_000


class _Words(dict):
    """Hash of a word; forgotten all at once when too many are held, which changes no result."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _STEP
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-mer with its occurrence number, in text order."""
    if not len(words):
        return words
    size = min(k, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for n in range(size):
        runs = _mixed(runs * _STEP + words[n : len(words) - size + 1 + n])
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(runs))
    nth = np.empty(len(runs), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mixed(runs + nth * _MIX)


def sketches(kmers: np.ndarray, number: int) -> np.ndarray:
    """``number`` sketches: each the hash of its first ``TUPLE`` k-mers in text order."""
    out = np.empty(number, np.uint64)
    seeds = _mixed(np.arange(1, number + 1, dtype=np.uint64) * _MIX)
    take = min(TUPLE, len(kmers))
    step = max(1, 200_000 // len(kmers))  # so many at a time: bounds memory for long texts
    for low in range(0, number, step):
        seed = seeds[low : low + step, None]
        rank = (kmers[None, :] ^ seed) * _STEP
        rank ^= rank >> np.uint64(31)
        first = np.argpartition(rank, take - 1, axis=1)[:, :take]
        first.sort(axis=1)  # text order
        value = np.zeros(len(seed), np.uint64)
        for n in range(take):
            value = _mixed(value * _MIX + kmers[first[:, n]])
        out[low : low + step] = value
    return out


def band_keys(text: str | None) -> list[int]:
    """The band keys of a text, as signed longs; none for a text without words."""
    kmers = labelled_kmers(word_hashes(text))
    if not len(kmers):
        return []
    found = sketches(kmers, ROWS * BANDS).reshape(BANDS, ROWS)
    value = np.arange(BANDS, dtype=np.uint64)
    for n in range(ROWS):
        value = _mixed(value * _MIX + found[:, n])
    return value.view(np.int64).tolist()


def coded(text: str | None) -> str:
    """A text as one character per word."""
    codes = (word_hashes(text) % np.uint64(_CODES)).astype("<u4") + np.uint32(_FIRST_CODE)
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def aligned(a: Column, b: Column, similarity: float) -> Column:
    """Whether two coded texts align within the band that ``similarity`` leaves; tried in a narrow band first. Words of one text that are not
    in the other are an edit each, so with more of them than allowed the wide band is not tried."""
    limit = F.floor(F.greatest(F.length(a), F.length(b)) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    narrow = F.floor(limit / 8).cast("int")
    far = F.abs(F.length(a) - F.length(b)) > limit

    def missing(x: Column, y: Column) -> Column:
        return F.length(F.call_function("translate", x, y, F.lit("")))

    near = F.call_function("levenshtein", a, b, narrow) >= 0
    return ~far & (near | (missing(a, b) <= limit) & (missing(b, a) <= limit) & (F.call_function("levenshtein", a, b, limit) >= 0))


def _runs(body: str, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words of a coded text with its occurrence number; as many runs as words, since the first ones start before it."""
    codes = np.frombuffer(body.encode("utf-32-le"), "<u4").astype(np.uint64)
    return labelled_kmers(np.concatenate([np.zeros(size - 1, np.uint64), codes]), size).view(np.int64)


def rare_runs(bodies: DataFrame, similarity: float) -> DataFrame:
    """node, term: of every coded text its rarest runs of two words, so many that two aligned texts share one.

    An edit breaks at most two runs of the longer text, so aligned texts of at most m words share t(m) = m - 2 * edits allowed, 1 or more where
    ``similarity`` is above a half (below, single words are taken). As t falls by one at most while m grows, of n runs put into any order common to
    all texts the first n - (t(n) - 1) + 1 are enough.
    """
    size = 2 if similarity > 0.5 else 1
    every = _mapped(bodies.select("node", "body"), lambda t: _runs(t, size), "terms", "array<bigint>", pa.list_(pa.int64()))
    often = every.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    usual = np.array([r["term"] for r in often.orderBy(F.desc("n"), "term").limit(RANKED).collect()], np.int64)
    by_value = np.argsort(usual)
    known = usual[by_value]

    def rarest(text: str) -> np.ndarray:
        terms = _runs(text, size)
        place = np.zeros(len(terms), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            place = np.where(known[at] == terms, len(known) - by_value[at], 0)
        allowed = int(len(terms) * (1 - similarity) + 1e-9)
        return np.unique(terms[np.lexsort((terms, place))[: size * allowed + size]])

    made = _mapped(bodies.select("node", "body"), rarest, "terms", "array<bigint>", pa.list_(pa.int64()))
    return made.select("node", F.explode("terms").alias("term"))


def _mapped(rows: DataFrame, make, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """``rows`` with their last column, the text, replaced by what ``make`` gives for it."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                made = pa.array([make(t.as_py()) for t in part.column(len(kept))], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], [*kept, name])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join([*kinds, f"{name} {kind}"]))


def _digest(body: Column) -> Column:
    return F.unhex(F.md5(body))


def _named(documents: DataFrame, key: str, text: str) -> DataFrame:
    """_key, node (what equal texts share) and _body."""
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.select(F.col(key).cast("bigint").alias("_key"), _digest(body).alias("node"), body.alias("_body"))


def _classes(documents: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """One row per document: _key, node, _group, class_id, class_size, n_texts."""
    require(documents, key, text)
    rows = _named(documents, key, text)
    sketched = _mapped(rows, band_keys, "bands", "array<bigint>", pa.list_(pa.int64()))
    texts = sketched.groupBy("node").agg(F.min("_key").alias("_rep"), F.count("*").alias("_copies"), F.first("bands").alias("bands"))
    texts = materialise(texts, "texts")
    buckets = texts.select(F.explode(F.array_distinct("bands")).alias("bucket"), "node")

    def bodies(nodes: DataFrame) -> DataFrame:
        wanted = texts.join(nodes, "node", "left_semi").select(F.col("node").alias("_n"), "_rep")
        one = rows.join(wanted, F.col("_key").eqNullSafe(F.col("_rep")) & (F.col("node") == F.col("_n")))
        made = _mapped(one.select("node", "_body"), coded, "body", "string", pa.string())
        return made.groupBy("node").agg(F.min("body").alias("body"))

    groups = connect(buckets, bodies, lambda a, b: aligned(a, b, similarity), lambda found: rare_runs(found, similarity))
    grouped = texts.drop("bands").join(groups, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    summed = grouped.groupBy("_group").agg(
        F.min("_rep").alias("class_id"), F.sum("_copies").alias("class_size"), F.count("*").alias("n_texts")
    )
    by_text = grouped.select("node", "_group").join(materialise(summed, "sums"), "_group")
    return rows.select("_key", "node").join(materialise(by_text, "classes"), "node")


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``key``, class_id (the smallest id of its class), class_size and n_texts (different ones)."""
    found = _classes(documents, key, text, similarity)
    return found.select(F.col("_key").alias(key), "class_id", "class_size", "n_texts")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that name their classes, with all columns: of each class one row with the smallest id."""
    found = _classes(documents, key, text, similarity)
    named = found.where(F.col("_key").eqNullSafe(F.col("class_id")))
    # a class may have several texts or rows with that id only if ids repeat: the smallest text hash stays, once
    stay = named.groupBy("_group", "_key").agg(F.min("node").alias("_text"), F.count("*").alias("_rows"))
    stay = materialise(stay.select("_key", "_text", "_rows").withColumnRenamed("_key", "_stay"), "stay")
    body = _digest(F.coalesce(F.col("_row")[text], F.lit("")))
    kept = documents.select(F.struct(*documents.columns).alias("_row")).join(
        stay, F.col("_row")[key].cast("bigint").eqNullSafe(F.col("_stay")) & (body == F.col("_text"))
    )
    once = kept.where("_rows = 1").select("_row.*")
    again = kept.where("_rows > 1").dropDuplicates(["_stay", "_text"]).select("_row.*")
    return once.unionByName(again)
