"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language, most frequent first. A document gets the same kind of list, and its
distance to a language is the sum, over its n-grams, of how far each is out of place there; an n-gram that the
profile lacks counts as one place beyond its end. The nearest language wins.

Learning: n-grams are counted per language over a sample of ``per_language`` distinct labelled texts of each language (a
documented bound, met within a few percent; texts are chosen by their hash, so the choice depends on neither order nor
partitioning), summed in Spark and cut to profiles. Prediction: one narrow pass, whole texts, the profiles travel with the tasks (languages x size entries).

Texts are lower-cased; digits, punctuation and white space become single blanks around words. Texts without a letter and null
texts are ``und`` with score 0. Ties go to the smaller n-gram, and between languages to the smaller name. Rows
without a language teach nothing; with no labelled row at all every document is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.llm.columns import require

UNDETERMINED = "und"
#: Lengths of the n-grams, entries of a profile, labelled rows per language to learn from.
LENGTHS = (1, 2, 3)
PROFILE = 400
PER_LANGUAGE = 1000
#: More languages than this are refused: their profiles are sent to every task.
MOST_LANGUAGES = 2000

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BITS = 21  # a code point


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text and their counts. An n-gram of three code points or fewer is one integer."""
    words = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(words.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    blank = points == 32
    found = []
    for n in LENGTHS:
        if len(points) < n:
            continue
        packed, inner = points[: len(points) - n + 1].copy(), np.zeros(len(points) - n + 1, dtype=bool)
        for k in range(1, n):
            packed = (packed << _BITS) | points[k : len(points) - n + 1 + k]
        for k in range(1, n - 1):  # a blank inside would join two words
            inner |= blank[k : len(points) - n + 1 + k]
        if n == 1:
            inner = blank
        found.append(packed[~inner])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(values: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by value."""
    return values[np.lexsort((values, -counts))][:size]


def _languages(labelled: DataFrame) -> DataFrame:
    """Distinct texts per language; refused beyond the number of languages that may travel with the tasks."""
    counts = labelled.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("_texts"))
    rows = counts.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return labelled.sparkSession.createDataFrame([tuple(r) for r in rows], "lang string, _texts bigint")


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` distinct texts of each language, those whose hash is small enough; each once.

    Hashes spread evenly, so the part of them below a threshold is known beforehand: no ranking, no hot language in one task.
    """
    hashed = labelled.withColumn("_h", F.xxhash64("text"))
    share = F.lit(float(per_language)) / F.col("_texts")
    small = hashed.join(F.broadcast(_languages(hashed)), "lang").where(
        F.col("_h") < F.lit(-(2.0**63)) + share * F.lit(2.0**64)
    )
    return small.select("lang", "text").distinct()


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, lang: str = "lang", text: str = "text") -> DataFrame:
    """Profiles from labelled rows: lang, place (from 0), gram (packed)."""
    require(labelled, lang, text)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sample = _sample(rows.where("lang is not null and text is not null"), per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, Counter] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _NOT_LETTERS.sub("", value):
                    found, often = grams(value)
                    sums.setdefault(name, Counter()).update(dict(zip(found.tolist(), often.tolist(), strict=True)))
            for name, counter in sums.items():
                columns = [pa.array([name] * len(counter)), pa.array(counter.keys(), pa.int64()), pa.array(counter.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    placed = counted.withColumn("place", F.row_number().over(place) - 1).where(F.col("place") < PROFILE)
    return placed.select("lang", "place", "gram")


class Profiles:
    """The profiles of all languages as one table: a row for each known n-gram, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.languages = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[2] for r in rows], dtype=np.int64))
        column = {name: n for n, name in enumerate(self.languages)}
        self.places = np.full((len(self.grams) + 1, len(self.languages)), PROFILE, dtype=np.int32)
        for name, place, gram in rows:
            self.places[np.searchsorted(self.grams, gram), column[name]] = place

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its distance as a part of the greatest possible one."""
        if not text or not self.languages or not _NOT_LETTERS.sub("", text):
            return UNDETERMINED, 0.0
        own = ranked(*grams(text))
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        places = self.places[np.where(known, at, len(self.grams))]
        away = np.abs(places - np.arange(len(own), dtype=np.int32)[:, None])
        away[places == PROFILE] = PROFILE
        total = away.sum(axis=0, dtype=np.int64)
        best = int(np.argmin(total))
        return self.languages[best], 1.0 - float(total[best]) / (PROFILE * len(own))


def predict(documents: DataFrame, profiles: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns, lang_pred and score for every document."""
    require(documents, text, *key)
    rows = [tuple(r) for r in profiles.limit(MOST_LANGUAGES * PROFILE + 1).collect()]  # bounded, else refused
    if len(rows) > MOST_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = Profiles(rows)
    narrow = documents.select(*key, F.col(text).alias("_text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [table.nearest(t.as_py()) for t in batch.column(len(key))]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*key, "lang_pred", "score"])

    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in key)
    return narrow.mapInArrow(label, f"{kinds}, lang_pred string, score double")


def held_out(key: Column) -> Column:
    """True for the fifth of the ids that nothing is learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))

