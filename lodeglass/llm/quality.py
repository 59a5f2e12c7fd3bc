"""Quality rules: a ledger of measurements and failure bits, and policies applied to it.

Each rule is evaluated once per document and leaves one bit in ``failed``. A policy is a versioned set of rules,
that is a bit mask: applying one, comparing two or asking what a rule alone removes needs bit operations on the ledger only,
never the texts. Everything is DataFrame functions: one narrow pass, no shuffle, no Python worker.

Null text counts as a text without words; an empty text likewise. Both fail the word count. Repeated rows are measured
one by one, an empty table gives an empty ledger; ties do not arise. Columns of the input stay, whatever their names, but one named like a
measurement is an error. Texts of any length are measured whole: windows are sorted within the row, n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.columns import WORD_CHAR, fresh, let, require, words_of

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
]

#: Rule -> (bit, test that is true when a document fails). The bits of the ledger never change their meaning;
#: a new rule takes a new bit.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "100 * n_symbols > 30 * n_words"),
    "duplicate_lines": (3, "100 * n_dup_lines > 50 * n_lines"),
    "upper_case": (4, "100 * n_upper > 50 * word_chars"),
    "short_words": (5, "word_chars < 2 * n_words"),
    "long_words": (6, "word_chars > 25 * n_words"),
}


@dataclass(frozen=True)
class Policy:
    """A named version of the set of rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case"))
V2 = Policy("v2", tuple(RULES))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text."""

    def hashes(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(starts: Column) -> Column:
        width = F.transform(
            starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)))
        )
        return F.aggregate(width, F.lit(0), lambda total, n: total + n)

    def repeated(hashed: Column) -> Column:
        placed = F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        ordered = F.sort_array(placed)

        def seen_again(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]),
            )
            return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), 0).otherwise(let(ordered, seen_again))

    return let(words, lambda w: let(hashes(w), repeated))


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with one column per measurement; a column of that name must not be there already."""
    require(documents, text)
    clash = [m for m in [*MEASURES, "failed"] if m in documents.columns]
    if clash:
        raise ValueError(f"columns {clash} are there already; rename them first")
    whole = F.coalesce(F.col(text), F.lit(""))
    words = words_of(F.col(text))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD_CHAR))
    words_at, lines_at = (fresh(documents, name) for name in ("_m", "_l"))
    counted = documents.withColumn(
        words_at,
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        ),
    ).withColumn(
        lines_at,
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ),
    )
    return counted.select(
        *documents.columns,
        F.col(words_at)["n_words"].alias("n_words"),
        F.col(words_at)["word_chars"].alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col(lines_at)["n_dup_lines"].alias("n_dup_lines"),
        F.col(words_at)["n_repeat_words"].alias("n_repeat_words"),
        F.col(lines_at)["n_lines"].alias("n_lines"),
        F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )


def ledger(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with all measurements and ``failed``, the bits of all rules that the document fails."""
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(0) for bit, test in RULES.values()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(documents, text).withColumn("failed", failed.cast("long"))


def passes(policy: Policy, failed: str = "failed") -> Column:
    """True for the ledger rows that ``policy`` keeps."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """What each rule does in each policy: documents that fail it, and those that fail nothing else in the policy.

    The ledger is first counted per bit pattern (2 to the number of rules at most, counted before the shuffle);
    every figure follows from those few rows. Columns: policy, rule, n_failed, n_only_this, n_kept, n_kept_without.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [
        F.struct(
            F.lit(p.version).alias("policy"),
            F.lit(rule).alias("rule"),
            F.lit(1 << RULES[rule][0]).cast("long").alias("bit"),
            F.lit(p.mask).cast("long").alias("mask"),
        )
        for p in policies
        for rule in p.rules
    ]
    spread = patterns.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("failed", "n", "c.*")
    within = F.col("failed").bitwiseAND(F.col("mask"))

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")

    return spread.groupBy("policy", "rule").agg(
        total(within.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(within == F.col("bit")).alias("n_only_this"),
        total(within == 0).alias("n_kept"),
        total((within == 0) | (within == F.col("bit"))).alias("n_kept_without"),
    )
