"""Data-quality reports: duplicates, inconsistent spellings, disguised numbers, constant columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.text import strip
from lodeglass.operators.profile import columns_of, quoted
from lodeglass.session import materialise


#: Bits of the map of repeated hashes, sent to every task: 16 MB whatever the table. Beyond as many repeated hashes it lets more
#: rows pass than it should, and they are shuffled; the result does not depend on it.
MAP_BITS = 1 << 27
_CHUNK = 1 << 15  # bits of one row of the map


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Key columns and n for every combination that occurs more than once.

    Only 8-byte hashes of the rows are shuffled first. The repeated ones set bits of a map of fixed size, which lets a second scan
    drop rows whose hash cannot repeat; whole values travel just for the others, merged before the shuffle and grouped
    by their values, so a hash clash cannot slip in.
    """
    names = columns or df.columns
    hashed = df.select(*[quoted(c) for c in names], F.xxhash64(*[quoted(c) for c in names]).alias("_h"))
    repeated = hashed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1")
    place = F.pmod("_h", F.lit(MAP_BITS))
    chunk, bit = F.floor(place / _CHUNK).cast("int"), (place % _CHUNK).cast("int")
    bitmap = materialise(
        repeated.select(chunk.alias("_chunk"), bit.cast("long").alias("_bit"))
        .groupBy("_chunk")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits")),
        "repeated",
    )
    byte = F.conv(F.hex(F.substr("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, F.col("_bit") % 8).bitwiseAND(F.lit(1)) == 1
    marked = hashed.withColumns({"_chunk": chunk, "_bit": bit})
    # at most MAP_BITS / _CHUNK rows of _CHUNK bits
    suspects = marked.join(F.broadcast(bitmap), "_chunk").where(is_set)
    return suspects.groupBy(*[quoted(c) for c in names]).agg(F.count("*").alias("n")).where("n > 1")


def spelling_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, issue, canonical, n_variants, n_rows: values equal but for case and outer space."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("raw")) for c in columns])
    raw = df.select(F.inline(cells)).where(F.col("raw").isNotNull())
    # Distinct spellings first, so that a value on a third of all rows is one row per task from here on.
    spellings = raw.groupBy("column", "raw").agg(F.count("*").alias("n"))
    merged = spellings.groupBy("column", F.lower(strip(F.col("raw"))).alias("canonical")).agg(
        F.count("*").alias("n_variants"), F.sum("n").alias("n_rows")
    )
    found = merged.where("n_variants > 1")
    return found.select("column", F.lit("variants").alias("issue"), "canonical", "n_variants", "n_rows")


def inconsistency_report(df: DataFrame, columns: list[str] | None = None, mostly: float = 0.8) -> DataFrame:
    """column, issue, canonical, n_variants, n_rows.

    ``variants``: one value in several spellings. ``numeric_text`` and ``date_text``: at least
    ``mostly`` of the filled cells, yet not all, read as a number or date; n_rows counts those that do not.
    ``constant``: every filled cell is the same.
    """
    names = columns or columns_of(df, T.StringType)
    spellings = spelling_variants(df, names)
    cells = []
    for i, name in enumerate(names):
        c = quoted(name)
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(c).alias("filled"),
                F.count(c.try_cast("double")).alias("numbers"),
                F.count(c.try_cast("date")).alias("dates"),
                F.min(c).alias("least"),
                F.max(c).alias("greatest"),
            ).alias(f"s{i}")
        )
    seen = df.agg(*cells).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))

    def issue(name: str, condition: Column, rows: Column, canonical: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(name).alias("issue"),
                canonical.alias("canonical"),
                F.lit(1).cast("long").alias("n_variants"),
                rows.alias("n_rows"),
            ),
        )

    def almost(count: str) -> Column:
        return (F.col(count) < F.col("filled")) & (F.col(count) >= F.col("filled") * mostly)

    nothing = F.lit(None).cast("string")
    issues = F.array(
        issue("numeric_text", almost("numbers"), F.col("filled") - F.col("numbers"), nothing),
        issue("date_text", almost("dates"), F.col("filled") - F.col("dates"), nothing),
        issue("constant", F.col("least") == F.col("greatest"), F.col("filled"), F.col("least")),
    )
    columnwise = seen.select("column", F.inline(F.filter(issues, lambda i: i.isNotNull())))
    return spellings.unionByName(columnwise)


def relate_datasets(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on shared key names: inner, left, left_semi or left_anti. Null keys never match."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how!r}")
    return left.join(right, on, how)


def key_coverage(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: matched_left, left_only, right_only (rows), left_dup_keys, right_dup_keys (keys).

    Both sides are reduced to one row per key before they meet, so hot keys cost nothing.
    """
    a = left.groupBy(*[quoted(k) for k in on]).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*[quoted(k) for k in on]).agg(F.count("*").alias("n_right"))
    null_key = F.lit(False)
    for k in on:
        null_key = null_key | F.col(k).isNull()
    has_left, has_right = F.col("n_left").isNotNull(), F.col("n_right").isNotNull()
    joined = a.join(b, on, "full")

    def rows(condition: Column, n: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0)).alias(name)

    return joined.agg(
        rows(has_left & has_right, "n_left", "matched_left"),
        rows(has_left & ~has_right, "n_left", "left_only"),
        rows(has_right & ~has_left, "n_right", "right_only"),
        F.count_if((F.col("n_left") > 1) & ~null_key).alias("left_dup_keys"),
        F.count_if((F.col("n_right") > 1) & ~null_key).alias("right_dup_keys"),
    )
