r"""Secret scan with multipart linking.

Strong findings stand alone: assignments (``password = ...``), access identifiers (``AKIA...``) and long hex runs.
Weak candidates mean nothing by themselves: an account name, an endpoint, a mixed run of letters and digits. They are
reported only where the parts complement one another: an interval join brings together access identifiers, secrets and
endpoints whose spans lie within ``reach`` code points of each other in one document.

Everything is DataFrame functions. Regular expressions run once per text and kind; positions come from the lengths of the
pieces between matches, summed by a window per document and kind, so a text with many findings costs no more per
finding than one with few. Only documents with a finding are shuffled, and only spans, never texts.

Spans count code points, end exclusive. Null text counts as empty. Rows equal in id and text get equal results each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.llm.columns import let, require, text_key
from lodeglass.session import materialise

#: The strong kinds, in the order in which ties at one start are listed. Assignments keep matches whose
#: value (group 2) has six characters or more. The quantifiers of the other two drop shorter runs at once.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Weak parts: an account name, an address, a run that may be a key.
ACCOUNT = r"""(?i)(?<![A-Za-z0-9_])(user(?:name|_?id)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i)(?<![A-Za-z0-9_])(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}"""
MIXED = r"[A-Za-z0-9+/_-]{16,}={0,2}"

KINDS = ["assign", "access", "hex", "account", "endpoint", "mixed"]  # in listing order
STRONG = KINDS[:3]
SECRETS = ["assign", "hex"]
IDENTIFIERS = ["access", "account"]


def _found(text: Column, kind: str, pattern: str, valid) -> Column:
    """Matches of one kind as structs: kind, number, code points since the last match, length, valid."""
    rank = KINDS.index(kind)

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return let(
            gaps,
            lambda g: F.transform(
                found,
                lambda m, i: F.struct(
                    F.lit(rank).alias("kind"),
                    i.cast("long").alias("n"),
                    F.length(F.get(g, i)).cast("long").alias("gap"),
                    F.length(m).cast("long").alias("size"),
                    valid(m).alias("valid"),
                ),
            ),
        )

    none = F.array().cast("array<struct<kind:int,n:bigint,gap:bigint,size:bigint,valid:boolean>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _value_size(match: Column) -> Column:
    """Length of the value of an assignment match: what follows the separator, blanks and an opening quote."""
    return F.length(F.regexp_extract(match, ASSIGN, 2))


def findings(documents: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """All spans of all kinds, linked or not: ``key`` columns, kind, start, end."""
    whole = F.coalesce(F.col(text), F.lit(""))
    always = lambda m: F.lit(True)
    kinds = [
        _found(whole, "assign", ASSIGN, lambda m: _value_size(m) >= 6),
        _found(whole, "access", ACCESS, always),
        _found(whole, "hex", HEX, always),
        _found(whole, "account", ACCOUNT, always),
        _found(whole, "endpoint", ENDPOINT, always),
        _found(whole, "mixed", MIXED, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
    ]
    rows = documents.select(*key, F.explode(F.concat(*kinds)).alias("f")).select(*key, "f.*")
    rows = rows.distinct()  # equal rows of a document must not lengthen the sums below
    order = Window.partitionBy(*key, "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("end", end)
        .where("valid")
        .select(*key, "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def near(left: DataFrame, right: DataFrame, key: list[str], reach: int, how: str) -> DataFrame:
    """``left`` rows with (``left_semi``) or without (``left_anti``) a ``right`` span of the same document within ``reach``.

    Both sides are dealt to cells of code points and joined on document and cell, so a document full of
    parts is compared cell by cell; a span reaches into every cell that its own interval, widened, touches.
    """
    width = max(reach, 64)
    cells = right.select(
        *key,
        F.col("start").alias("_rs"),
        F.col("end").alias("_re"),
        F.explode(
            F.sequence(
                F.floor((F.greatest(F.col("start") - reach, F.lit(0))) / width),
                F.floor((F.col("end") + reach) / width),
            )
        ).alias("_cell"),
    )
    spread = left.withColumn(
        "_cells", F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    )
    if how == "left_anti":
        hit = near(left, right, key, reach, "left_semi")
        return left.join(hit, [*key, "kind", "start", "end"], "left_anti")
    rows = spread.withColumn("_cell", F.explode("_cells")).drop("_cells")
    meets = [rows[k] == cells[k] for k in key] + [
        rows["_cell"] == cells["_cell"],
        rows["start"] < cells["_re"] + reach,
        rows["end"] > cells["_rs"] - reach,
    ]
    test = meets[0]
    for m in meets[1:]:
        test = test & m
    return rows.join(cells, test, "left_semi").drop("_cell").distinct()


def linked(found: DataFrame, key: list[str], reach: int) -> DataFrame:
    """The findings to report: all strong ones, and weak ones next to a part that complements them.

    A mixed run that overlaps another span says nothing new and is left out. One apart from them is a secret if an
    identifier or an endpoint is within reach. Identifiers and endpoints are reported next to a strong secret or next to
    such a mixed run.
    """

    def of(names: list[str]) -> Column:
        return F.col("kind").isin([KINDS.index(n) for n in names])

    strong = found.where(of(STRONG))
    places = found.where(of(["account", "endpoint"]))
    apart = near(found.where(of(["mixed"])), found.where(~of(["mixed"])), key, 0, "left_anti")
    keys = near(apart, found.where(of(["access", "account", "endpoint"])), key, reach, "left_semi")
    named = near(places, strong.where(of(SECRETS)).unionByName(keys), key, reach, "left_semi")
    return strong.unionByName(keys).unionByName(named)


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 256) -> DataFrame:
    """One row per document: ``key`` and ``spans``, an array of (start, kind, end) sorted by start and kind.

    ``kind`` is the position in ``KINDS``. ``reach`` is the scope of linking in code points.
    """
    require(documents, key, text)
    row = text_key(F.concat_ws("\u0000", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)))
    docs = documents.select(
        F.col(key).alias("_id"), F.col(text).alias("_text"), row[0].alias("_k1"), row[1].alias("_k2")
    )
    keys = ["_k1", "_k2"]
    found = materialise(findings(docs, keys, "_text"), "findings")
    spans = (
        linked(found, keys, reach)
        .groupBy(*keys)  # the spans of one document
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return (
        docs.drop("_text")
        .join(spans, keys, "left")
        .select(F.col("_id").alias(key), F.coalesce("spans", none).alias("spans"))
    )
