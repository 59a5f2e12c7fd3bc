import zlib

from lodeglass.llm import sharding
from lodeglass.llm.queries import QUERIES


def by_hand(rows, shards):
    rows = sorted(
        ((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    total, before, out, first = sum(r[1] for r in rows), 0, [], {}
    for n, (k, size, crc) in enumerate(rows):
        shard = (2 * before + size) * shards // (2 * total)
        out.append((k, size, crc, shard, n - first.setdefault(shard, n)))
        before += size
    return out


def got(df):
    rows = df.orderBy("position").collect()
    return [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows]


def test_against_prefix_sums_by_hand(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = got(QUERIES["op9_byte_shards"](spark, sf).withColumnRenamed("before", "position"))
    assert rows == by_hand(docs, 16)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + r[1]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r[1] for r in rows)


def test_nulls_ties_repeated_rows_and_clashing_names(make):
    rows = [(3, "é" * 50), (None, "a"), (None, None), (1, ""), (1, ""), (1, "longer"), (2, "x" * 1000)]
    df = make([(*r, "p") for r in rows], "doc_id long, text string, shard string")
    assert got(sharding.byte_shards(df, 4)) == by_hand(rows, 4)


def test_one_huge_row_and_empty_table(make):
    rows = [(i, "x" * (100_000 if i == 5 else 3)) for i in range(10)]
    assert got(sharding.byte_shards(make(rows), 16)) == by_hand(rows, 16)
    assert sharding.byte_shards(make([]), 16).count() == 0
