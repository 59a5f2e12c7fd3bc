import re
from collections import Counter

import pytest

from lodeglass.llm import quality
from lodeglass.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
    }


TEXTS = [
    None,
    "",
    " \t\n\x0b",
    "one",
    "a b c a b c a b c",
    "a a a a a",
    "x y z\nx y z\n\n x y z\nq",
    "é𝒳 ### 100% <b> | né e  é𝒳 ### 100%",
    "the cat sat on the mat the cat sat\n" * 40,
    "w" * 70000,
    " ".join(str(i % 977) for i in range(30000)),
]


def test_measurements_by_hand(make):
    rows = quality.ledger(make([(i, t) for i, t in enumerate(TEXTS)])).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = by_hand(TEXTS[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        bits = (want["n_words"] < 50) | (100 * want["n_repeat_words"] > 50 * want["n_words"]) << 1
        assert r["failed"] & 3 == bits


def test_query_over_all_documents_by_hand(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_quality_rules"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = by_hand(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_labelled_clean_documents_are_kept(spark, sf):
    rows = QUERIES["op8_quality_rules"](spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id"
    )
    clean = rows.where("quality = 1 and not base_failed")
    assert clean.where("kept").count() == clean.count() > 0
    junk = rows.where("quality = 0 and not base_failed")
    assert junk.where("not kept").count() >= 0.9 * junk.count()


def test_ablations_by_hand(make):
    documents = make([(i, t) for i, t in enumerate(TEXTS)] + [(50, "A! " * 60), (51, "word ## " * 60)])
    rows = quality.ledger(documents)
    failed = [r["failed"] for r in rows.collect()]
    got = {(r["policy"], r["rule"]): r for r in quality.ablations(rows, [quality.BASE, quality.V2]).collect()}
    assert len(got) == len(quality.BASE.rules) + len(quality.V2.rules)
    for policy in (quality.BASE, quality.V2):
        for rule in policy.rules:
            bit = 1 << quality.RULES[rule][0]
            r = got[policy.version, rule]
            assert r["n_failed"] == sum(bool(f & bit) for f in failed)
            assert r["n_only_this"] == sum(f & policy.mask == bit for f in failed)
            assert r["n_kept"] == sum(f & policy.mask == 0 for f in failed)
            assert r["n_kept_without"] == sum(f & (policy.mask & ~bit) == 0 for f in failed)


def test_empty_extra_columns_and_no_python(make):
    empty = make([], "doc_id long, text string, h string, p string")
    assert quality.ledger(empty).count() == 0
    extra = make([(1, "a b", "x", "y")], "doc_id long, text string, h string, w string")
    rows = quality.ledger(extra)
    assert rows.first()["h"] == "x"
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="n_words"):
        quality.ledger(make([(1, "a", 3)], "doc_id long, text string, n_words long"))


def test_columns_with_the_names_used_inside_stay(make):
    df = make([(1, "a b c", 5, "x")], "doc_id long, text string, _m long, _L string")
    row = quality.ledger(df).first()
    assert (row["_m"], row["_L"], row["n_words"], row["n_lines"]) == (5, "x", 3, 1)
