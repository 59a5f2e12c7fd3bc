import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeglass.llm import variants
from lodeglass.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
ALPHABET = [chr(c) for c in variants.LETTERS]


def vocabulary(rows, one_in=97):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def edits(word):
    """All strings one edit away, by the definition."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    deleted = {a + b[1:] for a, b in cuts if b}
    replaced = {a + c + b[1:] for a, b in cuts if b for c in ALPHABET}
    return (deleted | replaced | {a + c + b for a, b in cuts for c in ALPHABET}) - {word}


def by_hand(vocab):
    form, near = {}, {}
    for word, n in vocab.items():
        near[word] = [w for w in edits(word) if w in vocab]
        best = min(near[word], key=lambda w: (-vocab[w], w), default=None)
        form[word] = best if best and vocab[best] >= 2 * n else None
    out = []
    for word, n in vocab.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), vocab[form[word]] if form[word] else None))
    return sorted(out)


def listed(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_query_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = listed(QUERIES["op12_spelling_variants"](spark, sf))
    assert found == by_hand(vocabulary(docs)) and any(r[1] for r in found)


def test_words_nulls_odd_letters_and_empty_table(spark, make):
    rows = [(1, "Straße STRASSE Größe×Ære ÿÿÿÿÿ"), (2, None), (3, ""), (None, "null ids count"), (4, "x" * 5000), (4, "x" * 5000)]
    df = make([(*r, "k") for r in rows], "doc_id long, text string, word string")
    for one_in in (0, 1, 2):
        found = {r[0]: r[1] for r in variants.vocabulary(variants.words(df, one_in=one_in), 1, 1).collect()}
        want = Counter()
        for key, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(c.lower() if c.isascii() else c for c in run)
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if one_in and h % one_in == 0 else run] += 1
        assert found == {w: n for w, n in want.items() if w}
    empty = variants.vocabulary(variants.words(make([])))
    assert listed(variants.variants(empty)) == []


@pytest.mark.parametrize("tile", [3, 2048])
def test_crowded_cells_lose_no_pair(spark, monkeypatch, tile):
    """Many words of few letters share their cells; tiles of three meet as whole cells do."""
    monkeypatch.setattr(variants, "TILE", tile)
    monkeypatch.setattr(variants, "ROWS", 5)
    rng = np.random.default_rng(5)
    drawn = {"".join(rng.choice(list("abÿ"), size)) for size in rng.integers(1, 6, 150)}
    drawn |= {"a" * n for n in (7, 8, 3000, 3001)} | {"listen", "silent", "tinsel"}
    vocab = {w: int(n) for w, n in zip(sorted(drawn), rng.integers(1, 40, len(drawn)), strict=True)}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert listed(variants.variants(df)) == by_hand(vocab)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(40)] + [("side", "w20")]
    found = dict(map(tuple, variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert found == {w: "w40" for w, _ in chain}
