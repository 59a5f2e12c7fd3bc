import random
from collections import Counter

import numpy as np
import pytest

from lodeglass.llm import decontaminate as dc
from lodeglass.llm.queries import QUERIES


def verified(passage, question, answer):
    """Overlaps by sets of shingles over a whole text."""
    tokens, asked = dc.words(passage), dc.shingles(dc.words(question))
    size = len(next(iter(asked))) if asked else dc.SHINGLE
    have = {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)}
    answers = set(dc.words(answer))
    return (
        len(asked & have) / len(asked) if asked else 1.0,
        len(answers & set(tokens)) / len(answers) if answers else 1.0,
    )


def test_query_finds_what_brute_force_finds(spark, sf):
    items = [(r["item_id"], *dc.question_and_answer(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_benchmark_leaks"](spark, sf).collect()}
    want = {(d["doc_id"], i) for d in docs for i, q, a in items if min(verified(d["text"], q, a)) >= dc.OVERLAP}
    assert got == want and want


def build(texts):
    items = [(n, *dc.question_and_answer(t)) for n, t in enumerate(texts)]
    frequency = {}
    for t in texts:
        for w in set(dc.words(t)):
            frequency[w] = frequency.get(w, 0) + 1
    return dc.Index(items, frequency, len(texts), sum(len(dc.words(t)) for t in texts) / len(texts))


def test_search_returns_every_item_above_the_threshold():
    choose = random.Random(2)
    vocabulary = [f"w{n}" for n in range(300)]
    weights = [1 / (n + 1) for n in range(300)]
    index = build([" ".join(choose.choices(vocabulary, weights, k=choose.randint(1, 30))) for _ in range(400)])
    for _ in range(150):
        terms = sorted({index.term[w] for w in choose.choices(vocabulary, weights, k=40) if w in index.term})
        threshold = choose.choice([0.2, 0.4, 0.6, 0.9])
        want = {}
        for t in terms:
            for n, impact in zip(index.items[t], index.impacts[t], strict=True):
                want[n] = want.get(n, 0.0) + impact
        want = {n: round(s, 9) for n, s in want.items() if s >= threshold - 1e-9}
        bounds = index.bounds(np.zeros(len(terms), np.int64), np.array(terms), 1)[0]
        alive = np.flatnonzero(bounds >= threshold - 1e-9).tolist()
        assert {n // dc.BLOCK for n in want} <= set(alive)
        assert {n: round(s, 9) for n, s in index.search(terms, threshold, alive)} == want


ITEM = "What is the tall red tower near the old river bridge called by people who live there? It is called the lantern of kings."
OTHER = "Name seven small birds that sleep upside down in caves during winter months! They are not birds but bats."


def test_passages_nulls_edits_repeats_and_clashing_names(make, spark):
    filler = " ".join(f"filler{n}" for n in range(3000))
    near = ITEM.replace("What is", "What was")
    rows = [
        (1, filler + " " + ITEM + " " + filler),
        (2, near),
        (3, ITEM.split("?")[0]),  # the question without its answer
        (4, "lantern of kings"),
        (5, None),
        (6, ""),
        (None, OTHER.upper()),
        (8, ITEM),
        (8, ITEM),
        (9, " ".join(reversed(ITEM.split()))),
        (10, filler + ITEM + "\n" + OTHER + filler * 20),
    ]
    docs = make([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = make([(1, ITEM), (2, OTHER), (3, None), (4, "..."), (5, OTHER)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["item_id"]) for r in dc.find_leaks(docs, items).collect())
    assert got == [(0, 2), (0, 5), (1, 1), (2, 1), (8, 1), (8, 1), (10, 1), (10, 2), (10, 5)]
    small = dc.find_leaks(docs, items, most_bytes=100)  # several indexes
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in small.collect()) == got
    kept = dc.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 9]


def test_empty_tables_and_given_answers(make):
    items = make([(1, "alpha beta gamma delta epsilon zeta", "omega")], "item_id long, question string, answer string")
    docs = make([(1, "x alpha beta gamma delta epsilon zeta y omega"), (2, "alpha beta gamma delta epsilon zeta")])
    assert [r["doc_id"] for r in dc.find_leaks(docs, items).collect()] == [1]
    none = make([], "item_id long, text string")
    assert dc.find_leaks(docs, none).count() == 0 and dc.without_leaks(docs, none).count() == 2
    assert dc.find_leaks(make([]), items).count() == 0


VOCABULARY = [f"word{n}" for n in range(900)]


@pytest.mark.parametrize("cells", [1, 7, 1000])
def test_slices_of_windows_change_nothing(monkeypatch, cells):
    rng = random.Random(4)
    items = [(n, " ".join(rng.choices(VOCABULARY, k=30)), " ".join(rng.choices(VOCABULARY, k=6))) for n in range(40)]
    counts = Counter(w for _, q, a in items for w in set(dc.words(q) + dc.words(a)))
    index = dc.Index(items, counts, len(items), 36.0)
    text = " ".join(" ".join(rng.choices(VOCABULARY, k=200)) + " " + " ".join(items[n][1:]) for n in range(0, 40, 7))
    want = index.leaks(text, dc.THRESHOLD, dc.OVERLAP)
    assert want.keys() >= set(range(0, 40, 7))
    monkeypatch.setattr(dc, "CELLS", cells)
    assert index.leaks(text, dc.THRESHOLD, dc.OVERLAP) == want
