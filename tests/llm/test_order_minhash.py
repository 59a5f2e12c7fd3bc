import random

import numpy as np
import pytest
from test_line_dedup import edits
from test_links import by_hand as groups_of

from lodeglass.llm import links
from lodeglass.llm import order_minhash as om
from lodeglass.llm.queries import QUERIES


def similar(a, b):
    return edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)


def by_hand(rows):
    """class per row: equal texts, and every pair of texts that shares a band, aligned in Python."""
    texts = sorted({t or "" for _, t in rows})
    buckets = {}
    for t in texts:
        for key in om.band_keys(t):
            buckets.setdefault(key, set()).add(t)
    pairs = {(a, b) for m in buckets.values() for a in m for b in m if a < b}
    code = {t: om.coded(t) for t in texts}
    group = groups_of([(a, b) for a, b in pairs if similar(code[a], code[b])])
    least = {}
    for k, t in rows:
        g = group.get(t or "", t or "")
        least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
    return {(k, t): least[group.get(t or "", t or "")] for k, t in rows}


def test_query_by_hand(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op6_order_minhash"](spark, sf).collect()
    want = {k: c for (k, _), c in by_hand(rows).items()}
    assert {r["doc_id"]: r["class_id"] for r in got} == want and len(got) == len(rows)
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


BASE = [f"w{n}" for n in range(300)]


def changed(words, part, seed):
    choose = random.Random(seed)
    return [w if choose.random() > part else f"z{choose.randint(0, 10**6)}" for w in words]


def test_near_copies_are_found():
    """Copies with one word in fifty changed, about 0.8 of all five-word runs shared, agree on some band."""
    keys = set(om.band_keys(" ".join(BASE)))
    found = sum(bool(keys & set(om.band_keys(" ".join(changed(BASE, 0.02, n))))) for n in range(200))
    assert found >= 197
    far = sum(bool(keys & set(om.band_keys(" ".join(changed(BASE, 0.5, n))))) for n in range(200))
    assert far == 0


def test_order_matters():
    halves = [BASE[n * 10 : n * 10 + 10] for n in range(30)]
    random.Random(1).shuffle(halves)
    moved = om.labelled_kmers(om.word_hashes(" ".join(w for h in halves for w in h)))
    kept = om.labelled_kmers(om.word_hashes(" ".join(BASE)))
    shared = len(set(moved.tolist()) & set(kept.tolist())) / len(kept)
    same = np.mean(om.sketches(moved, 500) == om.sketches(kept, 500))
    assert shared > 0.5 and same < 0.75 * shared / (2 - shared)


def test_labels_tell_repeats_apart():
    kmers = om.labelled_kmers(om.word_hashes("a b c d e " * 20))
    assert len(set(kmers.tolist())) == len(kmers)


def test_sketches_do_not_depend_on_the_step():
    kmers = om.labelled_kmers(om.word_hashes(" ".join(BASE * 400)))
    assert np.array_equal(om.sketches(kmers, 32)[:3], om.sketches(kmers, 3))


def test_groups_nulls_short_texts_repeats_and_clashing_names(make):
    long = " ".join(f"v{n % 5000}" for n in range(60_000))
    rows = [
        (30, " ".join(BASE)),
        *[(40 + n, " ".join(changed(BASE, 0.02, n))) for n in range(25)],
        (5, None),
        (6, ""),
        (7, " !?"),
        (8, "two words"),
        (9, "Two words."),
        (None, "of no id"),
        (11, "of no id"),
        (12, "of no id"),
        (12, "of no id"),
        (13, long),
        (14, long + " more"),
        (15, " ".join(changed(BASE, 0.6, 99))),
    ]
    df = make([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    got = om.classes(df).collect()
    want = by_hand([r for r in rows if r[0] not in (13, 14)]) | {r: 13 for r in rows if r[0] in (13, 14)}
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == sorted((str(k), str(want[k, t])) for k, t in rows)
    assert {r["class_id"] for r in got if (r["doc_id"] or 0) >= 40} == {30}
    kept = om.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 7, 8, 11, 13, 15, 30]
    same = make([(1, "the same row of words twice")] * 3 + [(1, "but this is other text altogether")])
    assert om.one_of_each(same).count() == 2
    assert om.classes(make([])).count() == 0 and om.one_of_each(make([])).count() == 0


@pytest.mark.parametrize("part", [0.05, 0.19, 0.25, 0.4])
def test_alignment_by_hand(spark, part):
    a, b = om.coded(" ".join(BASE)), om.coded(" ".join(changed(BASE, part, 5)))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(om.aligned(df.a, df.b, 0.8)).first()[0] == similar(a, b)


@pytest.mark.parametrize(("part", "least"), [(0.05, 0.99), (0.1, 0.97), (0.15, 0.7), (0.18, 0.4)])
def test_recall_by_edit_similarity(part, least):
    """Of all pairs (text, copy with so many words changed) that the alignment accepts, the share that meets."""
    linked = met = 0
    for n in range(200):
        words = [f"t{n}w{i}" for i in range(300)]
        copy = changed(words, part, n)
        if sum(a != b for a, b in zip(words, copy, strict=True)) <= 60:
            linked += 1
            met += bool(set(om.band_keys(" ".join(words))) & set(om.band_keys(" ".join(copy))))
    print(part, linked, met)
    assert linked > 100 and met >= least * linked


def test_texts_around_one_passage_do_not_meet_in_pairs(make, monkeypatch):
    """300 texts share half of their words and buckets by them: far fewer pairs than 300 * 299 / 2 are compared, near copies are found."""
    met, real = [], links.materialise

    def noted(rows, name):
        out = real(rows, name)
        met.append(out.count()) if name == "pairs" else None
        return out

    monkeypatch.setattr(links, "materialise", noted)
    passage = [f"p{n}" for n in range(60)]
    rows = [(n, " ".join(passage + [f"d{n}w{i}" for i in range(60)])) for n in range(300)]
    rows += [(1000 + n, " ".join(changed(rows[n][1].split(), 0.03, n))) for n in range(0, 300, 30)]
    got = {r["doc_id"]: r["class_id"] for r in om.classes(make(rows)).collect()}
    assert got == {k: k % 1000 for k, _ in rows}
    assert sum(met) < 3 * len(rows)


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_aligned_texts_share_a_rare_run(spark, similarity):
    choose = random.Random(3)
    texts = []
    for n in range(60):
        words = [choose.choice(["of", "and", "a", f"r{choose.randint(0, 40)}", f"s{choose.randint(0, 999)}"]) for _ in range(choose.randint(1, 60))]
        texts += [words, changed(words, choose.random() * (1 - similarity), n)[choose.randint(0, 2) :] or words]
    coded = [om.coded(" ".join(w)) for w in texts]
    found = om.rare_runs(spark.createDataFrame(list(enumerate(coded)), "node long, body string"), similarity).collect()
    terms = {}
    for r in found:
        terms.setdefault(r["node"], set()).add(r["term"])
    limit = lambda a, b: int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    held = [(i, j) for i in range(len(coded)) for j in range(i) if edits(coded[i], coded[j]) <= limit(coded[i], coded[j])]
    assert len(held) >= 20 and all(terms[i] & terms[j] for i, j in held)
    assert len(found) == len({(r["node"], r["term"]) for r in found})
