import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodeglass.llm import alignment
from lodeglass.llm.queries import PIECES, QUERIES, TOKENIZER

A, B = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


@cache
def ours():
    with open(A, "rb") as a, open(B, "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


def whole(text):
    """Ids and byte ranges of both libraries over the whole text; None where they do not spell it."""
    a, b = libraries()
    sides = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, ours().bytes_a), (b.encode(text), ours().bytes_b)):
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        sides.append(list(zip(ids, [0, *ends], ends, strict=False)))
    return sides


def groups_and_links(sides):
    """By definition: cuts where both sides end a token; links by comparing the ranges inside a group."""
    cuts = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
    groups, links, start = [], [], 0
    at = [0, 0]
    for cut in cuts:
        mine = []
        for side in (0, 1):
            begin = at[side]
            while at[side] < len(sides[side]) and sides[side][at[side]][2] <= cut:
                at[side] += 1
            mine.append(sides[side][begin : at[side]])
        groups.append(mine)
        links += [(x[0], y[0]) for x in mine[0] for y in mine[1] if x[1] < y[2] and y[1] < x[2]]
        start = cut
    assert start == sides[0][-1][2]
    return groups, links


def by_hand(rows):
    found = [(key, groups_and_links(whole(text)) if text and whole(text) else None) for key, text in rows]
    counts = Counter(pair for _, f in found if f for pair in f[1])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for key, f in found:
        if f is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = f
        text = ";".join("|".join(",".join(str(t[0]) for t in side) for side in g) for g in groups)
        sums = sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)
        sizes = (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links))
        out.append((key, *sizes, *sums, hashlib.sha256(text.encode()).hexdigest()))
    return out


def listed(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert listed(QUERIES["op13_token_alignment"](spark, sf)) == sorted(by_hand(docs), key=str)


ODD = ["foo<|endoftext|>bar </s> <0x41>", "a▁b", "  two  blanks ", "\n\t\r\n", "漢字かな🙂 é́", "'s it's", " ", "x" * 30_000, "\0"]


def test_blocks_nulls_ties_and_empty_table(spark, make, monkeypatch):
    rows = [(n, t) for n, t in enumerate(ODD)] + [(90, None), (91, ""), (None, "no id"), (92, "twice it"), (92, "twice it")]
    df = make([(*r, "k") for r in rows], "doc_id long, text string, block string")
    want = sorted(by_hand(rows), key=str)
    assert listed(alignment.align(df, A, B)) == want
    assert dict((r[0], r[1]) for r in want)[1] == 0  # the sign for a blank does not spell itself
    monkeypatch.setattr(alignment, "BLOCK", 5)  # a block for each document
    assert listed(alignment.align(df.coalesce(1), A, B)) == want
    assert listed(alignment.align(make([]), A, B)) == []


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="  \n\t'strevmdl abTH12²½éß漢🙂.,!?-<|endoftext>▁", min_size=1, max_size=40), st.text(min_size=1)))
def test_any_text_as_the_libraries_encode(text):
    found = ours().encode(ours().cut(text))
    sides = whole(text)
    assert all(f[2] for f in found) == (sides is not None)
    if sides:
        for n in (0, 1):
            assert np.frombuffer(b"".join(f[n] for f in found), "<i4").tolist() == [t[0] for t in sides[n]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1), st.lists(st.integers(1, 5), min_size=1))
def test_coalescing_any_two_tilings(a, b):
    total = max(sum(a), sum(b))
    a, b = (np.array([*x, *[1] * (total - sum(x))]) for x in (a, b))
    (ae, be) = (np.cumsum(x) for x in (a, b))
    order, group = alignment.coalesce(ae - a, ae, be - b, be)
    assert group[-1] + 1 == len(set(ae) & set(be)) and sorted(order) == list(range(len(a) + len(b)))
    pairs = {(i, j) for i in range(len(a)) for j in range(len(b)) if ae[i] - a[i] < be[j] and be[j] - b[j] < ae[i]}
    assert set(zip(*(x.tolist() for x in alignment.overlaps(ae - a, ae, be - b, be)), strict=True)) == pairs


def test_written_groups_read_back():
    assert alignment.read_groups("1,2|3;4|5,6") == [([1, 2], [3]), ([4], [5, 6])]
    assert alignment.read_groups("") == []


def test_libraries_hold_few_chunks_at_once():
    """What the libraries return for a block is turned into bytes in slices: their objects would fill a worker's memory."""
    asked, made = [], ours()
    real = made._ask

    class Counted(alignment.Tokenizers):
        def __init__(self):
            self._new, self._old = {}, {}

        def _ask(self, names):
            asked.append(len(names))
            return real(names)

    names = [f" w{n}" for n in range(2 * alignment.AT_ONCE + 5)]
    assert Counted().encode(names) == real(names)
    assert asked == [alignment.AT_ONCE, alignment.AT_ONCE, 5]
