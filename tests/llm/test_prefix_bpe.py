import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm import prefix_bpe
from lodeglass.llm.pieces import Remembered, chunks
from lodeglass.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)
VOCABULARY = prefix_bpe.Vocabulary(
    prefix_bpe.Vocabulary.read_ranks(prefix_bpe.read_vocabulary(PATH)), public_tokenizers.PATTERN
)
KNOWN = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={}
)
ENCODER = prefix_bpe.Encoder(VOCABULARY, 50)  # few, so that forgetting is tested too
LETTERS = "  \n\t\x0b\x1c'strevmdl abTHE12²½é漢字🙂.,!?- ́"


def test_documents_as_the_library_encodes_them(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_prefix_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = KNOWN.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=LETTERS, max_size=40), st.text(max_size=40)))
def test_any_text(text):
    ids = ENCODER.encode(text)
    assert ids == KNOWN.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()
    assert "".join(chunks(text)) == text


def test_every_prefix_has_the_encoding_by_plain_merging():
    choose = random.Random(3)
    tokens = list(VOCABULARY.ranks)
    for _ in range(300):
        piece = b"".join(choose.choice(tokens) for _ in range(3)) + b"\xff"
        last = VOCABULARY.extend(piece, [])
        for end in range(1, len(piece) + 1):
            if piece[:end] not in VOCABULARY.ranks:
                assert VOCABULARY.walk(last[:end]) == VOCABULARY.merged(piece[:end])


def test_edits_and_appends():
    choose = random.Random(5)
    edited = prefix_bpe.EditableText(VOCABULARY, "")
    for _ in range(400):
        new = "".join(choose.choice(LETTERS) for _ in range(choose.randint(0, 6)))
        if choose.random() < 0.3:
            edited.append(new)
        else:
            start = choose.randint(0, len(edited.text))
            edited.replace(start, min(len(edited.text), start + choose.randint(0, 5)), new)
        assert edited.ids() == KNOWN.encode_ordinary(edited.text), edited.text
    with pytest.raises(ValueError):
        edited.replace(0, len(edited.text) + 1, "")


def test_edits_touch_little():
    edited = prefix_bpe.EditableText(VOCABULARY, "the quick brown fox jumps over the lazy dog " * 500)
    before = edited.reencoded
    edited.replace(9000, 9003, "xyz")
    edited.append("!")
    assert edited.reencoded - before < 60
    assert edited.ids() == KNOWN.encode_ordinary(edited.text)


def test_rows_with_nulls_long_texts_repeats_and_extra_columns(make):
    long = "ab" * 30_000 + " " * 5_000 + "é" * 20_000
    rows = [(1, None, "x"), (None, "", "y"), (2, long, "z"), (2, long, "z")]
    df = make(rows, "doc_id long, text string, ids string")
    found = prefix_bpe.encode(df, PATH, public_tokenizers.PATTERN)
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in found.collect())
    assert got == [(0, []), (1, []), *[(2, KNOWN.encode_ordinary(long))] * 2]
    back = prefix_bpe.decode(found, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == [b"", b"", *[long.encode()] * 2]
    assert prefix_bpe.round_trip(make([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_memory_is_bounded():
    made = []
    known = Remembered(lambda k: made.append(k) or len(k), 10)
    for n in range(100):
        assert known[str(n % 7)] == 1
    assert len(made) == 7
    for n in range(1000):
        known[str(n)]
        assert len(known) + len(known._old) <= 20
