import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeglass.llm import token_store
from lodeglass.llm.queries import QUERIES, TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)


@cache
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def by_hand(rows):
    out, start, encode = [], 0, library()
    for key, text in rows:
        ids = encode(text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def listed(df):
    rows = df.orderBy("start").collect()
    return [(r[0], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows]


def test_query_as_the_library_encodes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert listed(QUERIES["op4_token_files"](spark, sf)) == by_hand([(r["doc_id"], r["text"]) for r in docs])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=1500), st.data())
def test_random_access(ids, data):
    file = token_store.TokenFile(token_store.to_bytes(np.array(ids, np.uint32), [1, None], np.array([0, 0, len(ids)])))
    assert len(file) == len(ids) and file.keys == [1, None]
    for _ in range(5):
        if ids:
            at = data.draw(st.integers(0, len(ids) - 1))
            assert file[at] == ids[at]
        a = data.draw(st.integers(0, len(ids)))
        b = data.draw(st.integers(a, len(ids)))
        assert file.range(a, b).tolist() == ids[a:b]
    assert file.document(1).tolist() == ids
    with pytest.raises(IndexError):
        file[len(ids)]


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", " <|endoftext|><|endoftext|>. é漢"])
def test_added_tokens_in_texts(text):
    with open(PATH, "rb") as file:
        found = np.frombuffer(token_store._tokenizer(file.read())(text), "<u4").tolist()
    assert [*found, 0] == library()(text) and 50256 in found


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(["<|endoftext|>", "a", " b", " ", "\n", "é", "漢"])).map("".join), st.text(alphabet="  \n\t'strevmdl abTH12²½éß漢🙂.,!?-<|endoftext>", max_size=40), st.text(max_size=40)))
def test_any_text_as_the_library_encodes(text):
    with open(PATH, "rb") as file:
        encode = token_store._tokenizer(file.read())
    assert [*np.frombuffer(encode(text), "<u4"), 0] == library()(text)


def test_many_files_nulls_ties_and_empty_table(spark, make):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "<|endoftext|> a  b"), (4, "x" * 5000 + " 🙂é\n\n z"), (4, "x")]
    df = make([(*r, "k") for r in rows], "doc_id long, text string, key string")
    manifest = token_store.write_tokens(df, PATH, token_store.new_folder(spark), most=3)
    assert manifest.count() > 2
    got = listed(token_store.read_tokens(spark, manifest))
    want = by_hand(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    empty = token_store.write_tokens(make([]), PATH, token_store.new_folder(spark))
    assert token_store.read_tokens(spark, empty).count() == 0


def test_words_are_remembered_once(monkeypatch):
    """A chunk that is one piece is encoded once, also where it is a piece of other chunks; ids stay the library's."""
    made = []
    real = token_store.Remembered

    class Counted(real):
        def __init__(self, make, most):
            made.append(self)
            super().__init__(make, most)

    monkeypatch.setattr(token_store, "Remembered", Counted)
    with open(PATH, "rb") as file:
        encode = token_store._tokenizer.__wrapped__(file.read())
    library = Tokenizer.from_file(PATH)
    for text in ("a word", "a word, word word's", "''' 's''s '", "x1 1x  y\n z ", "Él año ÀÿÖ ß²½ ɐ٠", "<|endoftext|> a<|endoftext|>", " ", "'"):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(made) == 1 and " word" in made[0] and " word," in made[0]
