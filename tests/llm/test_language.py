import zlib
from collections import Counter

import numpy as np

from lodeglass.llm import language
from lodeglass.llm.queries import QUERIES

SAMPLES = [
    ("the cat and the dog are in the house with the others", "en"),
    ("der hund und die katze sind in dem haus mit den anderen", "de"),
    ("le chat et le chien sont dans la maison avec les autres", "fr"),
]


def counted(text):
    words = language._NOT_LETTERS.sub(" ", text.lower()).split()
    out = Counter()
    for word in words:
        out.update(word)
        padded = f" {word} "
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def unpacked(value, bits=language._BITS):
    out = ""
    while value:
        out = chr(value & ((1 << bits) - 1)) + out
        value >>= bits
    return out


def test_grams_by_hand():
    for text in ["Él 2 niños!", "a", "a b-c", SAMPLES[0][0], "漢字 🙂 x"]:
        values, counts = language.grams(text)
        got = {unpacked(v): n for v, n in zip(values.tolist(), counts.tolist(), strict=True)}
        assert got == counted(text), text


def distance(text, profile):
    own = sorted(counted(text).items(), key=lambda e: (-e[1], pack(e[0])))[: language.PROFILE]
    places = {g: n for n, g in enumerate(profile)}
    far = language.PROFILE
    return sum(abs(places[g] - n) if g in places else far for n, (g, _) in enumerate(own)) / (far * len(own))


def pack(gram):
    value = 0
    for c in gram:
        value = value << language._BITS | ord(c)
    return value


def test_prediction_by_hand(make):
    rows = [(i, *s) for i, s in enumerate(SAMPLES * 3)]
    profiles = language.learn(make(rows, "doc_id long, text string, lang string"))
    by_lang = {}
    for r in sorted(profiles.collect(), key=lambda r: r["place"]):
        by_lang.setdefault(r["lang"], []).append(unpacked(r["gram"]))
    for text, lang in SAMPLES:
        want = sorted(counted(text).items(), key=lambda e: (-e[1], pack(e[0])))[: language.PROFILE]
        assert by_lang[lang] == [g for g, _ in want]
    asked = ["the house", "das haus und", "la maison", "x", SAMPLES[1][0] * 500]
    found = language.predict(make(list(enumerate(asked))), profiles, ["doc_id"]).collect()
    for r in found:
        away = {lang: distance(asked[r["doc_id"]], p) for lang, p in by_lang.items()}
        assert r["lang_pred"] == min(sorted(away), key=away.get)
        assert np.isclose(r["score"], 1 - min(away.values()))


def test_held_out_accuracy_and_no_use_of_labels(spark, sf):
    got = QUERIES["op5_rank_order_language"](spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_undetermined_nulls_repeats_empty_and_extra_columns(make):
    profiles = language.learn(make([(1, "der", "de"), (2, None, "fr"), (3, "le", None)], "doc_id long, text string, lang string"))
    rows = [(1, None, "x"), (2, "", "x"), (None, "123 !?", "x"), (4, "der", "x"), (4, "der", "x")]
    found = language.predict(make(rows, "doc_id long, text string, score string"), profiles, ["doc_id"]).collect()
    assert [r["lang_pred"] for r in found] == ["und", "und", "und", "de", "de"]
    assert [r["score"] for r in found[:3]] == [0.0, 0.0, 0.0]
    none = language.learn(make([], "doc_id long, text string, lang string"))
    assert language.predict(make([(1, "der")]), none, ["doc_id"]).first()["lang_pred"] == "und"
    assert language.predict(make([]), profiles, ["doc_id"]).count() == 0


def test_sample_does_not_depend_on_partitions(make):
    rows = [(i, f"{SAMPLES[i % 3][0]} {'abc' * (i % 17)}", SAMPLES[i % 3][1]) for i in range(200)]
    df = make(rows, "doc_id long, text string, lang string")
    one, two = (sorted(map(tuple, language.learn(d, 7).collect())) for d in (df.repartition(1), df.repartition(9)))
    assert one == two
    copies = make([(i, "abc", "en") for i in range(500)], "doc_id long, text string, lang string").unionByName(df)
    assert language._sample(copies.select("lang", "text"), 7).count() <= 60
