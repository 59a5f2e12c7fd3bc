import hashlib

import corpus_pipeline
import public_tokenizers
import test_decontaminate
import test_line_dedup
import test_order_minhash
import test_quality
import tiktoken

from lodeglass.llm import decontaminate, prefix_bpe


def kept_by_rules(text):
    m = test_quality.by_hand(text)
    upper = sum(c.isupper() for c in text or "")
    return not (
        m["n_words"] < 50
        or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        or 100 * m["n_symbols"] > 30 * m["n_words"]
        or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
        or 100 * upper > 50 * m["word_chars"]
    )


def test_pipeline_by_hand(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    items = [decontaminate.question_and_answer(r["text"]) for r in items]
    rows = [r for r in rows if kept_by_rules(r[1])]
    cut = test_line_dedup.by_hand(spark, rows)
    rows = [(k, cut[k]) for k, t in rows if cut[k] == t or test_quality.WORD.search(cut[k])]
    named = test_order_minhash.by_hand(rows)
    rows = [r for r in rows if named[r] == r[0]]
    rows = [r for r in rows if not any(min(test_decontaminate.verified(r[1], *i)) >= 0.8 for i in items)]
    ranks = prefix_bpe.Vocabulary.read_ranks(prefix_bpe.read_vocabulary(public_tokenizers.path(corpus_pipeline.RANKS)))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k, t in rows:
        ids = known.encode_ordinary(t)
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got)


def test_stages_on_an_empty_table_keep_the_columns(spark, sf, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0


def test_null_text_and_repeated_rows(spark, sf, make):
    text = " ".join(f"word{n} stands here" for n in range(60))
    docs = make([(1, None), (2, text), (2, text), (3, text + "\none more line of words here"), (4, "")])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(r["doc_id"] for r in docs.collect()) == [2, 3]
