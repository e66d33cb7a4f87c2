"""The learnt operators: held-out accuracy, and exact counts against brute force."""

import math
import zlib
from collections import Counter

import pytest

from barwise.llm import language, lm_scoring, queries, toxicity
from barwise.llm.lm_scoring import Words, held_out_scores

FOLDER = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").where("lang is not null").collect()}
    rows = [r for r in language.predictions(docs).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 ..", "en"), (3, "", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.predictions(odd).collect()} == {("und", 0.0)}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.where("toxic in (0, 1)").collect()}
    rows = [r for r in toxicity.predictions(docs, labels).collect() if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows)
    hits = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert right > 0.95 and hits > 0.8 * sum(truth[r.doc_id] for r in rows)


def test_base_score_against_brute_force(spark):
    texts = [(k, f"The cat{k % 3} SAT on é{k % 5} mat" if k % 4 else None) for k in range(40)]
    c = Counter()
    for k, t in texts:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update([*(t or "").lower().split(), None])
    total = sum(c.values())
    for r in held_out_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        tokens = [*(texts[r.doc_id][1] or "").lower().split(), None]
        want = sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(want) and r.score < 0


def test_words_like_split():
    texts = [b"The cat\x0bSAT", None, b"", b" \t ", "É é\x1cx\u00a0y the cat".encode(), b"the", b"\n"]
    for some in (texts, [b""], [None, None], texts[-2:]):
        words, ends = Words(some), [0, *Words(some).ends.tolist()]
        every = [words.distinct[k].as_py() for k in words.which.tolist()]
        assert [every[a:b] for a, b in zip(ends, ends[1:])] == [(t or b"").lower().split() for t in some]
        assert words.text_of().tolist() == [k for k, t in enumerate(some) for _ in (t or b"").split()]


def test_base_scores_need_no_model(spark, monkeypatch):
    docs = spark.createDataFrame([(k if k % 9 else None, f"word{k % 7} Word{k} and" if k % 4 else None) for k in range(60)], "doc_id long, text string").repartition(3)
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))
    want = order(held_out_scores(docs).drop("score").collect())
    monkeypatch.setattr(lm_scoring, "train", None)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = order(queries.word_base_scores(spark, "").collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-4)
    words = spark.createDataFrame([(k, 0, f"w{k} w{k} w1".encode()) for k in range(50)], "row long, doc_id long, text binary")
    whole, part = (order(lm_scoring.score(words, lm_scoring.settled(lm_scoring.word_counts(words)), None, n).collect()) for n in (1000, 3))
    assert [r[:4] for r in whole] == [r[:4] for r in part] and [r[4] for r in whole] == pytest.approx([r[4] for r in part])
