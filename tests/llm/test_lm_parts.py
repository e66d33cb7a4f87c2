"""Scoring in parts: texts and ids go to different tasks, and the frequent words are found without sorting."""

import pytest

from barwise.llm import lm_scoring
from barwise.llm.common import settled

TEXTS = ["a a a b b c", "b c d d e", None, "", "f g A h", "a b zz"]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_no_task_gets_texts_beside_ids(spark):
    plan = lm_scoring.held_out_scores(rows(spark))._jdf.queryExecution().executedPlan().toString()
    calls = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert any("text#" in line for line in calls) and any("ids#" in line for line in calls)
    assert not [line for line in calls if "text#" in line and "ids#" in line]


@pytest.mark.parametrize("head_words", [0, 1, 2, 3, 4, 1000])
def test_head_of_any_size_gives_the_same_scores(spark, head_words):
    docs = rows(spark).selectExpr("doc_id as row", "doc_id", "cast(text as binary) as text")
    counts = settled(lm_scoring.word_counts(docs))
    words = {bytes(r.word): r.c for r in counts.collect() if bytes(r.word) != lm_scoring.END}
    least = lm_scoring._most_in_tail(counts.where("word != X'20'"), head_words)
    assert sum(c > least for c in words.values()) <= head_words
    assert not least or sum(c >= least for c in words.values()) > head_words
    got = {r.doc_id: r for r in lm_scoring.score(docs, counts, None, head_words).collect()}
    want = {r.doc_id: r for r in lm_scoring.score(docs, counts, None).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for k, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (want[k].n_tokens, want[k].n_known, want[k].train_tokens, None)
        assert r.n_known == r.n_tokens  # every word was learnt
        assert r.base_score == pytest.approx(want[k].base_score, abs=1e-9)
