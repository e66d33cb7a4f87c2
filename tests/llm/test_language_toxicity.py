"""Language labels against every labelling of short texts, rejected texts, and what the counterfactual term changes."""

import random
from itertools import product

import numpy as np
import pytest

from barwise.llm import language, toxicity

SENTENCES = {
    "en": "the weather is going to change before the evening and nobody should leave without a warm coat",
    "de": "das wetter wird sich noch vor dem abend ändern und niemand sollte ohne warmen mantel gehen",
    "ru": "погода изменится до вечера и никто не должен выходить без тёплого пальто",
}


def rows(copies=12):
    rng = random.Random(1)
    out = []
    for lang, sentence in SENTENCES.items():
        for _ in range(copies):
            words = sentence.split()
            rng.shuffle(words)
            out.append((len(out), " ".join(words), lang))
    return out


@pytest.fixture(scope="module")
def model(spark):
    # columns with names that the training uses itself
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows()], "doc_id long, text string, lang string, n long, count long, kind string")
    return language.train(docs)


def test_viterbi_equals_every_labelling(model):
    scorer = language.WordScores(model)
    for text in ("the weather погода abend", "ändern before und leave", "mantel", "warm warmen coat без coat"):
        words = language.letter_runs(text)
        scorer.learn(set(words))
        numbers = np.array([scorer.number[w] for w in words])
        for penalty in (0.0, 3.0, 50.0):
            path = language.viterbi(scorer.rows, [numbers], penalty)[0]
            total = lambda p: sum(scorer.rows[n, k] for n, k in zip(numbers, p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
            best = max(total(p) for p in product(range(len(model["langs"])), repeat=len(words)))
            assert total(path.tolist()) == pytest.approx(best, rel=1e-6)


def test_word_scores_are_sums_of_trigram_gains(model):
    scorer = language.WordScores(model)
    scorer.learn({"weather", "abend"})
    for word, number in scorer.number.items():
        for k, lang in enumerate(model["langs"]):
            want = 0.0
            for gram in language.trigrams(word):
                at = model["trigrams"].get(gram, len(model["trigrams"]))
                part = slice(model["starts"][at], model["starts"][at + 1])
                want += dict(zip(model["gain_langs"][part].tolist(), model["gains"][part].tolist())).get(k, 0.0)
            assert scorer.rows[number, k] == pytest.approx(want - (1e4 if lang == "ru" else 0), rel=1e-5)


def test_foreign_scripts_and_random_letters_are_rejected(spark, model):
    texts = {1: SENTENCES["en"], 2: SENTENCES["ru"], 3: "ไทยภาษา ที่ไม่มีใครเรียน", 4: "नमस्ते दुनिया", 5: "xqzv jwkp vbqx zzkw qjxv pwqz", 6: None, 7: "12 ..", 8: "", 9: f"{SENTENCES['de']} 漢字"}
    docs = spark.createDataFrame([(k, t, "q") for k, t in texts.items()], "doc_id long, text string, n string")
    assert {r.doc_id for r in language.keep_identified(docs, model).collect()} == {1, 2, 9}
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert found[1][0] == "en" and found[2][0] == "ru" and found[9][0] == "de"
    assert all(found[k] == ("und", 0.0) for k in (6, 7, 8)) and found[3][1] == found[4][1] == 0


def test_words_keep_their_combining_marks():
    assert language.letter_runs("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]
    assert language.letter_runs("été x2") == ["été", "x"]


def labelled(spark):
    """Toxic texts that often name a group, and neutral mentions of other groups only."""
    rng = random.Random(4)
    neutral = [f"word{chr(97 + k)}" for k in range(20)]
    docs, labels = [], []
    for k in range(400):
        words = rng.sample(neutral, 8)
        toxic = k % 2
        if toxic:
            words += [rng.choice(["scumword", "vileword"])] if k % 3 else []
            words += ["muslims"] if k % 4 else ["idiotword"]
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactual_term_lowers_scores_of_neutral_mentions(spark):
    docs, labels = labelled(spark)
    mention = spark.createDataFrame([(1, "muslims worda wordb wordc"), (2, "christians worda wordb wordc"), (3, "scumword vileword worda")], "doc_id long, text string")
    scores = {c: {r.doc_id: r.score for r in toxicity.score(mention, toxicity.train(docs, labels, consistency=c)).collect()} for c in (0.0, 10.0)}
    assert scores[0.0][1] > scores[10.0][1] + 0.2
    assert abs(scores[10.0][1] - scores[10.0][2]) < 0.5 * abs(scores[0.0][1] - scores[0.0][2])
    assert scores[10.0][3] > 0.5  # what is toxic stays so


def test_toxicity_scores_are_the_logistic_of_summed_weights(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    weights = dict(zip(model["names"], model["weights"]))
    texts = {1: None, 2: "", 3: "scumword worda", 4: "Muslims, scumword! idiotword"}
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, toxic int"), model).collect()}
    for k, text in texts.items():
        words = set(language.letter_runs(text or ""))
        logit = model["bias"] + sum(weights.get(f, 0.0) for f in toxicity.features_of(words))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-logit)))
    none = toxicity.train(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(docs.limit(1), none).collect()] == [pytest.approx(0.0, abs=1e-9)]
