"""Words of a slice are numbered once: the same words as the pattern's, and no Python call for each repeat."""

import random
import sys

import numpy as np
import pytest

from barwise.llm import language

LETTERS = "aZéßñ漢яه²Ⅷ१_7- \t\n\x02\x1c\x00'.Aİ́̀‍"


def model():
    grams = sorted({g for w in ("weather", "coat", "mantel", "abend", "погода") for g in language.trigrams(w)})
    starts = np.arange(len(grams) + 2)
    starts[-1] = len(grams)
    rng = np.random.default_rng(1)
    return {
        "langs": ["de", "en"], "background": 1.5, "trigrams": {g: k for k, g in enumerate(grams)}, "starts": starts,
        "gain_langs": rng.integers(0, 2, len(grams)), "gains": rng.random(len(grams)).astype(np.float32),
        "scripts": {"latin": np.array([True, True]), "cyrillic": np.array([False, True]), "greek": np.array([False, False])},
    }


def calls(texts):
    scorer, n = language.WordScores(model()), 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = list(language._labelled(texts, scorer, 8.0))
    finally:
        sys.setprofile(None)
    assert len(found) == len(texts)
    return n


def test_repeated_words_cost_no_call_each():
    words = ["weather", "coat", "mantel", "abend", "é²", "погода"] * 20
    one, twice = calls([" ".join(words)] * 200), calls([" ".join(words)] * 400)
    assert twice - one < 200 * len(words) // 2  # two calls a word before


def test_letter_runs_equal_the_pattern_s():
    rng = random.Random(3)
    for _ in range(3_000):
        text = "".join(rng.choice(LETTERS if rng.random() < 0.5 else LETTERS[:2] + " _7-\x02") for _ in range(rng.randrange(20)))
        assert language.letter_runs(text) == language._WORD.findall(text.lower())
    assert language.letter_runs("".join(map(chr, range(128)))) == ["abcdefghijklmnopqrstuvwxyz"] * 2


def test_scores_are_sums_of_gains_less_those_of_foreign_scripts():
    m, words = model(), ["weather", "погода", "ωab", "漢", "é", "coatmantel"]
    scorer = language.WordScores(m)
    scorer.learn(words)
    for w in words:
        want = np.zeros(2)
        for g in language.trigrams(w):
            if (at := m["trigrams"].get(g)) is not None:
                want[m["gain_langs"][at]] += m["gains"][at]
        want[0] -= 1e4 * (w == "погода")
        assert scorer.rows[scorer.number[w]] == pytest.approx(want, rel=1e-5)
        assert scorer.needed[scorer.number[w]] == pytest.approx(1.5 * len(w))


def test_words_without_letters_and_empty_texts():
    found = list(language._labelled(["²³ ²", None, "", "coat ² coat", "7"], language.WordScores(model()), 8.0))
    assert [f[0] == "und" for f in found] == [True, True, True, False, True]
    assert found[3][2][0][1:] == (2, 8)
    none = model() | {"langs": [], "scripts": {}}
    assert list(language._labelled(["coat"], language.WordScores(none), 8.0)) == [("und", 0.0, [])]
