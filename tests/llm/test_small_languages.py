"""Language models of languages with few labelled documents beside large ones."""

import random

from barwise.llm import language


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_small_language_keeps_its_trigrams(spark):
    rng = random.Random(1)
    wide = [chr(0x4E00 + k) for k in range(8000)]
    rows = [(k, words(rng, wide, 300), "aa") for k in range(400)] + [(1000, "zubo kimba wolle", "zz")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(language.trigrams("kimba")) <= model["trigrams"].keys() and len(model["trigrams"]) > 200_000


def test_unseen_trigrams_do_not_go_to_the_smallest_language(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, "abcdefg", 200), "large") for k in range(200)] + [(1000, words(rng, "hijklmn", 20), "Small")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = f"{words(rng, 'abcdefg', 10)} qrstuvw xyzqrst vwxqyzr {words(rng, 'abcdefg', 10)}"
    found = language.identify(spark.createDataFrame([(1, text), (2, rows[-1][1])], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, len(r.spans)) for r in sorted(found)] == [("large", 1), ("Small", 1)]
