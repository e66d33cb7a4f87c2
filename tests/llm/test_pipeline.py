"""The pipeline against the stages' operators applied by brute force to a small table."""

import random

import pytest

import corpus_pipeline
from barwise.llm.pieces import PieceTransducer
from barwise.llm.common import vocabulary_path
from barwise.llm.simhash import RADIUS, fingerprint

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    words = {"en": [f"the{chr(97 + k)}ing" for k in range(26)], "fr": [f"é{chr(97 + k)}eaux" for k in range(26)]}
    rows = []
    for k in range(120):
        lang = ("en", "fr")[k % 2]
        body = [rng.choice(words[lang]) for _ in range(rng.randint(30, 60))]
        rows.append((k, " ".join(body), lang))
    leak = "one two three four five six seven eight nine ten"
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(10)]
    rows += [(300, f"{rows[3][1]} {leak} {rows[5][1]}", "fr"), (301, "12 34 !!", "en"), (302, None, "en"), (303, "", None)]
    rows += [(400 + k, f"{rows[k][1]} vileword scumword {rows[k + 1][1]}", rows[k][2]) for k in range(20)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(400 <= i < 420)) for i, _, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("a", leak.upper())], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == NAMES
        after = {r.doc_id: r for r in docs.collect()}
        assert all(before[k] == r for k, r in after.items())
        gone = before.keys() - after.keys()
        if name.startswith("language"):
            assert gone == {301, 302, 303}
        elif name == "toxicity":
            assert gone == {i for i in before if 400 <= i < 420}
        elif name.startswith("simhash"):
            fp = {i: fingerprint(r.text.encode()) for i, r in before.items()}
            group = {i: i for i in fp}
            for _ in fp:
                for i in fp:
                    group[i] = min(group[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= RADIUS)
            assert after.keys() == {i for i in fp if group[i] == i} and {200, 205} <= gone
        else:
            assert gone == {300}
    machine = PieceTransducer(vocabulary_path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == after.keys()
    assert all(machine.decode(r.ids) == after[r.doc_id].text and r.n_pieces == len(r.ids) for r in rows)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
