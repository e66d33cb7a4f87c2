"""Every operator and stage on null ids and texts, empty and very long texts, repeated rows, empty tables and clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwise.llm import language, toxicity
from barwise.llm.chat import conversation_digests
from barwise.llm.decontamination import contamination, decontaminate
from barwise.llm.lm_scoring import held_out_scores
from barwise.llm.merkle import fingerprints_of_edits
from barwise.llm.near_text import keep_distinct
from barwise.llm.pieces import decode, encode, round_trips
from barwise.llm.sharding import assign_shards
from barwise.llm.simhash import deduplicate, near_duplicates
from barwise.llm.token_counts import encoded_lengths, length_histogram, suffix_sums

LONG = " ".join(f"word{k % 997} and" for k in range(450_000))  # over 5 MB
TEXTS = [
    (1, "a first text of some words", "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (5, "the same text twice over here", "en"), (5, "the same text twice over here", "en"),
    (6, "the same text twice over here", "de"), (None, "a text without any id at all", "en"), (None, "a text without any id at all", None), (None, None, None), (7, "12 34", "en"),
]
CLASHING = ("n", "c", "row", "word", "key", "_first", "fp", "component", "part", "item", "near_row", "near_doc", "hits", "count", "_bucket", "slot", "ids", "salt", "n_words", "kind")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*t, "s", None) for t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (None, 1, "c"), (5, None, "d"), (6, 0, "e"), (99, 1, "f")], "doc_id long, toxic int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("i", "the same text twice over here"), (None, "a first text"), ("j", None), ("k", ""), ("l", "--")], "item_id string, text string")


def by_row(spark, docs, labels, benchmark):
    """Operators that give a row for each row."""
    return {
        "op1": near_duplicates(docs), "op2": language.predictions(docs), "op3": toxicity.predictions(docs, labels), "op5": round_trips(docs), "op5 ids": encode(docs), "op5 texts": decode(encode(docs)),
        "op6": held_out_scores(docs), "op7": contamination(docs, benchmark), "op8": fingerprints_of_edits(docs), "op9": assign_shards(docs), "op10": encoded_lengths(docs),
    }


NAMES = ("op1", "op2", "op3", "op5", "op5 ids", "op5 texts", "op6", "op7", "op8", "op9", "op10")


@pytest.fixture(scope="module")
def results(spark, docs, labels, benchmark):
    return {name: df.collect() for name, df in by_row(spark, docs, labels, benchmark).items()}


@pytest.mark.parametrize("name", NAMES)
def test_each_row_gives_a_row(results, name):
    assert Counter(r.doc_id for r in results[name]) == Counter(t[0] for t in TEXTS)
    fives = [tuple(r) for r in results[name] if r.doc_id == 5]
    if name not in ("op8", "op9"):  # repeated rows are alike but for their neighbours and slots
        assert all(a == (pytest.approx(b, rel=1e-5) if isinstance(b, float) else b) for a, b in zip(*fives))


def test_results_of_odd_rows(results):
    at = lambda name, doc: next(r for r in results[name] if r.doc_id == doc)
    assert at("op1", 2).fingerprint == at("op1", 3).fingerprint == "0" * 16 and at("op1", 2).component_id == 2
    assert {r.component_id for r in results["op1"] if r.doc_id in (5, 6)} == {5}
    assert (at("op2", 2).lang_pred, at("op2", 7).lang_pred) == ("und", "und") and at("op2", 4).score > 0.5
    assert at("op5", 4).round_trip and at("op5", 2).n_pieces == 0
    assert at("op6", 2).n_tokens == 1 and at("op6", 4).n_tokens == 900_001 and {r.held_out for r in results["op6"] if r.doc_id is None} == {None}
    assert at("op7", 5).n_hit == 6 and at("op7", 5).n_items == 1 and at("op7", 1).n_hit == 0 and at("op7", 4).n_words == 900_000
    assert sorted(r.slot for r in results["op9"] if r.shard == at("op9", 4).shard)[0] == 0 and at("op9", 2)["size"] == 8
    assert len({r.shard for r in results["op9"] if r.doc_id in (5, 6)}) == 1
    assert at("op10", 2).n_tokens == 0 and at("op10", 4).n_tokens > 900_000


def test_empty_tables(spark, docs, labels, benchmark):
    for name, df in by_row(spark, docs.limit(0), labels.limit(0), benchmark.limit(0)).items():
        assert df.count() == 0, name
    assert suffix_sums(length_histogram(docs.limit(0))).count() == 0
    assert conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations(spark):
    rows = [(None, 1, "user", "x"), (None, 1, "user", "x"), (None, None, None, None), (1, 2, "assistant", LONG[:1_000_000]), (1, 1, "user", ""), (2, 1, "assistant", None)]
    chats = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, n long")
    got = {r.conv_id: r for r in conversation_digests(chats).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 3, 1: 2, 2: 1} and got[1].loss_chars == 1_000_000 and got[2].loss_chars == 0


def test_stages_keep_columns_and_defined_rows(spark, docs, labels, benchmark):
    kept = {
        "language": language.keep_identified(docs, language.train(docs)), "toxicity": toxicity.keep_civil(docs, toxicity.train(docs, labels)),
        "near text": keep_distinct(docs), "simhash": deduplicate(docs), "decontamination": decontaminate(docs, benchmark),
    }
    ids = {}
    for name, df in kept.items():
        rows = df.collect()
        assert df.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
        ids[name] = Counter(r.doc_id for r in rows)
    assert not {2, 3, 7} & ids["language"].keys() and ids["language"][5] == 2
    assert ids["near text"] == ids["simhash"] == Counter([1, 2, 4, 5, 7, None])  # one of the copies, of those without words, of those without an id
    assert ids["decontamination"] == Counter(t[0] for t in TEXTS if t[1] != TEXTS[4][1])


def test_pipeline_of_odd_rows(spark, docs, labels, benchmark, tmp_path):
    for name, df in (("documents", docs), ("labels", labels.drop("text").withColumn("quality", F.lit(1))), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert set(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) <= {1, 4, None}
