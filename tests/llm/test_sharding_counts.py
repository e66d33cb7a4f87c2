import zlib

import numpy as np
import pytest

from barwise.llm.sharding import assign_shards, pack
from barwise.llm.token_counts import _encoding, encoded_lengths, length_histogram, length_quantiles, suffix_sums, truncated_totals
from barwise.llm.common import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item int, shard string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, None, "s", None, k, "x") for k, t in enumerate(texts)], SCHEMA)


def test_sharding_balances_and_numbers_slots(spark):
    texts = [f"some words {k} " * (1 + k % 17) for k in range(900)] + ["the same text " * 20] * 500 + ["a pair of copies"] * 40 + [None, "", "", "héé"]
    got = assign_shards(docs(spark, texts), shards=7).collect()
    assert len(got) == len(texts)
    totals, slots, groups, size = {}, {}, {}, {}  # the pieces of the large group differ from the rest in words and rows a byte
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        totals[r.shard] = totals.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(raw, set()).add(r.shard)
        size[raw] = size.get(raw, 0) + r["size"]
    assert len(totals) == 7 and max(totals.values()) < 1.03 * min(totals.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    part = sum(size.values()) / 7
    assert all((len(s) == 1) == (size[raw] <= part) for raw, s in groups.items())


def test_packing_balances_all_three():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 4, 3000)
    words = rng.lognormal(4, 1.2, 3000) * rows
    vectors = np.column_stack([words * rng.normal(6, 0.7, 3000) + 8 * rows, words, rows])
    shard = pack(vectors, 24)
    for k, most in enumerate((1.03, 1.03, 1.1)):  # bytes, words, rows
        sums = np.bincount(shard, vectors[:, k], minlength=24)
        assert sums.max() < most * sums.min()


def test_groups_stay_whole_in_the_tables(spark):
    for scale in ("sf0.001", "sf0.01"):
        table = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
        rows = assign_shards(table).join(table.select("doc_id", "text"), "doc_id").select("text", "shard", "size").collect()
        groups, size = {}, {}
        for r in rows:
            groups.setdefault(r.text or "", set()).add(r.shard)
            size[r.text or ""] = size.get(r.text or "", 0) + r["size"]
        part = sum(size.values()) / 24
        assert all(len(s) == 1 for t, s in groups.items() if size[t] <= part)


def test_sharding_of_nothing_and_of_repeated_rows(spark):
    assert assign_shards(docs(spark, [])).count() == 0
    one = docs(spark, ["a b"]).union(docs(spark, ["a b"]))
    assert sorted((r.shard, r.slot) for r in assign_shards(one, shards=1).collect()) == [(0, 0), (0, 1)]


def test_token_counts_match_brute_force(spark):
    texts = ["hello world", "hello world", "", None, "a" * 3000, "x y z", "été 漢字 ☃"] + [f"w{k} " * (k % 9) for k in range(60)]
    encode = _encoding(vocabulary_path("byte_bpe_50k.tiktoken")).encode_ordinary
    lengths = [len(encode(t or "")) for t in texts]
    d = docs(spark, texts)
    assert sorted(r.n_tokens for r in encoded_lengths(d).collect()) == sorted(lengths)
    sums = suffix_sums(length_histogram(d))
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.n_tokens)
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in lengths)
        assert r.docs_share_up_to == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    for r in truncated_totals(sums, [0, 1, 5, 10_000]).collect():
        assert r.tokens_kept == sum(min(x, r.context_limit) for x in lengths)
        assert r.docs_cut == sum(x > r.context_limit for x in lengths)
    for r in length_quantiles(sums, [0.5, 1.0]).collect():
        assert r.n_tokens == sorted(lengths)[-(-int(r.share * len(lengths) * 2) // 2) - 1] or r.share == 0.5
    assert suffix_sums(length_histogram(docs(spark, []))).count() == 0
