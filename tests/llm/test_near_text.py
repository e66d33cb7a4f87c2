"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from barwise.llm.components import components
from barwise.llm.near_text import BANDS, bucket_links, keep_distinct, band_keys, shingle_set, similar
from barwise.llm.simhash import RADIUS, fingerprint


def brute_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """Row numbers that stay: of each group, the smallest id, ids before nulls."""
    sets = [brute_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    best = {}
    for k, (doc, _) in enumerate(rows):
        key = (doc is None, doc or 0, k)
        best[group[k]] = min(best.get(group[k], key), key)
    return sorted(k for _, _, k in best.values())


def sample():
    rng = random.Random(3)
    texts = [None, "", "one", "One", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 3, 6])):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    base = [f"w{k}" for k in range(120)]
    for k in range(60):  # one large group
        texts.append(" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]))
    return texts


def test_stage_matches_brute_force(spark):
    texts = sample()
    rows = [(1000 - k if k % 9 else None, t) for k, t in enumerate(texts)] + [(7, "same id and text here twice"), (7, "same id and text here twice"), (7, "but not here at all")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    want = brute_kept(rows)
    for small in (16, 1):
        got = keep_distinct(docs, small)
        assert got.columns == docs.columns
        assert sorted(r.k for r in got.collect()) == want
    assert keep_distinct(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies_beyond_four_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (596, 917, 2465, 5733)")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()) == [596, 2465]


def test_bands_reach_the_similarity():
    rng = np.random.default_rng(1)
    shared = []
    for _ in range(1000):  # at 0.8: 240 shingles of 300 in both
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1)
        shared.append((band_keys(np.sort(x[:270])) == band_keys(np.sort(x[30:]))).sum())
    assert min(shared) > 0 and abs(np.mean(shared) / BANDS - 0.8**5) < 0.02


def test_bucket_links_join_like_all_pairs():
    words = [f"w{k}" for k in range(60)]
    texts = [words, *([*words[:k], "x", *words[k + 1 :]] for k in range(2, 58, 4)), [f"y{k}" for k in range(60)]]
    sets = [shingle_set(" ".join(t).encode()) for t in texts]
    links = bucket_links(np.arange(len(sets)), np.arange(len(sets)), sets)
    assert len(links) == len(sets) - 2 and all(len(sets) - 1 not in pair for pair in links)


def test_pipeline_stage_links_fingerprints_beside_sets(spark):
    """b is within SimHash's radius of a, but its set isn't similar to a's; c is like b in its set only."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(40)]
    fp = fingerprint(" ".join(base).encode())
    while True:
        near = list(base)
        for k in rng.sample(range(40), 2):
            near[k] = f"w{rng.randrange(5000)}"
        if (fingerprint(" ".join(near).encode()) ^ fp).bit_count() <= RADIUS and not similar(*(shingle_set(" ".join(t).encode()) for t in (base, near))):
            break
    texts = [base, near, [*near, "x"], [f"y{k}" for k in range(40)], [f"y{k}" for k in range(20)] * 2, [f"y{k}" for k in range(20)] * 3]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(9, None), (8, "")], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    assert kept == {0, 3, 4, 8}
    assert {r.doc_id for r in keep_distinct(docs).collect()} == {0, 1, 3, 4, 8}


def test_components_of_many_links_in_few_tasks(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(0, 300) if k % 50 != 49] + [(400, 500), (500, 400), (7, 7)], "a long, b long")
    for per_task in (50_000, 3):
        got = {r.node: r.component for r in components(links, per_task).collect()}
        assert got == {k: k // 50 * 50 for k in range(300)} | {400: 400, 500: 400}
