import random

import numpy as np
import xxhash

from barwise.llm.components import components
from barwise.llm.simhash import covering_masks, deduplicate, fingerprint, near_duplicates, near_links


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def sample():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    texts = [None, "", " \n\t", "One", "one", "a b c", "A b C d", "x y z", "\x85 a"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 300]))]
        for _ in range(rng.choice([1, 1, 4, 9])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    for family in (0, 1):
        masks = covering_masks(family)
        assert len(set(masks)) == 31 and all(bin(m).count("1") == 32 for m in masks)
        for _ in range(3000):
            flips = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(m & flips == 0 for m in masks)
    assert min(bin(a | b).count("1") for a in covering_masks(0) for b in covering_masks(1)) >= 40


def test_fingerprints_match_brute_force():
    for text in sample():
        assert fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def test_components_match_brute_force(spark):
    texts = sample()
    docs = spark.createDataFrame([(1000 - k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp int, component string")
    fps = {1000 - k: brute_fingerprint(t) for k, t in enumerate(texts)}
    want = brute_components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    for most in (4096, 1):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs, most).collect()}
        assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    same, other = "one two three four five six", "quite another text with words of its own"
    rows = [(None, same), (7, same), (7, same), (7, other), (None, "a text of no id at all"), (None, "a text of no id at all")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, near long")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 7), (7, 7), (7, 7), (7, 7)]
    assert sorted(r.near for r in deduplicate(docs).collect()) == [1, 3, 4]


def test_very_long_text(spark):
    long = " ".join(f"w{k % 9973}" for k in range(800_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {1}


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(2)
    fps = {sum(1 << b for b in rng.sample(range(40), 3)) for _ in range(400)} | {rng.getrandbits(63) for _ in range(50)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    nodes = sorted(fps)
    want = brute_components(nodes, lambda a, b: bin(a ^ b).count("1") <= 4)
    got = {r.node: r.component for r in components(near_links(frame, most=20)).collect()}
    assert {n: got.get(n, n) for n in nodes} == want


def test_long_chains(spark):
    links = spark.range(300).selectExpr("(id * 7919) % 301 a", "((id + 1) * 7919) % 301 b")
    assert {r.component for r in components(links).collect()} == {0}
