import hashlib
import random
import time
import tracemalloc

from barwise.llm.decontamination import TestSuffixes, _hits_of, contamination, decontaminate, longest_matches, words_of


def brute(text, items, window):
    words = words_of(text.encode()) if text else []
    hit, found, longest = set(), set(), 0
    for name, item in items:
        w = words_of(item.encode()) if item else []
        n = min(window, len(w))
        if not n:
            continue
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
                longest = max(longest, max(k for k in range(n, len(words) - i + 1) if any(words[i : i + k] == w[j : j + k] for j in range(len(w)))))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest


def fixture():
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcde") + rng.choice("xyz") for _ in range(rng.choice([14, 25, 11, 10])))) for k in range(30)]
    items += [(100, "Tiny item here"), (101, "été"), (102, ""), (103, None), (2, "another text under an id that repeats for good measure today ok")]
    texts = [None, "", "--- !!", "no match at all", "TINY item, here! and été", "tiny item"]
    for k in range(60):
        w = [rng.choice("abcde") + rng.choice("xyz") for _ in range(rng.randrange(1, 80))]
        if k % 3 == 0:
            source = rng.choice(items[:30])[1].split()
            at = rng.randrange(len(source))
            w[len(w) // 2 : len(w) // 2] = source[at:]
        texts.append(" ".join(w) if k % 5 else ", ".join(w).upper())
    return texts, items


def frames(spark, texts, items):
    return (
        spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, item_id string, n_words string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_contamination_matches_brute_force(spark):
    texts, items = fixture()
    docs, benchmark = frames(spark, texts, items)
    for window, block in ((10, 4_000_000), (10, 200), (3, 4_000_000), (1, 500)):
        got = {r.doc_id: tuple(r)[1:] for r in contamination(docs, benchmark, window, block).collect()}
        assert got == {k: brute(t, items, window) for k, t in enumerate(texts)}


def test_longest_matches_are_maximal(spark):
    docs, benchmark = frames(spark, ["q q a b c d e f", "a b c x b c d"], [(7, "a b c d e"), (8, "z z")])
    got = sorted(tuple(r) for r in longest_matches(docs, benchmark, 2).collect())
    assert got == [(0, "7", 2, 0, 5), (1, "7", 0, 0, 3), (1, "7", 4, 1, 3)]


def test_empty_tables_and_removal(spark):
    texts, items = fixture()
    docs, benchmark = frames(spark, texts, items)
    assert contamination(docs.limit(0), benchmark).count() == 0
    assert contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    for block in (8_000_000, 700):  # a single pass, and several
        kept = decontaminate(docs, benchmark, block_bytes=block)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {k for k, t in enumerate(texts) if not brute(t, items, 10)[4]}


def test_repeated_words_are_not_paired_off(spark):
    item, text = "word " * 4_000, "word " * 20_000
    test = TestSuffixes([("a", item.encode())], 10)
    tracemalloc.start()
    began = time.process_time()
    n_words, hits, items = _hits_of([text.encode()], test)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_words.tolist() == [20_000] and items.to_pylist() == [["a"]]
    assert max(h["n_words"] for h in hits.to_pylist()[0]) == 4_000 and len(hits.flatten()) <= 20_000
    assert took < 4 and peak < 200_000_000
    docs, benchmark = frames(spark, ["word " * 500, "other " * 300 + "word " * 30], [(1, "word " * 100), (2, "word " * 12 + "other " * 20)])
    got = {r.doc_id: tuple(r)[1:] for r in contamination(docs, benchmark, 10).collect()}
    assert got == {k: brute(t, [(1, "word " * 100), (2, "word " * 12 + "other " * 20)], 10) for k, t in enumerate(["word " * 500, "other " * 300 + "word " * 30])}


def test_a_passage_of_many_items_is_one_match(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(30))
    items = [(str(k), f"{rng.random()} {passage} {rng.random()}") for k in range(400)]
    texts = [f"before {k} {passage} after" for k in range(200)]
    test = TestSuffixes([(name, text.encode()) for name, text in items], 10)
    _, hits, met = _hits_of([t.encode() for t in texts], test)
    assert len(hits.flatten()) == 200 and all(len(m) == 400 for m in met.to_pylist()) and len(test.sets) < 400 * 20
    assert {h["n_words"] for row in hits.to_pylist() for h in row} == {30}
