import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barwise.llm.mixing import mixed_texts, mixture, prefix_sums

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shared(sizes, weights=(1, 2, 3), epochs=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    everything, full = sum(sizes.values()), set()
    while True:
        left = everything - sum(epochs * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * w[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > epochs * sizes[s]}
        if not over:
            return target
        full |= over


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(f"own {c}") for c in ("key", "size", "before", "_part", "rank")})


def rows():
    out, n = [], 0
    for source, docs, words in (("b", 300, 40), ("a", 5, 3), ("é", 60, 11), (None, 4, 2), ("Z", 1, 1), ("none", 3, 0)):
        for k in range(docs):
            out.append((n, source, " \t".join(f"w{j}" for j in range(words + (k % 5 if words else 0))) or None))
            n += 1
    return out + [(7, "b", "twice over"), (7, "b", "twice over"), (None, "b", "no id"), (None, "b", "no id"), (None, "a", None), (n, "b", "word " * 20_000)]


def test_targets_and_budgets(spark):
    made = rows()
    sizes = defaultdict(int)
    for _, source, text in made:
        sizes[source] += len(WORDS.findall(text or ""))
    want = shared(dict(sizes))
    got = mixture(table(spark, made).repartition(7)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in made)
    taken, places = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        places[r.source].append(((hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:16]), r.taken / r["size"] if r["size"] else None))
    assert all(taken[s] == int(want[s] + 0.5) for s in want)
    for order in places.values():  # along the keys a source is taken ever less often
        times = [t for _, t in sorted(order, key=lambda p: p[0]) if t is not None]
        assert all(a >= b - 1e-12 for a, b in zip(times, times[1:]))


def test_reruns_agree_and_texts_add_up(spark):
    docs = table(spark, rows())
    first, again = (sorted(map(str, mixture(d).collect())) for d in (docs, docs.repartition(5)))
    assert first == again
    texts = mixed_texts(docs)
    assert texts.columns == [*docs.columns, "mix_epoch", "mix_text"]
    words, laps = defaultdict(int), defaultdict(set)
    for r in texts.collect():
        assert r.size == "own size"
        words[r.doc_id] += len(WORDS.findall(r.mix_text))
        laps[r.doc_id].add(r.mix_epoch)
    plan = defaultdict(int)
    for r in mixture(docs).collect():
        plan[r.doc_id] += r.taken
    assert {k: v for k, v in plan.items() if v} == dict(words)
    assert all(sorted(e) == list(range(len(e))) for e in laps.values())


def test_prefix_sums_over_groups_and_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("t"), (F.col("id") * 7 % 11).alias("x")).repartition(9)
    got = {(r.g, r.t): r.before for r in prefix_sums(df, ["g"], ["t"], {"before": F.col("x")}).collect()}
    assert all(got[t % 3, t] == sum(j * 7 % 11 for j in range(t % 3, t, 3)) for t in range(1000))


def test_nothing_to_mix(spark):
    assert mixture(table(spark, [])).count() == 0 and mixed_texts(table(spark, [])).count() == 0
    only = mixture(table(spark, [(1, "a", None), (2, None, "")])).collect()
    assert {(r.taken, r.target, r.source_size) for r in only} == {(0, 0.0, 0)}
