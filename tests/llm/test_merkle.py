import hashlib
import random

from pyspark.sql import functions as F

from barwise.llm.merkle import changed_paragraphs, fingerprints_of_edits, likeness, with_fingerprint, with_next


def frame(spark, texts, step=3):
    return spark.createDataFrame([(k * step, t, "clash", k) for k, t in enumerate(texts)], "doc_id long, text string, next_text string, _bucket int")


def sample():
    rng = random.Random(5)
    texts = ["", None, "one line", "one line", "a\nb\n\nc", "☃" * 200, "x" * 5000, "\n\n\n"]
    texts += ["\n".join("".join(rng.choice("abcdé ☃") for _ in range(rng.randrange(150))) for _ in range(rng.randrange(30))) for _ in range(120)]
    return texts


def test_edits_match_brute_force(spark):
    texts = [t or "" for t in sample()]
    got = {r.doc_id // 3: r for r in fingerprints_of_edits(frame(spark, sample())).collect()}
    assert sorted(got) == list(range(len(texts)))
    for k, r in got.items():
        n = len(texts[k])
        edited = texts[k][: n - n // 2] + texts[(k + 1) % len(texts)][: n // 2]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1.0) == (r.fingerprint.split("|")[0] == r.edited_fingerprint.split("|")[0])
        for j, s in got.items():
            assert (r.fingerprint == s.fingerprint) == (texts[k] == texts[j])
        assert (r.edited_fingerprint == r.fingerprint) == (edited == texts[k])
        if n > 1500:
            assert r.near_edited > 0.3
    assert got[2].near_next == 1.0 and got[len(texts) - 1].near_next < 1


def test_next_rows_with_repeated_ids_and_few_rows(spark):
    rows = [(5, "b"), (1, "x"), (5, "a"), (9, "z"), (1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.next_text) for r in with_next(df, ["text"]).collect())
    assert got == [(1, "x", "a"), (1, "x", "x"), (5, "a", "b"), (5, "b", "z"), (9, "z", "x")]
    assert with_next(df.limit(0), ["text"]).count() == 0
    many = spark.range(5000).select((F.col("id") * 7 % 5003).alias("doc_id"), F.col("id").cast("string").alias("text"))
    follow = {r.doc_id: r.next_doc for r in with_next(many.withColumn("doc", F.col("doc_id")), ["doc"], rows_per_bucket=20).collect()}
    order = sorted(follow)
    assert follow == dict(zip(order, order[1:] + order[:1]))


def test_branches_locate_edits(spark):
    lines = [f"line number {k} says something" for k in range(40)]
    edited = list(lines)
    edited[3], edited[29] = "changed", "also changed"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb")
    r = df.select(changed_paragraphs(F.col("fa"), F.col("fb")).alias("c"), likeness(F.col("fa"), F.col("fb")).alias("l")).first()
    assert r.c == [3, 29] and 0.9 < r.l < 1
