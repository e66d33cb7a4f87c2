import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from barwise.llm.divergence import _COUNTED, _connect, _shard, divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, most=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        c = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        everywhere = {t: sum(c[s][t] for s in sources) for t in kept}
        p = lambda held: {t: 1 + 1_000_000_000 * (held[t] + 1) // (sum(held.values()) + len(kept)) for t in kept}
        of, all_of = {s: p(c[s]) for s in sources}, p(everywhere)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(of[s][t], all_of[t])) for t in kept if c[s][t] and of[s][t] > all_of[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


def sample():
    rng = random.Random(5)
    vocabulary = ["the", "The", "naïve", "漢字", "a'b", "x9y", "éÉ", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 60]))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "É", None])) for _ in range(400)]
    rows += [("the same words again", "en", "s1")] * 50 + [(None, None, None), ("", "xx", "only"), ("12 34", "xx", "other"), ("rare once", "yy", "a"), ("\x00nul the\x00w", "en", "s2")]
    return rows + [("the long text of one word " * 60_000, "en", "s3")]


def test_equals_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(c) for c in ("term", "n", "row", "item", "value", "v", "docs")}).repartition(5)
    assert sorted(tuple(r) for r in divergence(docs).collect()) == brute(rows)
    assert sorted(tuple(r) for r in divergence(docs, least_docs=2, most_terms=3).collect()) == brute(rows, 2, 3)


def test_no_rows_and_no_terms(spark):
    docs = spark.createDataFrame([(1, "!", "en", "a"), (2, None, "en", "b")], "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence(docs).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence(docs.limit(0)).count() == 0


def test_a_shard_is_added_up_in_parts():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["l"] * 6), pa.array(["s", "t"] * 3), pa.array(["x", "y", "x", "x", "y", "x"]), pa.array([1] * 6, pa.int64()), pa.array([1] * 6, pa.int64())], schema=_COUNTED)
    whole = _shard(iter([batch] * 9), _connect(), most=12)
    assert sorted(zip(*[whole[c].to_pylist() for c in ("source", "term", "n")])) == [("s", "x", 18), ("s", "y", 9), ("t", "x", 18), ("t", "y", 9)]
