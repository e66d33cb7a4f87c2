import math

import numpy as np
from pyspark.sql import functions as F

from barwise.llm import negatives
from barwise.llm.common import settled
from barwise.llm.negatives import QUERIES, Index, _query_blocks, hard_negatives, integer_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step):
    data = {}
    for vec_id, x, label in rows:
        if vec_id is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            vec = [math.floor(256 * float(np.float32(c))) for c in x]
            data[vec_id] = min(data.get(vec_id, (label, vec)), (label, vec))
    score = lambda a, b: sum(x * y for x, y in zip(data[a][1], data[b][1]))
    out = []
    for a in data:
        if a % step:
            continue
        near = sorted((-score(a, b), b) for b in data if b != a and data[b][0] == data[a][0])[:5]
        for ps, positive in ((-s, b) for s, b in near):
            far = sorted((-score(a, b), b) for b in data if data[b][0] != data[a][0] and 80 * ps <= 100 * score(a, b) <= 100 * ps)[:5]
            out += [(a, positive, k, b, ps, -s) for k, (s, b) in enumerate(far, 1)]
    return sorted(out)


def clustered(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(scale=0.3, size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, [float(c) for c in v], int(k % 4)) for k, v in enumerate(x)]


def run(spark, rows, step):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("key", "pivot", "window", "rank", "block", "windows", "score", "n")}).repartition(4)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % step == 0).collect())


def test_equals_brute_force_on_clusters_and_copies(spark):
    rows = clustered(400, 8)
    rows += [(1000 + k, rows[7][1], k % 3) for k in range(150)]  # a third of all are copies of one vector
    got = run(spark, rows, 20)
    assert got == brute(rows, 20) and len(got) > 300


def test_odd_rows(spark):
    rows = clustered(60, 5, 9)
    rows += [(None, [1.0] * 5, 1), (100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0], 2), (102, [float("nan")] * 5, 1), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (104, [0.5] * 5, None), (110, [], 1), (120, [0.9, 0.1], 2)]
    rows += [(130, [0.4, 0.3, 0.2, 0.1, 0.0], 3)] * 2 + [(130, [0.1] * 5, 3), (140, [-1.0] * 5, 0), (150, [0.0] * 5, 1)]
    padded = [(i, x + [0.0] * (5 - len(x)) if x is not None else None, label) for i, x, label in rows]
    assert run(spark, rows, 10) == brute(padded, 10)
    assert run(spark, [], 10) == [] and run(spark, [(1, [0.5], 1)], 10) == [] and run(spark, [(10, [0.5], 1), (20, [0.5], 1)], 10) == []


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**20 + 7 * k), float(-(2**18) + k * k)], k % 2) for k in range(40)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_rounds_scan_less_than_everything(spark, monkeypatch):
    """On clustered rows the bound certifies before all blocks were met, and small blocks give the same rows."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(c) for c in v], int(k % 3)) for k, v in enumerate(np.repeat(np.eye(8), 60, axis=0) + rng.normal(scale=0.01, size=(480, 8)))]
    data = settled(integer_rows(spark.createDataFrame(rows, SCHEMA)))
    index = Index(data, block_rows=16)
    met = []
    scan = Index._round
    monkeypatch.setattr(Index, "_round", lambda self, *a: met.append(1) or scan(self, *a))
    anywhere = F.array(F.struct(F.lit(negatives._MOST).alias("high"), F.lit(-negatives._MOST).alias("low")))
    asked = data.where("vec_id % 30 = 0").withColumn("windows", anywhere)
    got = sorted((r.vec_id, r["rank"], r.other_id) for r in index.search(asked, 5, same=True).collect())
    vecs = {r.vec_id: np.array(r.vec) for r in data.collect()}
    want = []
    for a in range(0, 480, 30):
        best = sorted((-int(vecs[a] @ vecs[b]), b) for b in vecs if b != a and b % 3 == a % 3)[:5]
        want += [(a, k, b) for k, (_, b) in enumerate(best, 1)]
    assert got == sorted(want) and len(met) < 4
    # within the radius that certifies, most of the blocks need no look
    live = settled(index._keyed(asked, queries=True).withColumns({"inner": F.lit(0.0), "was": F.lit(-1e-6), "radius": F.lit(30.0)}))
    blocks = settled(live.mapInArrow(lambda batches: _query_blocks(batches, 1e-6, 1), QUERIES))
    assert 0 < index._pairs(blocks).count() < 0.25 * blocks.count() * index.blocks.count()
