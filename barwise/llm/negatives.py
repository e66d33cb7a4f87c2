"""Hard-negative mining by one-dimensional distance keys.

The best inner products become the nearest neighbours once every vector gets a component that brings it to the largest
norm M: with x' = (x, sqrt(M^2 - |x|^2)) and a query q' = (q, 0), |q' - x'|^2 = |q|^2 + M^2 - 2 qx. Each vector is stored
under the key (its nearest pivot, its distance to it), sorted. By the triangle inequality whatever lies within r of a
query has a key within r of the query's own distance to that pivot. A round therefore scans the key intervals of a radius
that were not scanned before, and nothing nearer than a query's inner bound; a query is done when it holds k rows at
distances within the radius, or the radius covers all that it may return. Scores are integers and exact; distances are
doubles and only tell what to scan, with a margin far above their error.

Rows and queries are packed in blocks of bounded size. Key intervals meet block intervals in cells of the distance axis,
so a round's joins are equi-joins, and a scan is one matrix product of a block of queries and a block of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import settled

SCALE = 256
MARGIN = 1e-9  # of the largest norm: far above the rounding of a distance, far below one step of a score


def integer_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part: vec holds floor(256 x) of each component.

    Rows with a null label, a null vector or a null or non-finite component are left out. Shorter vectors are filled
    with zeros to the longest. Components are held within the range in which no score can leave a long, which is beyond
    any embedding (x up to 1,048,576 at 64 components).
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    good = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    longest = good.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = math.isqrt((1 << 62) // max(longest, 1))
    held = F.transform(x, lambda c: F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), F.floor(SCALE * c).cast("double"))).cast("long"))
    vec = F.concat(held, F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("embedding")))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"))


class Pivots:
    """The pivots of a bounded sample, the norm that all vectors are brought to, and distances to the pivots."""

    def __init__(self, sample: np.ndarray, norm2: float, most: int):
        self.norm2 = norm2
        points = self.lifted(sample) if len(sample) else np.zeros((1, 2))
        chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < most and far.max() > 0:  # the farthest from those before
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        self.points = points[chosen]
        self.margin = MARGIN * max(1.0, math.sqrt(norm2))

    def lifted(self, vecs: np.ndarray, queries: bool = False) -> np.ndarray:
        """The vectors with the component that brings rows to the largest norm; it is 0 for queries."""
        wide = vecs.astype(float)
        return np.column_stack([wide, np.zeros(len(wide)) if queries else np.sqrt(np.maximum(0.0, self.norm2 - (wide * wide).sum(axis=1)))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        return np.column_stack([np.linalg.norm(lifted - p, axis=1) for p in self.points])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of two blocks."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


BLOCK = "block long, pivot int, low double, high double, n int, vec_ids binary, labels binary, keys binary, vecs binary"
_BLOCK = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("vec_ids", "labels", "keys", "vecs")]])


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most `most` neighbouring rows of one pivot, from a partition's sorted (pivot, key, vec_id, label, vec, part)."""
    waiting, made = None, 0

    def block(rows: pa.Table, made: int) -> pa.RecordBatch:
        keys = rows["key"].to_numpy()
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")  # ties go to the smaller vec_id
        vecs = np.array(rows["vec"].combine_chunks().flatten(), dtype=np.int64).reshape(len(rows), -1)[order]
        small = vecs.astype(np.int16) if np.abs(vecs).max(initial=0) < 1 << 15 else vecs
        packed = [x[order].tobytes() for x in (rows["vec_id"].to_numpy(), rows["label"].to_numpy(), keys)] + [small.tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, ((rows["part"][0].as_py() << 33) + made, rows["pivot"][0].as_py(), keys.min(), keys.max(), len(rows), *packed)))], _BLOCK)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        waiting = pa.concat_tables([waiting, rows]) if waiting is not None else rows
        while len(waiting):
            pivots = waiting["pivot"].to_numpy()
            other = np.flatnonzero(pivots[:most] != pivots[0])
            stop = int(other[0]) if len(other) else min(most, len(waiting))
            if stop == len(waiting) < most:
                break
            yield block(waiting.slice(0, stop), made)
            waiting, made = waiting.slice(stop), made + 1
    if waiting is not None and len(waiting):
        yield block(waiting, made)


QUERIES = "qblock long, spans array<struct<pivot int, low double, high double>>, vec_ids binary, labels binary, vecs binary, aways binary, highs binary, lows binary, was binary, radii binary, n int"
_BINARY = ("vec_ids", "labels", "vecs", "aways", "highs", "lows", "was", "radii")
_FOUND = pa.schema([("vec_id", pa.int64()), ("window", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])
_NEVER, _MOST = np.iinfo(np.int64).min, 1 << 62


def _query_blocks(batches: Iterator[pa.RecordBatch], margin: float, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most `most` queries, each with the key intervals of every pivot that this round must look at."""
    for whole in batches:
        for batch in (whole.slice(k, most) for k in range(0, len(whole), most)):
            col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            away = np.array(col["away"].flatten(), dtype=float).reshape(len(batch), -1)
            inner, was, radius = (col[c].to_numpy()[:, None] for c in ("inner", "was", "radius"))
            spans = []
            for first, last in ((np.maximum(away - radius, inner - away), away - was), (np.maximum(away + was, inner - away), away + radius)):  # below and above what was scanned
                low, high = np.where(first <= last, first, np.inf).min(axis=0) - 2 * margin, np.where(first <= last, last, -np.inf).max(axis=0) + 2 * margin
                spans += [{"pivot": p, "low": float(a), "high": float(b)} for p, (a, b) in enumerate(zip(low, high)) if a <= b]
            windows = col["windows"].to_pylist()
            width = max(map(len, windows))
            highs, lows = (np.array([[w[side] for w in row] + [empty] * (width - len(row)) for row in windows], dtype=np.int64) for side, empty in (("high", _NEVER), ("low", 0)))
            packed = [x.tobytes() for x in (col["vec_id"].to_numpy(), col["label"].to_numpy(), _matrix(col["vec"]), away, highs, lows, was, radius)]
            yield pa.RecordBatch.from_pylist([{"qblock": col["vec_id"][0].as_py(), "spans": spans, **dict(zip(_BINARY, packed)), "n": len(batch)}], _QUERIES)


_QUERIES = pa.schema([
    ("qblock", pa.int64()), ("spans", pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))), *[(c, pa.binary()) for c in _BINARY], ("n", pa.int32()),
])


def _scan(pair: dict, k: int, same: bool, margin: float) -> pa.RecordBatch:
    """The best k rows of a block in each window of each query of a block of queries, within this round's key intervals."""
    n, q = pair["n"], pair["queries"]
    ids, labels, keys = (np.frombuffer(pair[c], dtype=t) for c, t in (("row_ids", np.int64), ("row_labels", np.int64), ("keys", float)))
    held = {c: np.frombuffer(pair[c], dtype=float if c in ("aways", "was", "radii") else np.int64).reshape(q, -1) for c in _BINARY}
    dim = held["vecs"].shape[1]
    rows = np.frombuffer(pair["row_vecs"], dtype=np.int16 if len(pair["row_vecs"]) == 2 * n * dim else np.int64).reshape(n, dim)
    gap = np.abs(keys[None, :] - held["aways"][:, pair["pivot"]][:, None])
    may = (gap <= held["radii"] + margin) & (gap > held["was"] + margin)  # the last round's bound, term by term
    may &= (labels[None, :] == held["labels"]) == same
    may &= ids[None, :] != held["vec_ids"]
    some = np.flatnonzero(may.any(axis=1))
    scores, may = _scores(held["vecs"][some], rows), may[some]
    parts = []
    for window in range(held["highs"].shape[1]):
        fits = may & (scores <= held["highs"][some, window][:, None]) & (scores >= held["lows"][some, window][:, None])
        if np.abs(scores).max(initial=0) < 1 << 48:  # score and place in one number; rows stand by vec_id
            both = np.where(fits, scores * n + np.arange(n - 1, -1, -1), _NEVER)
            top = np.partition(both, n - k, axis=1)[:, -k:] if n > k else both
            query, place = np.nonzero(top != _NEVER)
            row = n - 1 - top[query, place] % n
        else:
            best = [np.flatnonzero(f)[np.lexsort((np.flatnonzero(f), -s[f]))][:k] for f, s in zip(fits, scores)]
            query, row = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate([*best, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        parts.append((held["vec_ids"][some, 0][query], np.full(len(query), window), ids[row], scores[query, row]))
    columns = [np.concatenate(x) for x in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _ranged(rows: DataFrame, most: int = 16_384) -> DataFrame:
    """Settled rows in the order of their keys, in partitions of some `most` rows, so that blocks are full."""
    order = ("pivot", "key", "vec_id")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).coalesce(max(1, -(-rows.count() // most)))


class Index:
    """Rows stored in blocks sorted by (pivot, distance)."""

    def __init__(self, rows: DataFrame, pivots: int = 32, sample: int = 2_048, block_rows: int = 4_096):
        """`rows` as of integer_rows, settled. Pivots are chosen in a sample of at most `sample` distinct vectors, by hash."""
        norm2 = rows.agg(F.max(F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()[0] or 0
        some = rows.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(sample).collect()
        self.pivots = Pivots(np.array([r.vec for r in some], dtype=np.int64), float(norm2), pivots)
        keyed = self._keyed(rows.select("vec_id", "label", "vec")).drop("away")
        ranged = _ranged(settled(keyed)).withColumn("part", F.spark_partition_id().cast("long"))
        self.blocks = settled(ranged.mapInArrow(lambda batches: _packed(batches, block_rows), BLOCK))
        ends = self.blocks.agg(F.min("low"), F.max("high")).first()
        self.low, self.high = (float(x or 0) for x in ends)
        #: the distance axis in 64 cells: key intervals and blocks meet in cells
        self.cell = max((self.high - self.low) / 64, self.pivots.margin)

    def _keyed(self, rows: DataFrame, queries: bool = False) -> DataFrame:
        """`rows` with away, its distances to all pivots, and pivot and key, the nearest one and its distance."""
        found, place = self.pivots, rows.columns.index("vec")

        def keyed(batches):
            for batch in batches:
                if len(batch):
                    away = found.distances(found.lifted(_matrix(batch.column(place)), queries))
                    near = away.argmin(axis=1)
                    named = {"pivot": pa.array(near, pa.int32()), "key": pa.array(away[np.arange(len(near)), near]), "away": pa.array(list(away), pa.list_(pa.float64()))}
                    yield pa.RecordBatch.from_arrays([*batch.columns, *named.values()], names=[*batch.schema.names, *named])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(keyed, f"{kinds}, pivot int, key double, away array<double>")

    def search(self, queries: DataFrame, k: int, same: bool, query_rows: int = 256) -> DataFrame:
        """(vec_id, window, other_id, score, rank): a query's best k rows in each of its windows of scores.

        `queries` (vec_id, label, vec, windows array<struct<high long, low long>>): a window's rows have scores from low to
        high, rows of the query's label if `same`, else of other labels; the query itself is never among them. Higher
        scores come first, then smaller ids. A query without windows gives no rows.
        """
        norm2, margin = self.pivots.norm2, self.pivots.margin
        own = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x).cast("double")
        # the distance at which a score lies, and the one within which all rows lie
        away_of = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("own") + norm2 - 2 * score.cast("double")))
        asked = settled(self._keyed(queries.where(F.size("windows") > 0), queries=True).withColumn("own", own).withColumn("inner", away_of(F.array_max("windows.high"))).withColumn("every", F.sqrt("own") + norm2**0.5 + margin))
        state = asked.select("vec_id", F.lit(-4 * margin).alias("was"))
        best, share = None, 0.25
        while True:
            held = best.groupBy("vec_id", "window").agg(F.when(F.count("*") >= k, F.min("score")).alias("last")) if best is not None else None
            spans = asked.select("vec_id", "own", "inner", "every", F.posexplode("windows").alias("window", "w")).where("w.low <= w.high")
            spans = spans.join(held, ["vec_id", "window"], "left") if held is not None else spans.withColumn("last", F.lit(None).cast("long"))
            need = spans.groupBy("vec_id").agg(F.max(F.least("every", away_of(F.coalesce("last", "w.low")))).alias("need"))
            # need certifies a query; the radius grows towards it from the inner bound
            left = asked.join(state, "vec_id").join(need, "vec_id").where("need > was")
            left = left.withColumn("radius", F.least("need", F.greatest("was", F.col("inner") + share * (F.col("every") - F.col("inner")))))
            live = settled(left.select("vec_id", "label", "vec", "windows", "away", "inner", "was", "radius", "pivot", "key"))
            if live.isEmpty():
                break
            found = self._round(live, k, same, query_rows)
            every = found if best is None else best.drop("rank").unionByName(found)
            place = F.row_number().over(Window.partitionBy("vec_id", "window").orderBy(F.desc("score"), "other_id"))
            best = settled(every.withColumn("rank", place).where(F.col("rank") <= k))
            state, share = live.select("vec_id", F.col("radius").alias("was")), 2 * share
        return best if best is not None else asked.sparkSession.createDataFrame([], "vec_id long, window int, other_id long, score long, rank int")

    def _pairs(self, blocks: DataFrame) -> DataFrame:
        """(qblock, block) of the blocks of queries and of rows that some key interval of this round brings together."""
        cells = lambda low, high: F.sequence(F.floor(low / self.cell), F.floor(high / self.cell))
        spans = blocks.select("qblock", F.inline("spans")).where((F.col("low") <= self.high) & (F.col("high") >= self.low))
        spans = spans.withColumns({"low": F.greatest("low", F.lit(self.low)), "high": F.least("high", F.lit(self.high))})
        spans = spans.withColumn("cell", F.explode(cells(F.col("low"), F.col("high"))))
        stored = self.blocks.select("block", "pivot", F.col("low").alias("first"), F.col("high").alias("last")).withColumn("cell", F.explode(cells(F.col("first"), F.col("last"))))
        # a span and a block that share several cells meet in the first of them
        meet = F.col("cell") == F.floor(F.greatest("low", "first") / self.cell)
        return spans.join(stored, ["pivot", "cell"]).where(meet & (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low"))).select("qblock", "block").distinct()

    def _round(self, live: DataFrame, k: int, same: bool, query_rows: int) -> DataFrame:
        """What the key intervals of this round hold: the best k rows of each block for each query and window."""
        margin = self.pivots.margin
        blocks = settled(_ranged(live).mapInArrow(lambda batches: _query_blocks(batches, margin, query_rows), QUERIES))
        pairs = self._pairs(blocks)
        rows = self.blocks.select("block", "pivot", "n", "keys", *[F.col(c).alias(f"row_{c.removeprefix('vec_')}" if c != "vecs" else "row_vecs") for c in ("vec_ids", "labels", "vecs")])
        met = pairs.join(blocks.drop("spans").withColumnRenamed("n", "queries"), "qblock").join(rows, "block")

        def scanned(batches):
            for batch in batches:
                for k_pair in range(len(batch)):
                    yield _scan(batch.slice(k_pair, 1).to_pylist()[0], k, same, margin)

        return met.mapInArrow(scanned, "vec_id long, window int, other_id long, score long")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, floor_pct: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first other rows of the same label, by falling integer inner product and then rising
    vec_id; for each, the negatives are the first rows of other labels with floor_pct % to 100 % of the positive's score.
    Anchors and positives without such rows give none. `rows` has (vec_id, embedding, label); `is_anchor` is a condition on
    vec_id. Rows as in integer_rows take part, those without an id don't; of rows that share an id the one with the least
    (label, vector) stands for all, so repeats count once. An empty table gives no rows. Other columns are not read.
    """
    whole = integer_rows(rows).where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("v")).select("vec_id", "v.label", "v.vec")
    data = settled(whole)
    index, anchors = Index(data), settled(data.where(is_anchor))
    anywhere = F.array(F.struct(F.lit(_MOST).alias("high"), F.lit(-_MOST).alias("low")))
    near = index.search(anchors.withColumn("windows", anywhere), positives, same=True)
    least = F.expr(f"score div 100 * {floor_pct} + ({floor_pct} * (score % 100) + 99) div 100")
    window = F.struct("rank", F.struct(F.col("score").alias("high"), least.alias("low")).alias("w"))
    windows = near.where("score >= 0").groupBy("vec_id").agg(F.sort_array(F.collect_list(window))["w"].alias("windows"))  # below 0 the bounds leave nothing between them
    far = index.search(anchors.join(windows, "vec_id"), negatives, same=False)
    named = near.select("vec_id", (F.col("rank") - 1).alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["vec_id", "window"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
