"""Near-duplicate texts: those whose SimHash fingerprints differ in few bits, and those whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more.

Fingerprints and their links are those of `simhash`, with all pairs within its radius. Texts at similarity 0.8 differ in
some 10 of 64 bits, far beyond any radius that covering tables can serve, so links on the sets come beside them.
Candidates share one of `BANDS` bands of `ROWS` minimum hashes, and each is checked on the sets themselves. A
pair at similarity s is no candidate with probability (1 - s^ROWS)^BANDS: 3.0e-6 at 0.8, less above.

Only distinct sets enter the bands. A bucket of at most `small` sets gives all its pairs; a larger one first gives
pairs with one of its members only. Where those leave it in several components, its sets come together in one
task, which compares every set outside the largest component with all others, by an index of their shingles. So
no link is lost, and no square of a large bucket's size is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import light, only, settled, settled_table, slices
from barwise.llm.components import components
from barwise.llm.simhash import fingerprint, near_links

SHINGLE, BANDS, ROWS, SEED = 5, 32, 5, 7
_RNG = np.random.default_rng(SEED)
_FACTORS, _SHIFTS = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) for _ in range(2))
_FACTORS |= np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's five-word shingles; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more: 9 times what they share is 4 times their sizes or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of a set's minimum hashes, other keys in each band."""
    if not len(shingles):
        return np.zeros(0, dtype=np.uint64)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(short), 8192):
        np.minimum(least, (short[a : a + 8192, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    return keys * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)


def _signed(docs: DataFrame, simhash: bool) -> DataFrame:
    """(near_doc, near_row, near_size, near_set, near_bands, near_fp): each row, its number, its set's size, 128-bit digest and band keys, and its fingerprint."""
    from xxhash import xxh3_128_digest

    @F.arrow_udf("near_size long, near_set binary, near_bands array<long>, near_fp long")
    def signed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            sizes, digests, keys, fps = [], [], [np.zeros(0, dtype=np.int64)], []
            for part in slices(pa.record_batch([whole], names=["text"]), 0, 2_000_000):
                for text in part.column(0).to_pylist():
                    shingles = shingle_set(text)
                    sizes.append(len(shingles))
                    digests.append(xxh3_128_digest(shingles.tobytes()))
                    keys.append(band_keys(shingles).view(np.int64))
                    fps.append(fingerprint(text) if simhash else 0)
            ends = np.cumsum([len(k) for k in keys]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["near_size", "near_set", "near_bands", "near_fp"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("near_doc"), F.monotonically_increasing_id().alias("near_row"))
    return settled_table(rows.withColumn("near", signed(F.col("near_doc.text").cast("binary"))).select("near_doc", "near_row", "near.*"))


def _buckets(batches, *names: str):
    """Per bucket of rows sorted by it: the bucket and its other columns as lists."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(len(names) + 1)))

    for bucket, members in groupby(rows(), lambda r: r[0]):
        yield bucket, [list(c) for c in zip(*members)][1:]


def _pairs(small: int):
    """Reads (bucket, node, size) sorted by bucket and size; writes (a, b, null) and, for larger buckets, (node, null, bucket)."""

    def run(batches):
        a, b, large = [], [], []

        def written():
            left, right, kept = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (a, b, [y for y, _ in large]))
            bucket = np.concatenate([np.zeros(0, dtype=np.int64), *(np.full(len(y), k) for y, k in large)])
            n, m = len(left), len(kept)
            columns = [
                pa.array(np.concatenate([left, kept])),
                pa.concat_arrays([pa.array(right), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(bucket)]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "bucket"])

        held = 0
        for bucket, (node, size) in _buckets(batches, "node", "size"):
            n = len(node)
            if n == 1:
                continue
            node, size = np.array(node), np.array(size)
            if n <= small:
                one, two = np.triu_indices(n, 1)
            else:
                one, two = np.full(n - 1, n // 2), np.delete(np.arange(n), n // 2)
                large.append((node, bucket))
            fits = 5 * np.minimum(size[one], size[two]) >= 4 * np.maximum(size[one], size[two])
            one, two = node[one[fits]], node[two[fits]]
            a.append(np.minimum(one, two))
            b.append(np.maximum(one, two))
            held += len(one) + n
            if held > 100_000:
                yield written()
                a, b, large, held = [], [], [], 0
        yield written()

    return run


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the rows numbered in `nodes`."""

    def made(batches):
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                yield pa.record_batch([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    texts = rows.select(F.col("near_row").alias("node"), F.col("near_doc.text").cast("binary").alias("text")).join(light(nodes), "node", "left_semi")
    return texts.mapInArrow(made, "node long, shingles binary")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose sets are similar."""

    def kept(batches):
        for batch in (part for whole in batches for part in slices(whole, 2, 4_000_000)):
            sides = [[np.frombuffer(x, dtype=np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            yield batch.filter(pa.array([similar(x, y) for x, y in zip(*sides)], pa.bool_())).select(["a", "b"])

    left = pairs.join(sets.toDF("a", "left"), "a")
    both = left.join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")
    return both.mapInArrow(kept, "a long, b long")


def bucket_links(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of one bucket that join its components exactly as all its similar pairs would."""
    names, where, sizes = np.unique(component, return_inverse=True, return_counts=True)
    parent = np.arange(len(names))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    posted, cuts = owner[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    starts = np.cumsum(n) - n
    links = []
    for x in np.flatnonzero(where != sizes.argmax()):
        own = shingle[starts[x] : starts[x] + n[x]]
        shared = np.bincount(np.concatenate([posted[cuts[s] : cuts[s + 1]] for s in own]), minlength=len(sets))
        near = np.flatnonzero(9 * shared >= 4 * (n[x] + n))
        for c, first in zip(*np.unique(where[near], return_index=True)):
            p, q = find(where[x]), find(c)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((int(node[x]), int(node[near[first]])))
    return links


def _bucket_linked(batches):
    for _, (node, component, sets) in _buckets(batches, "node", "component", "shingles"):
        links = bucket_links(np.array(node), np.array(component), [np.frombuffer(s, dtype=np.uint64) for s in sets])
        yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def _similar_links(rows: DataFrame, firsts: DataFrame, small: int) -> DataFrame:
    """(a, b) links between the distinct sets numbered in `firsts` whose chains join exactly the similar candidates."""
    entries = rows.join(firsts, F.col("near_row") == F.col("node"), "left_semi").select(F.explode("near_bands").alias("bucket"), F.col("near_row").alias("node"), F.col("near_size").alias("size"))
    sorted_entries = entries.repartition("bucket").sortWithinPartitions("bucket", "size", "node")
    found = settled(sorted_entries.mapInArrow(_pairs(small), "a long, b long, bucket long"))
    pairs = settled(found.where("b is not null").select("a", "b").distinct())
    large = found.where("b is null").select(F.col("a").alias("node"), "bucket")
    nodes = settled(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct())
    sets = settled(_sets(rows, nodes))
    links = settled(_checked(pairs, sets))
    if large.isEmpty():
        return links
    named = large.join(components(links), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_buckets = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    mixed = named.join(open_buckets, "bucket", "left_semi").join(sets, "node").select("bucket", "node", "component", "shingles")
    return links.union(settled(mixed.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_bucket_linked, "a long, b long"))).distinct()


def _first_row() -> Column:
    """The row to keep of a group: the smallest doc_id, ids before nulls, then the first row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("near_row").alias("row")))


def _fingerprint_links(signed: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b) links between the numbers in `firsts` of sets whose rows have fingerprints that SimHash links, or equal ones."""
    members = settled(signed.join(firsts, "near_set").select(F.col("near_fp").alias("fp"), "node"))
    heads = settled(members.groupBy("fp").agg(F.min("node").alias("head")))
    equal = members.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    left, right = heads.toDF("a", "left"), heads.toDF("b", "right")
    near = near_links(heads.select("fp")).join(left, "a").join(right, "b").select(F.col("left").alias("a"), F.col("right").alias("b"))
    return equal.union(near)


def keep_distinct(docs: DataFrame, small: int = 16, simhash: bool = False) -> DataFrame:
    """`docs` with exactly one row of each group chained by similar texts: that of the smallest doc_id. All columns stay.

    With `simhash`, fingerprints within its radius chain texts too. Texts without words are one group. Null and
    repeated ids are rows like any other.
    """
    rows = _signed(docs, simhash)
    signed = settled(rows.select("near_set", "near_fp", "near_row", "near_doc.doc_id").groupBy("near_set", "near_fp").agg(_first_row().alias("first")))
    firsts = settled(signed.groupBy("near_set").agg(F.min("first").alias("first")).select("near_set", "first", F.col("first.row").alias("node")))
    links = _similar_links(rows, firsts.select("node"), small)
    if simhash:
        links = links.union(_fingerprint_links(signed, firsts))
    named = firsts.join(components(links), "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    kept = settled(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("near_row")))
    return only(rows, kept, "near_row").select("near_doc.*")
