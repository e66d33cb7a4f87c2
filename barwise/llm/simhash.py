"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link at `RADIUS` or fewer differing bits. Each bit position i has a vector m(i) of RADIUS + 1
bits; for every non-zero vector v a table compares the positions with <m(i), v> = 1. The vectors of RADIUS
differing positions span less than the whole space, so some v is orthogonal to all of them and its table
puts the pair in one bucket: no pair within the radius is lost. Each of the 31 masks keeps 32 of 64 bits.

Only distinct fingerprints enter the tables, so copies make no hot bucket. A bucket gives links from its
members to one member of their cluster, not pairs. A bucket of over `most` fingerprints is dealt again by a
second family of masks, which pins some 48 bits and so bounds its parts whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import only, settled, settled_table, slices
from barwise.llm.components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def covering_masks(family: int = 0) -> list[int]:
    """The 31 masks of a family: every vector of 5 bits stands at two positions, shuffled by the family's number."""
    order = np.random.default_rng(family).permutation(64) if family else np.arange(64)
    vectors = order % (1 << (RADIUS + 1))
    return [sum(1 << i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, 1 << (RADIUS + 1))]


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text's word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # bytes.lower changes A-Z only, bytes.split parts at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=n).view(np.uint8).reshape(n, 8)
    if n < 64:
        ones = np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long. A null text has no words."""

    def hashed(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(hashed, "doc_id long, fp long")


def cluster_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from members of `fps` (distinct) to one member of their cluster, where near ones are chained."""
    left, members, roots = fps, [], []
    while len(left) > 1:
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= RADIUS
            if near.any():
                todo.extend(found := left[near])
                left = left[~near]
                members.append(found)
                roots.append(np.full(len(found), root))
    return (np.concatenate(members), np.concatenate(roots)) if members else (fps[:0], fps[:0])


def _linked(most: int | None):
    """Reads rows (bucket key columns..., fp) sorted by key; writes links (a, b), or (a, null) with its bucket if that is over `most`."""

    def run(batches):
        carry, over = None, None
        for batch in (*batches, None):
            if batch is None:
                if carry is None:
                    return
                columns, last = carry, True
            else:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                columns = columns if carry is None else [np.concatenate(x) for x in zip(carry, columns)]
                last = False
            *keys, fps = columns
            if not len(fps):
                continue
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts, stops = np.concatenate([[0], new]), np.concatenate([new, [len(fps)]])
            first = tuple(int(k[0]) for k in keys)
            final = tuple(int(k[-1]) for k in keys)
            links, rest = [], []
            if not last:
                if most is not None and (stops[-1] - starts[-1] > most or over == final):
                    carry, cut = None, len(starts)  # a bucket known to be too large is passed on as it comes
                else:
                    carry, cut = [c[starts[-1] :] for c in columns], len(starts) - 1
                starts, stops = starts[:cut], stops[:cut]
            sizes = stops - starts
            if most is not None:
                big = sizes > most
                if len(starts) and over == first:
                    big[0] = True
                rest = [np.arange(a, b) for a, b in zip(starts[big], stops[big])]
                over = final if carry is None and not last else over
                starts, stops, sizes = starts[~big], stops[~big], sizes[~big]
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS]
            links = [(fps[near + 1], fps[near])]
            links += [cluster_links(fps[a:b]) for a, b in zip(starts[sizes > 2], stops[sizes > 2])]
            rest = np.concatenate(rest) if rest else np.zeros(0, dtype=np.int64)
            a, b = (np.concatenate(x) for x in zip(*links))
            nothing = [pa.nulls(len(a), pa.int64()) for _ in keys]
            yield pa.record_batch([pa.array(a), pa.array(b), *nothing], names=["a", "b", *map(str, range(len(keys)))])
            yield pa.record_batch([pa.array(fps[rest]), pa.nulls(len(rest), pa.int64()), *[pa.array(k[rest].astype(np.int64)) for k in keys]], names=["a", "b", *map(str, range(len(keys)))])

    return run


def _tables(fps: DataFrame, family: int, *keys: str) -> DataFrame:
    """Each fingerprint once per mask: (keys..., mask number, masked bits, fp), a bucket's rows together and in order."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(family)]
    entries = F.array(*[F.struct(F.lit(n).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(masks)])
    rows = fps.select(*keys, "fp", F.inline(entries)).select(*keys, "mask", "bits", "fp")
    return rows.repartition(*keys, "mask", "bits").sortWithinPartitions(*keys, "mask", "bits")


def near_links(fps: DataFrame, most: int = 4096) -> DataFrame:
    """(a, b) links between distinct fingerprints whose chains join exactly those chained within the radius."""
    found = settled(_tables(fps, 0).mapInArrow(_linked(most), "a long, b long, mask long, bits long"))
    links = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select(F.xxhash64("mask", "bits").alias("bucket"), F.col("a").alias("fp"))
    if not large.isEmpty():
        again = _tables(large, 1, "bucket").mapInArrow(_linked(None), "a long, b long, bucket long, mask long, bits long")
        links = links.union(again.select("a", "b"))
    return links.distinct()


def _named(firsts: DataFrame, most: int, first: str, salts: int = 32) -> DataFrame:
    """(fp, least): the least `first` of each fingerprint's component, for rows (fp, first) of distinct fingerprints.

    Only fingerprints with links meet their component again, dealt by component and a salt, so that a large
    component is many tasks' work; the others are their own.
    """
    chained = settled(components(near_links(firsts.select("fp"), most)).select(F.col("node").alias("fp"), "component"))
    members = firsts.join(chained, "fp")
    least = members.groupBy("component").agg(F.min(first).alias("least"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    linked = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(spread, ["component", "salt"])
    alone = firsts.join(chained, "fp", "left_anti")
    return linked.select("fp", "least").union(alone.select("fp", F.col(first).alias("least")))


def near_duplicates(docs: DataFrame, most: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hex digits and the smallest doc_id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows of a null doc_id link too, but lend
    no id: a component of such rows alone has a null component_id. Repeated rows each give a row; an empty table
    gives none. Only columns doc_id and text are read.
    """
    hashed = settled(fingerprints(docs))
    firsts = settled(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    grouped = _named(firsts, most, "first")
    return hashed.join(grouped, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def deduplicate(docs: DataFrame, most: int = 4096) -> DataFrame:
    """`docs` with exactly one row of each group: that of the smallest doc_id, ids before nulls, then the first row.

    Repeated rows, and rows of repeated or null ids, are rows like any other. All columns stay. The table is
    written once with row numbers and read again.
    """
    rows = settled_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    hashed = settled(fingerprints(rows.select(F.col("row").alias("doc_id"), "doc.text")))
    ids = rows.select(F.col("row").alias("doc_id"), F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row")).alias("rank"))
    firsts = settled(hashed.join(ids, "doc_id").groupBy("fp").agg(F.min("rank").alias("first")))
    kept = _named(firsts, most, "first").select("least.row").distinct()
    return only(rows, settled(kept), "row").select("doc.*")


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
