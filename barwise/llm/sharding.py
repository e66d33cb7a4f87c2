"""Sharding by vector bin packing.

Every document has a size vector (bytes, tokens, rows), and documents with equal texts form a group. The
packing items are groups. A group goes, largest first, to the shard with room where the dot product of its
vector with the shard's residual capacity is highest, and stays whole. Only a group larger than a whole shard's equal part
of the bytes can't; it is dealt out by row in nearly equal pieces of at most `fill` of such a part each, which
leaves room to level them.

The packing runs on the driver over a bounded number of items at any input size: groups of at least one
`own`-th of the bytes (so `own` at most) are items of their own; the groups below that, each a negligible
part of a shard, share `bundles` hash bundles, whole groups in each. The law that holds is `bytes`: sizes near equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import settled


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, text_xx): size is the text's UTF-8 bytes plus 8, tokens its words.

    A null text has no bytes and no words and is in the group of the empty text.
    """
    text = F.coalesce("text", F.lit(""))
    raw = text.cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        (F.length(F.regexp_replace(text, "[^ \t-\r]+", "w")) - F.length(F.regexp_replace(text, "[^ \t-\r]+", ""))).cast("long").alias("tokens"),
        F.xxhash64(text).alias("text_xx"),
    )


def pack(vectors: np.ndarray, shards: int, slack: float = 0.003) -> np.ndarray:
    """The shard of each item. Items are placed by falling share of the bytes; ties go to the lowest shard.

    Of the shards with room for an item's bytes (an equal part and `slack` of it), it goes where the dot product
    with the residual capacity is highest; where none has room, to the one with most room.
    """
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    shard = np.zeros(len(vectors), dtype=np.int64)
    for item in np.lexsort((np.arange(len(vectors)), -share[:, 0])):
        room = residual[:, 0] + slack / shards >= share[item, 0]
        shard[item] = best = int(np.argmax(np.where(room, residual @ share[item], -np.inf) if room.any() else residual[:, 0]))
        residual[best] -= share[item]
    return shard


def assign_shards(docs: DataFrame, shards: int = 24, own: int = 49_152, bundles: int = 16_384, fill: float = 7 / 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    Slots count from 0 without gaps in each shard. grown_shard is null, as the law is `bytes`. Repeated rows and
    rows of a null doc_id each get a slot; an empty table gives an empty result. Only columns doc_id and text
    are read. Texts of any length are one row; one longer than a shard's part of the bytes makes its shard larger.
    """
    spark = docs.sparkSession
    # the settled rows' partitions are bounded by the scan's, so they also bound the tasks that number slots
    rows = settled(measured(docs)).withColumn("part", F.spark_partition_id())
    total = rows.agg(F.sum("size")).first()[0] or 0
    key = ["text_xx", "text_crc32"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    parts = F.col("bytes") * shards / F.lit(float(max(1, total)))
    pieces = F.when(parts <= 1, 1).otherwise(F.least(F.ceil(parts / fill), F.col("n"))).cast("int")
    large = settled(groups.where(F.col("bytes") * own >= total).select(*key, pieces.alias("pieces")))
    bundle = F.pmod("text_xx", F.lit(bundles))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces"))).otherwise(0)
    item = F.when(F.col("pieces").isNull(), F.struct(bundle.alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("c"))).otherwise(F.struct(F.col("text_xx").alias("a"), F.col("text_crc32").alias("b"), piece.cast("long").alias("c")))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    items_of = numbered.join(F.broadcast(large), key, "left").select("doc_id", "size", "text_crc32", "tokens", "part", item.alias("item"))
    vectors = items_of.groupBy("item").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("item").collect()
    shard = pack(np.array([v[1:] for v in vectors], dtype=float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(*v[0], int(s)) for v, s in zip(vectors, shard)], "a long, b long, c long, shard int")

    same = (F.col("item.a") == F.col("a")) & F.col("item.b").eqNullSafe(F.col("b")) & F.col("item.c").eqNullSafe(F.col("c"))
    dealt = items_of.join(F.broadcast(placed), same).select("doc_id", "size", "text_crc32", "part", "shard")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("rn", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rn") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
