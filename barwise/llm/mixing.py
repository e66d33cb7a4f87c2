"""Mixing sources to target weights.

Every document has a hash-random key. Rows are range-sorted by (source, key), prefix sums of their word counts
run over the sorted partitions, and each source is cut at its exact budget: whole epochs first, then the
documents whose words end before what is left of the budget, then a part of the one that crosses it.

Only (doc_id, source, size, key) rows are sorted. A source's cut is one row (epochs, the key at which it is cut, the
words left for that key), so texts are cut where they lie. A hot source is as many sorted partitions as its rows fill.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import light, settled

WORD = "[^ \t-\r]+"
ORDER = ("key", "doc_id", "text_xx")


def words(text: str | Column) -> Column:
    """How many words a text has; a null text has none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.length(F.regexp_replace(text, WORD, "w")) - F.length(F.regexp_replace(text, WORD, ""))).cast("long")


def _keyed(docs: DataFrame) -> list[Column]:
    doc_id = F.col("doc_id").cast("long")
    key = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 16)
    return [doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), key.alias("key"), F.xxhash64("text").alias("text_xx")]


def prefix_sums(rows: DataFrame, within: Sequence[str], order: Sequence[str | Column], values: dict[str, Column]) -> DataFrame:
    """`rows` with, under each name in `values`, the sum of its column over the rows of the group that come before.

    Rows are range-partitioned by group and order. A partition's rows are summed among themselves, and what came before
    it is summed over one row for each group and partition, so a hot group is spread over many tasks.
    """
    parted = settled(rows.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy(*within, "_part").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    offsets = totals.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in values])
    inside = Window.partitionBy(*within, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_at")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    summed = parted.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()}).join(light(settled(offsets)), same)
    return summed.select(*rows.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in values])


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null standing last.

    Sources by code point weigh `weights`, repeating, and share the sum of all sizes. No target is above `epochs` times
    its source's size; what is above is shared again by weight among the others until none is. Those at their limit
    are the first ones by limit over weight, so one pass of prefix sums in that order finds the last share.
    """
    weigh = F.array(*[F.lit(w) for w in weights])[(F.col("rank") % len(weights)).cast("int")].cast("long")
    named = prefix_sums(sizes, [], [F.asc_nulls_last("source")], {"rank": F.lit(1)})
    # exact: limit over weight times a common multiple of the weights
    level = F.col("source_size") * F.element_at(F.create_map(*[F.lit(x) for w in set(weights) for x in (w, math.lcm(*weights) // w)]), F.col("weight").cast("int"))
    leveled = settled(named.withColumn("weight", weigh).withColumn("level", level))
    wide = F.col("source_size").cast("decimal(38,0)")
    before = prefix_sums(leveled, [], ["level", F.asc_nulls_last("source")], {"limits": epochs * wide, "weighed": F.col("weight")})
    whole = leveled.agg(F.sum(wide).alias("everything"), F.sum("weight").alias("weight_sum"))
    left, weight_left = F.col("everything") - F.col("limits"), F.col("weight_sum") - F.col("weighed")
    free = before.join(F.broadcast(whole)).where(epochs * wide * weight_left >= left * F.col("weight"))
    share = free.agg(F.min(F.struct("level", F.col("source").isNull(), "source", left.cast("double").alias("left"), weight_left.alias("weight_left"))).alias("first")).select("first.left", "first.weight_left")
    target = F.least((epochs * F.col("source_size")).cast("double"), F.col("left") * F.col("weight") / F.col("weight_left"))
    return settled(leveled.join(F.broadcast(share)).select("source", "source_size", target.alias("target")))


def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(doc_id, source, size, key, text_xx, source_size, target, taken) for every row of `docs`.

    size counts words, target is the source's share of all words, taken the words of this row in the mix, repeats
    counted: a source's taken words add up to its target, rounded. Null and empty texts have no words and take none;
    a null source is a source. Repeated rows each take their part, in any order among themselves; rows of a null
    doc_id share a key and follow each other by their texts. An empty table gives no rows. Other columns are not read.
    """
    rows = settled(docs.select(*_keyed(docs)))
    targets = source_targets(settled(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, epochs)
    placed = prefix_sums(rows, ["source"], ORDER, {"before": F.col("size")})
    per_source = light(targets.withColumnRenamed("source", "of"))
    budget, size = F.floor(F.col("target") + 0.5), F.col("source_size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget % size - F.col("before")))
    taken = F.when(size > 0, F.floor(budget / size) * F.col("size") + rest).otherwise(0).cast("long")
    return placed.join(per_source, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "key", "text_xx", "source_size", "target", taken.alias("taken"))


def mixed_texts(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """The mix itself: `docs` with a row for each epoch of a document, and columns mix_epoch (from 0) and mix_text.

    mix_text is the whole text, but in its source's last epoch for the document at the cut, of which it is the first words
    up to the budget, joined by blanks. Documents beyond the cut and those without words give no row for that epoch. Texts are
    not shuffled: a row learns from its source's cut how often it is taken. Only rows that stand exactly at a cut, each
    other's repeats, are numbered in one group a cut.
    """
    plan = mixture(docs, weights, epochs)
    laps = F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size")).cast("int")
    placed = settled(plan.where("source_size > 0").select(F.col("source").alias("_of"), F.struct(*ORDER).alias("_at"), laps.alias("_laps"), (F.col("taken") - laps * F.col("size")).alias("_part")))
    # a source's cut: the last place with words in the partial epoch, and the words taken there by it and its repeats
    cuts = placed.groupBy("_of").agg(F.first("_laps").alias("_laps"), F.max(F.when(F.col("_part") > 0, F.col("_at"))).alias("_cut"))
    left = placed.join(light(settled(cuts.select(F.col("_of").alias("_from"), "_cut"))), F.col("_of").eqNullSafe(F.col("_from")) & (F.col("_at") == F.col("_cut"))).groupBy("_from").agg(F.sum("_part").alias("_left"))
    cuts = light(settled(cuts.join(left, F.col("_of").eqNullSafe(F.col("_from")), "left").drop("_from")))
    met = docs.withColumn("_key", F.struct(*_keyed(docs))).join(cuts, F.col("_key.source").eqNullSafe(F.col("_of"))).withColumn("_at", F.struct(*[F.col(f"_key.{c}").alias(c) for c in ORDER]))
    size, at_cut = F.col("_key.size"), F.coalesce(F.col("_at") == F.col("_cut"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("_of").orderBy("_at")) - 1
    exact = met.where(at_cut).withColumn("_rest", F.greatest(F.lit(0), F.least(size, F.col("_left") - nth * size)))
    others = met.where(~at_cut).withColumn("_rest", F.when(F.col("_at") < F.col("_cut"), size).otherwise(0))
    every = others.unionByName(exact).where(size > 0).withColumn("_times", F.col("_laps") + F.when(F.col("_rest") > 0, 1).otherwise(0)).where("_times > 0")
    rows = every.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.col("_rest")).cast("int")), " ")
    text = F.when((F.col("mix_epoch") == F.col("_laps")) & (F.col("_rest") < size), cut).otherwise(F.col("text"))
    return rows.select(*docs.columns, "mix_epoch", text.alias("mix_text"))
