"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

Leaves are blocks of up to `BLOCK` code points of one paragraph, a paragraph is a line, a section is
`SECTION` paragraphs. Each level hashes the hashes below it. The fingerprint writes the levels one after
the other, `root|sections|paragraphs|blocks`, so that equal roots show equal texts and differing
branches show where two versions differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SECTION = 64, 8


def _printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.right(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(8))), " ")


def _tree(text: Column) -> Column:
    """Block hashes by paragraph."""
    blocks = "(?s).{1,%d}" % BLOCK
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(blocks), F.lit(0)), lambda b: F.xxhash64(b)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of column `text` (null: empty) as column `name`."""
    part = {k: f"_{name}_{k}" for k in ("tree", "paragraphs", "sections")}
    starts = F.sequence(F.lit(0), F.floor((F.size(part["paragraphs"]) - 1) / SECTION).cast("int"))
    sections = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(part["paragraphs"]), i * SECTION + 1, SECTION)))
    return (
        df.withColumn(part["tree"], _tree(F.coalesce(text, F.lit(""))))
        .withColumn(part["paragraphs"], F.transform(part["tree"], lambda p: F.xxhash64(p)))
        .withColumn(part["sections"], sections)
        .withColumn(
            name,
            F.concat_ws(
                "|",
                F.lpad(F.lower(F.hex(F.xxhash64(part["sections"]))), 16, "0"),
                _printed(F.col(part["sections"])),
                _printed(F.col(part["paragraphs"])),
                _printed(F.flatten(part["tree"])),
            ),
        )
        .drop(*part.values())
    )


def _level(fingerprint: Column, k: int) -> Column:
    return F.split(F.split_part(fingerprint, F.lit("|"), F.lit(k)), " ")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else twice the common distinct blocks over the sum of both fingerprints' distinct blocks.

    A text without blocks is like no text with blocks (0). Null fingerprints give null.
    """
    x, y = (F.array_remove(F.array_distinct(_level(f, 4)), "") for f in (a, b))
    dice = 2 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.split_part(a, F.lit("|"), F.lit(1)) == F.split_part(b, F.lit("|"), F.lit(1)), 1.0).otherwise(dice).cast("double")


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers, from 0, of paragraphs of `a` that differ from the paragraph of that number in `b`.

    Only paragraphs of sections whose hashes differ are compared.
    """
    pa, pb, sa, sb = _level(a, 3), _level(b, 3), _level(a, 2), _level(b, 2)
    section = lambda i: F.floor(i / SECTION).cast("int")
    numbers = F.sequence(F.lit(0), F.size(pa) - 1)
    same_section = lambda i: F.get(sa, section(i)).eqNullSafe(F.get(sb, section(i)))
    return F.filter(numbers, lambda i: ~same_section(i) & ~F.get(pa, i).eqNullSafe(F.get(pb, i)))


def _bucket(doc_id: Column, bounds: list[float]) -> Column:
    """How many bounds are not above the id, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::step]
    fine = [bounds[k * step : (k + 1) * step] for k in range(len(coarse))]
    array = lambda xs: F.array(*map(F.lit, xs))
    c = F.size(F.filter(array(coarse), lambda x: x <= doc_id))
    inner = F.size(F.filter(F.get(F.array(*map(array, fine)), c - 1), lambda x: x <= doc_id))
    return F.when(c == 0, 0).otherwise((c - 1) * step + inner).cast("int")


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = 2000, most_buckets: int = 65_536) -> DataFrame:
    """Adds next_<column>: the values of the next row by ascending doc_id (after the last row: of the first).

    Rows of one doc_id follow each other by their `columns`; rows of a null doc_id come before all others, and the
    last row is followed by the first one with an id. Rows are dealt into buckets of neighbouring ids at
    approximate quantiles, each bucket is ordered by itself, and a copy of the next bucket's first row stands
    behind its last one. So rows with whole texts are shuffled once and no task orders them all.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    buckets = min(most_buckets, max(64, n // rows_per_bucket))
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(ids.approxQuantile("doc_id", shares, 0.25 / buckets))) if n else []
    bucket = lambda df: df.withColumn("_bucket", _bucket(F.col("doc_id").cast("double"), bounds))
    rows = bucket(docs)

    small = Window.orderBy("_bucket")  # one row per bucket
    firsts = bucket(ids).groupBy("_bucket").agg(F.min("doc_id").alias("_first"))
    firsts = firsts.select("_first", F.coalesce(F.lag("_bucket").over(small), F.max("_bucket").over(small.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    copies = docs.join(F.broadcast(firsts), docs["doc_id"] == F.col("_first")).groupBy("_before", "doc_id").agg(F.min(F.struct(*columns)).alias("_row"))
    copies = copies.select(F.col("_before").alias("_bucket"), F.lit(1).alias("_copy"), "doc_id", *[F.col(f"_row.{c}").alias(c) for c in columns])

    follows = Window.partitionBy("_bucket").orderBy("_copy", "doc_id", *columns)
    both = rows.withColumn("_copy", F.lit(0)).unionByName(copies, allowMissingColumns=True)
    return both.select("*", *[F.lead(c).over(follows).alias(f"next_{c}") for c in columns]).where("_copy = 0").drop("_bucket", "_copy")


def fingerprints_of_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the
    next document. A null text counts as empty; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(texts, ["text"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    out = pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        out = with_fingerprint(out, text, name)
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
