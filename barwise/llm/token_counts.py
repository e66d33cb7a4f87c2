"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. Everything asked of the lengths afterwards (totals,
quantiles, how much is left after truncating to a context limit) needs only that histogram and its
suffix sums, whose size is bounded by the longest document and not by the number of documents.
"""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import vocabulary_path


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("lengths", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for whole texts under a byte-level BPE; a null or empty text has 0 tokens.

    Duplicate rows stay duplicate rows; other columns are ignored.
    """
    path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def lengths(batches):
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(text.as_py())) if text.is_valid else 0 for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lengths, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. An empty table gives no rows.

    Each task sends one row per length that it met, so neither long nor repeated documents make a hot key.
    """
    path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def counted(batches):
        encode, seen = _encoding(path).encode_ordinary, Counter()
        for batch in batches:
            seen.update(len(encode(text.as_py())) if text.is_valid else 0 for text in batch.column(0))
        yield pa.record_batch([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(counted, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length L: documents and tokens at L or longer, tokens left when every
    document is cut to L, and the share of documents not longer than L.

    The window has one row per distinct length, at most the longest document's length.
    """
    longer = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return histogram.select(
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(longer).alias("docs_at_least"),
        F.sum(tokens).over(longer).alias("tokens_at_least"),
        (F.sum(tokens).over(everything) - F.sum(tokens).over(longer) + F.col("n_tokens") * F.sum("n_docs").over(longer)).alias("tokens_truncated"),
        (1 - (F.sum("n_docs").over(longer) - F.col("n_docs")) / F.sum("n_docs").over(everything)).alias("docs_share_up_to"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, tokens_kept, docs_cut) for any limits, from the suffix sums alone."""
    kept = [F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("n_docs")).otherwise(limit * F.col("n_docs"))) for limit in limits]
    cut = [F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)) for limit in limits]
    rows = [F.struct(F.lit(limit).cast("long").alias("context_limit"), F.coalesce(k, F.lit(0)).cast("long").alias("tokens_kept"), F.coalesce(c, F.lit(0)).cast("long").alias("docs_cut")) for limit, k, c in zip(limits, kept, cut)]
    return sums.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least `share` of the documents do not exceed."""
    picks = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("docs_share_up_to") >= s - 1e-12, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return sums.agg(F.array(*picks).alias("rows")).select(F.inline("rows"))
