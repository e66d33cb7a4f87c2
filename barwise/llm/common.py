"""What several operators of this subpackage share: reading, splitting off held-out rows, cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.operators.settle import settled, shared_folder

__all__ = ["Kept", "id_remainder", "light", "only", "rows_where", "settled", "settled_table", "slices", "table", "vocabulary_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`: the rule that fixes which rows are held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def settled_table(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file is installed; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def only(rows: DataFrame, kept: DataFrame, number: str, most: int = 1_000_000) -> DataFrame:
    """The rows of a written table whose `number` is in `kept`, both without repeats.

    Where at most `most` rows go, their numbers are broadcast and the rows stay where they are; where more go,
    rows and numbers are shuffled.
    """
    gone = settled(rows.select(number).join(kept, number, "left_anti"))
    if gone.count() <= most:
        return rows.join(F.broadcast(gone), number, "left_anti")
    return rows.join(kept, number, "left_semi")


def light(rows: DataFrame, most_bytes: int = 16_000_000) -> DataFrame:
    """Settled rows, marked for broadcast if they take at most `most_bytes`; otherwise left for Spark to shuffle."""
    width = F.lit(8 * len(rows.columns)) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind in ("string", "binary")), F.lit(0))
    return F.broadcast(rows) if (rows.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most_bytes else rows


class Kept(dict):
    """Values by text, kept while they take about `most_bytes`, and then all dropped.

    It belongs to a broadcast object: a worker's tasks of one stage share it, and it goes when the worker gets a
    task of another stage.
    """

    def __init__(self, most_bytes: int):
        self.most_bytes, self.used = most_bytes, 0

    def keep(self, key, value, n_bytes: int) -> None:
        self.used += n_bytes + 200
        if self.used > self.most_bytes:
            self.clear()
            self.used = n_bytes + 200
        self[key] = value


def rows_where(docs: DataFrame, judge: Callable[[], Callable[[list[str | None]], object]], most_bytes: int = 4_000_000) -> DataFrame:
    """The rows of `docs` of whose texts the judge says yes.

    `judge()` runs once in each task and gives a function from a list of texts to as many booleans. Only the
    texts go to Python, and only the booleans come back; the rows themselves stay where they are.
    """

    @F.arrow_udf("boolean")
    def kept(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged = judge()
        for whole in texts:
            parts = [pa.array(judged(part.column(0).to_pylist()), pa.bool_()) for part in slices(pa.record_batch([whole], names=["text"]), 0, most_bytes)]
            yield pa.concat_arrays(parts) if parts else pa.nulls(0, pa.bool_())

    return docs.where(kept("text"))


def slices(batch, column: int, most_bytes: int = 4_000_000):
    """Parts of an Arrow batch with at most `most_bytes` in a string or binary column, or one row if that is larger."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
