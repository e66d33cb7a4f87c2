"""Streams over files that end when all files are read, with what they wrote as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barwise.operators.settle import settled, shared_folder
from barwise.streaming.bars import latest, stream_bars
from barwise.streaming.levels import stream_leaky_extrema

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def large_state(spark: SparkSession):
    """State in RocksDB, on each executor's disk and in the checkpoint, as keyed state of any size needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def files(spark: SparkSession, path: str, schema: StructType, a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files in the folder `path`, oldest first, or of the one file that is there."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", a_batch) if a_batch else reader
    folder, _, name = path.rstrip("/").rpartition("/")
    one = spark.read.schema(schema).parquet(path).select("_metadata.file_path").first()
    if one is not None and one.file_path.endswith(f"/{name}"):  # streams read folders
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs the stream until its files are read and returns what it wrote, with the number of the batch.

    A batch's rows replace what an earlier attempt at the same batch has written, and a stream begun again in `folder`
    goes on from its checkpoint, so a lost driver or executor costs only the batch at work.
    """
    spark = stream.sparkSession
    keep: Callable[[DataFrame, int], None] = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    fields = StructType(list(stream.schema.fields)).add("batch", "long")
    try:
        return spark.read.schema(fields).parquet(f"{folder}/rows")
    except Exception as error:  # no file was there to read
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], fields)
        raise


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def hour_bars(spark: SparkSession, sf_dir: str, late: str = "400 days", a_batch: int | None = None) -> DataFrame:
    """Hourly bars of the events by type, priced at one plus the value. Files may come in any order within `late`."""
    path = f"{sf_dir}/events.parquet"
    ticks = files(spark, path, spark.read.parquet(path).schema, a_batch)
    bars = stream_bars(ticks, F.col("event_type"), 1 + F.col("value"), "1 hour", late, ("ts", "event_id"))
    return latest(drained(bars, new_folder(spark), "update"))


def leaky_levels(signal: DataFrame, settings: list[tuple[float, float]], zeta: float = 1.0, span: str = "week", a_batch: int = 4) -> DataFrame:
    """The leaky levels of signal rows, which are written span by span, in order of time, and streamed."""
    spark = signal.sparkSession
    folder = new_folder(spark)
    rows = settled(signal.select("asset", F.col("ts").cast("timestamp").alias("ts"), "log_close", "Z").withColumn("span", F.date_trunc(span, "ts")))
    for (at,) in rows.select("span").distinct().orderBy("span").collect():  # as a feed would: later files hold later rows
        rows.where(F.col("span") == F.lit(at)).drop("span").repartition("asset").write.mode("append").parquet(f"{folder}/signal")
    with large_state(spark):
        stream = stream_leaky_extrema(files(spark, f"{folder}/signal", rows.drop("span").schema, a_batch), settings, zeta)
        return drained(stream, folder, "append").withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("batch")
