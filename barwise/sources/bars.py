"""Bars and irregular events from files, and the tables that the engine writes."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Accepted names of each column, compared without case.
ALIASES = {
    "ts": ("datetime", "timestamp", "date", "time", "open_time", "ts"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "adj_close", "price"),
    "volume": ("volume", "vol", "v"),
}
BAR_COLUMNS = ("asset", "ts", "open", "high", "low", "close", "volume")


def first_of_each(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which makes the choice among duplicates definite."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _named(df: DataFrame, with_asset: bool, required: tuple[str, ...]) -> DataFrame:
    there = {c.strip().lower(): c for c in df.columns}
    found = {name: next((there[a] for a in names if a in there), None) for name, names in ALIASES.items()}
    if missing := [name for name in required if found[name] is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*["asset"] * with_asset, "_row", *[(F.lit(None) if column is None else df[f"`{column}`"]).alias(name) for name, column in found.items()])


def placed(raw: DataFrame) -> DataFrame:
    """`raw` with each row's place in the input: file, offset of its block in the file, and place in the block."""
    block = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("row"))
    return raw.withColumn("_row", block)


def clean_bars(raw: DataFrame, asset: str | None = None, keep: str = "first", required: tuple[str, ...] = tuple(ALIASES)) -> DataFrame:
    """Typed bars, one per asset and time. Unreadable values are null; rows without time, close or volume go.

    Among bars of one time the first (or last) in input order stays: by file name, then by place in the file.
    Columns that are not `required` may be absent, and are null.
    """
    named = _named(raw if "_row" in raw.columns else placed(raw), "asset" in raw.columns and asset is None, required)
    typed = (named if asset is None else named.withColumn("asset", F.lit(asset))).select(
        "asset",
        F.expr("try_cast(ts as timestamp_ntz)").alias("ts"),
        *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume")],
        "_row",
    ).where("ts is not null")
    once = first_of_each(typed, ["asset", "ts"], F.asc("_row") if keep == "first" else F.desc("_row"))
    return once.where("close is not null and volume is not null").drop("_row")


def read_bars(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Bars of one asset from CSV files with a header."""
    return clean_bars(spark.read.option("header", True).csv(path), asset)


def clean_events(raw: DataFrame, asset: str | None = None) -> DataFrame:
    """(asset, funding_time, funding_interval_hours, last_funding_rate), one row an asset and time, the first in input order; the interval may be absent."""
    raw = raw if "_row" in raw.columns else placed(raw)
    there = {c.strip().lower(): c for c in raw.columns}
    if missing := {"datetime", "last_funding_rate"} - there.keys():
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    interval = F.expr(f"try_cast(`{there['funding_interval_hours']}` as int)") if "funding_interval_hours" in there else F.lit(None).cast("int")
    rows = raw.select(
        (F.col("asset") if asset is None and "asset" in raw.columns else F.lit(asset)).alias("asset"),
        F.expr(f"try_cast(`{there['datetime']}` as timestamp_ntz)").alias("funding_time"),
        interval.alias("funding_interval_hours"),
        F.expr(f"try_cast(`{there['last_funding_rate']}` as double)").alias("last_funding_rate"),
        "_row",
    ).where("funding_time is not null and last_funding_rate is not null")
    return first_of_each(rows, ["asset", "funding_time"], F.asc("_row")).drop("_row")


def read_events(spark: SparkSession, path: str, asset: str | None = None) -> DataFrame:
    """The events of CSV files with a header."""
    return clean_events(spark.read.option("header", True).csv(path), asset)


def parse_assets(pairs: list[str], defaults: dict[str, str] | None = None) -> dict[str, str]:
    """ASSET:file arguments over `defaults`; the asset is upper-cased and the first colon parts them."""
    found = dict(defaults or {})
    for pair in pairs:
        asset, colon, file = pair.partition(":")
        if not colon:
            raise ValueError(f"expected ASSET:file, got {pair!r}")
        found[asset.strip().upper()] = file.strip()
    return found


def reset_assets(spark: SparkSession, path: str, assets: list[str], kind: str = "parquet") -> None:
    """Takes the named assets out of a table that was written with `append`, so that a new run of theirs starts afresh."""
    there = spark.read.format(kind).option("header", True).load(path)
    fields = StructType([f for f in there.schema if f.name != "asset"])
    folder = F.regexp_extract("_metadata.file_path", "(.*)/", 1)
    for (part,) in there.where(F.col("asset").isin(assets)).select(folder).distinct().collect():  # a folder an asset
        spark.createDataFrame([], fields).write.mode("overwrite").option("header", True).format(kind).save(unquote(part))


def write_table(df: DataFrame, path: str, kind: str = "parquet", append: bool = False) -> None:
    """A result table: replaced, or, with `append`, only the parts of the assets that `df` has."""
    writer = df.write.mode("overwrite").option("header", True).format(kind)
    if append and "asset" in df.columns:
        writer = writer.partitionBy("asset").option("partitionOverwriteMode", "dynamic")
    elif append:
        writer = writer.mode("append")
    writer.save(path)


def read_results(spark: SparkSession, paths: list[str], aliases: dict[str, tuple[str, ...]], percent: tuple[str, ...] = ()) -> DataFrame:
    """Result tables of several runs under one set of column names, by asset and horizon; ratios in `percent` become percentages."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(paths)
    there = {c.strip().lower(): c for c in raw.columns}
    picks = {name: next((there[a.lower()] for a in (name, *names) if a.lower() in there), None) for name, names in aliases.items()}
    if missing := [name for name, column in picks.items() if column is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    named = raw.select(*[(raw[f"`{c}`"] * 100 if name in percent else F.upper(raw[f"`{c}`"]) if name == "asset" else raw[f"`{c}`"]).alias(name) for name, c in picks.items()])
    return named.orderBy(*[c for c in ("asset", "horizon_bars", "horizon") if c in picks])


def bars_of_ticks(ticks: DataFrame, asset: Column, price: Column, unit: str, order: list[str]) -> DataFrame:
    """Bars of `unit` length from rows (ts, ...); open and close are the first and last price by `order`."""
    at = F.struct(*order)
    rows = ticks.select(asset.alias("asset"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar"), price.alias("price"), at.alias("at"))
    return rows.groupBy("asset", F.col("bar").alias("ts")).agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
