"""Files of a run: which assets' bars and events are there, raw files by name, and tables of several runs put together."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.operators import summaries
from barwise.operators.settle import settled
from barwise.sources import bars

#: The default files of bars by asset, and of the main ones.
DEFAULT_FILES = {a: f"{a.lower()}usdt_5m.csv" for a in ("BTC", "ETH", "XRP", "SOL")}
RATE_FILES = {a: f"{a.lower()}usdt_funding.csv" for a in DEFAULT_FILES}
MAIN_ASSETS = ("BTC", "ETH")
#: Names under which an asset's raw file may be stored, the first one found counts.
RAW_NAMES = ("{}usdt_5m.csv", "{}_5m.csv", "{}usdt.csv", "{}.csv")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def chosen_assets(pairs: list[str] | None = None, all_assets: bool = False) -> dict[str, str]:
    """The files by asset: those given as ASSET:file, else all defaults, else the main assets'."""
    if pairs:
        return bars.parse_assets(pairs)
    return {a: f for a, f in DEFAULT_FILES.items() if all_assets or a in MAIN_ASSETS}


def present(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Which of the named files are in the folder, by one listing of it; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    listed = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return sorted(r.name for r in listed.join(F.broadcast(wanted), "name", "left_semi").distinct().collect())


def scanned(spark: SparkSession, folder: str, files: dict[str, str], names: dict[str, tuple[str, ...]], required: tuple[str, ...], most_columns: int = 64) -> tuple[DataFrame | None, list[str]]:
    """(the rows of all assets' CSV files as one scan, under one set of column names; the files set aside).

    `names` gives each column's accepted headers. Every file has its own header, in any order: the first lines, one a file,
    are a small table that tells in which cell a column stands. A file whose header lacks a `required` column is set aside
    and named. An asset is found by its file's name. Without any file the rows are None.
    """
    there = present(spark, folder, list(files.values()))
    if not there:
        return None, []
    cells = F.array(*[f"_c{k}" for k in range(most_columns)])
    raw = spark.read.schema(", ".join(f"_c{k} string" for k in range(most_columns))).csv([f"{folder}/{name}" for name in there])
    lines = bars.placed(raw.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start")))
    plain = F.transform(cells, lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")))
    first = lines.where("_start = 0").groupBy("_file").agg(F.min(F.struct("_row", plain.alias("cells"))).alias("head"))
    at = {name: F.coalesce(*[F.nullif(F.array_position("head.cells", a), F.lit(0)) for a in accepted]) for name, accepted in names.items()}
    heads = settled(first.select("_file", F.col("head.cells").alias("_head"), *[p.cast("int").alias(f"_at_{name}") for name, p in at.items()]))
    good = heads.where(" and ".join(f"_at_{name} is not null" for name in required))
    of = spark.createDataFrame([(file, asset) for asset, file in files.items() if file in there], "_file string, asset string")
    known = good.join(F.broadcast(of), "_file")  # a row a file
    rows = lines.join(F.broadcast(known), "_file").where((F.col("_start") > 0) | (plain != F.col("_head"))).select("asset", "_row", *[F.get(cells, F.col(f"_at_{name}") - 1).alias(name) for name in names])
    read = {r["_file"] for r in good.select("_file").collect()}
    return rows, [name for name in there if name not in read]


def _together(spark: SparkSession, folder: str, files: dict[str, str], names: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame | None:
    rows, aside = scanned(spark, folder, files, names, required)
    if aside:
        warnings.warn(f"left out for missing columns: {', '.join(aside)}", stacklevel=3)
    return rows


def read_assets(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame | None:
    """Bars of all assets whose file is there, as one table; None if none is. Files that lack a column are left out with a warning."""
    rows = _together(spark, folder, files, bars.ALIASES, tuple(bars.ALIASES))
    return None if rows is None else bars.clean_bars(rows)


#: The columns of rate files.
RATE_COLUMNS = {c: (c,) for c in ("datetime", "funding_interval_hours", "last_funding_rate")}


def read_rate_files(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame | None:
    """Events of all assets whose file is there, keyed by asset; None if none is. Files that lack a column are left out with a warning."""
    rows = _together(spark, folder, files, RATE_COLUMNS, ("datetime", "last_funding_rate"))
    return None if rows is None else bars.clean_events(rows)


def read_raw(spark: SparkSession, folder: str, asset: str) -> DataFrame | None:
    """An asset's raw file under the first of its possible names, its headers stripped of blanks; None if there is none."""
    for name in RAW_NAMES:
        path = f"{folder}/{name.format(asset.lower())}"
        if exists(spark, path):
            raw = spark.read.option("header", True).csv(path)
            return raw.toDF(*[c.strip() for c in raw.columns])
    return None


def prepared(raw: DataFrame, asset: str) -> DataFrame:
    """Bars of a raw file with positive closes, the last row of each time, and returns; rows without a return go."""
    from barwise.operators.features import with_returns

    rows = bars.clean_bars(raw, asset, keep="last", required=("ts", "close", "volume")).where("close > 0")
    return with_returns(rows).where("ret is not null")


def combined(spark: SparkSession, folders: list[str], name: str) -> DataFrame | None:
    """One result table of several runs, from those folders that have it; a column that a run lacks is null."""
    found = [spark.read.option("header", True).option("inferSchema", True).csv(f"{f}/{name}") for f in folders if exists(spark, f"{f}/{name}")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def combined_liquidity(tables: list[DataFrame]) -> DataFrame:
    """Liquidity tables of several runs: each asset's first row, ranked anew by mean notional."""
    marked = [t.withColumn("_run", F.lit(k)) for k, t in enumerate(tables)]
    rows = bars.first_of_each(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked), ["asset"], F.asc("_run")).drop("_run")
    rank = F.row_number().over(Window.orderBy(F.desc("mean_notional"), "asset"))  # one row per asset
    return rows.withColumn("rank", rank).withColumn("top_two", F.col("rank") <= 2).orderBy("rank")


def combined_losses(details: list[DataFrame], pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(losses by origin of all runs, the pooled tests over them)."""
    detail = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), details)
    return detail, summaries.pooled_tests(detail, pools)
