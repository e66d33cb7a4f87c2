"""Source divergence audit by DuckDB shard aggregation.

Each task counts the terms of its documents in DuckDB, batch by batch. The counts are dealt to shards by hash of
(lang, term), so that a shard holds all that is known of its terms; DuckDB adds them up there, keeps the terms that
enough documents have, and, once Spark has merged the totals of sources and languages, gives the shard's part of the
pair sums and its best terms. Spark merges sums and rankings.

With counts c, a source's probability of a term is p(c) = 1 + floor(10^9 (c + 1) / (N + V)), and two sources differ in
it by f(p, q) = floor((p - q)^2 / q). A sum over all V terms needs only the terms that both sources have: with A and B
the terms of the two,

    sum f = sum over A and B of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]   (in the shards)
          + sum over A of f(p, q0) + sum over B of f(p0, q) + (V - |A| - |B|) f(p0, q0),

and the sums over A or B alone need only how many terms of a source have each count. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import light, settled, slices

SCALE = 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNT = rf"""with t as (select row, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from rows),
 d as (select row, any_value(lang) as lang, any_value(source) as source, term, count(*) as n from t group by row, term)
 select lang, source, term, sum(n)::bigint as n, count(*)::bigint as docs from d group by lang, source, term"""
ADD = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from rows group by lang, source, term"
KEEP = """select lang, source, term, n, (sum(n) over w)::bigint as lang_n, (row_number() over (partition by lang, term order by source) = 1)::bigint as first from rows
 window w as (partition by lang, term) qualify sum(docs) over w >= {least}"""
_P = "(1 + {scale}::hugeint * ({c} + 1) // ({n} + v)::hugeint)::bigint"
_F = "(({0} - {1}) * ({0} - {1}) // {1})"


PAIRS = f"""with p as (select lang, source, term, {_P.format(scale=SCALE, c='n', n='source_n')} as p, {_P.format(scale=SCALE, c='0', n='source_n')} as z from rows),
 f as (select a.lang, a.source, b.source as item, {_F.format('a.p', 'b.p')} - {_F.format('a.p', 'b.z')} - {_F.format('a.z', 'b.p')} + {_F.format('a.z', 'b.z')} as f
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source)
 select 'pair' as part, lang, source, item, sum(f)::decimal(38, 0) as value from f group by lang, source, item"""
TERMS = f"""with p as (select lang, source, term, {_P.format(scale=SCALE, c='n', n='source_n')} as p, {_P.format(scale=SCALE, c='lang_n', n='total_n')} as q from rows)
 select 'term' as part, lang, source, term as item, {_F.format('p', 'q')}::decimal(38, 0) as value from p where p > q
 qualify row_number() over (partition by lang, source order by {_F.format('p', 'q')} desc, term) <= {{most}}"""


def _connect():
    """A DuckDB of one thread in memory; it writes no files."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})


def _ask(connection, sql: str, rows: pa.Table, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What DuckDB answers about the table `rows`, in batches of the given fields."""
    connection.register("rows", rows)
    found = connection.sql(sql).to_arrow_table()
    connection.unregister("rows")
    yield from found.cast(fields).to_batches(max_chunksize=20_000)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = pa.schema([*list(_COUNTED)[:4], ("lang_n", pa.int64()), ("first", pa.int64())])
_FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])


def _shard(batches: Iterator[pa.RecordBatch], connection, most: int = 1_000_000) -> pa.Table:
    """A shard's counts as one table, added up whenever `most` rows are waiting."""
    added, waiting = _COUNTED.empty_table(), []
    for batch in batches:
        waiting.append(batch)
        if sum(len(b) for b in waiting) > most:
            added, waiting = pa.Table.from_batches(_ask(connection, ADD, pa.concat_tables([added, pa.Table.from_batches(waiting).cast(_COUNTED)]), _COUNTED), _COUNTED), []
    return pa.Table.from_batches(_ask(connection, ADD, pa.concat_tables([added, pa.Table.from_batches(waiting, waiting[0].schema).cast(_COUNTED)]), _COUNTED), _COUNTED) if waiting else added


def term_counts(docs: DataFrame, batch_bytes: int = 8_000_000) -> DataFrame:
    """(lang, source, term, n, docs): counts of a term and of documents with it, several rows a term.

    A row adds up about `batch_bytes` of a task's texts, or one text if that is longer.
    """

    def counted(batches):
        connection = _connect()
        for whole in batches:
            for batch in slices(whole, 2, batch_bytes):
                rows = pa.Table.from_batches([batch]).append_column("row", pa.array(range(len(batch)), pa.int64()))
                yield from _ask(connection, COUNT, rows, _COUNTED)

    return docs.select(_named("lang"), _named("source"), _named("text")).mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _p(count: Column | str, total: Column | str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + v)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20, 0)) * cast({count} + 1 as decimal(18, 0))) div cast({total} + v as decimal(20, 0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}").cast("decimal(38,0)")


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs in `docs`.

    Part `pair` has every other source of the lang with the sum of f over all kept terms, all ranks; part `term` the
    kept terms that the source has more often than its lang, up to rank `most_terms`. Null text, lang and source are
    read as ''. A repeated row is a document of its own; ties go by item. A lang without kept terms has pairs of value 0.
    An empty table gives no rows. Texts of any length are counted whole; other columns are not read.
    """
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.select("text").rdd.getNumPartitions())

    def keep(batches):
        connection = _connect()
        yield from _ask(connection, KEEP.format(least=least_docs), _shard(batches, connection), _KEPT)

    counts = term_counts(docs).repartition(shards, "lang", "term")
    kept = settled(counts.mapInArrow(keep, "lang string, source string, term string, n long, lang_n long, first long"))

    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_n"), F.sum("first").alias("v"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.count("*").alias("own_terms"))
    groups = settled(docs.select(_named("lang"), _named("source")).distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0))
    few = light(groups)

    known = kept.join(few, ["lang", "source"])
    if few is groups:
        known = known.repartition(shards, "lang", "term")

    def found(batches):
        connection, held = _connect(), list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            yield from _ask(connection, PAIRS, rows, _FOUND)
            yield from _ask(connection, TERMS.format(most=most_terms), rows, _FOUND)

    parts = settled(known.select("lang", "source", "term", "n", "lang_n", "source_n", "total_n", "v").mapInArrow(found, "part string, lang string, source string, item string, value decimal(38,0)"))

    zero = F.when(F.col("v") > 0, _p("0", "source_n"))
    other = few.select("lang", F.col("source").alias("item"), zero.alias("item_zero"), F.col("own_terms").alias("item_terms"))
    both = groups.withColumn("zero", zero).join(other, "lang").where("source <> item")
    rest = F.when(F.col("v") > 0, (F.col("v") - F.col("own_terms") - F.col("item_terms")) * _f("zero", "item_zero")).otherwise(0)
    # of a source's terms, how many have each count: against the other source's probability of a term it has not
    alike = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(few, ["lang", "source"]).withColumns({"p": _p("n", "source_n")}).join(other, "lang").where("source <> item")
    alone = alike.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _f("p", "item_zero")).alias("here"), F.sum(F.col("k") * _f("item_zero", "p")).alias("there"))
    sums = [
        both.select("lang", "source", "item", rest.alias("value")),
        alone.select("lang", "source", "item", F.col("here").alias("value")),
        alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias("value")),
        parts.where("part = 'pair'").select("lang", "source", "item", "value"),
    ]
    wide = [rows.withColumn("value", F.col("value").cast("decimal(38,0)")) for rows in sums]
    pairs = reduce(DataFrame.unionAll, wide).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    terms = parts.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [rows.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", terms))]
    return ranked[0].unionAll(ranked[1].where(F.col("rank") <= most_terms))
