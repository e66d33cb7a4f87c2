"""Language-model scores of whole texts: a word-count base over all training documents and an attention model.

Texts are lower-cased (A-Z), cut into words at ASCII white space, and end with one end token. Word counts are
exact and cover every training document. The most frequent words' counts go to all tasks (a fixed number of
words at most); the other words of each document are joined with the count table, so nothing grows on the driver.

The attention model scores the words' subword ids. Texts are turned into ids once, into a table. All pairs of
neighbouring ids of all training documents, across words too, are counted for the model's tables. Its layer is
trained in rounds of averaged shards: each task starts from the common model and makes Adam steps on windows of
its partition's documents, and the changes are summed by parts of the parameters over the tasks. Every training
document is in one of the rounds, with all its windows: each token of the training documents is learnt from once.
"""

from __future__ import annotations

from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm import attention
from barwise.llm.common import Kept, id_remainder, settled, settled_table, slices, vocabulary_path

#: Stands for the end of a text in the count table; no word holds a blank.
END = b" "
_SLICE = 2_000_000
#: A-Z in lower case, and every ASCII white space as a line feed.
_PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\v\f\r ", b"\n\n\n\n\n"))


class Words:
    """The lower-cased words of texts, without a Python object for each: `distinct` ones as Arrow bytes, the place of
    each word among them (`which`), and the number of words up to each text's end (`ends`).

    bytes.lower changes A-Z only; words end at ASCII white space.
    """

    def __init__(self, texts: list[bytes | None]):
        letters = np.frombuffer(b"\n".join([b"", *(t or b"" for t in texts), b""]).translate(_PLAIN), dtype=np.uint8)
        inner = letters != 10
        edges = np.flatnonzero(inner[1:] != inner[:-1])
        offsets = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters[inner])]).dictionary_encode()
        self.distinct, self.which = coded.dictionary, coded.indices.to_numpy()
        self.ends = np.searchsorted(edges[::2], np.cumsum([len(t or b"") + 1 for t in texts]))

    def listed(self) -> list[bytes]:
        """The distinct words, cut from one string."""
        ends = np.frombuffer(self.distinct.buffers()[1], dtype=np.int32)[: len(self.distinct) + 1].tolist()
        whole = self.distinct.buffers()[2].to_pybytes() if ends[-1] else b""
        return [whole[a:b] for a, b in zip(ends, ends[1:])]

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))


def word_counts(docs: DataFrame, flush: int = 500_000) -> DataFrame:
    """(word, c) over all rows, the end token as a blank. Tasks add up before the shuffle."""

    def counted(batches):
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for batch in slices(whole, 0, _SLICE):
                words = Words(batch.column(0).to_pylist())
                n = np.append(np.bincount(words.which, minlength=len(words.distinct)), batch.num_rows)
                held.append(pa.record_batch([pa.concat_arrays([words.distinct, pa.array([END])]), pa.array(n)], names=["word", "c"]))
                if sum(map(len, held)) > flush:
                    held = added(held)
                    if sum(map(len, held)) > flush // 2:
                        yield from held
                        held = []
        yield from added(held)

    def added(held):
        return pa.Table.from_batches(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks().to_batches() if held else []

    return docs.select(F.col("text").cast("binary")).mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class SubwordIds:
    """Subword ids of words as bytes, those met lately kept in bounded memory. Sent as the model's path."""

    def __init__(self, path: str, most_bytes: int = 96_000_000):
        self.path, self.most_bytes = path, most_bytes

    def __getstate__(self) -> dict:
        return {"path": self.path, "most_bytes": self.most_bytes}

    @cached_property
    def pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def known(self) -> Kept:
        return Kept(self.most_bytes)

    @cached_property
    def dtype(self) -> np.dtype:
        return id_type(self.pieces.vocab_size())

    def __call__(self, texts: list[bytes | None]) -> pa.Array:
        """The ids of each text's words, as bytes."""
        words = Words(texts)
        distinct = words.listed()
        ids = list(map(self.known.get, distinct))
        if None in ids:
            new = [k for k, x in enumerate(ids) if x is None]
            for k, x in zip(new, self.pieces.encode([distinct[k].decode("utf-8", "replace") for k in new], num_threads=1)):
                ids[k] = array(self.dtype.char, x).tobytes()
                self.known.keep(distinct[k], ids[k], len(distinct[k]) + len(ids[k]))
        by_word = pa.array(ids, pa.binary()).take(pa.array(words.which))
        _, ends, whole = by_word.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[: len(by_word) + 1]
        offsets = np.concatenate([[0], ends[words.ends]]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), whole])


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2") if size < 1 << 16 else np.dtype("<i4")


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """A table (row, doc_id, text, ids): a number for each row, its text and the text's subword ids, both as bytes."""

    shared = docs.sparkSession.sparkContext.broadcast(SubwordIds(path))

    def encoded(batches):
        ids_of, row = shared.value, TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, 1, _SLICE):
                ids = ids_of(batch.column(1).to_pylist())
                yield pa.record_batch([pa.array(range(row, row + len(ids)), pa.int64()), batch.column(0), batch.column(1), ids], names=["row", "doc_id", "text", "ids"])
                row += len(ids)

    return settled_table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(encoded, "row long, doc_id long, text binary, ids binary"))


def id_pairs(tokens: DataFrame, size: int, most_keys: int = 1_000_000) -> DataFrame:
    """(a, b, n): how often id b follows id a in the whole texts of `tokens`; `size` is the id of a text's end on both sides."""
    dtype = id_type(size)

    def counted(batches):
        def rows():
            return pa.record_batch([pa.array(keys >> 32), pa.array(keys & (1 << 32) - 1), pa.array(sums)], names=["a", "b", "n"])

        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, 0, _SLICE):
                raw = batch.column(0).to_pylist()
                ends = np.cumsum([len(r) // dtype.itemsize + 1 for r in raw])
                after = np.full(ends[-1], size, dtype=np.int64)
                inner = np.ones(len(after), dtype=bool)
                inner[ends - 1] = False
                after[inner] = np.frombuffer(b"".join(raw), dtype=dtype)
                before = np.concatenate([[size], after[:-1]])
                new, n = np.unique(before << 32 | after, return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > most_keys:
                    yield rows()
                    keys, sums = keys[:0], sums[:0]
        yield rows()

    return tokens.select("ids").mapInArrow(counted, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _initial(tokens: DataFrame, size: int) -> tuple[np.ndarray, dict]:
    """(code of each id, the model before training), from the pairs of all of `tokens`. At most CODES squared sums come to the driver."""
    pairs = settled(id_pairs(tokens, size))
    met = pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size + 1)
    counts[met.column("b").to_numpy()] = met.column("n").to_numpy()
    code_of = attention.id_codes(counts[:-1])
    head = np.minimum(np.append(code_of, 0), attention.RARE)

    def coded(batches):
        for batch in batches:
            a, b = (head[batch.column(k).to_numpy()].astype(np.int64) for k in (0, 1))
            yield pa.record_batch([pa.array(a), pa.array(b), batch.column(2)], names=["a", "b", "n"])

    rows = pairs.mapInArrow(coded, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((attention.CODES, attention.CODES))
    table[rows.column("a").to_numpy(), rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    ordered = np.argsort(code_of)
    tables = attention.output_tables(table, counts[:-1][ordered[attention.RARE - 1 :]])
    return code_of, attention.initial(tables, int(code_of.max(initial=0)) + 1)


#: Numbers of a parameter that go together to one summing task, and the parts into which the tasks are dealt first.
_TOGETHER, _SALTS = 32_768, 64
_CHANGES = "part string, salt int, values binary, weights binary"


def _changes(before: dict, trainer: attention.Trainer, salt: int):
    """What a task's steps changed, in parts; each row's change is times its weight."""
    for name in attention.learnt(before):
        change = trainer.m[name] - before[name]
        weight = trainer.touched[name] if name in attention.BY_ROW else np.full(len(change), trainer.windows, dtype=np.float32)
        change = change.reshape(len(change), -1) * weight[:, None]
        rows = max(1, _TOGETHER // change.shape[1])
        for a in range(0, len(change), rows):
            if weight[a : a + rows].any():
                yield _change(f"{name}.{a}", salt, (change[a : a + rows], weight[a : a + rows]))


def _change(part: str, salt: int, both) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part]), pa.array([salt], pa.int32()), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in both)], names=["part", "salt", "values", "weights"])


def _summed(batches):
    """Adds up the values and the weights of each part and salt, which come sorted."""
    key, sums = None, None
    for batch in batches:
        for part, salt, *both in zip(*(batch.column(k).to_pylist() for k in range(4))):
            both = [np.frombuffer(x, dtype="<f4").astype(np.float64) for x in both]
            if (part, salt) != key:
                if key is not None:
                    yield _change(*key, sums)
                key, sums = (part, salt), both
            else:
                sums = [x + y for x, y in zip(sums, both)]
    if key is not None:
        yield _change(*key, sums)


def _round(tokens: DataFrame, code_of: np.ndarray, m: dict, number: int, rounds: int, batch_windows: int) -> dict:
    """The model after one of `rounds` rounds over `tokens`; each row takes part in one of them, with all its windows."""
    sc = tokens.sparkSession.sparkContext
    sent = sc.broadcast((code_of, m))
    dtype = id_type(len(code_of))

    def trained(batches):
        codes, before = sent.value
        trainer = attention.Trainer(before, 0.02 / (number + 1))
        held: list[np.ndarray] = []
        for whole in batches:
            for batch in slices(whole, 1, _SLICE // 4):
                inputs, targets, ends = attention.joined([codes[np.frombuffer(r, dtype=dtype)] for r in batch.column(1).to_pylist()])
                doc, first, padded = attention.windows(np.diff(ends, prepend=0))
                place = first[:, None] + np.arange(attention.STRIDE)
                new = attention.gathered(inputs, first), targets[np.minimum(place, len(targets) - 1)], place < ends[doc][:, None], padded
                held = [np.concatenate(x) for x in zip(held, new)] if held else list(new)
                full = len(held[0]) // batch_windows * batch_windows
                for a in range(0, full, batch_windows):
                    trainer.step(*(x[a : a + batch_windows] for x in held))
                held = [x[full:] for x in held]
        if held and len(held[0]):
            trainer.step(*held)
        if trainer.steps:
            yield from _changes(before, trainer, TaskContext.get().partitionId() % _SALTS)

    part = F.pmod(F.xxhash64("row"), F.lit(rounds)) == number
    changes = tokens.where(part).select("row", "ids").mapInArrow(trained, _CHANGES)
    salted = changes.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_summed, _CHANGES)
    parts = salted.withColumn("salt", F.lit(0)).repartition("part").sortWithinPartitions("part").mapInArrow(_summed, _CHANGES).collect()
    sent.destroy()
    m = m | {k: m[k].copy() for k in attention.learnt(m)}
    for r in parts:
        name, a = r.part.split(".")
        weights = np.frombuffer(r.weights, dtype="<f4")
        rows = m[name][int(a) : int(a) + len(weights)]
        rows += (np.frombuffer(r["values"], dtype="<f4").reshape(len(weights), -1) / np.maximum(weights, 1e-12)[:, None]).reshape(rows.shape)
    return m


def train(tokens: DataFrame, path: str, rounds: int = 2, batch_windows: int = 512) -> dict:
    """The attention model of the rows of `tokens`. Without rows its outputs are those of empty tables."""
    code_of, m = _initial(tokens, SubwordIds(path).pieces.vocab_size())
    for number in range(rounds):
        m = _round(tokens, code_of, m, number, rounds, batch_windows)
    return {"code_of": code_of, "model": m}


def _most_in_tail(words: DataFrame, head_words: int) -> int:
    """The least c such that at most `head_words` of `words` occur more often. As many numbers come to the driver as
    there are different counts, fewer than the root of twice all words; the words themselves are not sorted."""
    met = words.groupBy("c").agg(F.count("*").alias("n")).toArrow()
    c, n = (met.column(k).to_numpy() for k in ("c", "n"))
    falling = np.argsort(-c)
    beyond = np.flatnonzero(np.cumsum(n[falling]) > head_words)
    return int(c[falling[beyond[0]]]) if len(beyond) else 0


def score(tokens: DataFrame, counts: DataFrame, trained: dict | None, head_words: int = 131_072) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of `tokens`; scores are log10 probabilities.

    `counts` is a settled count table. Repeated rows and rows of a null doc_id each give a row; a null text is
    empty and has its end only. Without a model `tokens` needs no ids, and `score` is null.
    """
    sc = tokens.sparkSession.sparkContext
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("end")).first()
    words = counts.where(F.col("word") != F.lit(END))
    most_in_tail = _most_in_tail(words, head_words)
    head = words.where(F.col("c") > most_in_tail).toArrow()
    frequent = sc.broadcast((pa.concat_arrays([pa.array([], pa.binary()), *head.column("word").chunks]), np.append(np.log10(head.column("c").to_numpy() + 1.0), np.nan)))
    end_log, end_known = float(np.log10(total["end"] + 1.0)), int(total["end"] > 0)
    schema = pa.schema([("row", pa.int64()), ("word", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_log", pa.float64())])

    def looked_up(batches):
        met, logs = frequent.value
        for whole in batches:
            for batch in slices(whole, 2, _SLICE):
                n, row = batch.num_rows, batch.column(0)
                words = Words(batch.column(2).to_pylist())
                found = logs[pc.fill_null(pc.index_in(words.distinct, value_set=met), -1).to_numpy()][words.which]
                known, text = ~np.isnan(found), words.text_of()
                n_head, head_log = np.bincount(text[known], minlength=n), np.bincount(text[known], found[known], minlength=n)
                n_tokens = np.diff(words.ends, prepend=0) + 1
                own = [row, pa.array([b" %d" % k for k in row.to_pylist()]), batch.column(1), pa.array(np.zeros(n, dtype=np.int64)), pa.array(n_tokens), pa.array(n_head + end_known), pa.array(head_log + end_log)]
                yield pa.RecordBatch.from_arrays(own, schema=schema)
                rest, times = np.unique(text[~known] * len(words.distinct) + words.which[~known], return_counts=True)
                at, which = np.divmod(rest, max(1, len(words.distinct)))
                tail = [row.take(pa.array(at)), words.distinct.take(pa.array(which)), pa.nulls(len(at), pa.int64()), pa.array(times), *(pa.nulls(len(at), f.type) for f in list(schema)[4:])]
                yield pa.RecordBatch.from_arrays(tail, schema=schema)

    rows = tokens.select("row", "doc_id", "text").mapInArrow(looked_up, "row long, word binary, doc_id long, n long, n_tokens long, head_known long, head_log double")
    others = words.where(F.col("c") <= most_in_tail) if most_in_tail else words.limit(0)
    parts = rows.join(others, "word", "left").drop("word").withColumn("score", F.lit(None).cast("double"))
    if trained:
        parts = parts.unionByName(model_scores(tokens, trained), allowMissingColumns=True)
    joined = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("head_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        (F.max("head_log") + F.sum(F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0)))).alias("logs"),
        F.max("score").alias("score"),
    )
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))
    return joined.select("doc_id", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def model_scores(tokens: DataFrame, trained: dict) -> DataFrame:
    """(row, score): the model's log10 probability of each row's ids. Texts stay where they are: beside ids, model
    and counts in one task they took the most of an executor's memory."""
    model = tokens.sparkSession.sparkContext.broadcast(trained)
    dtype = id_type(len(trained["code_of"]))

    def scored(batches):
        codes, m, space = model.value["code_of"], attention.ready(model.value["model"]), attention.Space()
        for whole in batches:
            for batch in slices(whole, 1, _SLICE // 4):
                logs = attention.log_probabilities(m, [codes[np.frombuffer(r, dtype=dtype)] for r in batch.column(1).to_pylist()], space)
                yield pa.record_batch([batch.column(0), pa.array(logs / np.log(10))], names=["row", "score"])

    return tokens.select("row", "ids").mapInArrow(scored, "row long, score double")


def base_scores(docs: DataFrame) -> DataFrame:
    """The columns of `held_out_scores` but `score`: the same counts and sums, without ids and without a model."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    counts = settled(word_counts(rows.where(id_remainder("doc_id", 7) != 2)))
    return score(rows, counts, None).select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score")


def held_out_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The scores of all rows, learnt from those whose id's crc32 leaves another remainder than 2 by 7.

    A null doc_id has no remainder: its row is not learnt from, and held_out is null. An empty table gives no
    rows. Only columns doc_id and text are read.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")
    tokens = tokenised(docs, path)
    learnt = tokens.where(id_remainder("doc_id", 7) != 2)
    counts = settled(word_counts(learnt))
    scored = score(tokens, counts, train(learnt, path))
    return scored.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
