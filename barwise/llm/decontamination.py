"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a bounded slice of a partition of documents. Prefix doubling over word numbers ranks the shard's
suffixes by their first 1, 2, 4, ... words among the test suffixes' prefixes; a suffix whose prefix starts no
test suffix drops out, as nothing can match it any further. The suffixes that share `window` words with some
test suffix, sorted by rank, are the shard's suffix array. Every test suffix is binary-searched in it, which
gives the range of all places where it begins. Test suffixes of one beginning are one rank: a place then looks
for its longest match among them by bisection in their order, comparing by a descent over the ranks of 2^k words.
So there is one row a place, and the items of a rank are looked up once; places and test suffixes are never
paired off, however often a passage or a word repeats. Documents with a match are the affected ones. Nothing is
shuffled.

The benchmark is sent to the tasks in blocks of at most `block_bytes` of text (a larger item is a block of its
own). Each block is a pass of its own over the documents, and its broadcast is dropped after it, so what a
task holds does not grow with the benchmark; one of up to `block_bytes` takes a single pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import rows_where, settled_table, slices

#: Lower-cases A-Z and turns all but digits, letters and non-ASCII bytes into blanks.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Text of a shard, in bytes.
SHARD_BYTES = 2_000_000
HITS = "array<struct<doc_word: long, n_words: long, item_id: string, item_word: long>>"
_HIT = pa.struct([("doc_word", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _halves(width: int) -> tuple[int, int]:
    """The greatest power of two below a width, and the rest."""
    left = 1 << (width - 1).bit_length() - 1
    return left, width - left


def _pairs(ranks: np.ndarray, after: np.ndarray, left: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where both halves of a prefix have ranks, and the key that the two make."""
    at = np.flatnonzero(ranks[: max(0, len(ranks) - left)] >= 0)
    at = at[after[at + left] >= 0]
    return at, ranks[at].astype(np.int64) * base + after[at + left]


class TestSuffixes:
    """One block of benchmark items: word numbers, and the ranks of all its suffixes by their first words."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        tokens, item, searched, starts = [], [], [], []
        for name, text in items:
            if not (words := words_of(text)):
                continue
            starts.append(len(tokens))
            tokens += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            item += [len(self.items)] * (len(words) + 1)
            # a test suffix is searched by its first `window` words, that of a shorter item by all of them
            width = min(window, len(words))
            searched += [width] * (len(words) - width + 1) + [0] * width
            self.items.append(name)
        self.tokens, self.item, self.searched, self.starts = (np.array(x, dtype=np.int64) for x in (tokens, item, searched, starts))
        self.base = len(self.tokens) + 1
        self.longest = int(np.diff(np.append(self.starts, len(self.tokens))).max(initial=1)) - 1
        self._ranks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def ranks(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each test suffix by its first `width` words, -1 if it has fewer; the sorted keys of those ranks)."""
        if width not in self._ranks:
            if width == 1:
                self._ranks[1] = np.where(self.tokens > 0, self.tokens, -1).astype(np.int32), np.zeros(0, np.int64)
            else:
                left, right = _halves(width)
                at, keys = _pairs(self.ranks(left)[0], self.ranks(right)[0], left, self.base)
                known, inverse = np.unique(keys, return_inverse=True)
                out = np.full(len(self.tokens), -1, dtype=np.int32)
                out[at] = inverse
                self._ranks[width] = out, known
        return self._ranks[width]

    @cached_property
    def order(self) -> np.ndarray:
        """The place of each test suffix among all of them, in the order of their word numbers."""
        rank, width = self.tokens.copy(), 1
        while True:
            after = np.concatenate([rank[width:], np.zeros(min(width, len(rank)), dtype=rank.dtype)]) + 1
            known, rank = np.unique(rank.astype(np.int64) * (self.base + 1) + after[: len(rank)], return_inverse=True)
            width *= 2
            if len(known) == len(rank) or width > len(rank):
                return rank

    @cached_property
    def classes(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By searched width: its suffixes by rank and then by order, where each rank's begin, each rank's set of items, and the ranks.

        A set of items is numbered by `sets`; ranks of the same items, as the windows of one passage have, share it.
        """
        found = {}
        for width in sorted({int(x) for x in np.unique(self.searched)} - {0}):
            searched = np.flatnonzero(self.searched == width)
            rank = self.ranks(width)[0][searched]
            searched = searched[np.lexsort((self.order[searched], rank))]
            ranks, begin = np.unique(self.ranks(width)[0][searched], return_index=True)
            items = np.split(self.item[searched], begin[1:])
            found[width] = searched, np.append(begin, len(searched)), np.array([self._numbered(np.unique(i)) for i in items], dtype=np.int64), ranks
        return found

    def _numbered(self, items: np.ndarray) -> int:
        return self._sets.setdefault(items.tobytes(), len(self._sets))

    @cached_property
    def _sets(self) -> dict[bytes, int]:
        return {}

    @cached_property
    def sets(self) -> list[np.ndarray]:
        """The items of each numbered set."""
        assert self.classes is not None
        return [np.frombuffer(raw, dtype=np.int64) for raw in self._sets]


class Shard:
    """The word numbers of a shard's documents, each followed by a 0, ranked among the test suffixes."""

    def __init__(self, tokens: np.ndarray, test: TestSuffixes):
        self.tokens, self.test = tokens, test
        self._ranks: dict[int, np.ndarray] = {1: np.where(tokens > 0, tokens, -1).astype(np.int32)}

    def ranks(self, width: int) -> np.ndarray:
        """The rank of each suffix by its first `width` words; -1 where no test suffix begins with them."""
        if width not in self._ranks:
            left, right = _halves(width)
            known = self.test.ranks(width)[1]
            out = np.full(len(self.tokens), -1, dtype=np.int32)
            if len(known):
                at, keys = _pairs(self.ranks(left), self.ranks(right), left, self.test.base)
                found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[found] == keys
                out[at[same]] = found[same]
            self._ranks[width] = out
        return self._ranks[width]

    @cached_property
    def powers(self) -> list[int]:
        """Widths of the extending descent, the largest first."""
        return [1 << k for k in reversed(range(self.test.longest.bit_length()))]

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By searched width: all places where a test suffix of it begins, their sets of items, and of the longest match at each its place in the test tokens and its words."""
        for window, (searched, begin, sets, known) in self.test.classes.items():
            ranks = self.ranks(window)
            places = np.flatnonzero(ranks >= 0)
            if not len(places):
                continue
            suffix_array = places[np.argsort(ranks[places], kind="stable")]
            ordered = ranks[suffix_array]
            low, high = (np.searchsorted(ordered, known, side=side) for side in ("left", "right"))
            n = high - low  # every rank's range of the array
            place, group = suffix_array[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(known)), n)
            if len(place):
                yield place, sets[group], *self._longest(place, searched, begin[group], begin[group + 1], window)

    def _longest(self, place: np.ndarray, searched: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, words) of the longest match of each place among searched[low:high], which are in order.

        The two neighbours of a place in that order have the longest, and bisection compares with both.
        """
        low, high = low.copy(), high.copy()
        source, length = searched[low], np.zeros(len(place), dtype=np.int64)
        live = np.arange(len(place))
        while len(live):
            middle = (low[live] + high[live]) // 2
            with_ = searched[middle]
            n = self._extended(place[live], with_, window)
            better = n > length[live]
            source[live[better]], length[live[better]] = with_[better], n[better]
            own = self.tokens[np.minimum(place[live] + n, len(self.tokens) - 1)]
            after = own > self.test.tokens[np.minimum(with_ + n, len(self.test.tokens) - 1)]
            low[live[after]], high[live[~after]] = middle[after] + 1, middle[~after]
            live = live[low[live] < high[live]]
        return source, length

    def _extended(self, place: np.ndarray, source: np.ndarray, window: int) -> np.ndarray:
        length = np.full(len(place), window, dtype=np.int64)
        for power in self.powers:
            at, to = place + length, source + length
            inside = (at < len(self.tokens)) & (to < len(self.test.tokens))
            a, b = (ranks[np.where(inside, x, 0)] for ranks, x in ((self.ranks(power), at), (self.test.ranks(power)[0], to)))
            length[inside & (a >= 0) & (a == b)] += power
        return length


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's rows in lists of at most `block_bytes` of text, or of a single item."""
    rows, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary")).orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(row[1]) > block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((row[0], bytes(row[1])))
        size += len(row[1])
    if rows:
        yield rows


def _shard(texts: list[bytes | None], test: TestSuffixes) -> tuple[Shard, np.ndarray]:
    """A shard of the texts, and where in it each text begins, with the end of all."""
    parts, starts = [np.zeros(0, dtype=np.int64)], [0]
    for text in texts:
        words = words_of(text)
        parts += [test.numbers(words), np.zeros(1, dtype=np.int64)]
        starts.append(starts[-1] + len(words) + 1)
    return Shard(np.concatenate(parts), test), np.array(starts)


def _hits_of(texts: list[bytes | None], test: TestSuffixes) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(words, longest matches, ids of the items with a match) of each text."""
    shard, starts = _shard(texts, test)
    heads, met = [np.zeros((4, 0), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for place, sets, source, length in shard.places():
        in_order = np.argsort(place, kind="stable")
        place, sets, source, length = (x[in_order] for x in (place, sets, source, length))
        doc = np.searchsorted(starts, place, side="right") - 1
        met.append(np.unique(doc * len(test.sets) + sets))
        # what the match of the place before holds already is no match of its own
        held = np.concatenate([[False], (place[1:] == place[:-1] + 1) & (length[:-1] > length[1:])])
        heads.append(np.vstack([doc, place - starts[doc], length, source])[:, ~held])
    doc, word, length, source = np.concatenate(heads, axis=1)
    in_order = np.argsort(doc, kind="stable")
    item = test.item[source]
    fields = [pa.array(word[in_order]), pa.array(length[in_order]), _taken(test.items, item[in_order]), pa.array((source - test.starts[item])[in_order])]
    hits = pa.ListArray.from_arrays(_offsets(doc, len(texts)), pa.StructArray.from_arrays(fields, names=[f.name for f in _HIT]))
    owner, number = np.divmod(np.unique(np.concatenate(met)), max(1, len(test.sets)))
    sizes = np.array([len(test.sets[k]) for k in number.tolist()], dtype=np.int64)
    pairs = np.unique(np.repeat(owner, sizes) * max(1, len(test.items)) + np.concatenate([*(test.sets[k] for k in number.tolist()), np.zeros(0, dtype=np.int64)]))
    owner, item = np.divmod(pairs, max(1, len(test.items)))
    return np.diff(starts) - 1, hits, pa.ListArray.from_arrays(_offsets(owner, len(texts)), _taken(test.items, item))


def _hit(texts: list[bytes | None], test: TestSuffixes) -> list[bool]:
    """Whether a text has a match: whether a searched test suffix begins anywhere in it."""
    shard, starts = _shard(texts, test)
    hit = np.zeros(len(texts), dtype=bool)
    for window, (_, _, _, known) in test.classes.items():
        places = np.flatnonzero(np.isin(shard.ranks(window), known))
        hit[np.searchsorted(starts, places, side="right") - 1] = True
    return hit.tolist()


def _taken(names: list[str], at: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(at, pa.int64()))


def _offsets(owner: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n)[:n])]), pa.int32())


def _joined(old: pa.Array, new: pa.Array) -> pa.Array:
    """Each row's values of two list columns, one after the other."""
    if not len(old.flatten()):
        return new
    kind = new.type
    return pa.array([[*(a or ()), *b] for a, b in zip(old.to_pylist(), new.to_pylist())], kind)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, n_words, hits, items) of every row of `docs`; hits are its longest verbatim matches with benchmark items.

    A match has at least `window` words, or is the whole of an item that has fewer, and says where it begins in
    the document and in one item that has it; `items` are the ids of all items with a match, once or more. A null or
    empty text has no words; items without an id or text are skipped. Texts of any length are shards of their own.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        sent = sc.broadcast((block, window))
        again = following is not None
        names = ["doc_id", *["text"] * again, "n_words", "hits", "items"]

        def searched(batches, sent=sent, again=again, names=names):
            test = TestSuffixes(*sent.value)
            for whole in batches:
                for batch in slices(whole, 1, SHARD_BYTES):
                    n_words, *found = _hits_of(batch.column(1).to_pylist(), test)
                    both = [_joined(batch.column(k), new) for k, new in zip((3, 4), found)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(1)] * again, pa.array(n_words, pa.int64()), *both], names=names)

        rows = rows.mapInArrow(searched, f"doc_id long, {'text binary, ' * again}n_words long, hits {HITS}, items array<string>")
        if not again:
            return rows
        rows = settled_table(rows)
        sent.destroy()
        block = following


def covered_words(hits: Column) -> Column:
    """How many words lie inside any of a row's matches."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(so_far, hit):
        end = F.greatest(so_far["end"], hit["doc_word"] + hit["n_words"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.least(end, F.greatest(so_far["end"], hit["doc_word"]))).alias("n"))

    return F.aggregate(F.array_sort(hits), start, step, lambda x: x["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match.

    n_hit counts words inside any match of `matched`; n_items the distinct items with a match, whose ids, sorted
    as strings and comma-joined, items_sha256 digests. An empty benchmark hits nothing. Repeated rows and rows
    of a null doc_id each give a row; other columns are not read.
    """
    items = F.array_sort(F.array_distinct("items"))
    rows = matched(docs, benchmark, window, block_bytes).withColumns({"n_hit": covered_words(F.col("hits")), "items": items})
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["n_words"])), F.lit(0).cast("long")).alias("longest_match"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """`docs` without the documents that have a longest match as in `matched`. All columns stay, nothing is shuffled.

    Null texts stay. Where the benchmark has several blocks, the rows that one leaves are written before the next.
    """
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast((block, window))

        def judge(sent=sent):
            test = TestSuffixes(*sent.value)
            return lambda texts: [not hit for hit in _hit([None if t is None else t.encode() for t in texts], test)]

        docs = rows_where(docs, judge, SHARD_BYTES)
        if following is not None:
            docs = settled_table(docs)
            sent.destroy()
        block = following
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): every longest verbatim match of at least `window` words."""
    return matched(docs, benchmark, window, block_bytes).select("doc_id", F.inline("hits")).select("doc_id", "item_id", "doc_word", "item_word", "n_words")
