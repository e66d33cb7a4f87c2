"""Language identification of mixed-language text.

Training counts character trigrams of words by language. A word's score per language is the sum of its
trigrams' log-probabilities, less those of trigrams never seen; languages that do not use the word's script are
out, as script ranges tell. A Viterbi path over a document's words, with a penalty for each switch, labels spans.

A word supports its label if its trigrams are likelier in that language than in a background in which all trigrams
ever seen are equally likely. Words of a script that no language uses, and random letters, support none. The
language with most letters in words that support it is the document's, and their share of all letters is the score.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Collection
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import id_remainder, rows_where, slices

#: First code points of script ranges, in order; what lies between is "other".
SCRIPTS = (
    (0x0041, "latin"), (0x02B0, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
    (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS = [start for start, _ in SCRIPTS]


def _marks() -> str:
    """The combining marks as ranges of a character class; they belong to the letters that they follow."""
    points = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(points), lambda x: x[1] - x[0])]
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


_WORD = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")
#: ASCII letters in lower case; every other ASCII character as a blank.
_ASCII = {c: chr(c).lower() if chr(c).isalpha() else " " for c in range(128)}
UNDETERMINED = "und"


def script(char: str) -> str:
    return SCRIPTS[max(0, bisect_right(_STARTS, ord(char)) - 1)][1]


def letter_runs(text: str) -> list[str]:
    """Runs of letters in lower case; a run without any letter (such as of superscript digits) is none."""
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


def trigrams(word: str) -> list[str]:
    framed = f"\x02{word}\x03"
    return [framed[i : i + 3] for i in range(len(framed) - 2)]


def train(docs: DataFrame, docs_per_language: int = 2000, unseen_share: float = 0.01) -> dict:
    """A model from the texts and non-null lang of `docs`: trigram and script counts by language.

    The fit uses a bounded sample: about `docs_per_language` whole documents of each language, picked by a
    hash of their ids, and all their trigrams. A trigram that a language lacks has the same probability in every
    language, `unseen_share` over the number of trigrams, whatever the language's total; the model holds by how
    much the log-probabilities of seen ones exceed it. No rows give a model without languages.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().withColumnRenamed("count", "n")
    picked = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000.0 * docs_per_language) / F.col("n"))

    def counted(batches):
        grams, letters = Counter(), Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(letter_runs(text)).items():
                    letters[lang, script(word[0])] += n
                    for gram in trigrams(word):
                        grams[lang, gram] += n
        rows = [(lang, 0, name, n) for (lang, name), n in letters.items()] + [(lang, 3, gram, n) for (lang, gram), n in grams.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["lang", "kind", "what", "n"])

    counts = picked.select("lang", "text").mapInArrow(counted, "lang string, kind long, what string, n long").groupBy("kind", "lang", "what").agg(F.sum("n").alias("n"))
    rows = counts.orderBy("kind", "what", "lang").toArrow()
    kinds, what, spoken, n = (rows.column(c).to_pylist() for c in ("kind", "what", "lang", "n"))
    langs = sorted(set(spoken))
    number = {lang: k for k, lang in enumerate(langs)}
    scripts: dict[str, np.ndarray] = {}
    cut = sum(k == 0 for k in kinds)
    for name, lang, c in zip(what[:cut], spoken[:cut], n[:cut]):
        scripts.setdefault(name, np.zeros(len(langs)))[number[lang]] = c
    words = sum(scripts.values()) if scripts else np.zeros(len(langs))
    grams = what[cut:]
    table = {gram: k for k, gram in enumerate(dict.fromkeys(grams))}
    entry_lang = np.array([number[lang] for lang in spoken[cut:]], dtype=np.int64)
    entry_n = np.array(n[cut:], dtype=np.float64)
    totals = np.bincount(entry_lang, entry_n, minlength=len(langs))
    unseen = unseen_share / (len(table) + 1)
    gains = np.log(((1 - unseen_share) * (entry_n - 0.5) / totals[entry_lang] + unseen) / unseen).astype(np.float32)
    starts = np.searchsorted(np.array([table[g] for g in grams], dtype=np.int64), np.arange(len(table) + 2))  # one more is for trigrams never seen
    background = float(np.log(1 / ((len(table) + 1) * unseen)))
    return {"langs": langs, "background": background, "trigrams": table, "starts": starts, "gain_langs": entry_lang, "gains": gains, "scripts": {s: v / np.maximum(words, 1) >= 1e-3 for s, v in scripts.items()}}


class WordScores:
    """Scores of words, kept while they take about `most_bytes` and the broadcast that holds them is in use. `needed` is what a word's score must reach to support a language."""

    def __init__(self, model: dict, most_bytes: int = 72_000_000):
        self.model, self.most_bytes = model, most_bytes
        #: What a word of each script loses in each language; the last row is for scripts that no language uses.
        used = {name: uses for name, uses in model["scripts"].items() if uses.any()}
        self.row_of = {name: k for k, name in enumerate(used)}
        self.lost = np.array([*(np.where(uses, 0, 1e4) for uses in used.values()), np.zeros(len(model["langs"]))], dtype=np.float32)
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.used = 0
        self.rows = np.zeros((0, len(self.model["langs"])), dtype=np.float32)
        self.needed = np.zeros(0, dtype=np.float32)

    def learn(self, words: Collection[str]) -> None:
        new = [w for w in words if w not in self.number]
        size = lambda ws: sum(map(len, ws)) * 2 + len(ws) * (200 + 4 * len(self.model["langs"]))
        if self.used + size(new) > self.most_bytes and self.number:
            self.reset()
            new = list(words)
        self.used += size(new)
        parts = [self._scores(new[k : k + 5_000]) for k in range(0, len(new), 5_000)]
        self.number.update((w, len(self.rows) + k) for k, w in enumerate(new))
        self.rows = np.concatenate([self.rows, *(p for p, _ in parts)])
        self.needed = np.concatenate([self.needed, *(n for _, n in parts)])

    def _scores(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get, unseen = self.model["trigrams"].get, len(self.model["trigrams"])
        framed = "".join([f"\x02{w}\x03" for w in new])
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        word = np.repeat(np.arange(len(new)), sizes)
        own = np.arange(len(word)) + 2 * word  # the first places of a framed word begin its trigrams, the last two none
        flat = np.array([get(framed[k : k + 3], unseen) for k in range(len(framed) - 2)], dtype=np.int64)[own]
        first, n = self.model["starts"][flat], np.diff(self.model["starts"])[flat]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())  # the entries of each trigram
        place = np.repeat(word, n) * len(self.model["langs"]) + self.model["gain_langs"][at]
        scores = np.bincount(place, self.model["gains"][at], minlength=len(new) * len(self.model["langs"])).astype(np.float32).reshape(len(new), -1)
        scores -= self.lost[[self.row_of.get(script(w[0]), -1) for w in new]]  # a script narrows the candidates
        return scores, (sizes * self.model["background"]).astype(np.float32)


def viterbi(scores: np.ndarray, words: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language number of each word of each document; documents go through their words side by side."""
    order = sorted(range(len(words)), key=lambda d: -len(words[d]))
    lengths = np.array([len(words[d]) for d in order])
    longest = int(lengths[0]) if len(order) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents with more than t words come first
    start = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([words[d] for d in order]) if longest else np.zeros(0, dtype=np.int64)
    path = np.zeros(len(flat), dtype=np.int16)
    if not longest:
        return [path[:0] for _ in words]
    best = np.zeros((len(order), scores.shape[1]), dtype=np.float64)
    stays, sources = [], []
    for t in range(longest):
        n = active[t]
        here = best[:n]
        if t:
            source = here.argmax(axis=1)
            switched = here[np.arange(n), source][:, None] - penalty
            stays.append(here >= switched)
            sources.append(source.astype(np.int16))
            np.maximum(here, switched, out=here)
        here += scores[flat[start[:n] + t]]
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        path[start[:n] + t] = state[:n]
        if t:
            state[:n] = np.where(stays[t - 1][np.arange(n), state[:n]], state[:n], sources[t - 1])
    out: list[np.ndarray] = [path[:0]] * len(words)
    for k, d in enumerate(order):
        out[d] = path[start[k] : start[k + 1]]
    return out


def _labelled(texts: list[str | None], scorer: WordScores, penalty: float):
    """Per text: (language, share of letters, runs); runs is a list of (language number, words, letters)."""
    langs = scorer.model["langs"]
    met: defaultdict[str, int] = defaultdict()  # a word's number in these texts; a word that comes again is held once
    met.default_factory = met.__len__
    found = [np.fromiter(map(met.__getitem__, run := letter_runs(t)), dtype=np.int32, count=len(run)) if t and langs else np.zeros(0, dtype=np.int32) for t in texts]
    met.default_factory = None  # else it holds itself
    lettered = [w[0].isalpha() or any(map(str.isalpha, w)) for w in met]
    scorer.learn([w for w, has in zip(met, lettered) if has])
    number = np.array([scorer.number[w] if has else -1 for w, has in zip(met, lettered)], dtype=np.int64)
    size = np.fromiter(map(len, met), dtype=np.int64, count=len(met))
    runs = [f if len(f) == 0 else f[number[f] >= 0] for f in found]
    words = [number[r] for r in runs]
    for run, numbers, path in zip(runs, words, viterbi(scorer.rows, words, penalty)):
        if not len(run):
            yield UNDETERMINED, 0.0, []
            continue
        letters = size[run]
        supports = scorer.rows[numbers, path] >= scorer.needed[numbers]
        sure, all_of = (np.bincount(path, weights=letters * x, minlength=len(langs)) for x in (supports, 1))
        best = int(np.lexsort((-np.arange(len(langs)), all_of, sure))[-1])
        heads = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
        spans = zip(path[heads].tolist(), np.diff(np.append(heads, len(path))).tolist(), np.add.reduceat(letters, heads).tolist())
        yield langs[best], float(sure[best] / letters.sum()), list(spans)


def identify(docs: DataFrame, model: dict, penalty: float = 8.0) -> DataFrame:
    """(doc_id, lang_pred, score, spans) per row: spans lists (lang, words, letters) in text order.

    A null text and one without letters get `und`, score 0 and no spans; one whose words support no language gets
    its path's most frequent one and score 0. Repeated rows and rows of a null doc_id each give a row.
    """
    known = docs.sparkSession.sparkContext.broadcast(WordScores(model))

    def labelled(batches):
        scorer = known.value
        langs = scorer.model["langs"]
        for whole in batches:
            for batch in slices(whole, 1):
                found = list(_labelled(batch.column(1).to_pylist(), scorer, penalty))
                spans = pa.array([[{"lang": langs[k], "words": w, "letters": c} for k, w, c in s] for _, _, s in found], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("letters", pa.int64())])))
                yield pa.record_batch([batch.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), spans], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(labelled, "doc_id long, lang_pred string, score double, spans array<struct<lang string, words long, letters long>>")


def keep_identified(docs: DataFrame, model: dict, least_share: float = 0.3, penalty: float = 8.0) -> DataFrame:
    """`docs` without those whose language is undetermined, or is supported by less than `least_share` of the letters.

    All columns stay, whatever their names. Repeated rows and rows of a null doc_id are judged one by one.
    """
    known = docs.sparkSession.sparkContext.broadcast(WordScores(model))

    def judge():
        scorer = known.value
        return lambda texts: [lang != UNDETERMINED and share >= least_share for lang, share, _ in _labelled(texts, scorer, penalty)]

    return rows_where(docs, judge)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans; learnt from rows whose id's crc32 leaves another remainder than 2 by 4."""
    model = train(docs.where(id_remainder("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
