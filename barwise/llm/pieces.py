"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser rewrites blanks to U+2581 and puts one in
front. The piece machine reads characters and writes piece ids; a character in no piece is read by the byte
fallback, which writes its UTF-8 bytes' pieces. The pair machine weighs two neighbouring pieces: 0 if merging
their joined text by the model's scores gives back just these two, else infinite. A segmentation is the
model's own exactly if all of its pairs weigh 0, so the tropical-semiring shortest path through the
composition with an input is the encoding.

The composition is built lazily and for one chunk at a time: a chunk ends where no piece of the model can
reach across, which the compiler checks, so the chunks' shortest paths make up the text's.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import Kept, slices, vocabulary_path

BLANK = "▁"
_INFINITE = float("inf")
_START = -1


class PieceTransducer:
    """The compiled machines. `pairs` and `known` keep what was composed so far, in bounded memory."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are compiled")
        if model.trainer_spec.model_type != 2:
            raise ValueError("only models with merge scores are compiled")
        self.prefix = BLANK if spec.add_dummy_prefix else ""
        self.text_of = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id_of = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
        self.byte_id = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        byte_of = {k: b for b, k in self.byte_id.items()}
        self.bytes_of = [bytes([byte_of[k]]) if k in byte_of else p.piece.replace(BLANK, " ").encode() if p.type == 1 else b"" for k, p in enumerate(model.pieces)]
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        #: The piece machine: maps by character to (such a map of the next state, the (length, id) of the pieces that
        #: end there or on the way there, the longest first).
        self.arcs: dict = {}
        for piece in sorted(self.id_of, key=len):  # what a piece begins with comes before it
            if len(piece) > 1 and self._merged(piece) != [piece]:
                continue  # merging never makes it
            arcs, ends = self.arcs, ()
            for char in piece[:-1]:
                arcs, ends = arcs.setdefault(char, ({}, ends))
            arcs[piece[-1]] = ({}, ((len(piece), self.id_of[piece]), *ends))
        self.longest = max(map(len, self.id_of), default=1)
        self.chunk = self._chunks()
        self.pairs, self.known = Kept(128_000_000), Kept(96_000_000)

    def _chunks(self) -> re.Pattern:
        """A pattern of chunks that no piece reaches across."""
        inner = [p.lstrip(BLANK) for p in self.id_of]
        letters = re.compile(r"[^\W\d_]+")
        if all(letters.fullmatch(p) or not letters.search(p) for p in inner) and not any(BLANK in p for p in inner):
            return re.compile(rf"{BLANK}*(?:[^\W\d_]+|(?:(?![^\W\d_]|{BLANK})[\s\S])+|$)")
        if not any(BLANK in p for p in inner):
            return re.compile(rf"{BLANK}*[^{BLANK}]*")
        return re.compile(r"[\s\S]+")

    def _merged(self, text: str) -> list[str]:
        """Merges by score, the leftmost first among equals. Used on single pieces and pairs when compiling."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, -_INFINITE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > -_INFINITE:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], -_INFINITE)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], -_INFINITE)
        return parts

    def pair_weight(self, a: int, b: int) -> float:
        weight = self.pairs.get((a, b))
        if weight is None:
            left, right = self.text_of[a], self.text_of[b]
            weight = 0.0 if self._merged(left + right) == [left, right] else _INFINITE
            self.pairs.keep((a, b), weight, 0)
        return weight

    def _arcs(self, chunk: str, at: int) -> tuple[tuple[int, int], ...]:
        """(length, piece) of the piece machine's arcs from a place, the longest first; of the byte fallback where it has none."""
        node, arcs = self.arcs, ()
        for char in chunk[at : at + self.longest]:
            if (found := node.get(char)) is None:
                break
            node, arcs = found
        return arcs or ((1, _START),)

    def _straight_path(self, chunk: str, met: dict) -> list[int] | None:
        """The ids of the path that the search of `shortest_path` finds if it never has to turn back; None if it has to,
        or a character is in no piece. The arcs of the places on the way are put into `met`.
        """
        weights, n, longest, root, heavy = self.pairs, len(chunk), self.longest, self.arcs, _INFINITE
        at, last, ids = 0, _START, []
        while at < n:
            node, arcs = root, ()
            for char in chunk[at : at + longest]:
                if (found := node.get(char)) is None:
                    break
                node, arcs = found
            if not arcs:
                return None
            met[at] = arcs
            for size, piece in arcs:
                if last == _START:
                    break
                weight = weights.get((last, piece))
                if (self.pair_weight(last, piece) if weight is None else weight) != heavy:
                    break
            else:
                return None
            ids.append(piece)
            at, last = at + size, piece
        return ids

    def shortest_path(self, chunk: str) -> list[int]:
        """The ids along the shortest path through normalised `chunk` composed with the piece and pair machines.

        Finite weights are all 0, so the first whole path without an infinite arc is a shortest one: the search
        goes depth first and never enters a state (place, last piece) that is known to lead nowhere. Most chunks need
        no turning back, so that way is tried first, without keeping a trail.
        """
        arcs: dict[int, tuple] = {}
        if (straight := self._straight_path(chunk, arcs)) is not None:
            return straight
        n, dead, weights, arcs_at, heavy = len(chunk), set(), self.pairs, self._arcs, _INFINITE
        at, last = 0, _START
        trail: list[tuple] = []  # (place, last piece, arcs not tried yet) of the states before
        while at < n:
            if (out := arcs.get(at)) is None:
                out = arcs[at] = arcs_at(chunk, at)
            left = iter(out)
            while True:
                for size, piece in left:
                    if last != _START and piece != _START:
                        weight = weights.get((last, piece))
                        if (self.pair_weight(last, piece) if weight is None else weight) == heavy:
                            continue
                    if not dead or (at + size, piece) not in dead:
                        break
                else:
                    dead.add((at, last))
                    at, last, left = trail.pop()
                    continue
                break
            trail.append((at, last, left))
            at, last = at + size, piece
        ids = [piece for _, piece, _ in trail[1:]]
        ids.append(last)
        if _START in ids:
            places = [*(t[0] for t in trail), n]
            ids = [k for a, b, piece in zip(places, places[1:], ids) for k in ([piece] if piece != _START else [self.byte_id[x] for x in chunk[a:b].encode()])]
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        chunks = self.chunk.findall(self.prefix + text.replace(" ", BLANK))
        known = self.known
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            pass
        found = []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = struct.pack(f"<{len(path := self.shortest_path(chunk))}i", *path)
                if len(chunk) <= 48:
                    known.keep(chunk, ids, 2 * len(chunk) + len(ids))
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        """The inverse transducer: pieces and bytes to text, without the blank put in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", errors="replace")


def _compiled(docs: DataFrame, model_path: str | None):
    """The machine compiled once, as a broadcast of the vocabulary's size; workers drop it, and what it keeps, with the stage."""
    return docs.sparkSession.sparkContext.broadcast(PieceTransducer(model_path or vocabulary_path("piece_bpe_32k.model")))


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces) per row, for whole texts; a null or empty text has no ids.

    Repeated rows and rows of a null doc_id each give a row; an empty table gives none. Other columns are not read.
    """
    compiled = _compiled(docs, model_path)

    def encoded(batches):
        machine = compiled.value
        for whole in batches:
            for batch in slices(whole, 1):
                raw = [machine.encode_bytes(t or "") for t in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.record_batch([batch.column(0), ids, pa.array(np.diff(ends).astype(np.int64))], names=["doc_id", "ids", "n_pieces"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, "doc_id long, ids array<int>, n_pieces long")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    compiled = _compiled(encoded, model_path)

    def decoded(batches):
        machine = compiled.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([machine.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id long, text string")


def round_trips(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, round_trip.

    round_trip tells whether the decoded text is the text itself; only U+2581 in a text, which reads as a
    blank, can make it false. A null text counts as empty.
    """
    compiled = _compiled(docs, model_path)
    names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"]

    def digested(batches):
        machine = compiled.value
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for text in batch.column(1).to_pylist():
                    raw = machine.encode_bytes(text or "")
                    ids = np.frombuffer(raw, dtype="<i4")
                    back = machine.decode(ids.tolist())
                    rows.append((len(ids), int(machine.is_byte[ids].sum()), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digested, "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
