"""Paths without turning back: arcs are looked up once a place, and the search gives the same ids after a turn."""

import random

import sentencepiece

from barwise.llm.common import vocabulary_path
from barwise.llm.pieces import PieceTransducer

PATH = vocabulary_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_no_place_is_looked_up_twice(monkeypatch):
    machine, places = PieceTransducer(PATH), []
    look_up = machine._arcs
    monkeypatch.setattr(machine, "_arcs", lambda chunk, at: places.append(at) or look_up(chunk, at))
    assert machine.encode("the weather") == LIBRARY.encode("the weather")
    assert not places  # one call a place before


def test_straight_paths_and_turns_give_the_library_s_ids():
    machine, rng, straight, turned = PieceTransducer(PATH), random.Random(7), 0, 0
    parts = ["th", "er", "an", "on", "ou", "eux", "é", "ñ", "漢", "☃", "re", "nt", ".", "ing"]
    for _ in range(5_000):
        word = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))
        if machine._straight_path("▁" + word, {}) is None:
            turned += 1
        else:
            straight += 1
        assert machine.encode(word) == LIBRARY.encode(word), word
    assert straight > 500 and turned > 500
