import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barwise.llm.common import vocabulary_path
from barwise.llm.pieces import PieceTransducer, decode, encode, round_trips

PATH = vocabulary_path("piece_bpe_32k.model")
MACHINE = PieceTransducer(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.lists(st.one_of(st.sampled_from([" ", "  ", "   ", "      ", "\n", "\t", "the", "ing", "é", "漢", "☃", "a", "1", "###", "<s>", "<0x0A>", "▁", "²", ".", "_", "ation", "Ü", " "]), st.text(max_size=4)), max_size=14).map("".join)


@given(TEXT)
@settings(max_examples=1500, deadline=None)
def test_shortest_path_is_the_model_s_encoding(text):
    if "\x00" not in text:
        assert MACHINE.encode(text) == LIBRARY.encode(text)
    assert MACHINE.decode(MACHINE.encode(text)) == text.replace("▁", " ")


def test_words_against_the_library():
    rng = random.Random(1)
    parts = ["th", "re", "un", "able", "ly", "est", "qu", "ción", "schaft", "ung", "x", "zz", "ou", "er", "heit"]
    for _ in range(20_000):
        word = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))
        assert MACHINE.encode(word) == LIBRARY.encode(word), word


def test_runs_of_blanks_and_long_runs():
    for n in [*range(1, 70), 333]:
        for text in (" " * n, " " * n + "a", "a" + " " * n + "b", "x" * n, "=" * n, "\n" * n, "漢" * n):
            assert MACHINE.encode(text) == LIBRARY.encode(text), (n, text[:5])


def test_frames(spark):
    texts = [None, "", " ", "a b\n c", "☃▁☃", "the " * 40_000, "é"]
    docs = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in encode(docs).collect()}
    assert all(got[k].ids == LIBRARY.encode(t or "") and got[k].n_pieces == len(got[k].ids) for k, t in enumerate(texts))
    back = {r.doc_id: r.text for r in decode(encode(docs)).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(texts))
    assert {r.doc_id for r in round_trips(docs).where("not round_trip").collect()} == {4}
    assert encode(docs.limit(0)).count() == 0 and round_trips(docs.limit(0)).count() == 0
