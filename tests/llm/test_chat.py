import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from barwise.llm.chat import CONTROL, conversation_digests, escape, format_conversations, read_back, render, unescape

PIECES = st.lists(st.one_of(st.sampled_from([*CONTROL, "\\", "\\\\", "<", "|", "<|", "|>", "[", "turn", "\n", " ", "é", "漢", "\u0000"]), st.text(max_size=5)), max_size=12).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_hides_control_strings(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROL)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
@settings(max_examples=200, deadline=None)
def test_rendering_reads_back(turns):
    assert [(r, t) for r, t, _, _ in read_back(render(turns))] == turns


def test_digests_match_brute_force(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    rows += [(1, 2, "assistant", "  two\n "), (1, 0, "system", None), (1, 1, "user", "<|end|> \\ <|turn|>"), (1, 3, "assistant", ""), (1, 4, "assistant", None), (1, 5, "assistant", "漢字 ☃ été <|text|>\\")]
    rows += [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, None, "b")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(40)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    for piece_chars in (4_000_000, 100):
        got = {r.conv_id: r for r in conversation_digests(frame, piece_chars=piece_chars).collect()}
        assert set(got) == {-1, 1, 2, 3}
        for conv, r in got.items():
            turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
            loss = [text for _, role, text in turns if role == "assistant"]
            assert r.n_turns == len(turns)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
            assert r.loss_chars == sum(map(len, loss))
            assert r.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()
            assert r.formatted_chars == len(render([(role, text) for _, role, text in turns]))
    pieces = {p: format_conversations(frame, piece_chars=p).collect() for p in (4_000_000, 100)}
    ids = {p: [i for r in sorted(rs, key=lambda r: (r.conv_id, r.piece)) for i in r.ids] for p, rs in pieces.items()}
    assert ids[100] == ids[4_000_000] and len(pieces[100]) > len(pieces[4_000_000])
    assert conversation_digests(frame.limit(0)).count() == 0
