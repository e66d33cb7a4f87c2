"""The attention step by few products: tokens that share factors, and inputs that serve as keys and as values."""

import numpy as np
import pytest

from barwise.llm import attention as A
from barwise.llm.common import vocabulary_path
from barwise.llm.lm_scoring import SubwordIds
from test_lm_memory import model_and_windows


def test_tokens_of_all_upper_digits_share_products(monkeypatch):
    m, texts, batch = model_and_windows()
    assert len(np.unique(batch[1] // A.DIGITS[2])) > 200
    calls, matmul = [], np.matmul

    def counted(*args, **kinds):
        calls.append(1)
        return matmul(*args, **kinds)

    monkeypatch.setattr(np, "matmul", counted)
    A.gradients(m, *batch)
    assert len(calls) < 100  # a call and more for each upper digit before
    calls.clear()
    A.token_logs(A.ready(m), texts, chunk=2048)
    assert len(calls) < 100


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 500])
def test_every_token_has_a_slot_among_its_equals(n):
    want = np.random.default_rng(n).integers(0, A.CODES + 100, n).astype(np.int32)
    want = want[A._by_head(want)]
    upper, slot, wants = A._dealt(want)
    assert len(np.unique(slot)) == n and np.array_equal(wants[slot], want)
    assert np.array_equal(np.minimum(wants, A.RARE) // A.DIGITS[2], np.repeat(upper, len(wants) // max(1, len(upper))))
    assert (np.delete(wants, slot) <= A.RARE).all()  # slots left over are no rarer ids


@pytest.mark.parametrize("most_bytes", [1, 1000, 96_000_000])
def test_ids_with_any_memory(most_bytes):
    ids_of = SubwordIds(vocabulary_path("piece_bpe_32k.model"), most_bytes)
    texts = ["The cat sat\ton the mat".encode(), None, b"", b" cat  ", "漢字 \x00 the the".encode()]
    for some in (texts, texts[::-1], [], [None]):
        want = [[i for w in (t or b"").lower().split() for i in ids_of.pieces.encode(w.decode())] for t in some]
        assert [np.frombuffer(x, dtype=ids_of.dtype).tolist() for x in ids_of(some).to_pylist()] == want
