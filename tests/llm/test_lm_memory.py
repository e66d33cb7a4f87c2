"""Training and scoring on memory that is used again: the same results, and few new pages a step."""

import tracemalloc

import numpy as np
import pytest

from barwise.llm import attention as A
from barwise.llm.lm_scoring import Words


def model_and_windows(n=512, seed=5):
    rng = np.random.default_rng(seed)
    m = A.initial(A.output_tables(rng.integers(0, 3, (A.CODES, A.CODES)).astype(float), rng.integers(0, 9, 200)), A.CODES + 200, seed)
    texts = [rng.integers(1, A.RARE, 16 * 40 - 1).astype(np.int32) for _ in range(-(-n // 40))]
    inputs, targets, ends = A.joined(texts)
    doc, first, padded = A.windows(np.diff(ends, prepend=0))
    place = first[:, None] + np.arange(A.STRIDE)
    return m, texts, [x[:n] for x in (A.gathered(inputs, first), targets[np.minimum(place, len(targets) - 1)], place < ends[doc][:, None], padded)]


def test_later_steps_take_little_new_memory():
    m, _, batch = model_and_windows()
    trainer = A.Trainer(m)
    trainer.step(*batch)
    tracemalloc.start()
    trainer.step(*batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # 15 MB of arrays anew before


def test_used_memory_changes_no_result():
    m, texts, batch = model_and_windows()
    space = A.Space()
    A.gradients(m, *batch, space)
    few = [x[:70] for x in batch]
    loss, grad = A.gradients(m, *few, space)
    alone, want = A.gradients(m, *few)
    assert loss == alone
    for name in A.learnt(m):
        for x, y in zip(grad[name], want[name]):
            assert np.array_equal(x, y), name
    ready = A.ready(m)
    A.log_probabilities(ready, texts, space)
    assert np.array_equal(A.log_probabilities(ready, texts[:2], space), A.log_probabilities(ready, texts[:2]))


@pytest.mark.parametrize("texts", [[], [None], [b"A\x0bb  a", b"", None, b" \tc\r\n"], ["ÀB c d \x1cE".encode()]])
def test_words_are_cut_at_ascii_white_space(texts):
    words = Words(texts)
    assert words.listed() == words.distinct.to_pylist()
    ends = [0, *words.ends.tolist()]
    got = [[words.listed()[k] for k in words.which[a:b]] for a, b in zip(ends, ends[1:])]
    assert got == [(t or b"").lower().split() for t in texts]
