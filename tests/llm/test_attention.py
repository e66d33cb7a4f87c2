"""The attention model against plain loops: windows, normalisation, derivatives and the tables' pairs."""

import numpy as np
import pytest

from barwise.llm import attention as A
from barwise.llm.lm_scoring import id_pairs, train, tokenised
from barwise.llm.common import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")


def model(n_rare=150, seed=3):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 3, (A.CODES, A.CODES)).astype(float)
    m = A.initial(A.output_tables(pairs, rng.integers(0, 9, n_rare)), A.CODES + n_rare, seed)
    for k in A.learnt(m):
        m[k] = m[k] + (rng.standard_normal(m[k].shape) * 0.2).astype(np.float32)
    return m


def texts_of(m, seed=4):
    rng = np.random.default_rng(seed)
    n = len(m["E"])
    some = lambda k: np.where(rng.random(k) < 0.3, rng.integers(A.CODES, n, k), rng.integers(1, A.RARE, k)).astype(np.int32)
    return [some(k) for k in (0, 1, 15, 16, 17, 33, 100)]


def softmax(x):
    x = np.exp(x - x.max())
    return x / x.sum()


def by_hand(m, text):
    """Each token's log-probability, one at a time, from the window that scores it."""
    inputs, targets, out = np.append(0, text), np.append(text, 0), []
    for t, want in enumerate(targets):
        start = t // A.STRIDE * A.STRIDE
        at = np.arange(max(0, start - A.WINDOW + A.STRIDE), t + 1)
        x = m["E"][inputs[at]] + m["P"][at - start + A.WINDOW - A.STRIDE]
        a = softmax((x[-1] @ m["Q"]) @ (x @ m["K"]).T)
        h = x[-1] + (a @ (x @ m["V"])) @ m["O"]
        before, head = min(inputs[t], A.RARE), min(want, A.RARE)
        upper, third = divmod(head, A.DIGITS[2])
        first, second = divmod(upper, A.DIGITS[1])
        p = softmax(m["B1"][before] + h @ m["U1"])[first] * softmax(m["B2"][before, first] + h @ m["U2"][first])[second] * softmax(m["B3"][before, upper] + h @ m["U3"][upper])[third]
        if want > A.RARE:
            b, spot = divmod(want - A.CODES, A.BAND)
            p *= softmax(m["B4"] + h @ m["U4"])[b] * softmax(m["B5"][b] + h @ m["U5"][b])[spot]
        out.append(np.log(p))
    return out


def test_batched_windows_equal_single_tokens():
    m = model()
    texts = texts_of(m)
    logs, ends = A.token_logs(A.ready(m), texts, chunk=3)
    want = np.concatenate([by_hand(m, t) for t in texts])
    assert len(logs) == ends[-1] == sum(len(t) + 1 for t in texts)  # every token once
    assert logs == pytest.approx(want, abs=2e-4)
    assert A.log_probabilities(A.ready(m), texts) == pytest.approx([sum(by_hand(m, t)) for t in texts], abs=5e-3)


def test_next_tokens_sum_to_one():
    m = A.ready(model())
    for prefix in texts_of(m)[:5]:
        codes = [c for c in range(1, len(m["E"])) if c != A.RARE]
        logs, ends = A.token_logs(m, [np.append(prefix, c).astype(np.int32) for c in codes])
        at = np.concatenate([[0], ends[:-1]]) + len(prefix)
        end = A.token_logs(m, [prefix])[0][-1]
        assert np.exp(logs[at]).sum() + np.exp(end) == pytest.approx(1, abs=1e-4)


def test_derivatives_against_differences():
    m = model()
    inputs, targets, ends = A.joined(texts_of(m))
    doc, first, padded = A.windows(np.diff(ends, prepend=0))
    place = first[:, None] + np.arange(A.STRIDE)
    live = place < ends[doc][:, None]
    seen, want = A.gathered(inputs, first), targets[np.minimum(place, len(targets) - 1)]
    wide = {k: m[k].astype(np.float64) for k in m}
    grad = A.gradients(wide, seen, want, live, padded)[1]
    rng = np.random.default_rng(0)
    for name in A.learnt(m):
        rows, g = grad[name] if name in A.BY_ROW else (np.arange(len(m[name])), grad[name])
        for _ in range(4):
            k = rng.integers(len(rows))
            at = (rows[k], *(rng.integers(n) for n in m[name].shape[1:]))
            loss = []
            for step in (1e-4, -1e-4):
                moved = wide | {name: wide[name].copy()}
                moved[name][at] += step
                loss.append(A.gradients(moved, seen, want, live, padded)[0])
            assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(g[(k, *at[1:])], abs=2e-4), name


def test_pairs_and_training_cover_all_documents(spark):
    import sentencepiece

    texts = ["The cat sat on the mat", "", None, "a cat", "漢字 the the"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    tokens = tokenised(docs.repartition(3), PATH)
    got = {(r.a, r.b): r.n for r in id_pairs(tokens, 32000).collect()}
    pieces, want = sentencepiece.SentencePieceProcessor(model_file=PATH), {}
    for t in texts:
        ids = [32000, *(i for w in (t or "").lower().split() for i in pieces.encode(w)), 32000]
        for pair in zip(ids, ids[1:]):
            want[pair] = want.get(pair, 0) + 1
    assert got == want
    # windows of every document move the model, and it comes to expect what it saw
    more = tokenised(spark.createDataFrame([(k, f"north wind {'blows cold ' * 30}") for k in range(200)], "doc_id long, text string").repartition(3), PATH)
    start, end = (train(more, PATH, rounds=r) for r in (0, 4))
    ids = start["code_of"][np.frombuffer(more.first().ids, dtype="<u2")]
    before, after = (A.log_probabilities(A.ready(t["model"]), [ids])[0] for t in (start, end))
    assert after > before
    assert not np.array_equal(start["model"]["E"][ids[0]], end["model"]["E"][ids[0]])


def test_every_window_of_a_long_document_is_learnt_from(spark):
    rng = np.random.default_rng(2)
    text = " ".join("".join(chr(97 + k) for k in rng.integers(0, 26, 5)) for _ in range(400))
    tokens = tokenised(spark.createDataFrame([(0, text)], "doc_id long, text string"), PATH)
    start, end = (train(tokens, PATH, rounds=r, batch_windows=4) for r in (0, 1))
    ids = np.frombuffer(tokens.first().ids, dtype="<u2")
    late = start["code_of"][ids[len(ids) // 2 :]]  # outputs start at zero, so that embeddings first move in the second step
    assert len(np.unique(late)) > 150 and (start["model"]["E"][late] != end["model"]["E"][late]).any(axis=1).all()
