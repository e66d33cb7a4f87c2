"""A small causal self-attention model over subword ids, in numpy.

Ids are renumbered by falling frequency, and every id of the vocabulary has a code and an embedding of its own. Code
0 ends a text; the most frequent ids have the codes below `RARE`; `RARE` itself is no id but announces, as an
output, one of the rarer ids, whose codes come after it. An output is predicted digit by digit, in the bases
`DIGITS`, and a rarer id in two more steps, its band of `BAND` neighbouring codes and its place there. That costs
a fraction of a softmax over all codes. One attention layer corrects the log-probabilities that a bigram table
counted over the corpus gives the three digits, and those that the ids' frequencies give the other two steps.
Windows of `WINDOW` inputs overlap: the last `STRIDE` positions of each are scored, the ones before are context,
so every token is scored once.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE, WIDTH = 32, 16, 16
DIGITS, BAND = (16, 16, 8), 64
CODES = DIGITS[0] * DIGITS[1] * DIGITS[2]
RARE = CODES - 1
MOST = np.float32(60)
_LATE = WINDOW - STRIDE
_ONES = np.ones(4096, dtype=np.float32)
#: 1 where an output may look at a place of its window.
_CAUSAL = (np.arange(WINDOW)[None, :] <= np.arange(_LATE, WINDOW)[:, None]).astype(np.float32)
#: Tokens with the same upper digits are multiplied this many at a time.
_TOGETHER = 16
#: Parameters whose rows belong to single codes or bands; the others belong to every window.
BY_ROW = ("E", "U5")


def id_codes(counts: np.ndarray) -> np.ndarray:
    """The code of each id, from the corpus counts of ids; equal counts go by id."""
    codes = np.arange(1, len(counts) + 1)
    codes[RARE - 1 :] += 1
    code_of = np.empty(len(counts), dtype=np.int32)
    code_of[np.argsort(-counts, kind="stable")] = codes
    return code_of


def output_tables(pairs: np.ndarray, rare: np.ndarray) -> dict:
    """Log-probabilities of the next code's digits by the code before, and of the rarer ids' bands and places.

    `pairs` counts neighbouring codes, all rarer ids as `RARE`; a code seldom before others falls back on the
    overall frequencies. `rare` counts the rarer ids in the order of their codes.
    """
    overall = pairs.sum(axis=0) + 0.5
    third = (pairs + 8 * overall / overall.sum()).reshape(CODES, *DIGITS)
    second = third.sum(axis=3)
    first = second.sum(axis=2)
    padded = np.zeros(max(1, -(-len(rare) // BAND)) * BAND)
    padded[: len(rare)] = rare + 0.5
    by_band = padded.reshape(-1, BAND) + 1e-30
    logs = lambda x, whole: np.log(x / whole[..., None]).astype(np.float32)
    return {
        "B1": logs(first, first.sum(axis=1)), "B2": logs(second, first), "B3": logs(third, second).reshape(CODES, -1, DIGITS[2]),
        "B4": logs(by_band.sum(axis=1), by_band.sum()), "B5": logs(by_band, by_band.sum(axis=1)),
    }


def initial(tables: dict, n_codes: int, seed: int = 0) -> dict:
    """The model before training: random embeddings and attention, and outputs that leave the tables as they are."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(WIDTH)).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, dtype=np.float32)
    m = {"E": normal(n_codes, WIDTH), "P": normal(WINDOW, WIDTH), **{k: normal(WIDTH, WIDTH) for k in "QKVO"}}
    m["Q"] /= np.float32(np.sqrt(WIDTH))
    a, b, c = DIGITS
    return tables | m | {"U1": zeros(WIDTH, a), "U2": zeros(a, WIDTH, b), "U3": zeros(a * b, WIDTH, c), "U4": zeros(WIDTH, len(tables["B4"])), "U5": zeros(len(tables["B5"]), WIDTH, BAND)}


def learnt(m: dict) -> list[str]:
    return [k for k in m if k[0] != "B"]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the first scored input, whether it is the document's first) of each window.

    Documents of `lengths` inputs stand one behind the other.
    """
    n = -(-lengths // STRIDE)
    doc = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, (np.cumsum(lengths) - lengths)[doc] + nth * STRIDE, nth == 0


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, where each text ends) of texts given as codes without the end, one behind the other."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    inputs, targets = (np.zeros(ends[-1] if len(ends) else 0, dtype=np.int32) for _ in range(2))
    inner = np.ones(len(targets), dtype=bool)
    inner[ends - 1] = False
    targets[inner] = np.concatenate([np.zeros(0, dtype=np.int32), *texts])
    inputs[1:][inner[:-1]] = targets[inner]
    return inputs, targets, ends


class Space:
    """Arrays that are used again: memory of a megabyte for each step of each batch costs more than the arithmetic on it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple, like: np.ndarray) -> np.ndarray:
        """An array of this shape and of the kind of `like`, with whatever it held before."""
        size, flat = int(np.prod(shape)), self.held.get(name)
        if flat is None or len(flat) < size or flat.dtype != like.dtype:
            flat = self.held[name] = np.empty(size, dtype=like.dtype)
        return flat[:size].reshape(shape)

    def rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rows of `table` with the numbers `at`, which must all exist."""
        return table.take(at, axis=0, out=self(name, (*at.shape, *table.shape[1:]), table), mode="clip")

    def product(self, name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x @ y; the last axis but one of x is merged with those before if y is one matrix."""
        if y.ndim == 2:
            return np.matmul(x.reshape(-1, x.shape[-1]), y, out=self(name, (x.size // x.shape[-1], y.shape[1]), x)).reshape(*x.shape[:-1], y.shape[1])
        return np.matmul(x, y, out=self(name, (*x.shape[:-1], y.shape[-1]), x))


def gathered(inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The codes of each window, whose first scored input is given."""
    at = first[:, None] + np.arange(-_LATE, STRIDE)
    return inputs[np.clip(at, 0, len(inputs) - 1)]


def _attend(late, q, x, out, padded: np.ndarray, space: Space, a: np.ndarray):
    """(one over the sums of the attention weights, the inputs' means by them, the states); `a` gets the weights themselves.

    Keys and values are the inputs `x`: the matrices that make keys are in the queries `q`, those of values in `out`.
    `padded` marks windows without anything before. Attention scores count as `MOST` at most, so that their
    exponentials need no shift.
    """
    np.matmul(q, x.transpose(0, 2, 1), out=a)
    if not a.max() <= MOST:
        np.minimum(a, MOST, out=a)
    np.exp(a, out=a)
    a *= _CAUSAL
    a[padded, :, :_LATE] = 0
    share = 1 / (a @ _ONES[:WINDOW])
    o = space.product("o", a, x)
    o *= share[:, :, None]
    h = space.product("h", o, out)
    h += late
    return share, o, h


def _by_head(want: np.ndarray) -> np.ndarray:
    """The order of codes by their heads; 16-bit numbers are sorted by counting."""
    return np.argsort(np.minimum(want, RARE).astype(np.uint16), kind="stable")


def _runs(numbers: np.ndarray, n: int):
    """(number, its slice) for each number below n that occurs in a sorted array."""
    cuts = np.searchsorted(numbers, np.arange(n + 1))
    return [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts)).tolist()]


def _dealt(want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper digits of each block, each token's slot, the wanted code of each slot) of tokens in the order of `_by_head`.

    Tokens with the same upper digits fill blocks of `_TOGETHER` slots, so that the products of all blocks are one
    call; slots left over want the block's first code.
    """
    a, b, c = DIGITS
    each = np.bincount(np.minimum(want, RARE) // c, minlength=a * b)
    blocks = -(-each // _TOGETHER)
    upper = np.repeat(np.arange(a * b), blocks)
    slot = np.arange(len(want)) + np.repeat((np.cumsum(blocks) - blocks) * _TOGETHER - np.cumsum(each) + each, each)
    wants = np.repeat(upper * c, _TOGETHER)
    wants[slot] = want
    return upper, slot, wants


def _digits(m: dict, h: np.ndarray, before: np.ndarray, want: np.ndarray, blocks: np.ndarray, space: Space):
    """For each digit: (logits of all slots, wanted places, factors' name). `before` is below CODES; `want` and `blocks` are as `_dealt`."""
    a, b, c = DIGITS
    upper, third = np.divmod(np.minimum(want, RARE), c)
    first, second = np.divmod(upper, b)
    at = before.astype(np.int64)
    one, two, three = (space.rows(name, m[name].reshape(-1, m[name].shape[-1]), rows) for name, rows in (("B1", at), ("B2", at * a + first), ("B3", at * (a * b) + upper)))
    one += space.product("U1", h, m["U1"])
    change = space("U2", two.shape, h)
    for k, some in _firsts(blocks):
        np.matmul(h[some], m["U2"][k], out=change[some])
    two += change
    three += space.product("U3", h.reshape(-1, _TOGETHER, WIDTH), space.rows("factors", m["U3"], blocks)).reshape(three.shape)
    return (one, first, "U1"), (two, second, "U2"), (three, third, "U3")


def _firsts(blocks: np.ndarray):
    """(first digit, its slots) for each that occurs."""
    return [(k, slice(some.start * _TOGETHER, some.stop * _TOGETHER)) for k, some in _runs(blocks // DIGITS[1], DIGITS[0])]


def _rare_steps(m: dict, want: np.ndarray):
    """The two steps more that predict each wanted rarer id: (which tokens, logits of the tables, correction's factors, wanted place, its name and row)."""
    rare = np.flatnonzero(want > RARE)
    if len(rare):
        rare = rare[np.argsort(want[rare], kind="stable")]
        band, spot = np.divmod(want[rare] - CODES, BAND)
        yield rare, np.repeat(m["B4"][None], len(rare), axis=0), m["U4"], band, "U4", None
        for k, at in _runs(band, len(m["B4"])):
            yield rare[at], np.repeat(m["B5"][k][None], at.stop - at.start, axis=0), m["U5"][k], spot[at], "U5", k


def _log_share(logits: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at its wanted place; logits are used up. They are corrected log-probabilities and need no shift."""
    got = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + want)
    np.exp(logits, out=logits)
    return got - np.log(logits @ _ONES[: logits.shape[1]])


def _merged(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """What the inputs are multiplied by to meet other inputs as queries meet keys, and to be added up as values are."""
    return m["Q"] @ m["K"].T, m["V"] @ m["O"]


def ready(m: dict) -> dict:
    """`m` with its queries tabulated by code and by place, as scoring uses them."""
    meet, out = _merged(m)
    return m | {"EQ": m["E"] @ meet, "PQ": m["P"] @ meet, "out": out}


def token_logs(m: dict, texts: list[np.ndarray], chunk: int = 2048, block: int = 128, space: Space | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(natural log-probability of every token, where each text ends), under a `ready` model.

    The states of `block` windows at a time stay near the processor; the outputs of `chunk` windows share products.
    """
    space = space or Space()
    inputs, targets, ends = joined(texts)
    doc, first, padded = windows(np.diff(ends, prepend=0))
    out = np.zeros(len(targets))
    for a in range(0, len(doc), chunk):
        part = slice(a, a + chunk)
        seen = gathered(inputs, first[part])
        scored = seen[:, _LATE:]
        states = space("states", (*scored.shape, WIDTH), m["E"])
        for b in range(0, len(seen), block):
            some = slice(b, b + block)
            x, q = space.rows("x", m["E"], seen[some]), space.rows("q", m["EQ"], scored[some])
            x += m["P"]
            q += m["PQ"][_LATE:]
            states[some] = _attend(x[:, _LATE:], q, x, m["out"], padded[part][some], space, space("a", (len(x), STRIDE, WINDOW), x))[2]
        place = first[part][:, None] + np.arange(STRIDE)
        live = np.flatnonzero((place < ends[doc[part]][:, None]).ravel())
        live = live[_by_head(targets[place.ravel()[live]])]
        at = place.ravel()[live]
        blocks, slot, want = _dealt(targets[at])
        rows = np.zeros(len(want), dtype=np.int64)
        rows[slot] = live
        h = space.rows("hs", states.reshape(-1, WIDTH), rows)
        got = np.zeros(len(want), dtype=np.float32)
        for logits, spot, _ in _digits(m, h, np.minimum(scored.ravel().take(rows), RARE), want, blocks, space):
            got += _log_share(logits, spot)
        for some, logits, factors, spot, *_ in _rare_steps(m, want):
            logits += h[some] @ factors
            got[some] += _log_share(logits, spot)
        out[at] = got[slot]
    return out, ends


def log_probabilities(m: dict, texts: list[np.ndarray], space: Space | None = None) -> np.ndarray:
    """The natural log-probability of each text, given as codes without the end."""
    if not texts:
        return np.zeros(0)
    logs, ends = token_logs(m, texts, space=space)
    return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]))


def _error(logits: np.ndarray, want: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted loss of a softmax and its derivative by the logits, which are used up as in `_log_share`."""
    at = np.arange(0, logits.size, logits.shape[1]) + want
    got = logits.ravel().take(at)
    p = np.exp(logits, out=logits)
    whole = p @ _ONES[: p.shape[1]]
    p *= (weight / whole)[:, None]
    p.ravel()[at] -= weight
    return float((np.log(whole) - got) @ weight), p


def _by_code(m: dict, seen: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes that occur in the windows, sums of `dx` over their places).

    A window's context is mostly what the window before has scored: the two are added up place by place first.
    """
    alone = np.append(True, (seen[1:, :_LATE] != seen[:-1, _LATE:]).any(axis=1))
    codes = np.concatenate([seen[:, _LATE:].ravel(), seen[alone, :_LATE].ravel()])
    rows = np.concatenate([dx[:, _LATE:].reshape(-1, WIDTH), dx[alone, :_LATE].reshape(-1, WIDTH)])
    dx[alone, :_LATE] = 0
    scored = rows[: seen.shape[0] * STRIDE].reshape(-1, STRIDE, WIDTH)
    scored[:-1] += dx[1:, :_LATE]
    number = np.zeros(len(m["E"]), dtype=np.int64)
    number[codes] = 1
    met = np.flatnonzero(number)
    number[met] = np.arange(len(met))
    which, sums = number[codes], np.empty((len(met), WIDTH), dtype=dx.dtype)
    for k, column in enumerate(np.ascontiguousarray(rows.T)):
        sums[:, k] = np.bincount(which, column, len(met))
    return met, sums


def gradients(m: dict, seen: np.ndarray, targets: np.ndarray, live: np.ndarray, padded: np.ndarray, space: Space | None = None) -> tuple[float, dict]:
    """(mean loss of the live tokens, its derivatives) for windows of codes; targets and live are of the scored places.

    Those of `BY_ROW` parameters are (row numbers, derivatives of these rows).
    """
    space = space or Space()
    product = space.product
    flat = lambda y: y.reshape(-1, y.shape[-1])
    meet, out = _merged(m)
    x = space.rows("x", m["E"], seen)
    x += m["P"]
    late = space("late", (len(x), STRIDE, WIDTH), x)
    late[:] = x[:, _LATE:]
    # beside each other: attention weights and the derivatives of their logarithms, derivatives of means and queries
    both, sides = space("both", (len(x), 2, STRIDE, WINDOW), x), space("sides", (len(x), 2, STRIDE, WIDTH), x)
    (a, da), (do, q) = both.swapaxes(0, 1), sides.swapaxes(0, 1)
    q[:] = product("q", late, meet)
    share, o, h = _attend(late, q, x, out, padded, space, a)
    at = np.flatnonzero(live.ravel())
    at = at[_by_head(targets.ravel()[at])]
    blocks, slot, want = _dealt(targets.ravel()[at])
    rows = np.zeros(len(want), dtype=np.int64)
    rows[slot] = at
    hs, before = space.rows("hs", flat(h), rows), np.minimum(seen[:, _LATE:].ravel().take(rows), RARE)
    weight = np.zeros(len(want), dtype=h.dtype)
    weight[slot] = 1 / len(at)
    grad: dict = {k: np.zeros_like(m[k]) for k in ("U2", "U3", "U4")}
    loss, dhs, change, names, by_row = 0.0, space("dhs", hs.shape, hs), space("change", hs.shape, hs), [], []
    one, two, three = _digits(m, hs, before, want, blocks, space)
    more, error = _error(*one[:2], weight)
    loss += more
    grad["U1"] = hs.T @ error
    np.matmul(error, m["U1"].T, out=dhs)
    more, error = _error(*two[:2], weight)
    loss += more
    for k, some in _firsts(blocks):
        np.matmul(hs[some].T, error[some], out=grad["U2"][k])
        np.matmul(error[some], m["U2"][k].T, out=change[some])
    dhs += change
    more, error = _error(*three[:2], weight)
    loss += more
    if len(blocks):
        dealt, first = error.reshape(len(blocks), _TOGETHER, -1), np.flatnonzero(np.diff(blocks, prepend=-1))
        grad["U3"][blocks[first]] = np.add.reduceat(product("by_block", hs.reshape(len(blocks), _TOGETHER, WIDTH).transpose(0, 2, 1), dealt), first, axis=0)
        dhs += flat(product("by_factors", dealt, space.rows("factors", m["U3"], blocks).transpose(0, 2, 1)))
    for some, logits, factors, spot, name, row in _rare_steps(m, want):
        more, error = _error(logits + hs[some] @ factors, spot, weight[some])
        of_factors = hs[some].T @ error
        dhs[some] += error @ factors.T
        loss += more
        if name == "U5":
            names.append(row)
            by_row.append(of_factors)
        else:
            grad[name] = of_factors
    grad["U5"] = np.array(names, dtype=np.int64), np.array(by_row).reshape(-1, WIDTH, BAND)
    dh = space("dh", h.shape, h)
    dh[:] = 0
    flat(dh)[at] = dhs[slot]
    of_out = flat(o).T @ flat(dh)
    np.multiply(product("by_out", dh, out.T), share[:, :, None], out=do)
    np.matmul(do, x.transpose(0, 2, 1), out=da)
    da -= np.einsum("ijk,ijk->ij", do, o)[:, :, None]
    da *= a
    dq = product("dq", da, x)
    dx = product("dx", both.reshape(-1, 2 * STRIDE, WINDOW).transpose(0, 2, 1), sides.reshape(-1, 2 * STRIDE, WIDTH))
    of_meet = flat(late).T @ flat(dq)
    dh += product("by_meet", dq, meet.T)
    dx[:, _LATE:] += dh
    grad |= {"Q": of_meet @ m["K"], "K": of_meet.T @ m["Q"], "V": of_out @ m["O"].T, "O": m["V"].T @ of_out, "P": dx.sum(axis=0), "E": _by_code(m, seen, dx)}
    return loss, grad


class Trainer:
    """Adam over a copy of a model; rows of `BY_ROW` parameters move only when a window meets them."""

    def __init__(self, m: dict, rate: float = 0.01):
        self.m = m | {k: m[k].copy() for k in learnt(m)}
        self.rate, self.steps, self.windows = rate, 0, 0
        self.mean, self.var = ({k: np.zeros_like(m[k]) for k in learnt(m)} for _ in range(2))
        self.touched = {k: np.zeros(len(m[k]), dtype=np.float32) for k in BY_ROW}
        self.space = Space()

    def step(self, seen: np.ndarray, targets: np.ndarray, live: np.ndarray, padded: np.ndarray) -> float:
        loss, grad = gradients(self.m, seen, targets, live, padded, self.space)
        self.steps += 1
        self.windows += len(seen)
        for name, g in grad.items():
            rows, g = g if name in BY_ROW else (slice(None), g)
            mean, var = self.mean[name][rows], self.var[name][rows]
            mean *= np.float32(0.9)
            mean += np.float32(0.1) * g
            var *= np.float32(0.99)
            var += np.float32(0.01) * g * g
            times = self.steps
            if name in BY_ROW:
                self.mean[name][rows], self.var[name][rows] = mean, var
                self.touched[name][rows] += 1
                times = self.touched[name][rows].reshape(-1, *[1] * (g.ndim - 1))
            down = np.sqrt(var / (1 - 0.99**times))
            down += np.float32(1e-8)
            self.m[name][rows] -= mean * (self.rate / (1 - 0.9**times)) / down
        return loss
