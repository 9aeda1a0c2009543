"""A gated recurrent language model with a class-factored softmax, in numpy.

A token is predicted in two steps, its class and then the word within the
class: P(w | h) = P(class | h) P(w | class, h). The commonest words have
classes of their own making (``WORD_CLASSES`` of ``CLASS_WORDS``); every other
word belongs to one of ``RARE_CLASSES`` classes by its ending, and its share
within the class is its share in the corpus. Training is truncated
backpropagation through time with Adam; scoring runs many texts side by side
and carries each text's state from window to window to the text's end.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WORD_CLASSES, CLASS_WORDS, RARE_CLASSES = 16, 32, 32, 64
WORDS = WORD_CLASSES * CLASS_WORDS
CLASSES, SYMBOLS = WORD_CLASSES + RARE_CLASSES, WORDS + RARE_CLASSES
#: Steps of a window of training and of scoring; streams trained side by side at first, and where much is read.
TRAIN_STEPS, SCORE_STEPS, STREAMS, MORE_STREAMS = 20, 64, 32, 128
#: Tokens whose softmax is computed at a time, in scoring and in training.
CHUNK, TRAIN_CHUNK = 1 << 13, 1 << 11

SHAPES = {"inputs": (SYMBOLS, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN), "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,), "word_w": (WORD_CLASSES, HIDDEN, CLASS_WORDS), "word_b": (WORD_CLASSES, CLASS_WORDS)}

SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def class_of(symbols: np.ndarray) -> np.ndarray:
    """Symbols are the words, by class, and then one for each rare class."""
    return np.where(symbols < WORDS, symbols // CLASS_WORDS, symbols - WORDS + WORD_CLASSES)


def initial(word_mass: np.ndarray, rare_mass: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """A model that starts from the corpus shares of the words and of the rare classes."""
    rng = np.random.default_rng(seed)
    own = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    words = np.maximum(word_mass.reshape(WORD_CLASSES, CLASS_WORDS), 1e-12)
    own["class_b"] = np.log(np.concatenate([words.sum(1), np.maximum(rare_mass, 1e-12)])).astype(np.float32)
    own["word_b"] = np.log(words).astype(np.float32)
    own["inputs"][:, :HIDDEN] += 1  # keep more of the state at first
    return own


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def views(values: np.ndarray) -> dict[str, np.ndarray]:
    """The weights as views of one vector."""
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = values[at : at + n].reshape(shape)
        at += n
    return out


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    return views(values.astype(np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _sigmoid_in_place(x: np.ndarray) -> np.ndarray:
    half = x.dtype.type(0.5)
    x *= half
    np.tanh(x, out=x)
    x *= half
    x += half
    return x


def step(model: dict[str, np.ndarray], h: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """(next state, update gate, reset gate, new content, recurrent content) after reading the symbols."""
    x = model["inputs"][symbols]
    u = h @ model["recur"]
    gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r, inner = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
    new = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
    return new + z * (h - new), z, r, new, inner


def _exponentials(w: np.ndarray, b: np.ndarray, state: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(e^logit, their sums, the logit of each row's chosen class); classes go down, so that the sums run over whole rows of memory.

    The largest logit is taken off only where the sums would leave the numbers' range.
    """
    def logits() -> np.ndarray:
        x = w.T @ state.T
        x += b[:, None]
        return x

    rows = np.arange(len(chosen))
    x = logits()
    own = x[chosen, rows]
    with np.errstate(over="ignore"):
        sums = np.exp(x, out=x).sum(0)
    if not (sums.min(initial=1) > 1e-30 and sums.max(initial=1) < 1e30):
        x = logits()
        x -= x.max(0)
        own = x[chosen, rows]
        sums = np.exp(x, out=x).sum(0)
    return x, sums, own


def _pick(w: np.ndarray, b: np.ndarray, state: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log-softmax of each row's chosen class."""
    _, sums, own = _exponentials(w, b, state, chosen)
    return own - np.log(sums)


def log_probabilities(model: dict[str, np.ndarray], h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(symbol | h), row by row."""
    out = np.empty(len(symbols), np.float64)
    for at in range(0, len(symbols), CHUNK):
        state, own = h[at : at + CHUNK], symbols[at : at + CHUNK]
        classes = class_of(own)
        part = _pick(model["class_w"], model["class_b"], state, classes)
        words = np.flatnonzero(own < WORDS)
        order = words[np.argsort(classes[words], kind="stable")]
        ends = np.searchsorted(classes[order], np.arange(WORD_CLASSES + 1))
        for c in range(WORD_CLASSES):
            rows = order[ends[c] : ends[c + 1]]
            if len(rows):
                part[rows] += _pick(model["word_w"][c], model["word_b"][c], state[rows], own[rows] - c * CLASS_WORDS)
        out[at : at + CHUNK] = part
    return out


def score(model: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """The natural log-likelihood of each whole text (symbols, the end included)."""
    total = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    length = np.array([len(texts[i]) for i in order], np.int64)
    symbols = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(texts) else length
    # features go down and texts along, as in training; what the steps do is step()'s
    h, recur = np.zeros((HIDDEN, len(texts)), np.float32), np.ascontiguousarray(model["recur"].T)
    for begin in range(0, int(length.max(initial=0)), SCORE_STEPS):
        end = min(begin + SCORE_STEPS, int(length[0]))
        counts = np.searchsorted(-length, -np.arange(begin, end))  # texts longer than t
        at = np.concatenate([[0], np.cumsum(counts)])
        seen, states = np.empty(at[-1], np.int64), np.empty((at[-1], HIDDEN), np.float32)
        for t, n, low, high in zip(range(begin, end), counts, at, at[1:], strict=False):
            own = seen[low:high] = symbols[start[:n] + t]
            if n < h.shape[1]:
                h = np.ascontiguousarray(h[:, :n])
            states[low:high] = h.T
            x, u = np.ascontiguousarray(model["inputs"][own].T), recur @ h
            x[: 2 * HIDDEN] += u[: 2 * HIDDEN]
            both = _sigmoid_in_place(x[: 2 * HIDDEN])
            new = u[2 * HIDDEN :]
            new *= both[HIDDEN:]
            new += x[2 * HIDDEN :]
            np.tanh(new, out=new)
            h -= new
            h *= both[:HIDDEN]
            h += new
        whose = np.arange(at[-1]) - np.repeat(at[:-1], counts)
        total += np.bincount(whose, log_probabilities(model, states, seen), len(texts))
    out = np.empty(len(texts))
    out[order] = total
    return out


# -- training -----------------------------------------------------------------


def _loss(w: np.ndarray, b: np.ndarray, state: np.ndarray, chosen: np.ndarray, scale: np.floating) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(gradients of w, b and state, summed loss) of a softmax of which a class is chosen a row."""
    d, sums, own = _exponentials(w, b, state, chosen)
    loss = float(np.log(sums).sum() - own.sum())
    d *= scale / sums
    d[chosen, np.arange(len(chosen))] -= scale
    return (d @ state).T, d.sum(1), (w @ d).T, loss


def gradients(model: dict[str, np.ndarray], h: np.ndarray, window: np.ndarray, fresh: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(gradients, state after the window, mean loss) of a window (steps, streams); fresh marks the steps at which a text begins."""
    steps, n = window.shape
    own, size = window.ravel(), steps * n
    kind = model["recur"].dtype
    # features go down and streams along, so that each gate is whole rows of memory
    states, news, inners = (np.empty((steps, HIDDEN, n), kind) for _ in range(3))
    gates, keep, recur = np.empty((steps, 2 * HIDDEN, n), kind), ~fresh, np.ascontiguousarray(model["recur"].T)
    inputs = np.ascontiguousarray(model["inputs"][window].transpose(0, 2, 1))
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        before = np.multiply(h, keep[t], out=states[t])
        u, x = recur @ before, inputs[t]
        both = _sigmoid_in_place(np.add(x[: 2 * HIDDEN], u[: 2 * HIDDEN], out=gates[t]))
        inners[t] = u[2 * HIDDEN :]
        new = np.multiply(both[HIDDEN:], inners[t], out=news[t])
        new += x[2 * HIDDEN :]
        np.tanh(new, out=new)
        h = before - new
        h *= both[:HIDDEN]
        h += new
    state = states.transpose(0, 2, 1).reshape(size, HIDDEN)
    classes, scale = class_of(own), kind.type(1 / size)
    g, dh_out, loss = {k: np.zeros_like(model[k]) for k in ("class_w", "class_b")}, np.empty((size, HIDDEN), kind), 0.0
    for at in range(0, size, TRAIN_CHUNK):
        to = slice(at, at + TRAIN_CHUNK)
        d_w, d_b, dh_out[to], more = _loss(model["class_w"], model["class_b"], state[to], classes[to], scale)
        g["class_w"] += d_w
        g["class_b"] += d_b
        loss += more
    g["word_w"], g["word_b"] = np.zeros_like(model["word_w"]), np.zeros_like(model["word_b"])
    # by class, the rare ones last; sixteen bits are sorted by radix
    order = np.argsort(classes.astype(np.int16), kind="stable")
    ends = np.searchsorted(classes[order], np.arange(WORD_CLASSES + 1))
    order = order[: ends[-1]]
    by_class, inner, d_class = state[order], own[order] % CLASS_WORDS, np.empty((len(order), HIDDEN), kind)
    for c in np.flatnonzero(np.diff(ends)):
        at = slice(ends[c], ends[c + 1])
        g["word_w"][c], g["word_b"][c], d_class[at], more = _loss(model["word_w"][c], model["word_b"][c], by_class[at], inner[at], scale)
        loss += more
    dh_out[order] += d_class
    dh_out = np.ascontiguousarray(dh_out.reshape(steps, n, HIDDEN).transpose(0, 2, 1))
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    # what each step's gradient is multiplied by, for all steps at once
    to_new, to_z = (1 - z) * (1 - news * news), (states - news) * z * (1 - z)
    to_r = inners * r * (1 - r)
    dh = np.zeros_like(h)
    dx, du = np.empty((steps, 3 * HIDDEN, n), kind), np.empty((steps, 3 * HIDDEN, n), kind)
    for t in reversed(range(steps)):
        d_new = np.multiply(dh, to_new[t], out=dx[t, 2 * HIDDEN :])
        np.multiply(dh, to_z[t], out=dx[t, :HIDDEN])
        np.multiply(d_new, to_r[t], out=dx[t, HIDDEN : 2 * HIDDEN])
        du[t, : 2 * HIDDEN] = dx[t, : 2 * HIDDEN]
        np.multiply(d_new, r[t], out=du[t, 2 * HIDDEN :])
        dh *= z[t]
        dh += model["recur"] @ du[t]
        dh += dh_out[t]
        dh *= keep[t]
    g["recur"] = (states @ du.transpose(0, 2, 1)).sum(0)
    dx = dx.transpose(0, 2, 1).reshape(size, 3 * HIDDEN)
    g["inputs"] = np.zeros_like(model["inputs"])
    order = np.argsort(own.astype(np.int16), kind="stable")
    sorted_own = own[order]
    first = np.flatnonzero(np.diff(sorted_own, prepend=-1))
    g["inputs"][sorted_own[first]] = np.add.reduceat(dx[order], first, axis=0)
    return g, np.ascontiguousarray(h.T), loss / size


def train(model: dict[str, np.ndarray], texts: list[np.ndarray], rate: float = 0.01, passes: int = 1, streams: int = STREAMS) -> tuple[dict[str, np.ndarray], int]:
    """(a trained copy, tokens read): the texts are laid end to end over parallel streams, whose states go on from window to window."""
    now = flat(model)
    own = views(now)
    mean, square = np.zeros_like(now), np.zeros_like(now)
    tokens = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    first = np.zeros(len(tokens), bool)
    first[np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64) if texts else []] = True
    streams = max(1, min(streams, len(tokens) // TRAIN_STEPS))
    steps = -(-len(tokens) // streams)
    # the last stream is filled up from the beginning, so that no token is left out
    lanes, starts = np.resize(tokens, (streams, steps)).T, np.resize(first, (streams, steps)).T.copy()
    total, k = passes * -(-steps // TRAIN_STEPS), 0
    for _ in range(passes):
        h = np.zeros((streams, HIDDEN), np.float32)
        for at in range(0, steps, TRAIN_STEPS):
            parts, h, _ = gradients(own, h, lanes[at : at + TRAIN_STEPS].astype(np.int64), starts[at : at + TRAIN_STEPS])
            k += 1
            pace = rate * (1 - 0.9 * k / total) * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
            x = flat(parts)
            x *= np.float32(min(1, 1 / (np.sqrt(float(x @ x)) + 1e-9)))
            mean += np.float32(0.1) * (x - mean)
            x *= x
            square += np.float32(0.001) * (x - square)
            np.sqrt(square, out=x)
            x += np.float32(1e-8)
            np.divide(mean, x, out=x)
            now -= np.float32(pace) * x
    return own, passes * len(tokens)
