"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows are tagged O / B-kind / I-kind.  Training is plain back-propagation with
Adam over labelled windows of ``LENGTH`` characters; decoding is Viterbi over a
batch of windows of any one length at once.
"""

from __future__ import annotations

import numpy as np

LENGTH, EMBED, HIDDEN = 64, 10, 16
_SINGLE = "abcdefghijklmnopqrstuvwxyz@.-+()=\"':_%/,"
_CLASSES = {c: i + 1 for i, c in enumerate(_SINGLE)}
#: Class 0 pads training windows; then the characters above, digit, upper case, space, line break, other.
N_CLASSES = len(_SINGLE) + 6
#: Pads a window that is read, at its end: no class.
PAD = 255
_DIGIT, _UPPER, _BLANK, _BREAK, _OTHER = range(len(_SINGLE) + 1, len(_SINGLE) + 6)
_TABLE = np.full(128, _OTHER, np.uint8)
for _c, _i in _CLASSES.items():
    _TABLE[ord(_c)] = _i
_TABLE[48:58] = _DIGIT
_TABLE[65:91] = _UPPER
_TABLE[32] = _BLANK
_TABLE[[9, 10, 11, 12, 13]] = _BREAK


def classes(text: str) -> np.ndarray:
    """Character classes of a text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], _OTHER).astype(np.uint8)


def _squash(x, out=None):
    """A rational curve in the shape of tanh, which costs a few products and a division; flat beyond 3."""
    x = np.clip(x, -3, 3, out=out)
    q = x * x
    top = q + 27
    top *= x
    q *= 9
    q += 27
    return np.divide(top, q, out=out)


def _slope(x):
    """Derivative of ``_squash``."""
    q = np.minimum(x * x, 9)
    return ((9 - q) / (9 + 3 * q)) ** 2


#: Gates are 0.5 + 0.5 * squash(z / 2), as the logistic curve is of tanh; the fourth part of z is no gate.
_HALF = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), HIDDEN)


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def new_model(n_tags: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = {"embed": rng.normal(0, 0.3, (N_CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, n_tags)), "bias": np.zeros(n_tags), "trans": rng.normal(0, 0.1, (n_tags, n_tags)), "begin": np.zeros(n_tags)}
    for d in "fb":
        m["w" + d] = rng.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
        m["c" + d] = np.zeros(4 * HIDDEN)
        m["c" + d][HIDDEN : 2 * HIDDEN] = 1.0
    return {k: v.astype(np.float32) for k, v in m.items()}


def _lstm(m, d, x, keep):
    """Hidden states (T, B, H) of one direction; ``keep`` collects what the backward pass needs."""
    steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    w, c0 = m["w" + d], m["c" + d]
    pre = x @ w[:EMBED] + c0
    rec = w[EMBED:]
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
    for t in steps:
        z = pre[t] + h @ rec
        s = _squash(z[:, : 3 * HIDDEN] * 0.5) * 0.5 + 0.5
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = _squash(z[:, 3 * HIDDEN :])
        before, prior = h, c
        c = f * c + i * g
        u = _squash(c)
        h = o * u
        out[t] = h
        if keep is not None:
            keep.append((t, i, f, o, g, u, prior, before, _slope(z * _HALF) * _HALF**2, _slope(c)))
    return out


def emissions(m, chars) -> np.ndarray:
    """Tag scores (T, K, B) of windows (B, T).

    Both directions go step by step together: the backward one reads the windows
    from their end, and no state comes out of ``PAD`` there, so it changes no score
    before it.  One product gives a step's gates and the scores of the step before
    it, hence one step more than characters.  Of each part of z half its ``_squash``
    is taken, x * (1/18 + (4/3) / (3 + x * x)), so cells are halves too; of these it
    is taken whole, x * (2/9 + (4/3) / (3/4 + x * x)).
    """
    n, length = chars.shape
    n_gates, n_tags = 4 * HIDDEN, len(m["bias"])
    w = np.zeros((2, n_gates + n_tags, EMBED + HIDDEN + 1), np.float32)
    for d, side in zip("fb", w, strict=True):
        side[:n_gates] = _HALF[:, None] * np.vstack([m["w" + d], m["c" + d]]).T
    w[:, n_gates:, EMBED:-1] = m["out"].reshape(2, HIDDEN, n_tags).transpose(0, 2, 1)
    w[0, n_gates:, -1] = m["bias"]
    x = np.take(m["embed"].T.astype(np.float32), chars.T, axis=1, mode="clip")  # (E, T, B)
    given = np.ones((2, EMBED + HIDDEN + 1, n), np.float32)  # embedding, state and one
    state = given[:, EMBED:-1]
    state[:] = 0
    z, q = np.empty((2, n_gates + n_tags, n), np.float32), np.empty((2, n_gates, n), np.float32)
    every, gates, (i, f, o, g) = z[:, :n_gates], z[:, : 3 * HIDDEN], (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    c, u, v = np.zeros((3, 2, HIDDEN, n), np.float32)
    scores = np.zeros((length, n_tags, n), np.float32)
    held = (chars.T != PAD).astype(np.float32)
    padded = (held.min(axis=1) == 0).tolist()
    for t in range(length + 1):
        if t < length:
            given[0, :EMBED], given[1, :EMBED] = x[:, t], x[:, -1 - t]
        np.matmul(w, given, out=z)
        if t > 0:
            scores[t - 1] += z[0, n_gates:]
            scores[-t] += z[1, n_gates:]
        every.clip(-3, 3, out=every)
        np.multiply(every, every, out=q)
        q += 3
        np.divide(4 / 3, q, out=q)
        q += 1 / 18
        every *= q
        gates += 0.5
        np.multiply(i, g, out=u)
        c *= f
        c += u
        c.clip(-1.5, 1.5, out=u)
        np.multiply(u, u, out=v)
        v += 3 / 4
        np.divide(4 / 3, v, out=v)
        v += 2 / 9
        u *= v
        np.multiply(o, u, out=state)
        if t < length and padded[-1 - t]:
            state[1] *= held[-1 - t]
            c[1] *= held[-1 - t]
    return scores


def _open_stretches(e, trans, weak, n):
    """Stretches (window, first, end) of scores (T, K, B) of windows of ``n`` characters outside which tag 0 is right,
    with the character on each side.

    Where tag 0 beats each other tag by more than the transitions from and to any
    neighbours can bring, every best path has it; between two such characters, other
    tags need a ``weak`` one.
    """
    gain = np.maximum(0, (trans - trans[:, :1]).max(axis=0)) + np.maximum(0, (trans - trans[:1]).max(axis=1))
    free = weak | ((e[:, 1:] + (gain[1:, None] + 1e-3)).max(axis=1) >= e[:, 0])
    free &= np.arange(len(e))[:, None] < n
    edge = np.diff(np.pad(free.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (window, first), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    before = np.pad(np.cumsum(weak.T, axis=1), ((0, 0), (1, 0)))
    held = before[window, end] > before[window, first]
    return window[held], np.maximum(first[held] - 1, 0), np.minimum(end[held] + 1, n[window[held]])


def viterbi(m, chars) -> np.ndarray:
    """Best tags (B, T) of windows (B, T), 0 for ``PAD`` at their ends.

    A window in which tag 0 beats all others at each character, by more than any
    transitions can bring, is 0 throughout; of the rest, what may hold another tag is
    decoded, stretches of about one length together.
    """
    e, trans = emissions(m, chars), m["trans"].astype(np.float32)
    e[0] += m["begin"].astype(np.float32)[:, None]
    tags = np.zeros(chars.shape, np.uint8)
    stay, away = trans[0, 0], trans[1:, 1:].max()
    gain = max(0.0, trans[0, 1:].max() - stay) + max(0.0, trans[1:, 0].max() - stay) + max(0.0, away - stay)
    n_chars = (chars != PAD).sum(axis=1)
    weak = (e[:, 1:].max(axis=1) - e[:, 0] >= -gain) & (np.arange(len(e))[:, None] < n_chars)
    unsure = np.flatnonzero(weak.any(axis=0))
    if not len(unsure):
        return tags
    e = e[:, :, unsure]
    window, first, end = _open_stretches(e, trans, weak[:, unsure], n_chars[unsure])
    order = np.argsort(first - end, kind="stable")
    window, first, length = window[order], first[order], (end - first)[order]
    done = 0
    while done < len(order):
        longest = int(length[done])
        here = slice(done, done + max(1, chars.size // (len(trans) * longest)))
        w, a, n = window[here], first[here], length[here]
        at = np.minimum(a + np.arange(longest)[:, None], len(e) - 1)
        best = np.ascontiguousarray(e[at, :, w].transpose(0, 2, 1))
        for t in range(1, longest):  # the best score that ends in each tag takes the place of its emission
            best[t] += (best[t - 1][:, None] + trans[:, :, None]).max(axis=0)
        tag = np.zeros(len(w), np.int64)
        for t in range(longest - 1, -1, -1):
            tag = (best[t] + np.where(t < n - 1, trans[:, tag], 0)).argmax(axis=0)
            live = np.count_nonzero(n > t)
            tags[unsure[w[:live]], a[:live] + t] = tag[:live]
        done = here.stop
    return tags


def _gradient(m, chars, tags):
    """Mean negative log-likelihood and its gradient."""
    n, length = chars.shape
    x = m["embed"][chars.T]
    kept = {"f": [], "b": []}
    hidden = {d: _lstm(m, d, x, kept[d]) for d in "fb"}
    states = np.concatenate([hidden["f"], hidden["b"]], axis=2)
    e = states @ m["out"] + m["bias"]
    trans, k = m["trans"], m["trans"].shape[0]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + m["begin"]
    for t in range(1, length):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(length - 2, -1, -1):
        beta[t] = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _lse(alpha[-1], 1)
    rows, gold = np.arange(n), tags.T
    path = (m["begin"][gold[0]] + e[0][rows, gold[0]]).astype(np.float64)
    for t in range(1, length):
        path += trans[gold[t - 1], gold[t]] + e[t][rows, gold[t]]
    de = np.exp(alpha + beta - total[None, :, None])
    g = {"begin": de[0].sum(0), "trans": np.zeros_like(trans)}
    for t in range(length - 1):
        pair = alpha[t][:, :, None] + trans + (e[t + 1] + beta[t + 1])[:, None, :] - total[:, None, None]
        g["trans"] += np.exp(pair).sum(0)
    np.add.at(g["trans"], (gold[:-1].ravel(), gold[1:].ravel()), -1)
    np.add.at(g["begin"], gold[0], -1)
    for t in range(length):
        de[t][rows, gold[t]] -= 1
    flat = de.reshape(-1, k)
    g["out"], g["bias"] = states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
    ds = de @ m["out"].T
    dx = np.zeros_like(x)
    for d, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
        w = m["w" + d]
        gw, gc = np.zeros_like(w), np.zeros_like(m["c" + d])
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t, i, f, o, gg, u, prior, before, steep, steep_cell in reversed(kept[d]):
            dh = dh + part[t]
            dc = dc + dh * o * steep_cell
            dz = np.concatenate([dc * gg, dc * prior, dh * u, dc * i], axis=1) * steep
            gw[:EMBED] += x[t].T @ dz
            gw[EMBED:] += before.T @ dz
            gc += dz.sum(0)
            dx[t] += dz @ w[:EMBED].T
            dh, dc = dz @ w[EMBED:].T, dc * f
        g["w" + d], g["c" + d] = gw, gc
    g["embed"] = np.zeros_like(m["embed"])
    np.add.at(g["embed"], chars.T.ravel(), dx.reshape(-1, EMBED))
    return float((total - path).mean()), {a: b / n for a, b in g.items()}


def train(chars: np.ndarray, tags: np.ndarray, n_tags: int, steps: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 11) -> dict[str, np.ndarray]:
    """Fit a model to labelled windows (B, T)."""
    m = new_model(n_tags, seed)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(chars), min(batch, len(chars)))
        _, g = _gradient(m, chars[pick], tags[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            m[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m
