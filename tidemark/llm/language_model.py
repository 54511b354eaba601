"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Texts are read once into blocks: a block's tokens as indices into its own list
of distinct words, which are keyed by 64-bit hashes.  The neural model has two
levels: the most frequent words are classes of their own (a fixed number), and
one class is the rest.  Every word of the rest seen at least twice in training
has a context vector and a target vector of its own (a few small numbers each),
so the vocabulary follows the corpus; singletons and unseen words share one,
zero.  With R and Q the classes' context and target vectors, C1 and C2 the
position matrices, r and q the words' own vectors, c the class, and P and G
directions taken from R and R C1,

    log P(c | u, v) = ((R[u] + r[u] P) C1 + (R[v] + r[v] P) C2) . Q[c] + b[c] - log Z(u, v)
    log P(w | rest, u) = log(n[w] + 1) + G[c(u)] . q[w] - log Z(c(u))

Z(u, v) is summed over the classes for each position (from a table where both
are classes), Z(c) over all words of the rest by one aggregation, so
probabilities over all words add up to one.  A word of the rest is told from
others of the rest by the class of the word before it, not by that word's own
vector.

Training runs where the blocks are.  The rounds share out the training
positions: each is an example of the classes in exactly one; a task fits the
classes to its blocks and the tasks' parameters are averaged in a tree.  Then
each block fits its words' own vectors to all its positions.  One exchange by
word adds up the word's corpus count and averages its vectors, and one by block
brings both back: no vocabulary is broadcast or gathered, and classes, whose
rows would be the hottest, take no part in it.  Results depend slightly on how
the input is split, since tasks train apart and are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored, texts
from .textvec import Block, text_blocks

CLASSES, WIDTH, NOISE, ROUNDS = 256, 16, 48, 2
#: Numbers in each of a word's own two vectors, their steps per unit, and the training count from which it has them.
OWN, STEPS, LEAST_SEEN = 4, 32.0, 2
BATCH, RATE, WORD_BATCH, WORD_RATE = 2048, 0.08, 2048, 0.2
#: Positions scored against all classes at once: their rows fit in a core's cache.
SCORE_ROWS = 512
_PLACE_BITS = 26
#: Text bytes whose tokens form one block; frequent words that a block proposes as classes.
CHUNK_BYTES, PROPOSED = 8 << 20, 4 * CLASSES
#: Parameter sets averaged by one task of the tree.
FAN_IN = 32
#: The end of a text, as a word hash; class 1 (class 0 is the rest).
END = np.uint64(0x5BD1E995_C2B2AE35)


def _press(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers cost next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).data)


def _unpress(x: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


_BLOCK = "block long, docs binary, held binary, lengths binary, tokens binary, words binary, seen binary, learned long, top_words array<long>, top_seen array<long>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"array<long>": pa.list_(pa.int64()), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _read(batches):
    """A row for each block: its tokens, its distinct words with their training counts, and its most frequent ones."""
    task = TaskContext.get().partitionId() << 12
    number = 0
    ids, nulls, held, lengths, hashes, size = [], [], [], [], [], 0

    def flush():
        nonlocal number, ids, nulls, held, lengths, hashes, size
        out_held, n = np.concatenate(held), np.concatenate(lengths)
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        learn = np.repeat(~out_held, n)
        seen = np.bincount(place[learn], minlength=len(words))
        by_count = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")  # small numbers for common words
        new = np.empty(len(words), np.int64)
        new[by_count] = np.arange(len(words))
        words, seen = words[by_count].view(np.int64), seen[by_count]
        top = np.lexsort((words, -seen))[:PROPOSED]
        top = top[seen[top] > 0]
        row = {"block": task + number, "docs": _press(np.stack([np.concatenate(ids), np.concatenate(nulls)])), "held": _press(out_held), "lengths": _press(n), "tokens": _press(new[place].astype(np.uint32))}
        row |= {"words": words.tobytes(), "seen": _press(seen), "learned": int(learn.sum()), "top_words": words[top].tolist(), "top_seen": seen[top].tolist()}
        number += 1
        ids, nulls, held, lengths, hashes, size = [], [], [], [], [], 0
        return pa.RecordBatch.from_pylist([row], _schema(_BLOCK))

    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column("text")):
            found = Block(data, offsets, lower=True)
            n = found.n_words
            at = np.cumsum(n + 1)
            words = np.full(int(at[-1]), END)
            put = np.ones(len(words), bool)
            put[at - 1] = False
            words[put] = found.hash
            names = batch.column("doc_id").slice(a, b - a)
            ids.append(names.fill_null(0).to_numpy())
            nulls.append(names.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
            held.append(batch.column("held_out").slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool))
            lengths.append(n + 1)
            hashes.append(words)
            size += len(data)
            if size >= CHUNK_BYTES:
                yield flush()
    if ids:
        yield flush()


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(held, lengths, tokens) of a block."""
    return _unpress(row["held"], bool), _unpress(row["lengths"], np.int64), _unpress(row["tokens"], np.uint32)


class Model:
    """Parameters of the log-bilinear model over class numbers."""

    NAMES = ("r", "q", "c1", "c2", "b")

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        v = len(unigram)
        self.unigram = unigram
        self.r, self.q = rng.normal(0, 0.15, (v, WIDTH)), rng.normal(0, 0.15, (v, WIDTH))
        self.c1, self.c2 = np.eye(WIDTH), np.eye(WIDTH) * 0.5
        self.b = np.log(unigram)
        for n in self.NAMES:
            setattr(self, n, getattr(self, n).astype(np.float32))

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for n in self.NAMES:
            x = getattr(self, n)
            setattr(self, n, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def noise(self, rng) -> np.ndarray:
        cumulative = np.cumsum(self.unigram)
        return np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(cumulative) - 1)

    def errors(self, hat: np.ndarray, t: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """NCE errors of the examples' classes and of the noise: 1 - P(data), and -P(data)."""
        offset = self.b - np.log(NOISE * self.unigram).astype(np.float32)
        good = (hat * self.q[t]).sum(1) + offset[t]
        bad = hat @ self.q[noise].T + offset[noise]
        return 1 / (1 + np.exp(np.clip(good, -30, 30))), -1 / (1 + np.exp(-np.clip(bad, -30, 30)))

    def fit(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng, state: dict) -> None:
        """One pass of NCE over examples: class ``w`` follows ``u``, which follows ``v``."""
        for k in range(0, len(w), BATCH):
            a, c, t = u[k : k + BATCH], v[k : k + BATCH], w[k : k + BATCH]
            hat, noise = (self.r @ self.c1)[a] + (self.r @ self.c2)[c], self.noise(rng)
            e_good, e_bad = self.errors(hat, t, noise)
            d_hat = e_good[:, None] * self.q[t] + e_bad @ self.q[noise]
            g_q, d_1, d_2 = np.zeros_like(self.q), np.zeros_like(self.r), np.zeros_like(self.r)
            g_b = np.bincount(t, e_good, len(self.b)).astype(np.float32)
            np.add.at(g_b, noise, e_bad.sum(0))
            _add_rows(g_q, t, e_good[:, None] * hat)
            np.add.at(g_q, noise, e_bad.T @ hat)
            _add_rows(d_1, a, d_hat)
            _add_rows(d_2, c, d_hat)
            for n, g in (("q", g_q), ("b", g_b), ("r", d_1 @ self.c1.T + d_2 @ self.c2.T), ("c1", self.r.T @ d_1), ("c2", self.r.T @ d_2)):
                g = g / len(t)
                state[n] = state.get(n, 1e-6) + g * g
                setattr(self, n, getattr(self, n) + RATE * g / np.sqrt(state[n]))

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        """P, along which words' own vectors move their context, and G, what each class says of the word of the rest after it."""
        share = np.sqrt(self.unigram / self.unigram.sum())[:, None]

        def leading(x):
            x = x - (share**2 * x).sum(0)
            _, size, axes = np.linalg.svd(share * x, full_matrices=False)
            return x, axes[:OWN], np.maximum(size[:OWN], 1e-3)

        _, axes, size = leading(self.r.astype(float))
        after, turned, spread = leading((self.r @ self.c1).astype(float))
        return (axes * size[:, None]).astype(np.float32), (after @ turned.T / spread).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair scores by each context position, and log Z of every class pair, as 32-bit floats."""
        one, two = self.r @ self.c1 @ self.q.T + self.b, self.r @ self.c2 @ self.q.T
        log_z = np.empty((len(one), len(one)), np.float32)
        for u in range(len(one)):
            s = two + one[u]
            top = s.max(1)
            log_z[u] = np.log(np.exp(s - top[:, None]).sum(1)) + top
        return one, two, log_z


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``out[rows] += values``, equal rows summed."""
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    cuts = np.flatnonzero(np.diff(ranked, prepend=-1))
    out[ranked[cuts]] += np.add.reduceat(values[order], cuts)


class Own:
    """Own vectors of a block's words: ``r`` as context, ``q`` as target; those of classes stay zero."""

    def __init__(self, n: int):
        self.r, self.q = np.zeros((n, OWN), np.float32), np.zeros((n, OWN), np.float32)
        self._state = {name: np.ones((n, OWN), np.float32) for name in "rq"}

    def _learn(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        cuts = np.flatnonzero(np.diff(ranked, prepend=-1))
        g, rows, state = np.add.reduceat(gradient[order], cuts), ranked[cuts], self._state[name]
        state[rows] += g * g
        getattr(self, name)[rows] += WORD_RATE * g / np.sqrt(state[rows])

    def fit(self, model: Model, p: np.ndarray, g: np.ndarray, classes: np.ndarray, at: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng) -> None:
        """One pass of NCE over the positions ``at``, the classes' parameters held fixed; ``u``, ``v``, ``w`` are word numbers (-1: none)."""
        pool = w[at]
        pool = pool[classes[pool] == 0]
        c1, c2, r1, r2 = p @ model.c1, p @ model.c2, model.r @ model.c1, model.r @ model.c2
        for k in range(0, len(at), WORD_BATCH):
            here = at[k : k + WORD_BATCH]
            a, c, t = u[here], v[here], w[here]
            ca, cc, ct = np.where(a < 0, 1, classes[a]), np.where(c < 0, 1, classes[c]), classes[t]
            hat = r1[ca] + r2[cc] + self.r[a] @ c1 + self.r[c] @ c2
            noise = model.noise(rng)
            e_good, e_bad = model.errors(hat, ct, noise)
            d_hat = e_good[:, None] * model.q[ct] + e_bad @ model.q[noise]
            for rows, kind, turn in ((a, ca, c1), (c, cc, c2)):
                mine = np.flatnonzero(kind == 0)
                if len(mine):
                    self._learn("r", rows[mine], d_hat[mine] @ turn.T)
            rest = np.flatnonzero(ct == 0)
            if len(rest):  # which word of the rest, told apart from others drawn by their counts
                context, drawn = g[ca[rest]], rng.choice(pool, NOISE)
                e_own = 1 / (1 + np.exp(np.clip((context * self.q[t[rest]]).sum(1), -30, 30)) / NOISE)
                e_drawn = -1 / (1 + NOISE * np.exp(-np.clip(context @ self.q[drawn].T, -30, 30)))
                self._learn("q", np.concatenate([t[rest], drawn]), np.concatenate([e_own[:, None] * context, e_drawn.T @ context]))

    def packed(self) -> np.ndarray:
        """Both vectors of each word in eight bytes."""
        flat = np.concatenate([self.r, self.q], axis=1)
        return np.ascontiguousarray(np.clip(np.rint(flat * STEPS), -127, 127).astype(np.int8)).view(np.int64).ravel()


def _log_share(s: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of each row's chosen share of its exponentials; ``s`` is used up."""
    mine = s[np.arange(len(s)), chosen]
    top = s.max() if len(s) else 0.0
    if top > 60 or s.min() < -60:  # beyond what 32-bit exponentials of a whole row can hold for certain
        s = s - s.max(axis=1, keepdims=True)
        mine = s[np.arange(len(s)), chosen]
    np.exp(s, out=s)
    return mine - np.log(s.sum(1))


def _vectors(packed: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(packed).view(np.int8).reshape(-1, 2 * OWN).astype(np.float32) / np.float32(STEPS)


def _contexts(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's word and the two before it; a text begins after two ends, given as -1."""
    w = tokens.astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    u, v = np.empty_like(w), np.empty_like(w)
    u[1:], v[2:] = w[:-1], w[:-2]
    u[begin] = -1
    v[:2] = -1
    v[begin] = -1
    v[begin[lengths > 1] + 1] = -1
    return w, u, v


def _classes(words: np.ndarray, top: np.ndarray, number: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(top, words), len(top) - 1)
    return np.where(top[at] == words, number[at], 0).astype(np.int16)


def _examples(held: np.ndarray, lengths: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """The positions of round ``r``; over all rounds, each position of the texts not held out once."""
    return np.flatnonzero(np.repeat(~held, lengths))[r::rounds]


_WORD = "place long, word long, seen int, vector long"
_BACK = "block long, place long, seen long, vector long, first boolean"


def _mean(batches):
    """Rows sorted by word: each gets the word's corpus count and its vectors averaged over its blocks by their occurrences."""

    def settle(rows: pa.Table):
        word, seen = rows.column("word").to_numpy(), rows.column("seen").to_numpy().astype(np.int64)
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        cuts = np.flatnonzero(first)
        total = np.add.reduceat(seen, cuts)
        flat = rows.column("vector").to_numpy().view(np.int8).reshape(-1, 2 * OWN)
        mean = np.rint(np.add.reduceat(flat * seen[:, None], cuts) / np.maximum(total, 1)[:, None]).astype(np.int8)
        mean[total < LEAST_SEEN] = 0
        back = np.cumsum(first) - 1
        place, mean = rows.column("place").to_numpy(), np.ascontiguousarray(mean).view(np.int64).ravel()
        for k in range(0, len(word), 100_000):
            here = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(place[here] >> _PLACE_BITS), pa.array(place[here]), pa.array(total[back[here]]), pa.array(mean[back[here]]), pa.array(first[here])], schema=_schema(_BACK))

    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            word = rows.column("word").to_numpy()
            cut = int(np.searchsorted(word, word[-1], "left"))
            if cut:
                yield from settle(rows.slice(0, cut))
            held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield from settle(held)


_NARROW = "block long, docs binary, held binary, lengths binary, tokens binary, classes binary"
_EQUIPPED = f"{_NARROW}, seen binary, vectors binary, first binary"


def _average(batches):
    total, weight = 0.0, 0.0
    for batch in batches:
        for flat, w in zip(batch.column("flat").to_pylist(), batch.column("weight").to_pylist(), strict=True):
            total, weight = total + w * np.frombuffer(flat), weight + w
    if weight:
        yield _set(total / weight, weight)


def _added(batches):
    total = 0.0
    for batch in batches:
        for flat in batch.column("flat").to_pylist():
            total = total + np.frombuffer(flat)
    if np.ndim(total):
        yield _set(total, 1.0)


def _set(numbers: np.ndarray, weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(numbers, np.float64).tobytes()], pa.binary()), pa.array([float(weight)])], ["flat", "weight"])


_SET = "flat binary, weight double"


class Scorer:
    """A trained model with the corpus counts it needs to score blocks."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        self.parts = blocks.rdd.getNumPartitions()
        self.n = int(blocks.agg(F.sum("learned")).first()[0] or 0)
        end = int(END.view(np.int64))
        pair = F.explode(F.arrays_zip("top_words", "top_seen")).alias("t")
        counts = blocks.select(pair).groupBy(F.col("t.top_words").alias("word")).agg(F.sum("t.top_seen").alias("seen"))
        best = counts.where(F.col("word") != end).orderBy(F.desc("seen"), "word").limit(CLASSES - 2).collect()
        words = np.array([end, *(r["word"] for r in best)], np.int64)
        order = np.argsort(words)
        self.top, self.number = words[order], (np.arange(len(words)) + 1)[order]
        top, number, size = self.top, self.number, len(words) + 1

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    classes = _classes(np.frombuffer(row["words"], np.int64), top, number)
                    yield _set(np.bincount(classes, _unpress(row["seen"], np.int64), size), 1.0)

        found = self._by_tree(blocks.select("words", "seen").mapInArrow(run, _SET), self.parts, _added)
        #: Exact training counts by class, that of the rest at 0.
        self.seen = np.zeros(size, np.int64) if found is None else np.rint(found).astype(np.int64)
        self.model = Model((self.seen + 1) / (self.n + size))

    def train(self, rounds: int = ROUNDS) -> Scorer:
        """Fit the classes where the blocks are, then average; each round starts from the last average.  Then the words' own vectors."""
        unigram, top, number = self.model.unigram, self.top, self.number
        for r in range(rounds):
            start = self.model.vector()

            def run(batches, start=start, r=r):
                model, state, weight = Model(unigram).load(start), {}, 0
                for batch in batches:
                    for row in batch.to_pylist():
                        held, lengths, tokens = _unpack(row)
                        w, u, v = _contexts(tokens, lengths)
                        classes = np.append(_classes(np.frombuffer(row["words"], np.int64), top, number), np.int16(1))  # -1: the end
                        at = np.random.default_rng((17, r, row["block"])).permutation(_examples(held, lengths, r, rounds))
                        model.fit(classes[u[at]], classes[v[at]], classes[w[at]], np.random.default_rng((19, r, row["block"])), state)
                        weight += len(at)
                if weight:
                    yield _set(model.vector(), weight)

            averaged = self._by_tree(self.blocks.select("block", "held", "lengths", "tokens", "words").mapInArrow(run, _SET), self.parts, _average)
            if averaged is not None:
                self.model.load(averaged)
        self._equip()
        self._normalise()
        return self

    def _equip(self) -> None:
        """Blocks with the corpus counts and own vectors of their words."""
        model, top, number, seen_by_class = self.model, self.top, self.number, self.seen
        self.p, self.g = p, g = model.directions()

        def learn(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    held, lengths, tokens = _unpack(row)
                    words, seen = np.frombuffer(row["words"], np.int64), _unpress(row["seen"], np.int64)
                    classes = _classes(words, top, number)
                    rng = np.random.default_rng((23, row["block"]))
                    own = Own(len(words) + 1)  # the last row is that of no word
                    own.fit(model, p, g, classes, rng.permutation(_examples(held, lengths, 0, 1)), *(_contexts(tokens, lengths)[k] for k in (1, 2, 0)), rng)
                    which, packed = np.flatnonzero(classes == 0), own.packed()
                    for k in range(0, len(which), 100_000):
                        here = which[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(here + (row["block"] << _PLACE_BITS)), pa.array(words[here]), pa.array(seen[here].astype(np.int32)), pa.array(packed[here])], schema=_schema(_WORD))

        def narrow(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    classes = _classes(np.frombuffer(row["words"], np.int64), top, number)
                    kept = {k: row[k] for k in ("block", "docs", "held", "lengths", "tokens")}
                    yield pa.RecordBatch.from_pylist([kept | {"classes": _press(classes)}], _schema(_NARROW))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            classes = _unpress(row["classes"], np.int16)
            seen, vectors, first = seen_by_class[classes], np.zeros(len(classes), np.int64), np.zeros(len(classes), bool)
            if right.num_rows:
                at = right.column("place").to_numpy() & ((1 << _PLACE_BITS) - 1)
                seen[at], vectors[at], first[at] = right.column("seen").to_numpy(), right.column("vector").to_numpy(), right.column("first").to_numpy(zero_copy_only=False)
            return pa.Table.from_pylist([row | {"seen": _press(seen), "vectors": _press(vectors), "first": _press(first)}], _schema(_EQUIPPED))

        words = self.blocks.select("block", "held", "lengths", "tokens", "words", "seen").mapInArrow(learn, _WORD)
        back = words.repartition("word").sortWithinPartitions("word").mapInArrow(_mean, _BACK)
        left = self.blocks.select("block", "docs", "held", "lengths", "tokens", "words").mapInArrow(narrow, _NARROW)
        self.equipped = stored(left.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(meet, _EQUIPPED), "lm-equipped")

    @staticmethod
    def _by_tree(sets: DataFrame, n: int, merge) -> np.ndarray | None:
        """Number sets from ``n`` partitions, merged level by level."""
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            sets = sets.repartition(n).mapInArrow(merge, "flat binary, weight double")
        found = sets.toArrow()
        return np.frombuffer(next(iter(merge(found.to_batches()))).column("flat")[0].as_py()) if found.num_rows else None

    def _normalise(self) -> None:
        """V, and the log of the sum over all words of the rest for each class of the word before."""
        g = self.g

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    seen, first = _unpress(row["seen"], np.int64), _unpress(row["first"], bool)
                    mine = np.flatnonzero(first & (seen > 0))
                    q, times = _vectors(_unpress(row["vectors"], np.int64)[mine])[:, OWN:], seen[mine] + 1.0
                    total = np.zeros(len(g) + 1)
                    total[-1] = len(mine)
                    for k in range(0, len(q), 8192):
                        total[:-1] += times[k : k + 8192] @ np.exp((q[k : k + 8192] @ g.T).astype(np.float64))
                    yield _set(total, 1.0)

        found = self._by_tree(self.equipped.select("seen", "first", "vectors").mapInArrow(run, _SET), self.equipped.rdd.getNumPartitions(), _added)
        found = np.zeros(len(g) + 1) if found is None else found
        self.v = int(round(found[-1])) + int((self.seen[1:] > 0).sum())
        self.log_rest = np.log(found[:-1] + 1)  # and all unseen words

    def scores(self) -> DataFrame:
        tables, n, v, model, log_rest = self.model.tables(), self.n, self.v, self.model, self.log_rest
        p, g = self.p, self.g
        ten = np.log(10.0)

        def run(batches):
            one, two, log_z = tables
            turned = np.concatenate([p @ model.c1 @ model.q.T, p @ model.c2 @ model.q.T])
            for batch in batches:
                for row in batch.to_pylist():
                    ids, nulls = _unpress(row["docs"], np.int64).reshape(2, -1)
                    held, lengths, tokens = _unpack(row)
                    count, classes = _unpress(row["seen"], np.int64), np.append(_unpress(row["classes"], np.int16), np.int16(1))
                    own = np.concatenate([_vectors(_unpress(row["vectors"], np.int64)), np.zeros((1, 2 * OWN), np.float32)])
                    own_r = np.ascontiguousarray(own[:, :OWN])
                    has = own_r.any(axis=1)
                    known = count > 0
                    base = np.log10((count + 1) / (n + v + 1))
                    w, u, back = _contexts(tokens, lengths)
                    cw, cu, cv = classes[w], classes[u], classes[back]
                    logp = one[cu, cw].astype(np.float64) + two[cv, cw] - log_z[cu, cv]
                    moved = np.flatnonzero(has[u] | has[back])  # contexts with vectors of their own
                    for k in range(0, len(moved), SCORE_ROWS):
                        m = moved[k : k + SCORE_ROWS]
                        s = np.concatenate([own_r[u[m]], own_r[back[m]]], axis=1) @ turned
                        s += one[cu[m]]
                        s += two[cv[m]]
                        logp[m] = _log_share(s, cw[m])
                    rest = np.flatnonzero(cw == 0)
                    for k in range(0, len(rest), 1 << 16):
                        m = rest[k : k + (1 << 16)]
                        logp[m] += np.log(count[tokens[m]] + 1) + (g[cu[m]] * own[w[m], OWN:]).sum(1) - log_rest[cu[m]]
                    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                    score = np.add.reduceat(logp, at) / ten
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, mask=nulls.astype(bool)), pa.array(held), pa.array(lengths), pa.array(np.add.reduceat(known[tokens].astype(np.int64), at)), pa.array(np.full(len(ids), n)), pa.array(np.add.reduceat(base[tokens], at)), pa.array(score), pa.array(score / lengths)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score"],
                    )

        return self.equipped.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double")


def fitted(docs: DataFrame) -> Scorer:
    """Read ``docs`` into blocks and choose the classes; ``train`` learns from the rows outside the held-out fold."""
    source = texts(docs, "doc_id").withColumn("held_out", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)))
    return Scorer(stored(source.mapInArrow(_read, _BLOCK), "lm-blocks"))


def scored(docs: DataFrame) -> DataFrame:
    """Scores of every whole text: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score).

    ``mean_score`` is the score for a token.  A null or empty text is the end
    token alone.  A null doc_id counts as not held out.  Repeated rows are texts
    of their own; other columns are ignored; an empty table gives no rows.
    """
    return fitted(docs).train().scores()
