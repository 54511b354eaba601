"""Order-preserving packing into fixed windows by dynamic programming.

The token stream of a block of documents, in their order, is cut into windows
of at most 2048 tokens.  Cuts may stand at document ends (free), sentence ends
(a small penalty) or, where a sentence is long or a block ends, inside one (a
larger penalty).  With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + WINDOW_COST + min over i of f(i) + padding(j - i)

where padding is 2048 - length, or nothing when the length is a power of two.
The first form is ``2048 - j + min(f(i) + i)`` over the cuts within reach: a
monotone queue keeps that minimum, so each cut enters and leaves it once.  The
padding-free lengths are a handful of extra transitions.

No shuffle: blocks are cut from each input partition as it is read.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import byte_letters, parts
from .common import texts, vocabulary_file
from .pairs import PairIndex, gathered, words

WINDOW = 2048
SENTENCE_PENALTY, TRUNCATION_PENALTY, WINDOW_COST = 1.0, 8.0, 2.0
#: Longest stretch without a cut; longer ones get truncation cuts this far apart.
MAX_GAP = 64
#: Tokens that are packed together; bounds a task's memory.
BLOCK_TOKENS = 1 << 20
#: Padding-free lengths tried everywhere; all powers of two are tried at a block's end.
EXACT = (1024, 512, 256)
#: Distinct chunks kept between slices of a partition, and bytes of text in a slice.
CACHE_WORDS, SLICE_BYTES = 200_000, 8 << 20
#: The tokenizer's pieces, and the blank between chunks.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+| ")
#: Chunks that the library encodes: with characters beyond the Latin blocks, or with what begins a special token.
_PLAIN_END = "\u0250"
_ODD = re.compile(rf"[{_PLAIN_END}-\U0010ffff]|<\|")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SENTENCE_END = frozenset(".!?…。！？")


class WordTokens:
    """Token ids of a vocabulary whose pre-tokenizer never crosses white space.

    Texts are split at white space and each distinct chunk is encoded once: its
    pieces (the tokenizer's own pattern) are merged together with those of all
    other new chunks through the pair occurrence index.  Chunks with characters
    from ``_PLAIN_END`` on, where normalising is more than lower case, and those
    that may hold a special token go through the library.  Tables of chunks and
    pieces are bounded; when one is full the chunks seen once are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.inner, self.final = (np.array([ids[c + end] for c in letters], np.int32) for end in ("", "</w>"))
        merges = [tuple(pair) if isinstance(pair, list) else tuple(pair.split(" ")) for pair in spec["model"]["merges"]]
        self.index = PairIndex([(ids[a], ids[b], ids[a + b]) for a, b in merges], {*self.inner.tolist(), *self.final.tolist()})
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        for token, i in vocab.items():
            word = token.removesuffix("</w>")
            self.ends[i] = token.endswith("</w>") and word != "" and set(word) <= _SENTENCE_END
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.offsets = words(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int64)

    def keep_common(self, most: int = CACHE_WORDS // 2) -> None:
        """Forget the chunks seen once, and all if still more than ``most`` are left."""
        kept = np.flatnonzero(self.seen > 1)
        if len(kept) > most:
            self.forget()
            return
        names = list(self.words)
        self.words = words(map(names.__getitem__, kept.tolist()))
        self.flat, length = gathered(self.flat, self.offsets, kept)
        self.offsets = np.concatenate([[0], np.cumsum(length)])
        self.seen = np.ones(len(kept), np.int64)

    def _library(self, rows: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(rows, add_special_tokens=False)]

    def _pieces(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each chunk) of plain chunks."""
        number = words([" "])
        at = np.fromiter(map(number.__getitem__, _PIECE.findall(" ".join(chunks).lower() + " ")), np.int64)
        new = [w.encode() for w in itertools.islice(number, 1, None)]
        lengths = np.array([len(w) for w in new], np.int64)
        raw = np.frombuffer(b"".join(new), np.uint8)
        symbols = self.inner[raw]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[raw[last]]
        flat, count = self.index.merge(symbols, lengths)
        offsets = np.concatenate([[0, 0], np.cumsum(count)])  # the blank between chunks has no ids
        ids, length = gathered(flat, offsets, at)
        stop = np.cumsum(length)[at == 0]
        return ids, np.diff(stop, prepend=0)

    def _learn(self) -> None:
        """Encode the chunks that have been numbered but not encoded."""
        new = list(itertools.islice(self.words, len(self.offsets) - 1, None))
        if not new:
            return
        odd = {w for w in new if _ODD.search(w)} if _ODD.search(" ".join(new)) else ()
        ids, count = self._pieces([w for w in new if w not in odd] if odd else new)
        if odd:
            hard = [w for w in new if w in odd]
            found = self._library(hard)
            plain = np.array([w not in odd for w in new])
            order = np.empty(len(new), np.int64)
            order[plain], order[~plain] = np.arange(len(count)), np.arange(len(count), len(new))
            count = np.concatenate([count, [len(x) for x in found]]).astype(np.int64)
            ids, count = gathered(np.concatenate([ids, *found]), np.concatenate([[0], np.cumsum(count)]), order)
        self.flat = np.concatenate([self.flat, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(count)])

    def encode(self, rows: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.words) > CACHE_WORDS:
            self.keep_common()
        number = self.words.__getitem__
        whole = {k for k, t in enumerate(rows) if any(c in t for c in _SEPARATORS)}  # str.split takes these as white space, the library does not
        at = [np.fromiter(map(number, t.split()), np.int64) if k not in whole else None for k, t in enumerate(rows)]
        self._learn()
        every = np.concatenate([np.zeros(0, np.int64), *(x for x in at if x is not None)])
        self.seen = np.concatenate([self.seen, np.zeros(len(self.words) - len(self.seen), np.int64)]) + np.bincount(every, minlength=len(self.words))
        ids, length = gathered(self.flat, self.offsets, every)
        stop = np.concatenate([[0], np.cumsum(length)])
        out, done = [], 0
        for k, x in enumerate(at):
            if x is None:
                out += self._library([rows[k]])
            else:
                out.append(ids[stop[done] : stop[done + len(x)]])
                done += len(x)
        return out


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(vocabulary_file(path))


def candidates(ends_doc: np.ndarray, sentence: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to ``total`` and their penalties."""
    penalty = np.full(total + 1, np.inf)
    penalty[np.flatnonzero(sentence) + 1] = SENTENCE_PENALTY
    penalty[ends_doc] = 0.0
    penalty[0] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(at)
    long = np.flatnonzero(gaps > MAX_GAP)
    if len(long):
        extra = np.concatenate([np.arange(at[k] + MAX_GAP, at[k + 1], MAX_GAP) for k in long])
        penalty[extra] = TRUNCATION_PENALTY
    tail = np.arange(max(1, total - WINDOW), total)  # so that a block's rest can be cut into powers of two
    penalty[tail] = np.minimum(penalty[tail], TRUNCATION_PENALTY)
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Positions of the cheapest cuts, first 0 and last the total."""
    total = int(at[-1])
    where = np.full(total + 1, -1, np.int32)
    where[at] = np.arange(len(at))
    # For each cut, the cut that stands an exact power of two earlier (or -1).
    exact = []
    for size in EXACT:
        back = at - size
        exact.append(np.where(back >= 0, where[np.maximum(back, 0)], -1).tolist())
    tail_from = total - WINDOW
    small = [1 << k for k in range(12) if 1 << k not in EXACT]
    at_list, pen, where = at.tolist(), penalty.tolist(), where
    cost, came = [0.0] * len(at_list), [0] * len(at_list)
    queue: deque = deque([(0.0, 0)])
    first_exact, second_exact, third_exact = exact
    for j in range(1, len(at_list)):
        p = at_list[j]
        low = p - WINDOW
        while at_list[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best = value + WINDOW - p
        for k in (first_exact[j], second_exact[j], third_exact[j]):
            if k >= 0 and cost[k] < best:
                best, i = cost[k], k
        if p > tail_from:
            for size in small:
                if p >= size and (k := int(where[p - size])) >= 0 and cost[k] < best:
                    best, i = cost[k], k
        best += pen[j] + WINDOW_COST
        cost[j], came[j] = best, i
        value = best + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [total], len(at_list) - 1
    while j:
        j = came[j]
        cuts.append(at_list[j])
    return np.array(cuts[::-1])


def pack_block(ids: np.ndarray, ends_doc: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of one block: (doc index, start in the doc, length, window index, offset in it, stream position)."""
    cuts = best_cuts(*candidates(ends_doc, ends_sentence[ids], len(ids)))
    begins = np.concatenate([[0], ends_doc[:-1]])
    start = np.unique(np.concatenate([begins, cuts[:-1]]))
    stop = np.append(start[1:], len(ids))
    doc = np.searchsorted(ends_doc, start, "right")
    window = np.searchsorted(cuts, start, "right") - 1
    return doc, start - begins[doc], stop - start, window, start - cuts[window], start


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, path: str, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of every document, in windows of at most 2048 tokens.

    A document is its ids and then ``end_id``, so a null or empty text is one
    token.  Each id lies in exactly one piece; a window's pieces follow each
    other from offset 0.  ``sequence_id`` is unique: the input partition's
    number and the window's number within it.  Repeated rows are packed as
    separate documents, null doc_ids stay null, other columns are ignored.
    """

    def run(batches):
        voc = word_tokens(path)
        sequence = TaskContext.get().partitionId() << 40
        names, held, size = [], [], 0

        def flush():
            nonlocal sequence, names, held, size
            ids = np.concatenate(held)
            lengths = np.array([len(x) + 1 for x in held[::2]])
            doc, start, length, window, offset, at = pack_block(ids, np.cumsum(lengths), voc.ends)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * p : 4 * (p + n)]) for p, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [pa.array(names, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(window + sequence), pa.array(offset)]
            offsets = np.append(at, len(ids)) if with_ids else np.zeros(len(at) + 1)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32) if with_ids else np.zeros(0, np.int32))))
            sequence += int(window[-1]) + 1
            names, held, size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

        end = np.array([end_id], np.int32)
        for batch in batches:
            for part in parts(batch, "text", SLICE_BYTES):
                for name, found in zip(part.column("doc_id").to_pylist(), voc.encode(part.column("text").to_pylist()), strict=True):
                    names.append(name)
                    held += [found, end]
                    size += len(found) + 1
                    if size >= BLOCK_TOKENS:
                        yield flush()
        if held:
            yield flush()
        voc.keep_common()

    return texts(docs, "doc_id").mapInArrow(run, PIECES)
