"""Vectorised word, line and shingle hashing over Arrow string buffers.

A text's words are ``[^\\x20\\x09-\\x0D]+``.  Everything here works on the raw
UTF-8 bytes of a block of texts at once: all byte ranges take their next eight
bytes together, mix them into 64-bit states, and those that have ended drop
out, so no Python object is made per word.  Every step is a bijection of the
state, so no pattern of bytes collides by construction.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays of a task.
BLOCK_BYTES = 1 << 20

_U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U64(2) + _U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low k bytes of eight, and the bytes from which on a range is hashed by itself.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ALONE = 4096
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def text_blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into blocks: (first row, row after the last, bytes, offsets).

    A block holds whole texts; one longer than ``block_bytes`` has its own block.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(chunk):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
            yield row + first, row + last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last
        row += len(chunk)


class Block:
    """Words of a block of texts: ``doc`` (row in the block), ``start``, ``end`` (bytes) and ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        n = len(data)
        self._bytes = np.zeros(n + 8, np.uint8)
        self._bytes[:n] = _LOWER[data] if lower else data
        self.space = _SPACE[data]
        head = np.ones(n + 1, bool)
        head[1:n] = self.space[: n - 1] if n else False
        head[offsets] = True
        begins = ~self.space & head[:n]
        ends = ~self.space
        if n:
            ends[: n - 1] &= self.space[1:] | head[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = self.range_hash(self.start, self.end)
        self.n_words = np.bincount(self.doc, minlength=self.n_docs)

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, eight bytes of each at a time; very long ones one by one."""
        eights = np.ndarray((len(self.data) + 1,), "<u8", self._bytes, strides=(1,))
        left = end - start
        out = mix(left.astype(np.uint64) * _U64(0x9E3779B97F4A7C15) + _U64(1))
        for k in np.flatnonzero(left > _ALONE):
            out[k] = int.from_bytes(blake2b(self._bytes[start[k] : end[k]], digest_size=8).digest(), "little")
        live = np.flatnonzero((left > 0) & (left <= _ALONE))
        at, left = start[live], left[live]
        while len(live):
            piece = eights[at] & _KEEP[np.minimum(left, 8)]
            out[live] = mix((out[live] ^ piece) * _U64(0xD6E8FEB86659FD93))
            on = left > 8
            live, at, left = live[on], at[on] + 8, left[on] - 8
        return out

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-wise flag in each text."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each window of ``width`` words inside one text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = self.hash[:n] * _SHINGLE[0]
        for k in range(1, width):
            value = value + self.hash[k : n + k] * _SHINGLE[k]
        inside = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return inside, mix(value[inside])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of each text's distinct shingles, sorted by both.

        A text with fewer words than ``width`` has its whole word sequence as
        one shingle; one without words has none.
        """
        first, value = self.windows(width)
        doc = self.doc[first]
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < width))
        if len(short):
            at = np.concatenate([[0], np.cumsum(self.n_words)])
            sums = mix(np.array([np.sum(self.hash[at[d] : at[d + 1]] * _SHINGLE[: at[d + 1] - at[d]], dtype=np.uint64) for d in short], np.uint64) + _SHINGLE[32 + self.n_words[short]])
            doc, value = np.concatenate([doc, short]), np.concatenate([value, sums])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        return doc[keep], value[keep]
