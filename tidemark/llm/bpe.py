"""Byte-level BPE by a pair occurrence index.

The distinct words of a partition's texts, a bounded slice at a time, are
merged together: an index maps each pair to all its positions (see ``pairs``),
ranks are applied in ascending order.  A text's ids are then gathered word by
word from one array, without an object for each word.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, vocabulary_file
from .pairs import PairIndex, gathered, words

#: Distinct words kept between slices of a partition, and bytes of text in a slice.
CACHE_WORDS, PART_BYTES = 200_000, 8 << 20
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers JSON file.

    Tables of distinct words are bounded; when one is full the words seen once are forgotten.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.specials.values()])
        token_bytes = [b""] * size
        for token, i in ids.items():
            token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            token_bytes[i] = token.encode()
        self.bytes_flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.bytes_at = np.concatenate([[0], np.cumsum([len(t) for t in token_bytes])])
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        merges = [tuple(pair) if isinstance(pair, list) else tuple(pair.split(" ")) for pair in spec["model"]["merges"]]
        self.index = PairIndex([(ids[a], ids[b], ids[a + b]) for a, b in merges], set(self.byte_ids.tolist()))
        self.split = regex.compile(_SPLIT)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.forget()

    def forget(self) -> None:
        self.words, self.seen = words(self.specials), np.zeros(0, np.int64)
        self.flat, self.offsets = np.array(list(self.specials.values()), np.int32), np.arange(len(self.specials) + 1)

    def keep_common(self, most: int = CACHE_WORDS // 2) -> None:
        """Forget the words seen once, and all if still more than ``most`` are left."""
        again = self.seen > 1
        again[: len(self.specials)] = True
        kept = np.flatnonzero(again)
        if len(kept) > most:
            self.forget()
            return
        names = list(self.words)
        self.words = words(map(names.__getitem__, kept.tolist()))
        self.flat, length = gathered(self.flat, self.offsets, kept)
        self.offsets = np.concatenate([[0], np.cumsum(length)])
        self.seen = np.ones(len(kept), np.int64)

    def _words(self, text: str) -> list[str]:
        if self.special_split is None or not any(s in text for s in self.specials):
            return self.split.findall(text)
        found = []
        for part in self.special_split.split(text):
            found += [part] if part in self.specials else self.split.findall(part)
        return found

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, their number in each text); special tokens' strings are recognised, none are added."""
        if len(self.words) > CACHE_WORDS:
            self.keep_common()
        number = self.words.__getitem__
        at = [np.fromiter(map(number, self._words(t)), np.int64) for t in rows]
        new = [w.encode("utf-8") for w in itertools.islice(self.words, len(self.offsets) - 1, None)]
        if new:
            flat, count = self.index.merge(self.byte_ids[np.frombuffer(b"".join(new), np.uint8)], np.array([len(w) for w in new]))
            self.flat = np.concatenate([self.flat, flat])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(count)])
        every = np.concatenate([np.zeros(0, np.int64), *at])
        self.seen = np.concatenate([self.seen, np.zeros(len(self.words) - len(self.seen), np.int64)]) + np.bincount(every, minlength=len(self.words))
        ids, length = gathered(self.flat, self.offsets, every)
        stop = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *(len(x) for x in at)])]
        return ids, np.diff(stop)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of token ids, special tokens included; invalid UTF-8 is replaced."""
        data, length = gathered(self.bytes_flat, self.bytes_at, ids)
        stop = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(stop)]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(vocabulary_file(path))


def parts(batch: pa.RecordBatch, column: str, limit: int = PART_BYTES):
    """Slices of a batch with about ``limit`` bytes of text each."""
    size = pc.cumulative_sum(pc.binary_length(batch.column(column)).cast(pa.int64())).to_numpy(zero_copy_only=False)
    first, done = 0, 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(first, last - first)
        first, done = last, size[last - 1]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): token ids of each whole text.

    ``path`` is the vocabulary file, which every executor must have at that
    place, or the bare name of a public tokenizer.  A null or empty text has no ids; rows are neither joined nor
    dropped, so repeated rows and null ids stay; other columns are ignored.
    """

    def run(batches):
        voc = vocabulary(path)
        for batch in batches:
            for part in parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(*voc.encode(part.column("text").to_pylist()))], ["doc_id", "ids"])
        voc.keep_common()

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches):
        voc = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            counts = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(voc.decode(ids.flatten().to_numpy(zero_copy_only=False), counts), pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): each text encoded and its ids decoded, in one pass."""

    def run(batches):
        voc = vocabulary(path)
        for batch in batches:
            for part in parts(batch, "text"):
                ids, counts = voc.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, counts), pa.array(voc.decode(ids, counts), pa.string())], ["doc_id", "ids", "text"])
        voc.keep_common()

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(tokens: DataFrame) -> DataFrame:
    """Counts and digests of (doc_id, ids, text) rows."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
