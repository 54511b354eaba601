"""MinHash near-duplicates by HyperMinHash registers.

A document's set is its distinct five-word shingles.  The 256 registers of a
sketch hold, for the smallest hash of each bucket, its leading-zero count and
four mantissa bits in one byte; empty registers borrow from others
(densification), so two sketches agree in a register with a probability near
the Jaccard similarity.  32 bands of 8 compressed registers choose candidates,
the collision-corrected estimate discards hopeless pairs, and the rest is
confirmed on the full sets.  Documents with equal sets are one class
throughout.  In a candidate group every member is first compared with one
leader; only rows that are still in another component than most of their group
are compared with all of it, in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hot_keys, spread_join, stored, texts
from .textvec import Block, text_blocks

REGISTERS, BANDS, WIDTH = 256, 32, 5
MANTISSA_BITS, ZEROS_MAX = 4, 15
#: Members of a band bucket that one comparison holds at once, on either side.
BLOCK_ROWS = 512
#: Comparisons with one member of each candidate group before the groups that are still apart meet in blocks.
LEADER_ROUNDS = 2
#: Standard errors below the threshold at which the estimate still asks for the full sets.
SIGMAS = 5.0
ATTEMPTS = 48
#: What follows from a set alone, so that its class has it from any row.
OF_A_SET = ("n_shingles", "bands", "sketch")

_rng = np.random.Generator(np.random.PCG64(7))
_BORROW = _rng.integers(0, REGISTERS, (ATTEMPTS, REGISTERS))
_BAND_ORDER = _rng.permutation(REGISTERS)
_BAND_SALT = _rng.integers(1, 1 << 62, (1, BANDS), dtype=np.uint64)


def sketches(doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Registers (n_docs, 256) of sorted (doc, shingle hash) rows; texts without shingles stay zero."""
    bucket = doc * REGISTERS + (value >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(bucket), bool)
    first[1:] = bucket[1:] != bucket[:-1]  # sorted, so the first of a bucket is its smallest
    rest = (value[first] << np.uint64(8)) | np.uint64(1)
    top = np.frexp(rest.astype(np.float64))[1] - 1
    top = top - (rest >> np.minimum(top, 63).astype(np.uint64) == 0)  # where the float was rounded up
    zeros = np.minimum(63 - top, ZEROS_MAX)
    shift = top - MANTISSA_BITS
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64(15)
    registers = np.zeros(n_docs * REGISTERS, np.uint8)
    full = np.zeros(n_docs * REGISTERS, bool)
    registers[bucket[first]] = (zeros << MANTISSA_BITS).astype(np.uint8) | mantissa.astype(np.uint8)
    full[bucket[first]] = True
    registers, full = registers.reshape(n_docs, REGISTERS), full.reshape(n_docs, REGISTERS)
    source, have = registers.copy(), full.copy()
    some = have.any(axis=1)
    open_ = np.flatnonzero(some & ~full.all(axis=1))
    for pick in _BORROW:
        if not len(open_):
            break
        take = ~full[open_] & have[open_][:, pick]
        rows, cols = np.nonzero(take)
        registers[open_[rows], cols] = source[open_[rows], pick[cols]]
        full[open_[rows], cols] = True
        open_ = open_[~full[open_].all(axis=1)]
    for d in open_:  # very few shingles: the next filled register to the right
        at = np.flatnonzero(have[d])
        gaps = np.flatnonzero(~full[d])
        registers[d, gaps] = source[d, at[np.searchsorted(at, gaps) % len(at)]]
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of compressed registers."""
    packed = np.ascontiguousarray(registers[:, _BAND_ORDER]).view(np.uint64).reshape(len(registers), BANDS)
    x = packed * np.uint64(0x9E3779B97F4A7C15) + _BAND_SALT
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _collision() -> float:
    """Chance that two registers with different smallest hashes hold the same byte."""
    total = sum(4.0**-k for k in range(1, ZEROS_MAX + 1)) + 4.0**-ZEROS_MAX
    return total / 2**MANTISSA_BITS


COLLISION = _collision()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of all rows of ``a`` against all of ``b``, corrected for chance agreement."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = (b == row).mean(axis=1)
    return (out - COLLISION) / (1 - COLLISION)


def _sketch_rows(batches):
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column("text")):
            doc, value = Block(data, offsets, lower=True).shingles(WIDTH)
            n = b - a
            at = np.searchsorted(doc, np.arange(n + 1))
            registers = sketches(doc, value, n)
            keys = band_keys(registers)
            digest = [hashlib.blake2b(value[at[i] : at[i + 1]], digest_size=16).digest() if at[i] < at[i + 1] else None for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, n), batch.column("text_key").slice(a, n), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([r.tobytes() for r in registers], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest", "bands", "sketch"],
            )


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    out = []
    for a, b, data, offsets in text_blocks(column):
        doc, value = Block(data, offsets, lower=True).shingles(WIDTH)
        at = np.searchsorted(doc, np.arange(b - a + 1))
        out += [value[at[i] : at[i + 1]] for i in range(b - a)]
    return out


def _registers(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(group.num_rows, REGISTERS)


def _hopeful(a: pa.Table, b: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``a`` and ``b`` may reach the threshold, by sizes and sketches, and their estimates."""
    size, other = a.column("n_shingles").to_numpy()[:, None], b.column("n_shingles").to_numpy()[None, :]
    guess, j = estimate(_registers(a), _registers(b)), threshold / 100
    spread = np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.minimum(size, other)))
    return (guess >= j - SIGMAS * spread) & (100 * np.minimum(size, other) >= threshold * np.maximum(size, other)), guess


def _alike(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal small numbers."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


class _Groups:
    """Union-find over positions of one comparison."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _promising_pairs(threshold: int):
    """Of one part of a leader's pairs, those that may reach the threshold."""

    def run(pairs: pa.Table, leader: pa.Table) -> pa.Table:
        if not leader.num_rows or not pairs.num_rows:
            return pairs.select(["a", "b", "part"]).slice(0, 0)
        return pairs.filter(pa.array(_hopeful(leader.slice(0, 1), pairs, threshold)[0][0])).select(["a", "b", "part"])

    return run


def _confirmed_pairs(threshold: int):
    """Of one part of a leader's pairs, those that reach the threshold on the full sets."""

    def run(pairs: pa.Table, leader: pa.Table) -> pa.Table:
        if not leader.num_rows or not pairs.num_rows:
            return pairs.select(["a", "b"]).slice(0, 0)
        own = _sets(leader.column("text").slice(0, 1))[0]
        return pairs.filter(pa.array([_alike(own, x, threshold) for x in _sets(pairs.column("text"))])).select(["a", "b"])

    return run


def _across(group: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides of a pair of blocks, and which of them may link different components."""
    minor = group.column("minor").to_numpy(zero_copy_only=False)
    component = _numbers(group.column("component"))
    left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
    hopeful, guess = _hopeful(group.take(pa.array(left)), group.take(pa.array(right)), threshold)
    return left, right, hopeful & (component[left][:, None] != component[right][None, :]), guess


def _promising_rows(threshold: int):
    """Rows of one pair of blocks that may link with a row of another component."""

    def run(group: pa.Table) -> pa.Table:
        left, right, hopeful, _ = _across(group, threshold)
        some = np.concatenate([left[hopeful.any(axis=1)], right[hopeful.any(axis=0)]])
        return group.select(["bucket", "lo", "hi", "minor", "cid", "component"]).take(pa.array(some, pa.int64()))

    return run


def _compare(threshold: int):
    """Confirmed links of one pair of blocks; a pair already joined by others needs no test."""

    def run(group: pa.Table) -> pa.Table:
        left, right, hopeful, guess = _across(group, threshold)
        ids, sets = group.column("cid").to_pylist(), _sets(group.column("text"))
        component = _numbers(group.column("component")).tolist()
        x, y = np.nonzero(hopeful)
        order = np.argsort(-guess[x, y], kind="stable")
        found, tree = [], _Groups(len(ids))
        for p, q in zip(left[x[order]].tolist(), right[y[order]].tolist(), strict=True):
            r, s = tree.root(component[p]), tree.root(component[q])
            if r != s and _alike(sets[p], sets[q], threshold):
                tree.up[r] = s
                found.append((ids[p], ids[q]))
        return pa.table({"a": pa.array([p for p, _ in found], pa.binary()), "b": pa.array([q for _, q in found], pa.binary())})

    return run


def _open(members: DataFrame, known: DataFrame | None, seed: int) -> DataFrame:
    """(bucket, cid, component, minor) of buckets that still hold several components.

    ``minor`` rows are outside the largest component of their bucket.  Without
    ``known`` components each class is its own.
    """
    if known is None:
        rows = members.select("bucket", "cid", F.col("cid").alias("component"))
    else:
        rows = members.select("bucket", "cid").join(known, F.col("cid") == known["id"], "left").select("bucket", "cid", F.coalesce("component", "cid").alias("component"))
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max_by("component", F.struct("n", F.xxhash64("component", F.lit(seed)))).alias("main")).where("k > 1").select("bucket", "main")
    return stored(rows.join(main, "bucket").select("bucket", "cid", "component", (F.col("component") != F.col("main")).alias("minor")), "open")


def _leader_links(rows: DataFrame, payload: DataFrame, threshold: int, seed: int) -> DataFrame:
    """Links between one member of each bucket's largest component and the rows outside it.

    Buckets of one group mostly choose the same leader, so a class has few
    distinct pairs.  A leader's pairs are dealt out in parts of bounded size.
    """
    leaders = rows.where("not minor").groupBy("bucket").agg(F.min_by("cid", F.xxhash64("cid", F.lit(seed))).alias("a"))
    pairs = rows.where("minor").join(leaders, "bucket").select("a", F.col("cid").alias("b")).distinct()
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    pairs = stored(pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "pairs")

    def beside(pairs: DataFrame, check, schema: str, *columns: str) -> DataFrame:
        side = payload.select("cid", *columns)
        members = pairs.join(side.withColumnRenamed("cid", "b"), "b")
        own = pairs.select("a", "part").distinct().join(side.withColumnRenamed("cid", "a"), "a")
        own = own.toDF(*own.columns)  # its columns are not those of ``members``
        return members.groupBy("a", "part").cogroup(own.groupBy("a", "part")).applyInArrow(check(threshold), schema)

    hopeful = stored(beside(pairs, _promising_pairs, "a binary, b binary, part int", "n_shingles", "sketch"), "hopeful")
    return stored(beside(hopeful, _confirmed_pairs, "a binary, b binary", "text"), "confirmed")


def _block_links(rows: DataFrame, payload: DataFrame, threshold: int) -> DataFrame:
    """Links from the rows outside the largest component of their bucket to all its rows.

    Both sides are dealt out in blocks; a row goes to every pair of blocks that
    holds its own.  Sketches first tell which rows have any hope; only those
    are compared on their full sets.  Nothing is dropped, whatever a bucket's size.
    """
    size = rows.groupBy("bucket").agg(F.ceil(F.count_if("minor") / BLOCK_ROWS).cast("int").alias("few"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("all"))
    sized = rows.join(size, "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    left = sized.where("minor").select("bucket", own("few").alias("lo"), every("all").alias("hi"), F.lit(True).alias("minor"), "cid", "component")
    right = sized.select("bucket", every("few").alias("lo"), own("all").alias("hi"), F.lit(False).alias("minor"), "cid", "component")
    key = ["bucket", "lo", "hi"]
    hopeful = left.unionByName(right).join(payload.select("cid", "n_shingles", "sketch"), "cid").groupBy(*key).applyInArrow(_promising_rows(threshold), "bucket long, lo int, hi int, minor boolean, cid binary, component binary")
    return stored(stored(hopeful, "hopeful").join(payload, "cid").groupBy(*key).applyInArrow(_compare(threshold), "a binary, b binary"), "confirmed")


def _classes(filled: DataFrame) -> DataFrame:
    """(digest, doc_id, text_key, cid, n, and what equal sets share) of each distinct set: one row that has it, the name it goes by, and its rows.

    The name is the row's doc_id in eight bytes, followed by the text's hash
    where several classes would have the same: a doc_id that repeats with
    different texts is in several classes.
    """
    first = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("_r"), F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in OF_A_SET]).select("digest", "_r.doc_id", "_r.text_key", "n", *OF_A_SET)
    shared = first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    eight = lambda c: F.lpad(F.hex(c), 16, "0")
    name = F.concat(eight("doc_id"), F.when(F.col("_n").isNotNull(), eight("text_key")).otherwise(""))
    return first.join(shared, "doc_id", "left").select("digest", "doc_id", "text_key", F.unhex(name).alias("cid"), "n", *OF_A_SET)


def near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Two rows are linked if 100 * |intersection| >= threshold * |union| of
    their sets.  A null or empty text, or one without words, has an empty set
    and stands alone; a text of fewer than five words has its whole sequence
    as one shingle.  Rows are compared as rows: a doc_id that repeats with
    different texts has the component of each text in its row, and
    ``component_id`` is the smallest doc_id of the component's rows.  Rows whose
    doc_id is null are kept and linked with nothing (component_id null, kept
    true).  Other columns are ignored.
    """
    return _grouped(docs, threshold).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, chosen) of every row; one text of each component is ``chosen``."""
    source = texts(docs, "doc_id").withColumn("text_key", F.xxhash64("text"))
    parts = stored(source.mapInArrow(_sketch_rows, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sketch binary"), "sketches")
    filled = parts.where("digest is not null and doc_id is not null")
    classes = stored(_classes(filled), "classes")
    row = ["doc_id", "text_key"]
    buckets = classes.select("cid", F.explode(F.array_distinct("bands")).alias("bucket"))
    # Buckets with the same members would repeat the same comparisons: one of them is enough.
    member = F.xxhash64("cid")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(member).alias("x"), F.sum(member.bitwiseAND((1 << 40) - 1)).alias("s")).where("n > 1")
    chosen = sizes.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = stored(buckets.join(chosen, "bucket", "left_semi"), "members")
    needed = members.select("cid").distinct()
    rows = classes.select("cid", *row, "n_shingles", "sketch").join(needed, "cid", "left_semi")
    # One plan at every size: the needed ids grow with the corpus, so they are never broadcast.
    payload = stored(source.join(rows.hint("merge"), row).dropDuplicates(["cid"]).select("cid", "n_shingles", "sketch", "text"), "payload")
    # Leaders join most of a group in few comparisons; the rest meets in blocks, so that every candidate pair of two components is tested.
    # A bucket of one component stays so: each step reads only those that the last left open.
    known, rest = None, members
    for seed in range(LEADER_ROUNDS):
        rest = _open(rest, known, seed)
        known = _joined(known, _leader_links(rest, payload, threshold, seed))
    known = _joined(known, _block_links(_open(rest, known, LEADER_ROUNDS), payload, threshold))
    first = F.struct("doc_id", "text_key")
    linked = classes.join(known, classes["cid"] == known["id"]).select("digest", first.alias("own"), "component")
    least = linked.groupBy("component").agg(F.min("own").alias("first"))
    where = classes.join(linked.join(least, "component").select("digest", "first"), "digest", "left").select("digest", F.coalesce("first", first).alias("first"))
    copies = filled.select(*row, "n_shingles", "digest")
    joined = spread_join(copies, where, "digest", hot_keys(classes, "digest", "n"), "doc_id").select(*row, "n_shingles", F.col("first.doc_id").alias("component_id"), (first == F.col("first")).alias("chosen"))
    alone = parts.where("digest is null or doc_id is null").select(*row, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"))
    return joined.unionByName(alone)


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of ``known`` ones and new links."""
    return components(links if known is None else links.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def representatives(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """One row of ``docs``, all columns, for each group of near-duplicates.

    Repeated rows (equal doc_id and text) count as copies of each other; rows
    without a doc_id stay.
    """
    keep = _grouped(docs, threshold).where("chosen and doc_id is not null").select(F.col("doc_id").alias("id"), "text_key").distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    named = docs.join(keep.hint("merge"), (docs["doc_id"] == keep["id"]) & (key == keep["text_key"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
