"""Embedding near-duplicates by a random-projection tree forest.

Each level of a tree projects on one random direction and splits at the
sample's median of the node; vectors within a margin of the split go both ways
(spill), so that two vectors at the similarity threshold rarely part.  A label's
depth follows its number of vectors, so leaves stay of one size at any scale.
Within a leaf all pairs are compared exactly in double precision; a pair that
several leaves hold is counted in the first of them only, which each vector's
list of leaves tells without any pair being emitted.  Equal vectors are one
class throughout, and a leaf that the splits cannot break up is compared in
blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_blocks, stored

TREES, LEAF_ROWS, BLOCK_ROWS = 8, 192, 768
#: Spill on either side of a split, in standard deviations of the distance, along a direction, of two vectors at the
#: threshold.  A level parts such a pair in about 2 % of the cases and copies 6 % of the vectors: many trees with little
#: spill grow slower with depth than few with much (at depth 18 all eight lose 2 pairs in 10,000, with 21 copies a vector).
SPILL = 0.35
#: Bound of the sample that the splits are fitted on; every row is indexed.
SAMPLE_ROWS = 32_768
MAX_DEPTH = 32
#: Sample rows a node needs for a median of its own; smaller nodes take their level's.
NODE_ROWS = 24


class Forest:
    """Directions, split points and margin for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, dimension: int, cosine: float, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng((seed, dimension))
        self.margin = SPILL * float(np.sqrt(max(0.0, 2 - 2 * cosine)) / np.sqrt(dimension))
        self.directions = rng.normal(size=(trees, MAX_DEPTH, dimension))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits: list[list[np.ndarray]] = []
        self.level: list[np.ndarray] = []
        for t in range(trees):
            p = sample @ self.directions[t].T if len(sample) else np.zeros((0, MAX_DEPTH))
            middle = np.median(p, axis=0) if len(p) else np.zeros(MAX_DEPTH)
            node, splits, depth = np.zeros(len(p), np.int64), [], 0
            while depth < MAX_DEPTH and len(p) >> depth >= NODE_ROWS:
                at = np.full(1 << depth, middle[depth])
                order = np.argsort(node, kind="stable")
                edges = np.searchsorted(node[order], np.arange((1 << depth) + 1))
                for k in range(1 << depth):
                    if edges[k + 1] - edges[k] >= NODE_ROWS:
                        at[k] = np.median(p[order[edges[k] : edges[k + 1]], depth])
                splits.append(at)
                node = node * 2 + (p[:, depth] >= at[node])
                depth += 1
            self.splits.append(splits)
            self.level.append(middle)

    def leaves(self, unit: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tree << 40 | leaf) of each leaf that each unit vector enters; ``depth`` by row."""
        rows, codes = [], []
        for t, splits in enumerate(self.splits):
            p = unit @ self.directions[t, : max(1, int(depth.max(initial=1)))].T
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for k in range(int(depth.max(initial=0))):
                on = depth[row] > k
                rows.append(row[~on])
                codes.append(node[~on] | t << 40)
                row, node = row[on], node[on]
                at = splits[k][node] if k < len(splits) else self.level[t][k]
                gap = p[row, k] - at
                left, right = gap < self.margin, gap >= -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            codes.append(node | t << 40)
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values, np.float64) for x in column]


def _enter(forests: dict[int, Forest], cosine: float):
    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            size = np.array([len(v) for v in vectors])
            for dimension in np.unique(size).tolist():
                at = np.flatnonzero(size == dimension)
                m = np.stack([vectors[i] for i in at])
                forest = forests.get(dimension) or forests.setdefault(dimension, Forest(np.zeros((0, dimension)), dimension, cosine))
                row, code = forest.leaves(m / np.linalg.norm(m, axis=1, keepdims=True), batch.column("depth").to_numpy()[at])
                edges = np.searchsorted(row, np.arange(len(at) + 1))
                keys = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(code))
                pick = pa.array(at[row])
                yield pa.RecordBatch.from_arrays([batch.column("label").take(pick), pa.array(np.full(len(row), dimension)), pa.array(code), batch.column("rep").take(pick), batch.column("n").take(pick), pa.array([m[i].tobytes() for i in row], pa.binary()), keys.take(pa.array(row))], ["label", "dimension", "leaf", "rep", "n", "vector", "leaves"])

    return run


def _compare(cosine: float):
    """Links of one pair of blocks: (id, linked copies, root in this comparison)."""

    def run(group: pa.Table) -> pa.Table:
        own, lo, hi = group.column("own").to_numpy(), group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        ids, weight = group.column("rep").to_numpy(), group.column("n").to_numpy()
        here = group.column("cell")[0].as_py()["leaf"]
        m = np.stack([np.frombuffer(v, np.float64) for v in group.column("vector").to_pylist()])
        norm = np.sqrt((m * m).sum(axis=1))
        lists = group.column("leaves").to_pylist()
        keys = np.full((len(ids), max(map(len, lists))), -1, np.int64)
        for i, x in enumerate(lists):
            keys[i, : len(x)] = x
        before = np.where((keys >= 0) & (keys < here), keys, -1)  # earlier leaves only
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        count = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        step = max(1, 400_000 // max(1, len(right)))
        for first in range(0, len(left), step):
            rows = left[first : first + step]
            near = (m[rows] @ m[right].T) / (norm[rows][:, None] * norm[right][None, :]) >= cosine
            if lo == hi:
                near &= rows[:, None] < right[None, :]
            x, y = np.nonzero(near)
            for part in range(0, len(x), 50_000):
                i, j = rows[x[part : part + 50_000]], right[y[part : part + 50_000]]
                seen = np.zeros(len(i), bool)
                for k in range(before.shape[1]):
                    b = before[i, k]
                    seen |= (b >= 0) & (b[:, None] == before[j]).any(axis=1)
                i, j = i[~seen], j[~seen]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                while len(i):  # hook roots together until all these pairs share one
                    a, b = root[i], root[j]
                    if (a == b).all():
                        break
                    np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                    while (root[root] != root).any():
                        root = root[root]
        some = np.flatnonzero(count > 0)
        return pa.table({"id": pa.array(ids[some]), "linked": pa.array(count[some]), "root": pa.array(ids[root[some]])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Only vectors of one label and one dimension are compared.  A row whose
    label or embedding is null, or whose vector is zero or holds null, NaN or
    infinite components, links with nothing.  Equal vectors link with each
    other and share their links; repeated rows count as vectors of their own.
    A row with a null vec_id stays, with component_id null and kept true.
    """
    source = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (square > 0), F.lit(False))
    source = source.withColumn("valid", valid)
    good = source.where("valid")
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    sample = classes.select("embedding", F.xxhash64("rep", "label").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("embedding").toArrow()
    found = _matrix(sample.column("embedding").combine_chunks()) if sample.num_rows else []
    forests = {}
    for dimension in sorted({len(v) for v in found}):
        m = np.stack([v for v in found if len(v) == dimension])
        forests[dimension] = Forest(m / np.linalg.norm(m, axis=1, keepdims=True), dimension, cosine)
    # Depth by label: halve until a leaf has LEAF_ROWS vectors.
    depth = classes.groupBy("label").agg(F.least(F.lit(MAX_DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / LEAF_ROWS)))).cast("long").alias("depth"))
    kind = dict(classes.dtypes)["label"]
    entered = classes.join(depth, "label").select("label", "rep", "n", "embedding", "depth").mapInArrow(_enter(forests, cosine), f"label {kind}, dimension long, leaf long, rep long, n long, vector binary, leaves array<long>")
    cells = stored(entered.withColumn("cell", F.struct("label", "dimension", "leaf")).drop("label", "dimension", "leaf"), "cells")
    pairs = in_blocks(cells, "cell", "rep", BLOCK_ROWS)
    links = stored(pairs.groupBy("cell", "lo", "hi").applyInArrow(_compare(cosine), "id long, linked long, root long"), "vector-links")
    counts = links.groupBy("id").agg(F.sum("linked").alias("linked"))
    linked = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, classes["rep"] == counts["id"], "left").drop("id").join(linked, F.col("rep") == linked["id"], "left")
    known = known.select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = source.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
