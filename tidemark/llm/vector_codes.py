"""Vector code compression: exact Lloyd rounds over the parts of integer vectors, on anchors-hierarchy metric trees.

Vectors are dealt into blocks; for each block and part position a metric tree
is built once, middle-out: about root-n anchors steal points from each other,
the anchors' balls are merged pairwise up to a root, and an anchor with too
many points is split in the same way.  Every ball caches its points' sums and
count.  A round walks the trees with lists of candidate entries that children
inherit: an entry leaves a ball's list when all of the ball is nearer to
another, and a ball with one candidate left is owned whole, so its cached sums
are added without touching its points.  Only points of leaves that keep several
candidates are compared, in exact integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and points of an anchor that is not split further.
BLOCK_ROWS, LEAF_POINTS = 4096, 192
#: Integer components lie within this bound, so that squared distances of vectors of 64 components are exact longs.
LARGEST = 1 << 27
#: Room that rounding in double precision gets when a candidate is dropped.
SLACK = 1e-6


def _nodes(d: int) -> np.dtype:
    return np.dtype([("lo", "i4"), ("hi", "i4"), ("left", "i4"), ("right", "i4"), ("radius", "f8"), ("sum", "i8", (d,))])


class _Builder:
    """Grows one tree: ``order`` lists points so that every ball's points are a range of it."""

    def __init__(self, points: np.ndarray):
        self.points, self.real = points, points.astype(np.float64)
        self.order: list[np.ndarray] = []
        self.placed = 0
        self.balls: list[list] = []

    def anchors(self, rows: np.ndarray) -> list[np.ndarray]:
        """About root-n groups of ``rows``: the point farthest from its anchor becomes the next anchor and steals what is nearer to it."""
        x = self.real[rows]
        pivots = [0]
        owner, far = np.zeros(len(rows), np.int64), ((x - x[0]) ** 2).sum(axis=1)
        for k in range(1, int(np.ceil(np.sqrt(len(rows))))):
            new = int(far.argmax())
            if far[new] == 0:
                break
            between = ((x[pivots] - x[new]) ** 2).sum(axis=1)
            maybe = np.flatnonzero(far * 4 > between[owner])  # others are nearer to their anchor by the triangle inequality
            gap = ((x[maybe] - x[new]) ** 2).sum(axis=1)
            stolen = gap < far[maybe]
            owner[maybe[stolen]], far[maybe[stolen]] = k, gap[stolen]
            pivots.append(new)
        order = np.argsort(owner, kind="stable")
        return [rows[g] for g in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)]

    def ball(self, total: np.ndarray, count: int, radius: float, left: int, right: int) -> int:
        self.balls.append([0, 0, left, right, radius, total, count])
        return len(self.balls) - 1

    def leaf(self, rows: np.ndarray) -> int:
        total = self.points[rows].sum(axis=0)
        radius = float(np.sqrt(((self.real[rows] - total / len(rows)) ** 2).sum(axis=1).max(initial=0)))
        at = self.ball(total, len(rows), radius, -1, -1)
        self.balls[at].append(rows)
        return at

    def grow(self, rows: np.ndarray) -> int:
        """Root of the tree over ``rows``; equal points alone never split."""
        groups = self.anchors(rows) if len(rows) > LEAF_POINTS else [rows]
        if len(groups) == 1:
            return self.leaf(rows)
        live = [self.grow(g) for g in groups]
        center = np.stack([self.balls[b][5] / self.balls[b][6] for b in live])
        radius, count = np.array([self.balls[b][4] for b in live]), np.array([self.balls[b][6] for b in live], np.float64)
        cost = np.full((len(live), len(live)), np.inf)

        def compare(i: int) -> None:
            """Radius of the ball around the pair's centre of mass that holds both balls."""
            gap = np.sqrt(((center - center[i]) ** 2).sum(axis=1))
            both = count + count[i]
            reach = np.maximum(gap * count / both + radius[i], gap * count[i] / both + radius)
            reach[~on] = np.inf
            reach[i] = np.inf
            cost[i], cost[:, i] = reach, reach

        on = np.ones(len(live), bool)
        for i in range(len(live)):
            compare(i)
        for _ in range(len(live) - 1):
            i, j = divmod(int(cost.argmin()), len(live))
            a, b = self.balls[live[i]], self.balls[live[j]]
            live[i] = self.ball(a[5] + b[5], a[6] + b[6], float(cost[i, j]), live[i], live[j])
            center[i], radius[i], count[i] = self.balls[live[i]][5] / self.balls[live[i]][6], self.balls[live[i]][4], self.balls[live[i]][6]
            on[j] = False
            cost[j], cost[:, j] = np.inf, np.inf
            compare(i)
        return live[int(np.flatnonzero(on)[0])]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(permutation, nodes), nodes from the root downward, every child after its parent."""
        top, listed, at = self.grow(np.arange(len(self.points))), [], 0
        stack, spot = [(top, -1, 0)], {}
        order = []
        while stack:  # depth first, left before right: leaves meet their ranges in order
            b, up, side = stack.pop()
            spot[b] = len(listed)
            listed.append(b)
            ball = self.balls[b]
            if up >= 0:
                self.balls[up][7 + side] = spot[b]
            if ball[2] < 0:
                order.append(ball[7])
                ball[0], ball[1] = at, at + ball[6]
                at += ball[6]
            else:
                ball += [-1, -1]
                stack += [(ball[3], b, 1), (ball[2], b, 0)]
        nodes = np.zeros(len(listed), _nodes(self.points.shape[1]))
        for k in range(len(listed) - 1, -1, -1):
            ball = self.balls[listed[k]]
            inner = ball[2] >= 0
            left, right = (ball[7], ball[8]) if inner else (-1, -1)
            lo, hi = (nodes[left]["lo"], nodes[right]["hi"]) if inner else (ball[0], ball[1])
            nodes[k] = (lo, hi, left, right, ball[4], ball[5])
        return np.concatenate(order), nodes


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metric tree over the rows of an integer matrix: the order of its points, and balls (range, children, radius, sum)."""
    return _Builder(points).finish()


def walk(nodes: np.ndarray, entries: np.ndarray, visit_ball, visit_points) -> None:
    """Walk a tree level by level with inherited candidate lists.

    ``visit_ball(balls, entry)`` gets the balls that one entry owns whole, ``visit_points(balls, masks)`` the leaves
    whose points must be compared, with their candidates.  Nearness is judged with room for rounding, so that an
    entry that might be nearest, or equally near, stays in the list.
    """
    real = entries.astype(np.float64)
    apart = np.sqrt(((real[:, None, :] - real[None, :, :]) ** 2).sum(axis=2))
    at, mask = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(at):
        ball = nodes[at]
        center = ball["sum"] / (ball["hi"] - ball["lo"])[:, None]
        gap = ((center[:, None, :] - real[None, :, :]) ** 2).sum(axis=2)
        best = np.where(mask, gap, np.inf).argmin(axis=1)
        nearest = gap[np.arange(len(at)), best]
        # All of a ball is nearer to entry b than to e if its centre is, by more than its radius, measured along e - b.
        lead = (gap - nearest[:, None]) / 2 - ball["radius"][:, None] * apart[best]
        mask = mask & ~(lead > SLACK * (1 + gap + nearest[:, None]))
        left = mask.sum(axis=1)
        own = left == 1
        if own.any():
            visit_ball(ball[own], best[own])
        leaf = ~own & (ball["left"] < 0)
        if leaf.any():
            visit_points(ball[leaf], mask[leaf])
        on = ~own & ~leaf
        at, mask = np.concatenate([ball["left"][on], ball["right"][on]]).astype(np.int64), np.concatenate([mask[on], mask[on]])


def _ranges(balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the order, number of the ball) of every point of some balls."""
    size = balls["hi"].astype(np.int64) - balls["lo"]
    whose = np.repeat(np.arange(len(balls)), size)
    return np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(balls["lo"].astype(np.int64), size), whose


def nearest_entry(points: np.ndarray, entries: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lowest nearest entry, squared distance) of each integer point, exactly."""
    out, least = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
    for e in range(len(entries)):
        step = points - entries[e]
        gap = np.einsum("ij,ij->i", step, step)
        if mask is not None:
            gap = np.where(mask[:, e], gap, np.iinfo(np.int64).max)
        nearer = gap < least
        out[nearer], least[nearer] = e, gap[nearer]
    return out, least


def round_sums(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points that each entry owns; ``points`` are in the tree's order."""
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)

    def whole(balls, entry):
        np.add.at(sums, entry, balls["sum"])
        np.add.at(counts, entry, balls["hi"].astype(np.int64) - balls["lo"])

    def compared(balls, masks):
        place, whose = _ranges(balls)
        entry, _ = nearest_entry(points[place], entries, masks[whose])
        for e in np.unique(entry):
            mine = place[entry == e]
            sums[e] += points[mine].sum(axis=0)
            counts[e] += len(mine)

    walk(nodes, entries, whole, compared)
    return sums, counts


def assigned(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point, in the tree's order."""
    code, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)

    def whole(balls, entry):
        place, whose = _ranges(balls)
        code[place] = entry[whose]

    def compared(balls, masks):
        place, whose = _ranges(balls)
        code[place], _ = nearest_entry(points[place], entries, masks[whose])

    walk(nodes, entries, whole, compared)
    step = points - entries[code]
    np.einsum("ij,ij->i", step, step, out=error)
    return code, error


BLOCK_SCHEMA = "vec_ids array<long>, labels array<string>, orders binary, points binary, sizes array<int>, nodes binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer components, shorter vectors padded with zeros."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)] = flat[offsets[0] : offsets[-1]]
    return out


def _blocks(width: int):
    """Batches of vectors to blocks with a tree for each part."""
    d = width // PARTS

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                m = _matrix(pa.concat_arrays([part.column("v")]), width)
                orders, points, sizes, trees = [], [], [], []
                for p in range(PARTS):
                    order, nodes = build_tree(m[:, p * d : (p + 1) * d])
                    orders.append(order.astype(np.int32).tobytes())
                    points.append(m[order, p * d : (p + 1) * d].astype(np.int32).tobytes())
                    sizes.append(len(nodes))
                    trees.append(nodes.tobytes())
                yield pa.RecordBatch.from_pylist([{"vec_ids": part.column("vec_id").to_pylist(), "labels": part.column("label").to_pylist(), "orders": b"".join(orders), "points": b"".join(points), "sizes": sizes, "nodes": b"".join(trees)}], pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("orders", pa.binary()), ("points", pa.binary()), ("sizes", pa.list_(pa.int32())), ("nodes", pa.binary())]))

    return run


def _opened(row: dict, d: int):
    """(order, points, nodes) of each part of a stored block."""
    n, kind, at = len(row["vec_ids"]), _nodes(d), 0
    for p in range(PARTS):
        order = np.frombuffer(row["orders"], np.int32, n, 4 * n * p)
        points = np.frombuffer(row["points"], np.int32, n * d, 4 * n * d * p).reshape(n, d).astype(np.int64)
        yield order, points, np.frombuffer(row["nodes"], kind, row["sizes"][p], at)
        at += row["sizes"][p] * kind.itemsize


def _round(books: list[np.ndarray], d: int):
    """One row of sums for each part, entry and component that a task's blocks give."""

    def run(batches):
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                for p, (_, points, nodes) in enumerate(_opened(row, d)):
                    s, c = round_sums(points, nodes, books[p])
                    sums[p] += s
                    counts[p] += c
        rows = [(p, e, counts[p][e], sums[p][e]) for p in range(PARTS) for e in range(len(books[p])) if counts[p][e]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int64()))] + [pa.array([r[3].tolist() for r in rows], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _encode(books: list[np.ndarray], d: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["vec_ids"])
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p, (order, points, nodes) in enumerate(_opened(row, d)):
                    code, off = assigned(points, nodes, books[p])
                    codes[order, p] = code
                    error[order] += off
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label as text, v): kept vectors as floor(4096 x); components beyond +-2**27 are set to that bound."""
    source = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("x", lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * SCALE))).cast("long"))
    return source.where(F.coalesce(finite, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each kept row of (vec_id, embedding, label).

    Rows whose vector is null or holds null, NaN or infinite components are
    dropped.  Vectors of unequal length are padded with zeros to the longest,
    and that to a multiple of eight.  Codebooks begin with the 16 smallest
    vec_ids (of repeated ones the smaller vector first; null ids last), fewer
    if there are fewer rows.  Repeated rows count as often as they occur; null
    labels share one sum; other columns are ignored.  No kept row gives no row.
    """
    rows = prepared(vectors)
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = max(PARTS, -(-(longest or 0) // PARTS) * PARTS)
    d = width // PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", "label").limit(ENTRIES).select("v").collect()
    start = np.zeros((len(first), width), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    books = [start[:, p * d : (p + 1) * d].copy() for p in range(PARTS)]
    blocks = stored(rows.mapInArrow(_blocks(width), BLOCK_SCHEMA), "vector-blocks")
    for _ in range(ROUNDS if len(first) else 0):
        parts = blocks.mapInArrow(_round(books, d), "part int, entry int, n long, sums array<long>")
        # At most 8 parts x 16 entries x the components of a part come to the driver.
        each = parts.select("part", "entry", "n", F.posexplode("sums").alias("k", "x")).groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in each.collect():
            books[r["part"]][r["entry"], r["k"]] = int(r["x"]) // r["n"]
    coded = stored(blocks.mapInArrow(_encode(books, d), "vec_id long, label string, code string, error long"), "vector-codes")
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), "label"))
    coded = coded.withColumn("_key", key)
    sums = coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    hot = stored(hot_keys(sums, "_key", "_n"), "hot-labels")
    out = spread_join(coded, sums.drop("_n"), "_key", hot, "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The rounds written out: components by row, part and position, distances by joins on part and position."""
    steps = [
        f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT i, p, j, v[p * (len(v) // {PARTS}) + j] AS x FROM k, LATERAL (SELECT unnest(range({PARTS})) AS p), LATERAL (SELECT unnest(range(1, len(v) // {PARTS} + 1)) AS j)),
b0 AS (SELECT p, i - 1 AS e, j, x FROM x WHERE i <= {ENTRIES})"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"g{r} AS MATERIALIZED (SELECT i, p, arg_min(e, (g, e)) AS e, min(g) AS g FROM (SELECT i, x.p, e, CAST(sum((x.x - b.x) * (x.x - b.x)) AS BIGINT) AS g FROM x JOIN b{r} b ON b.p = x.p AND b.j = x.j GROUP BY i, x.p, e) GROUP BY i, p)")
        if r < ROUNDS:
            mean = "CAST(floor(sum(x) / count(*)) AS BIGINT)"  # sums stay below 2**53
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT p, e, j, {mean} AS x FROM x JOIN g{r} USING (i, p) GROUP BY p, e, j) m USING (p, e, j))")
    steps.append(f"c AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(g) AS BIGINT) AS error FROM g{ROUNDS} GROUP BY i)")
    return (
        ",\n".join(steps)
        + f""" SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256 FROM k JOIN c USING (i)"""
    )


CODES_SQL = _codes_sql()
