"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids, one for each range of keys.

A turn's id is 16 bytes of a digest of its role and text; a conversation's key
is its turns' ids in order.  Equal conversations are one key with a weight.
Keys are partitioned by range, so that a prefix which a third of all
conversations share is cut like any other.  Each range grows an adaptive radix
tree (layouts of 4, 16, 48 and 256 children, compressed paths); only byte
depths that end a turn emit nodes.  A node that lies wholly inside a range is
final there.  Only the paths that a range shares with its neighbours are
partial: every sum over a subtree is a sum over ranges, because a node counts
as new only in the first range that has it, and those few rows are added up.

A key has at most ``LONG`` turns.  Behind them the nodes of a conversation are a
chain, as long as no different one begins with the same ``LONG`` turns: the rest
is a digest in the key, with the rest's bytes, and its nodes are made row by
row from the pieces of the conversation, which are never gathered.  Different
conversations that share more than ``LONG`` turns keep whole keys.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, stored

#: Bytes of a turn's id; turn numbers that are sorted together; conversation ids joined to one text; turns of a range at most, about.
WIDTH, SPAN, ID_BLOCK, RANGE_TURNS = 16, 1024, 1 << 16, 500_000
#: Turns that a conversation may take from the first of its five, at most.
MOST_SHARED = 8
#: Turns of a key.  The rest of a longer conversation is one last id of its key, and a chain of nodes of its own.
LONG = 4096
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


class Node4:
    """Up to four children in two short arrays; ``row`` is the key that ends here, or -1."""

    __slots__ = ("prefix", "row", "labels", "kids")
    room = 4

    def __init__(self, prefix: bytes, row: int = -1, labels: bytes = b"", kids: tuple = ()):
        self.prefix, self.row, self.labels, self.kids = prefix, row, bytearray(labels), list(kids)

    def find(self, label: int):
        k = self.labels.find(label)
        return self.kids[k] if k >= 0 else None

    def put(self, label: int, kid):
        """Set a child; returns the node, or the larger one that takes its place."""
        k = bisect_left(self.labels, label)
        if k < len(self.labels) and self.labels[k] == label:
            self.kids[k] = kid
            return self
        if len(self.labels) == self.room:
            return self.grown().put(label, kid)
        self.labels.insert(k, label)
        self.kids.insert(k, kid)
        return self

    def grown(self):
        return Node16(self.prefix, self.row, self.labels, self.kids)

    def children(self):
        return self.kids


class Node16(Node4):
    """Up to sixteen children, found by bisection."""

    __slots__ = ()
    room = 16

    def find(self, label: int):
        k = bisect_left(self.labels, label)
        return self.kids[k] if k < len(self.labels) and self.labels[k] == label else None

    def grown(self):
        return Node48(self.prefix, self.row, self.labels, self.kids)


class Node48:
    """Up to 48 children behind an index of all labels."""

    __slots__ = ("prefix", "row", "index", "kids")

    def __init__(self, prefix: bytes, row: int, labels: bytes, kids: list):
        self.prefix, self.row, self.index, self.kids = prefix, row, bytearray(256), list(kids)
        for k, label in enumerate(labels):
            self.index[label] = k + 1

    def find(self, label: int):
        k = self.index[label]
        return self.kids[k - 1] if k else None

    def put(self, label: int, kid):
        k = self.index[label]
        if k:
            self.kids[k - 1] = kid
        elif len(self.kids) == 48:
            return Node256(self).put(label, kid)
        else:
            self.kids.append(kid)
            self.index[label] = len(self.kids)
        return self

    def children(self):
        return self.kids


class Node256:
    """A place for every label."""

    __slots__ = ("prefix", "row", "kids")

    def __init__(self, small: Node48):
        self.prefix, self.row = small.prefix, small.row
        self.kids = [small.find(label) for label in range(256)]

    def find(self, label: int):
        return self.kids[label]

    def put(self, label: int, kid):
        self.kids[label] = kid
        return self

    def children(self):
        return [k for k in self.kids if k is not None]


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common beginning of ``a`` and ``b[at:]``."""
    least, most = 0, min(len(a), len(b) - at)
    while least < most:
        half = (least + most + 1) // 2
        if a[:half] == b[at : at + half]:
            least = half
        else:
            most = half - 1
    return least


class RadixTree:
    """An adaptive radix tree; one key may be the beginning of another."""

    def __init__(self):
        self.root = Node4(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, above, label, at = self.root, None, 0, 0
        while True:
            shared = len(node.prefix) if key.startswith(node.prefix, at) else _common(node.prefix, key, at)
            at += shared
            if shared < len(node.prefix):  # the compressed path forks
                fork = Node4(node.prefix[:shared])
                turn, node.prefix = node.prefix[shared], node.prefix[shared + 1 :]
                fork.put(turn, node)
                if at == len(key):
                    fork.row = row
                else:
                    fork.put(key[at], Node4(key[at + 1 :], row))
                above.put(label, fork)
                return
            if at == len(key):
                node.row = row
                return
            kid = node.find(key[at])
            if kid is None:
                larger = node.put(key[at], Node4(key[at + 1 :], row))
                if larger is not node:
                    if above is None:
                        self.root = larger
                    else:
                        above.put(label, larger)
                return
            node, above, label, at = kid, node, key[at], at + 1


NODE_SCHEMA = "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, weight long, fresh long, ends string"


def _name(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[: depth * WIDTH]).digest()[:WIDTH]


def range_nodes(keys: list[bytes], sizes: list[list[int]], counts: list[int], lowest: list[int], ends: list[str], before: int, after: int) -> dict[str, list]:
    """Nodes of one range of distinct keys.

    ``before`` and ``after`` are the turns that the least key shares with the
    range before and the greatest with the range behind (-1: there is none).
    ``node`` and ``parent`` name what is partial (else null); ``weight`` is the
    subtree's members times bytes, ``fresh`` the bytes of its nodes that no range before has.
    """
    tree = RadixTree()
    for row, key in enumerate(keys):
        tree.insert(key, row)
    first, last = min(range(len(keys)), key=keys.__getitem__), max(range(len(keys)), key=keys.__getitem__)
    longer = after * WIDTH == len(keys[last])
    nodes, ups, tops = [tree.root], [-1], [0]  # parents before children; byte depth of the end
    for k, node in enumerate(nodes):
        for kid in node.children():
            nodes.append(kid)
            ups.append(k)
            tops.append(tops[k] + 1 + len(kid.prefix))
    member, least, leaves, weight, fresh = [0] * len(nodes), [None] * len(nodes), [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    sample, has_first, has_last, heads = [-1] * len(nodes), [False] * len(nodes), [False] * len(nodes), [[] for _ in nodes]
    out = {name: [] for name in ("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "weight", "fresh", "ends")}
    up_of, is_new, is_open, whose = [], [], [], []
    for k in range(len(nodes) - 1, -1, -1):
        row, end, start = nodes[k].row, tops[k], tops[ups[k]] if k else -1
        if row >= 0:
            member[k] += counts[row]
            least[k] = lowest[row] if least[k] is None else min(least[k], lowest[row])
            sample[k] = row
            has_first[k] |= row == first
            has_last[k] |= row == last
        here = heads[k]
        for depth in range(end // WIDTH, start // WIDTH, -1):
            new = not (has_first[k] and depth <= before)
            partial = not new or (has_last[k] and depth <= after)
            stops = row >= 0 and depth * WIDTH == end
            if stops and not here and not (row == last and longer):
                leaves[k] += 1
            size = sizes[sample[k]][depth - 1] if depth else 0
            weight[k] += member[k] * size
            fresh[k] += size if new else 0
            at = len(up_of)
            up_of.append(-1)
            is_new.append(new)
            is_open.append(partial)
            whose.append(sample[k])
            for h in here:
                up_of[h] = at
            for name, value in zip(("conv_id", "depth", "n_convs", "n_children", "n_leaves", "weight", "fresh"), (least[k], depth, member[k], sum(is_new[h] for h in here), leaves[k], weight[k], fresh[k])):
                out[name].append(value)
            out["ends"].append(ends[row] if stops else None if partial else NO_MEMBERS)
            here = [at]
        if k:
            up = ups[k]
            member[up] += member[k]
            least[up] = least[k] if least[up] is None else min(least[up], least[k])
            leaves[up] += leaves[k]
            weight[up] += weight[k]
            fresh[up] += fresh[k]
            sample[up] = sample[k]
            has_first[up] |= has_first[k]
            has_last[up] |= has_last[k]
            heads[up] += here
        heads[k] = []
    for at, up in enumerate(up_of):
        depth, key = out["depth"][at], keys[whose[at]]
        out["node"].append(_name(key, depth) if is_open[at] else None)
        out["parent"].append(_name(key, depth - 1) if up >= 0 and is_open[up] else None)
        out["parent_conv_id"].append(out["conv_id"][up] if up >= 0 and not is_open[up] else None)
    return out


_ARROW = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
_FIELDS = [(f.split()[0], _ARROW[f.split()[1]]) for f in NODE_SCHEMA.split(", ")]


def _grow(group: pa.Table) -> pa.Table:
    column = lambda name: group.column(name).to_pylist()
    before, after = group.column("before")[0].as_py(), group.column("after")[0].as_py()
    found = range_nodes(column("key"), column("sizes"), column("n"), column("lowest"), column("ends"), before, after)
    return pa.table({name: pa.array(found[name], kind) for name, kind in _FIELDS})


def _meetings(batches):
    """Turns that the first key shares with the key before the range, and the last with the key behind it."""
    for batch in batches:
        rows = batch.to_pylist()
        share = lambda a, b: -1 if a is None or b is None else _common(a, b, 0) // WIDTH
        yield pa.RecordBatch.from_arrays([pa.array([r["part"] for r in rows], pa.int32()), pa.array([share(r["first"], r["_last"]) for r in rows], pa.int32()), pa.array([share(r["last"], r["_first"]) for r in rows], pa.int32())], ["part", "before", "after"])


def _end_digests(batches):
    """SHA-256 of each key's ids, read in order as they come: (sid, block, ids) rows are sorted, no key's ids are gathered."""
    sid, state, done = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
            if key != sid:
                if sid is not None:
                    done.append((sid, state.hexdigest()))
                sid, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["sid", "ends"])
            done = []
    if sid is not None:
        done.append((sid, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["sid", "ends"])


def _segments(turns: DataFrame) -> DataFrame:
    """(conv_id, at, els): a conversation's turns in order, cut where its turn numbers pass a multiple of ``SPAN``; ``at`` turns come before."""
    role, text = F.coalesce(turns["role"].cast("string"), F.lit("")), F.coalesce(turns["text"].cast("string"), F.lit(""))
    ident = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), ident.alias("id"), F.octet_length(text).cast("long").alias("size")).where("conv_id is not null")
    span = F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(-(1 << 62)))
    cut = rows.groupBy("conv_id", span.alias("span")).agg(F.array_sort(F.collect_list(F.struct("turn", "id", "size"))).alias("els"))
    cut = stored(cut.select("conv_id", "span", F.transform("els", lambda e: F.struct(e["id"].alias("id"), e["size"].alias("size"))).alias("els")), "turns")
    counts = cut.select("conv_id", "span", F.size("els").cast("long").alias("n"))
    at = F.sum("n").over(Window.partitionBy("conv_id").orderBy("span")) - F.col("n")
    return cut.join(counts.select("conv_id", "span", at.alias("at")), ["conv_id", "span"]).drop("span")


def _pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, start, els) of every rebuilt conversation: its turns in pieces, ``start`` turns come before; a turnless one has an empty piece.

    Conversation c takes the first h turns of conversation c - c mod 5, then
    its own behind its first h; h is crc32 of the decimal c, modulo 9.
    """
    cut = _segments(turns)
    shared = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    heads = cut.where((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("at") < MOST_SHARED)).select(F.col("conv_id").alias("base"), F.struct("at", F.slice("els", F.lit(1), (F.lit(MOST_SHARED) - F.col("at")).cast("int")).alias("els")).alias("piece"))
    heads = heads.groupBy("base").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["els"])).alias("head"))
    each = cut.select("conv_id").distinct().withColumn("base", base).join(heads, "base", "left")
    lead = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), shared.cast("int")))
    none = F.array().cast("array<struct<id:string,size:bigint>>")
    lead = each.select("conv_id", F.coalesce(lead, none).alias("els"))
    skip = F.greatest(F.lit(0), shared - F.col("at")).cast("int")
    own = cut.where(F.size("els") > skip).select("conv_id", F.greatest(F.lit(0).cast("long"), F.col("at") - shared).alias("behind"), F.slice("els", skip + 1, F.size("els")).alias("els"))
    sizes = lead.select("conv_id", F.size("els").cast("long").alias("led"))
    return lead.select("conv_id", F.lit(0).cast("long").alias("start"), "els").unionByName(own.join(sizes, "conv_id").select("conv_id", (F.col("led") + F.col("behind")).alias("start"), "els"))


def _joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, key, sizes) of whole pieces."""
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", F.size("els").alias("n"), "els"))).alias("p"))
    whole = whole.withColumn("els", F.flatten(F.transform("p", lambda x: x["els"])))
    key = F.unhex(F.array_join(F.transform("els", lambda e: e["id"]), ""))
    return whole.select("conv_id", key.alias("key"), F.transform("els", lambda e: e["size"]).alias("sizes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Keys (conv_id, key, sizes) of every rebuilt conversation, and the pieces (conv_id, start, els) behind keys that end with a digest, if any do."""
    pieces = stored(_pieces(turns), "pieces")
    over = F.col("start") + F.size("els") - LONG  # turns of a piece behind the key
    long = stored(pieces.where(over > 0).select("conv_id").distinct(), "long-conversations")
    if long.isEmpty():
        return _joined(pieces), None
    short, rest = pieces.join(long, "conv_id", "left_anti"), pieces.join(long, "conv_id", "left_semi")
    front = rest.where(F.col("start") < LONG).withColumn("els", F.slice("els", F.lit(1), (F.lit(LONG) - F.col("start")).cast("int")))
    back = rest.where(over > 0).select("conv_id", F.greatest("start", F.lit(LONG).cast("long")).alias("start"), F.when(F.col("start") < LONG, F.slice("els", (F.lit(LONG) - F.col("start") + 1).cast("int"), F.size("els"))).otherwise(F.col("els")).alias("els"))
    back = stored(back, "tails")
    # Sums over turns do not depend on where pieces were cut.
    turn = F.posexplode("els").alias("k", "e")
    each = back.select("conv_id", "start", turn).select("conv_id", "e.size", *[F.xxhash64(F.lit(seed), F.col("start") + F.col("k"), "e.id").cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)])
    digest = each.groupBy("conv_id").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    digest = digest.select("conv_id", F.substring(F.sha2(F.concat_ws(":", F.lit("rest"), "h1", "h2", "n"), 256), 1, 2 * WIDTH).alias("rest"), "bytes")
    keyed = _joined(front).join(digest, "conv_id").withColumn("front", F.sha2("key", 256))
    apart = keyed.groupBy("front").agg(F.count_distinct("rest").alias("_k")).where("_k > 1").select("front")
    keyed = stored(keyed.join(apart.withColumn("split", F.lit(True)), "front", "left"), "long-keys")
    whole = rest.join(keyed.where("split").select("conv_id"), "conv_id", "left_semi")
    chains = keyed.where("split is null")
    ended = chains.select("conv_id", F.concat("key", F.unhex("rest")).alias("key"), F.concat("sizes", F.array("bytes")).alias("sizes"))
    return _joined(short).unionByName(_joined(whole)).unionByName(ended), back.join(chains.select("conv_id"), "conv_id", "left_semi")


def _chains(ends: DataFrame, tails: DataFrame) -> DataFrame:
    """Nodes behind the keys' last digests: one for each turn of the smallest member's tail, from its pieces."""
    sums = tails.select("conv_id", "start", F.aggregate("els", F.lit(0).cast("long"), lambda a, e: a + e["size"]).alias("b"), F.size("els").alias("n"))
    by = Window.partitionBy("conv_id")
    sums = sums.select("conv_id", "start", (F.sum("b").over(by) - F.sum("b").over(by.orderBy("start")) + F.col("b")).alias("left"), F.max(F.col("start") + F.col("n")).over(by).alias("last"))
    each = tails.join(sums, ["conv_id", "start"]).select("conv_id", "start", "left", "last", F.posexplode("els").alias("k", "e"))
    before = F.sum("e.size").over(Window.partitionBy("conv_id", "start").orderBy("k")) - F.col("e.size")
    rows = each.withColumn("left", F.col("left") - before).join(ends.select("conv_id", "parent_conv_id", "n_convs", "ends_sha256"), "conv_id").withColumn("depth", F.col("start") + F.col("k") + 1)
    final = F.col("depth") == F.col("last")
    parent = F.when(F.col("depth") == LONG + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    one = F.lit(1).cast("long")
    return rows.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.when(final, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("left")).alias("saved_tokens"), F.when(final, F.col("ends_sha256")).otherwise(NO_MEMBERS).alias("ends_sha256"))


def _distinct(conversations: DataFrame) -> DataFrame:
    """(key, sizes, n, lowest, ends): equal conversations once, with the digest of their ids."""
    named = conversations.withColumn("sid", F.unhex(F.sha2("key", 256)))
    groups = named.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lowest"))
    ids = named.groupBy("sid", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = ids.repartition("sid").sortWithinPartitions("sid", "block").select("sid", "ids").mapInArrow(_end_digests, "sid binary, ends string")
    known = groups.join(ends, "sid").drop("sid")
    return conversations.join(known, conversations["conv_id"] == known["lowest"]).select("key", "sizes", "n", "lowest", "ends")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations of (conv_id, turn, role, text).

    Turns are ordered by number, null first, and by id where numbers repeat;
    repeated rows are turns of their own.  Null roles and texts are empty.
    Rows without a conv_id belong to no conversation.  Extra columns are
    ignored; an empty table has no node.
    """
    spark = turns.sparkSession
    conversations, tails = rebuilt(turns)
    keys = stored(_distinct(stored(conversations, "rebuilt")), "keys")
    total = keys.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TURNS))
    ranged = stored(keys.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "key-ranges")
    edges = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("part")  # one row a range
    edges = edges.withColumn("_last", F.lag("last").over(order)).withColumn("_first", F.lead("first").over(order))
    meetings = stored(edges.mapInArrow(_meetings, "part int, before int, after int"), "meetings")
    made = stored(ranged.join(F.broadcast(meetings), "part").groupBy("part").applyInArrow(_grow, NODE_SCHEMA), "range-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "fresh")]
    met = stored(made.where("node is not null").groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.coalesce(F.max("ends"), F.lit(NO_MEMBERS)).alias("ends")), "met-nodes")
    above = met.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = made.where("node is null and parent is not null").drop("parent_conv_id")
    hot = stored(hot_keys(below.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n"), "hot-parents")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("weight") - F.col("fresh")).alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    rows = [made.where("node is null and parent is null"), spread_join(below, above, "parent", hot, "conv_id"), met.join(above, "parent", "left")]
    nodes = rows[0].select(*columns).unionByName(rows[1].select(*columns)).unionByName(rows[2].select(*columns))
    if tails is None:
        return nodes
    nodes = stored(nodes, "nodes")
    ends = nodes.where(F.col("depth") == LONG + 1).join(tails.select("conv_id").distinct(), "conv_id", "left_semi")
    return nodes.join(ends.select("conv_id", "depth"), ["conv_id", "depth"], "left_anti").select(*nodes.columns).unionByName(_chains(ends, tails))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit."""
    bits = f"list_transform(range(8 * length({text})), lambda i: (ord({text}[i // 8 + 1]) >> (i % 8)) & 1)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform({bits}, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)))"


TRIE_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'id': sha256(concat(length(role), ':', role, text)), 'size': strlen(text)}} ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS els FROM t GROUP BY conv_id),
h AS (SELECT conv_id, els, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.els, [])[1:h.h], h.els[h.h + 1:]) AS els FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(els) AS n, d, list_transform(els[1:d], lambda e: e.id) AS prefix, list_transform(els[1:d - 1], lambda e: e.id) AS up, CASE WHEN d = 0 THEN 0 ELSE els[d].size END AS size FROM r, LATERAL (SELECT unnest(range(len(els) + 1)) AS d)),
n AS (SELECT prefix, any_value(CASE WHEN d > 0 THEN up END) AS up, any_value(size) AS size, d, count(*) AS n_convs, min(conv_id) AS conv_id, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY prefix, d),
k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
s AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.prefix),
a AS (SELECT prefix[1:j] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM s, LATERAL (SELECT unnest(range(d + 1)) AS j) GROUP BY 1)
SELECT s.conv_id, s.d AS depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM s JOIN a ON a.prefix = s.prefix LEFT JOIN n AS u ON s.d > 0 AND u.prefix = s.up"""
