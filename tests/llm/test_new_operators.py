"""URL filter, prefix trie and vector codes against brute force, their SQL and their edges."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, urls, vector_codes

# --- quality classifier


def test_scores_equal_plain_compression(spark, sf):
    """Every score from the trained parts alone: frames of plain Zstandard, pooled neighbours, a logistic curve."""
    import zstandard

    from tidemark.llm import quality

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    presses = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]

    def difference(text):
        pieces = [text[k : k + quality.CHUNK_BYTES] for k in range(0, len(text), quality.CHUNK_BYTES)]
        good, bad = (sum(len(p.compress(x)) for x in pieces) for p in presses)
        return (bad - good) / (len(text) + quality.DAMPING)

    def score(x):
        p = 1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * x + model.offset))))
        xs, ys = model.knots
        k = next((i for i, v in enumerate(xs) if v > x), len(xs))
        line = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k - 1] + (ys[k] - ys[k - 1]) * (x - xs[k - 1]) / (xs[k] - xs[k - 1])
        return (1 - quality.BLEND) * line + quality.BLEND * p

    assert all(b >= a for a, b in zip(model.knots[1], model.knots[1][1:]))
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in quality.scores(docs, model).collect())
    assert got == Counter((r["doc_id"], round(score(difference((r["text"] or "").encode())), 9)) for r in docs.collect())


# --- URL filter


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


ODD = [
    None, "", "no scheme/en/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/", "http://notexample.com/en/", "http://a.example.com/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/z",
    "https://x.net/es/1", "https://x.net/fr/", "https://net/fr/", "https://x.net/Es/1", "https://x.org?u=http://y.com/", "https://x.com#/en/", "https://x.com:80/en/", "://com/", "a://b://c.com/", "http://ÀÉ.com/é", "http://x.net/\n/es/", "http://.com/", "http://com./", "x" * 5000 + "://" + "y" * 5000 + ".com/" + "z" * 50_000,
]


def test_url_rules_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    made = ["".join(rng.choice(("http://", "www.", "example.", "com", "net", "/", "en/", "es/", "fr/", "?", "#", "x", "A")) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(i, u, "page", "r") for i, u in enumerate(ODD + made + made[:9])], "page_id long, url string, host string, rule string")
    more = [*urls.RULES, ("block", "example.com", ""), ("allow", "www.example.com", "/"), ("block", "x.net", "/e")]
    for rules in (urls.RULES, more):
        want = Counter((i, *brute_url(u, rules)) for i, u in enumerate(ODD + made + made[:9]))
        for bound in (64, 0):
            monkeypatch.setattr(urls, "EXPRESSION_RULES", bound)
            got = urls.judged(rows, rules).collect()
            assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got) == want
            assert all(r["verdict"] == ("block" if r["score"] >= 0.5 else "allow") for r in got if not r["rule"])


def test_url_rules_as_a_table_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 2)
    monkeypatch.setattr(urls, "EXPRESSION_RULES", 1)
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    rows = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judged(rows, rules).collect()}
    assert got == {i: brute_url(u, urls.RULES)[:3] for i, u in enumerate(ODD)}


def test_url_model_on_urls_it_never_saw(spark):
    bad = ["https://www.casino-royal.net/de/1", "http://m.cheap-pills.org/x", "https://free-bets.org/", "https://blog.spam-farm.net/en/9", "http://adult-x.example.org/de/77", "https://m.ads-track.example.org/"]
    good = ["https://www.school-library.net/de/1", "http://m.thther.example.org/x", "https://garden-news.org/", "https://blog.farmers.net/en/9", "http://tiontion.example.org/de/77", "https://m.museum.example.org/"]
    rows = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(rows, ()).collect()}
    assert [got[i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_url_grams_equal_brute_force():
    import pyarrow as pa

    texts = ["", "a", "Host7.com", None, "éa", "x" * 30]
    row, bucket = urls.grams(pa.array(texts), 1)
    want = Counter()
    for i, t in enumerate(texts):
        b = bytes([0]) + bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in (t or "").encode()) + bytes([0])
        for n in urls.SIZES:
            for k in range(len(b) - n + 1):
                value = int.from_bytes(b[k : k + n], "big") | (1 << 3 | n) << (8 * n)
                want[i, int(urls.mix(np.array([value], np.uint64))[0]) >> (64 - urls.BITS)] += 1
    assert Counter(zip(row.tolist(), bucket.tolist())) == want


def test_url_filter_of_nothing(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []
    empty = urls.fit(spark, spark.createDataFrame([], "url string, label int"))
    assert urls.judged(spark.createDataFrame([(None, None)], "page_id long, url string"), (), empty).collect()[0]["score"] == 0.5


# --- prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [e[3:] for e in sorted(v)] for c, v in turns.items()}
    whole = {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9 :] for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        ends[tuple(s)].append(c)
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("ranges", "long"), [(1, 4096), (2, 9), (7, 4096), (5, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, ranges, long):
    monkeypatch.setattr(prefix_trie, "LONG", long)
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", 40)
    rng = random.Random(ranges)
    rows = []
    for c in [*range(0, 80), *range(1000, 1040, 3), -7, -5]:
        for t in range(rng.choice((1, 2, 3, 5, 12))):
            rows.append((c, rng.choice((t, t, t, None, 5)), rng.choice(("user", "bot", None, "")), rng.choice(("a", "b", "é" * 9, None, "", "long " * 400)) if t % 3 else "same"))
    rows += rows[:5] + [(None, 0, "user", "lost")] + [(2000, t, "user", str(t)) for t in range(50)] + [(2001, t, "user", str(t)) for t in range(50)]
    # One that shares twenty turns with them, one that ends where a key does, and two equal ones with other turn numbers.
    rows += [(2002, t, "user", str(t) if t < 20 else f"other {t}") for t in range(40)] + [(2003, t, "user", str(t)) for t in range(9)] + [(c, t * k, "bot", f"alone {t}") for c, k in ((3000, 1), (4000, 5)) for t in range(30)] + [(5000, t, "bot", f"lonely {t}") for t in range(30)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        frame = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
        assert Counter(tuple(r) for r in prefix_trie.trie(frame).collect()) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_of_few_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(3, 0, "user", "x")]  # takes more turns of an absent conversation than it has: no turn is left
    assert Counter(tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()) == brute_trie(rows)
    rows = [(5 * k, 0, "user", "x") for k in range(300)]
    assert Counter(tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()) == brute_trie(rows)


def test_radix_tree_layouts_and_paths():
    rng = random.Random(1)
    keys = list({bytes(rng.choice((0, 1, 255, rng.randrange(256))) for _ in range(rng.randint(0, 6))) for _ in range(4000)} | {bytes([a, 7]) for a in range(256)} | {bytes([9, 9, a]) for a in range(40)} | {bytes([8, 8, a]) for a in range(12)})
    rng.shuffle(keys)
    tree = prefix_trie.RadixTree()
    for row, key in enumerate(keys):
        tree.insert(key, row)

    def found(key):
        node, at = tree.root, 0
        while node is not None and key.startswith(node.prefix, at):
            at += len(node.prefix)
            if at == len(key):
                return node.row
            node, at = node.find(key[at]), at + 1
        return -1

    assert [found(k) for k in keys] == list(range(len(keys)))
    kinds, stack = set(), [tree.root]
    while stack:
        node = stack.pop()
        kinds.add(type(node).__name__)
        stack += node.children()
        assert node.row >= 0 or len(node.children()) > 1 or node is tree.root  # paths are compressed
    assert kinds == {"Node4", "Node16", "Node48", "Node256"}


# --- vector codes


def brute_codes(rows):
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(8, -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8)
    kept = [(i, [math.floor(min(max(4096 * x, -(2.0**27)), 2.0**27)) for x in v] + [0] * (width - len(v)), l) for i, v, l in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    d, books, codes, errors = width // 8, [], [""] * len(kept), [0] * len(kept)
    for p in range(8):
        points, book = [r[1][p * d : p * d + d] for r in kept], [r[1][p * d : p * d + d] for r in first]
        for step in range(7):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in points]
            if step < 6:
                for k in range(len(book)):
                    mine = [x for x, (_, n) in zip(points, near) if n == k]
                    if mine:
                        book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        books += [str(c) for e in book for c in e]
        codes = [c + f"{k:02x}" for c, (_, k) in zip(codes, near)]
        errors = [e + g for e, (g, _) in zip(errors, near)]
    labels = Counter()
    for (_, _, l), e in zip(kept, errors):
        labels[l] += e
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return Counter((i, c, e, labels[l], digest) for (i, _, l), c, e in zip(kept, codes, errors))


VECTORS = "vec_id long, embedding array<float>, label int"


def exact(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


def test_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 150)
    monkeypatch.setattr(vector_codes, "LEAF_POINTS", 10)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16)) * 0.3
    rows = [(int(i), (centers[i % 20] + rng.normal(size=16) * 0.001 * (i % 7)).tolist(), int(i) % 3 or None) for i in rng.permutation(500)]
    rows += rows[:40] + [rows[0]] * 200 + [(None, rows[1][1], 1), (3, [0.0] * 16, 2), (9000, None, 1), (9001, [float("nan")] * 16, 1), (9002, [None] * 16, 1), (9003, [float("inf")] * 16, 1), (9004, [0.25] * 5, None), (9005, [], 4), (9006, [3e38] * 16, 5)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).repartition(3)
    assert Counter(tuple(r) for r in vector_codes.compressed(frame).collect()) == brute_codes(exact(rows))


def test_codes_of_few_vectors(spark):
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compressed(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    rows = [(7, [-0.0001] * 8, None), (7, [0.5] * 8, None), (2, [-1.5] * 8, 1)]
    assert Counter(tuple(r) for r in vector_codes.compressed(spark.createDataFrame(rows, VECTORS)).collect()) == brute_codes(exact(rows))


def test_balls_hold_their_points_and_are_owned_whole():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-9, 9, (900, 4)) + 1000 * k for k in range(8)] + [np.full((700, 4), 5)])
    order, nodes = vector_codes.build_tree(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    for node in nodes:
        mine = points[order[node["lo"] : node["hi"]]]
        assert (mine.sum(axis=0) == node["sum"]).all()
        assert np.sqrt(((mine - mine.mean(axis=0)) ** 2).sum(axis=1)).max() <= node["radius"] + 1e-6
    entries = points[[0, 900, 1800, 2700, 5, 3600]]
    touched = []
    vector_codes.walk(nodes, entries, lambda balls, e: None, lambda balls, m: touched.append((balls["hi"] - balls["lo"]).sum()))
    assert sum(touched) < len(points) / 2  # most balls are owned without touching their points
    code, error = vector_codes.assigned(points[order], nodes, entries)
    want = ((points[order][:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()


def test_new_queries_equal_their_sql(spark, sf):
    from tidemark.llm import queries

    con = duckdb.connect()
    for name in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op12_prefix_trie", "op13_vector_codes"):
        reply = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in reply.description]
        got = queries.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(columns)
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(reply.fetchall())
