"""Connected components: right on any links, in no more rounds than these need."""

import random

from tidemark.llm import common


def smallest_reachable(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        r, s = sorted((root(a), root(b)))
        up[s] = r
    return {x: root(x) for x in up}


def tables(monkeypatch):
    """Names of the tables that ``components`` writes from now on."""
    written, store = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(name) or store(df, name))
    return written


def found(spark, links):
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r["id"] for r in got})
    return {r["id"]: r["component"] for r in got}


def test_any_links(spark):
    random.seed(3)
    loose = [(random.randrange(400), random.randrange(400)) for _ in range(260)]
    chain = [(k + 1000, k + 1001) for k in range(40)]
    hub = [(5000, k + 3000) for k in range(60)]
    links = loose + chain + hub
    want = {x: c for x, c in smallest_reachable(links).items() if any(x in p and p[0] != p[1] for p in links)}
    assert found(spark, links) == want
    assert found(spark, []) == {} == found(spark, [(7, 7)])


def test_stars_need_no_round(spark, monkeypatch):
    written = tables(monkeypatch)
    links = [(1, k) for k in range(2, 30)] + [(k, 40) for k in (50, 51)] + [(51, 40)]
    assert found(spark, links) == smallest_reachable(links)
    assert written == ["links"]


def test_two_stars_that_are_linked_need_one_round(spark, monkeypatch):
    written = tables(monkeypatch)
    links = [(1, k) for k in range(3, 9)] + [(2, k) for k in range(10, 15)] + [(1, 2)]
    assert found(spark, links) == smallest_reachable(links)
    assert written == ["links", "links"]
