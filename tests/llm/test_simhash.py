import random

import numpy as np
import xxhash

from vitalspark.llm import simhash
from vitalspark.llm.common import components


def brute(values, budget=4):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def planted(n, seed):
    rnd = random.Random(seed)
    values = {rnd.getrandbits(64) for _ in range(n)}
    for x in list(values)[: n // 2]:
        for bits in (1, 3, 4, 5, 6):
            values.add(x ^ sum(1 << b for b in rnd.sample(range(64), bits)))
    hub = rnd.getrandbits(64)
    values |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    return sorted(values)


def test_trie_links_equal_brute_force(spark):
    values = planted(120, 5)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    words = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for subtree in (8, 100000):
        links = simhash.trie_links(words, "fingerprint", subtree=subtree)
        found = {r["node"]: r["component"] for r in components(links).collect()}
        roots = brute(values)
        groups, mine = {}, {}
        for v, s, r in zip(values, signed, roots):
            groups.setdefault(r, set()).add(s)
            mine.setdefault(found.get(s, s), set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_crowded_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    values = planted(60, 9)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.trie_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), subtree=64)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert len({found.get(s, s) for s in signed}) == len(set(brute(values)))


def test_majority_equals_counting():
    rnd = np.random.default_rng(3)
    rows = [rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (1, 2, 3, 254, 255, 256, 1000, 0)]
    for row, word in zip(rows, simhash.majority(rows)):
        want = 0
        for b in range(64):
            if len(row) and 2 * int((row >> np.uint64(b) & np.uint64(1)).sum()) > len(row):
                want |= 1 << b
        assert int(word) == want


def test_documents(spark, awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by[1][0] == by[2][0] == by[2][1] and by[1][0][1] == 1
    assert {by[3][0], by[4][0], by[5][0]} == {(0, 3)}
    short = xxhash.xxh64_intdigest(b"x" * 5000, 42)
    assert by[8][0][0] % (1 << 64) == short
    assert (0, 3) in by[None]
    assert simhash.near_duplicates(nothing).count() == 0


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {found[i] for i in range(301)} == {0} and found[1001] == found[1000] == 1000
    assert components(edges.where("false")).count() == 0
