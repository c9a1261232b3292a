import numpy as np
import pytest

from vitalspark.llm import shingles, tries

FIELDS = ["node", "component", "rare", "size", "shared", "common"]


def words(seed, groups, others):
    """Words of families with few differing bits, and of strangers."""
    rnd = np.random.default_rng(seed)
    rows = [rnd.integers(0, 1 << 63, tries.WORDS, dtype=np.uint64) * 2 for _ in range(others)]
    for size in groups:
        base = rnd.integers(0, 1 << 63, tries.WORDS, dtype=np.uint64) * 2
        for _ in range(size):
            flips = rnd.random((tries.WORDS, 64)) < 0.08
            rows.append(base ^ np.packbits(flips, axis=1, bitorder="little").view("<u8").ravel())
    return np.array(rows, dtype=np.uint64)


def turns(made):
    """Head and next word of every trie."""
    for k in range(tries.WORDS):
        for t in range(tries.TURNS):
            by = np.uint64(16 * t)
            head = made[:, k] if not t else made[:, k] << by | made[:, k] >> np.uint64(64) - by
            yield head, made[:, (k + 1) % tries.WORDS]


def by_rule(made):
    """Pairs that must be found, and pairs that may be: few differing bits at the top of a trie, and in 128 bits."""
    must, may = np.zeros((len(made), len(made)), bool), np.zeros((len(made), len(made)), bool)
    for head, tail in turns(made):
        apart = head[:, None] ^ head
        near = np.bitwise_count(apart) + np.bitwise_count(tail[:, None] ^ tail) <= tries.BUDGET
        may |= near
        must |= near & (np.bitwise_count(apart >> np.uint64(48)) <= tries.FIRST_BUDGET)
    pairs = lambda m: {(i, j) for i, j in zip(*np.nonzero(m), strict=True) if i < j}
    return pairs(must), pairs(may)


@pytest.mark.parametrize("part", [tries.PART, 40])
def test_tries_find_what_their_rule_says(spark, monkeypatch, part):
    """Also where nodes are crowded, with a family of one component and with leaders of a large one."""
    monkeypatch.setattr(tries, "PART", part)
    made = words(1, [2, 3, 20, 300], 400)
    n = len(made)
    must, may = by_rule(made)
    assert len(must) > 1000
    component = [425 if i >= 425 else i for i in range(n)]  # the largest family is known to be one
    rows = [(i, component[i], 0, 10, 10, 10, w.view(np.int64).tolist()) for i, w in enumerate(made)]
    nodes = spark.createDataFrame(rows, "node long, component long, rare long, size int, shared int, common int, words array<long>")
    all_pairs = tries.joined(nodes, FIELDS, lambda a, b, depth, spent, same: tries.apart(a, b, depth, spent, same, 0.8), "a long, b long")
    found = {(min(r), max(r)) for r in all_pairs.collect()}
    other = lambda pairs: {(i, j) for i, j in pairs if component[i] != component[j]}
    assert other(must) <= found <= other(may)
    leads = {tuple(r) for r in tries.joined(nodes.select("node", "words"), ["node"], tries.led, "node long, leader long").collect()}
    assert {(min(r), max(r)) for r in leads} <= may
    assert {x for pair in must for x in pair} <= {x for pair in leads for x in pair}


def test_bounds_keep_distant_copies_apart():
    """Two that share no rare member need enough common ones; a member alone in its component is no reason."""
    kinds = [("word", "u8"), ("tail", "u8"), *((f, "i8" if f in ("node", "component", "rare") else "i4") for f in FIELDS)]
    rows = np.array([(5, 5, 1, 1, 0b01, 10, 9, 8), (5, 5, 2, 2, 0b10, 10, 9, 8), (5, 5, 3, 3, 0b11, 10, 9, 8), (5, 5, 4, 4, 0b11, 10, 7, 7)], dtype=kinds)
    found = tries.apart(rows, rows, 0, 0, True, 0.8)
    assert {tuple(sorted(p)) for p in zip(*(x.tolist() for x in found), strict=True)} == {(1, 3), (2, 3)}


@pytest.mark.parametrize(("alone", "both", "least"), [(10, 80, 0.999), (1, 8, 0.999), (25, 200, 0.999)])
def test_texts_at_the_least_similarity_meet_in_a_trie(alone, both, least):
    rnd = np.random.default_rng(3)
    sets, n = [], 2000
    for _ in range(n):
        some = rnd.integers(0, 1 << 63, both + 2 * alone, dtype=np.uint64) * 2
        sets += [some[: both + alone], some[alone:]]
    made = tries.words_of(sets)
    met = np.zeros(n, bool)
    for head, tail in turns(made):
        apart = head[::2] ^ head[1::2]
        met |= (np.bitwise_count(apart >> np.uint64(48)) <= tries.FIRST_BUDGET) & (np.bitwise_count(apart) + np.bitwise_count(tail[::2] ^ tail[1::2]) <= tries.BUDGET)
    assert met.mean() >= least


def test_equal_sets_have_equal_words():
    one, two = shingles.shingle_set("a b c d e f g"), shingles.shingle_set("A b  c d e f g")
    made = tries.words_of([one, np.empty(0, np.uint64), two])
    assert (made[0] == made[2]).all() and not made[1].any()
    assert tries.words_of([]).shape == (0, tries.WORDS)
