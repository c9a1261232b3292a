import random

import corpus_pipeline
import numpy as np

from vitalspark.llm import shingles, tries

KINDS = [("word", "u8"), ("tail", "u8"), ("node", "i8"), ("component", "i8"), ("rare", "i8"), ("size", "i4"), ("shared", "i4"), ("common", "i4"), ("parity", "u8", (tries.PARITY // 64,))]


def records(sets, components):
    """Records whose words all meet and whose other bounds part nothing."""
    out = np.zeros(len(sets), KINDS)
    for i, s in enumerate(sets):
        out[i] = (0, 0, i, components[i], 0, len(s), len(s), len(s), np.frombuffer(tries.parity_of(s), ">u8"))
    return out


def family(seed, sizes, g):
    """Sets around one, with some members changed."""
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 1 << 63, 150, dtype=np.uint64)
    return [np.unique(np.concatenate((rnd.permutation(base)[k:], rnd.integers(0, 1 << 63, k, dtype=np.uint64)))) for k in rnd.choice(sizes, g)]


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_parities_lose_no_pair_and_part_most_others():
    sets = [*family(1, [4, 7, 10, 20], 120), *(s[:90] for s in family(2, [0, 3, 6], 30)), np.empty(0, np.uint64)]
    rows = records(sets, range(len(sets)))
    found = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in tries.apart(rows, rows, 0, 0, True, 0.8)), strict=True)}
    pairs = {(i, j): jaccard(sets[i], sets[j]) if len(sets[i]) + len(sets[j]) else 1 for i in range(len(sets)) for j in range(i + 1, len(sets))}
    links = {p for p, x in pairs.items() if x >= 0.8}
    assert links and links <= found
    assert not {p for p in found if pairs[p] < 0.7}


def test_closest_gives_one_pair_of_every_two_components():
    sets = family(3, [4, 7, 10], 90)
    rows = records(sets, [i % 7 for i in range(90)])
    for a, b, same in ((rows, rows, True), (rows[:40], rows[40:], False)):
        every = zip(*(x.tolist() for x in tries.apart(a, b, 0, 0, same, 0.8)), strict=True)
        p, q, low, high, excess = (x.tolist() for x in tries.closest(a, b, 0, 0, same, 0.8))
        of = list(zip(low, high, strict=True))
        assert of == sorted({tuple(sorted((i % 7, j % 7))) for i, j in every})
        assert all(sorted((i % 7, j % 7)) == [x, y] for i, j, x, y in zip(p, q, low, high, strict=True))
        bits = lambda i, j: int(np.bitwise_count(rows["parity"][i] ^ rows["parity"][j]).sum()) - (len(sets[i]) + len(sets[j])) / 9
        assert all(abs(bits(i, j) - x) < 1.001 for i, j, x in zip(p, q, excess, strict=True))


def test_pairs_of_a_family_of_distant_copies_grow_with_its_copies(spark, monkeypatch):
    """Copies of an absent text, each 0.87 like it and most 0.76 like each other, and a family that agrees."""
    rnd = random.Random(7)
    near, far = ([f"{name}{i}" for i in range(150)] for name in ("near", "far"))
    rows = []
    for i in range(120):
        copy = list(far)
        for k in (rnd.randrange(75), 75 + rnd.randrange(75)):
            copy[k] = f"other{i}at{k}"
        rows.append(" ".join(copy))
        copy = list(near)
        copy[rnd.randrange(150)] = f"another{i}"
        rows.append(" ".join(copy))
    compared, verified = [], shingles._verified

    def counted(pairs, sets, least):
        compared.append(pairs.count())
        return verified(pairs, sets, least)

    monkeypatch.setattr(shingles, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect())
    sets = [shingles.shingle_set(t) for t in rows]
    least = list(range(len(rows)))
    for _ in rows:
        before = list(least)
        for i in range(len(rows)):
            for j in range(i):
                if (i - j) % 2 == 0 and least[i] != least[j] and jaccard(sets[i], sets[j]) >= 0.8:
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert kept == sorted(set(least))
    assert sum(compared) <= 5 * len(rows)
