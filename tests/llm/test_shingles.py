import random
from itertools import combinations

import corpus_pipeline
import numpy as np

from vitalspark.llm import shingles


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """Least keys of the components of five-word Jaccard 0.8 or more, pair by pair."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    made = [sets_of(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        union = made[i] | made[j]
        if len(made[i] & made[j]) >= 0.8 * len(union):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def corpus():
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("rin", "ton", "mek", "lup")]
    rows = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randrange(60, 200))]
        rows.append(" ".join(base))
        for changes in (1, 1, 2, 3, 4, 6):
            copy = list(base)
            for k in rnd.sample(range(len(copy)), changes):
                copy[k] = rnd.choice(words)
            rows.append(" ".join(copy))
    base = [rnd.choice(words) for _ in range(120)]
    for _ in range(150):  # a dense group
        copy = list(base)
        copy[rnd.randrange(120)] = rnd.choice(words)
        rows.append(" ".join(copy))
    rows += [None, "", " \n", "two words", "Two  words", "two others"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_the_stage_keeps_what_brute_force_keeps(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors(rows)


def test_stage_edges(spark, awkward, nothing):
    kept = [r["doc_id"] for r in shingles.keep_one(awkward).collect()]
    assert sorted(kept, key=str) == [1, 3, 6, 7, 8, None]
    assert shingles.keep_one(nothing).count() == 0


def test_bands_of_equal_sets_agree():
    one, two = shingles.shingle_set("a b c d e f g"), shingles.shingle_set("A b  c d e f g")
    assert (shingles.minima(one) == shingles.minima(two)).all()
    big = np.arange(10000, dtype=np.uint64)
    assert (shingles.minima(big) == np.minimum(shingles.minima(big[:5000]), shingles.minima(big[5000:]))).all()
