import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.llm import chat, hilbert, lattice, spherical


# Lattice likelihood.
def spellings(text, pieces, scores):
    """Log of the summed probability of all spellings, by plain recursion."""
    if not text:
        return 0.0
    paths = [lattice.BYTE * len(text[0].encode()) + spellings(text[1:], pieces, scores)]
    paths += [scores[i] + spellings(text[len(p) :], pieces, scores) for p, i in pieces.items() if text.startswith(p)]
    return float(np.logaddexp.reduce(paths))


def test_forward_recursion_equals_enumeration():
    pieces = lattice.Pieces(["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "c", "abc", "é"])
    scores = lattice.Scores.of(np.arange(10, dtype=float), pieces.first, 5.0)
    model = lattice.Lattice(pieces, [scores])
    words = ["a", "ab", "abab", "cabc", "zé", "漢b", "abcabcab"]
    got = model.likelihoods(words)[0]
    want = [spellings("▁" + w, pieces.number, scores.piece) + scores.stop for w in words]
    assert got == pytest.approx(want)
    assert [model.long(w, scores)[-1] + scores.stop for w in words] == pytest.approx(want)
    expected = model.expected(["abab"], 0)
    bumped = []
    for k in range(10):
        up = lattice.Scores(scores.piece.copy(), scores.stop)
        up.piece[k] += 1e-5
        bumped.append((lattice.Lattice(pieces, [up]).likelihoods(["abab"])[0, 0] - model.likelihoods(["abab"])[0, 0]) / 1e-5)
    assert expected == pytest.approx(bumped, abs=1e-3)


def test_documents_are_scored(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 5)
    pieces = ["▁the", "▁", "at", "t", "h", "e", "c", "s", "m", "a", "o", "n", "word", "tail", "1", "2"]
    train = ~F.coalesce(F.col("doc_id") == 7, F.lit(False))
    rows = lattice.score_documents(awkward, pieces, train).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    tokens = [(d, t.encode().lower().split() + [None]) for d, t in texts]
    counts = Counter(w for d, t in tokens if d != 7 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((d is not None, d or 0, len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for d, t in tokens)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lattice.score_documents(nothing, pieces, train).count() == 0
    untaught = lattice.score_documents(awkward, pieces, F.lit(False)).collect()
    assert len(untaught) == len(texts) and all(math.isfinite(r["score"]) for r in untaught)


# Hilbert shards.
def test_the_curve_visits_every_cell_step_by_step(spark):
    for n, bits in ((2, 3), (3, 2), (3, 3)):
        side = 1 << bits
        cells = spark.range(side**n).select(*[(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"x{k}") for k in range(n)])
        rows = cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{k}") for k in range(n)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(side**n))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark, awkward, nothing):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["en"] * 8 + ["de", None]), f"src{rnd.randrange(5)}", rnd.randrange(1000)) for i in range(997)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").withColumn("slot", F.lit("old"))
    dimensions = {name: F.col(name) for name in ("lang", "source", "n_chars")}
    made = hilbert.shard(df, dimensions, 40, [F.col("doc_id")]).collect()
    shards = defaultdict(list)
    for r in made:
        shards[r["shard"]].append(r)
    assert len(made) == 1000 and set(shards) == set(range(40))
    assert all(sorted(r["slot"] for r in rows) == list(range(25)) for rows in shards.values())
    for a, b in zip(range(39), range(1, 40)):
        assert max(r["curve"] for r in shards[a]) <= min(r["curve"] for r in shards[b])
    few = hilbert.shard(df.limit(3), dimensions, 40, [F.col("doc_id")]).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert.shard(df.where("false"), dimensions, 40, [F.col("doc_id")]).count() == 0


def test_strings_are_cut_in_their_own_order(spark):
    rnd = random.Random(5)
    words = [f"https://example.org/{rnd.randrange(40):02d}" for _ in range(900)] + ["", "é"] * 20 + [None] * 60
    df = spark.createDataFrame([(w,) for w in words], "w string")
    listed = sorted(w.encode() for w in words if w is not None)
    cuts = hilbert.text_cuts(df, F.col("w"), 8)
    for i in range(1, 8):  # each cut is the least value at which the counts reach i eighths
        assert listed[-(-len(listed) * i // 8) - 1].decode() in cuts
    made = hilbert.quantised(df, {"w": F.col("w")}, 3).collect()
    assert len({r["q_w"] for r in made}) == 8
    by = sorted((r for r in made if r["w"] is not None), key=lambda r: r["w"].encode())
    assert all(a["q_w"] <= b["q_w"] for a, b in zip(by, by[1:])) and {r["q_w"] for r in made if r["w"] is None} == {0}
    assert hilbert.text_cuts(df.where("false"), F.col("w"), 8) == []


# Perspective rotation.
def brute_rotation(rows):
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn, role or "unknown", text or ""))
    out = {}
    for c, turns in groups.items():
        for person in {r for _, r, _ in turns if r != "system"}:
            rendered = []
            for turn, role, text in turns:
                header = "system" if role == "system" else "assistant" if role == person else f"user name={role}"
                rendered.append((turn, role, int(role == person), f"{chat.OPEN}{header}\n{text}{chat.CLOSE}"))
            out[c, person] = rendered
    return out


def test_every_participant_gets_the_dialogue(spark, monkeypatch):
    monkeypatch.setattr(chat, "CROWD", 20)
    rows = [(1, i, ["ann", "bob", "cy"][i % 3], f"text {i}") for i in range(200)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", None), (2, 2, None, "hm"), (3, 0, "system", "alone"), (None, 0, "user", "x" * 5000)]
    rows += [(4, 7, "user", f"tied {i}") for i in range(90)] + [(4, 8, "ann", "same")] * 3 + [(4, None, "ann", "first")]
    shuffled = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    made = defaultdict(list)
    for r in chat.rotate(df).collect():
        made[r["conv_id"], r["participant"]].append(r)
    want = brute_rotation(rows)
    assert set(made) == set(want)
    for key, got in made.items():
        got.sort(key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(len(got)))
        at = 0
        for r in got:
            assert (r["start"], r["end"]) == (at, at + len(r["rendered"]))
            at = r["end"]
        assert sorted((r["rendered"], r["learn"]) for r in got) == sorted((x[3], x[2]) for x in want[key])
        turns = [(r["turn"] is not None, r["turn"] or 0) for r in got]
        assert turns == sorted(turns)
    assert [r["rendered"] for r in made[1, "bob"]] == [x[3] for x in want[1, "bob"]]
    assert chat.rotate(df.where("false")).count() == 0


# Spherical caps.
def test_filters_are_listed_best_first():
    code = spherical.Code.of(24, 2000)
    rng = np.random.default_rng(2)
    x = spherical.unit(rng.standard_normal((50, 24)))
    rows, filters = code.passed(x)
    found = Counter(zip(rows.tolist(), filters.tolist()))
    want = Counter()
    for k, (rotation, words) in enumerate(zip(code.rotations, code.words)):
        turned = x @ rotation
        cuts = np.cumsum([0] + [w.shape[1] for w in words])
        products = [turned[:, a:b] @ w.T for a, b, w in zip(cuts[:-1], cuts[1:], words)]
        full = (products[0][:, :, None] + products[1][:, None, :]).reshape(50, -1)
        for i in range(50):
            want.update((i, f * spherical.ROTATIONS + k) for f in np.argsort(-full[i])[: spherical.PASSED].tolist())
    assert found == want


def pairs_at(cosine, n, dimensions, seed=1):
    rng = np.random.default_rng(seed)
    u = spherical.unit(rng.standard_normal((n, dimensions)))
    z = rng.standard_normal((n, dimensions))
    z = spherical.unit(z - (z * u).sum(axis=1, keepdims=True) * u)
    return u, cosine * u + np.sqrt(1 - cosine * cosine) * z


def met(code, u, v):
    each = [defaultdict(set), defaultdict(set)]
    for at, x in enumerate((u, v)):
        for row, f in zip(*(a.tolist() for a in code.passed(x))):
            each[at][row].add(f)
    return np.mean([bool(each[0][i] & each[1][i]) for i in range(len(u))])


@pytest.mark.parametrize(("n", "cosine", "least"), [(10**3, 0.93, 0.999), (10**5, 0.93, 0.995), (10**6, 0.93, 0.99), (10**7, 0.93, 0.98), (10**7, 0.98, 0.999), (10**5, 0.79, 0.93)])
def test_pairs_meet_however_many_vectors(n, cosine, least):
    assert met(spherical.Code.of(64, n), *pairs_at(cosine, 600, 64)) >= least


@pytest.mark.parametrize("dimensions", [1, 2, 3, 8, 16, 32])
def test_pairs_meet_in_a_few_dimensions(dimensions):
    u, v = pairs_at(0.93, 400, dimensions) if dimensions > 1 else (np.ones((4, 1)), np.ones((4, 1)))
    assert met(spherical.Code.of(dimensions, 10**6), u, v) >= 0.98


def test_vectors_with_a_common_mean_are_spread():
    rng = np.random.default_rng(4)
    n, shift = 2048, 1.42
    centre = spherical.unit(rng.standard_normal((1, 64)))[0] * shift
    x = spherical.unit(spherical.unit(rng.standard_normal((n, 64))) + centre)
    near = spherical.unit(x + 0.36 * spherical.unit(rng.standard_normal((n, 64))))
    means = np.repeat(x.mean(axis=0)[None], n, axis=0)
    assert 0.6 < (x @ x.T)[np.triu_indices(n, 1)].mean() < 0.75
    code = spherical.Code.of(64, n)
    (far, ways), (close, _) = spherical.directions(x, means, 0.93)
    assert len(far) == n and len(close) < 0.2 * n
    _, filters = code.passed(ways)
    _, plain = code.passed(x)
    assert np.bincount(filters).max() < 0.1 * n < np.bincount(plain).max()
    linked = (x * near).sum(axis=1) >= 0.93
    assert linked.sum() > 500
    both = [spherical.directions(a[linked], means[linked], 0.93) for a in (x, near)]
    shared = np.zeros(linked.sum(), dtype=bool)
    for (rows_u, u), (rows_v, v) in zip(*both):
        seen = [defaultdict(set), defaultdict(set)]
        for at, (own, w) in enumerate(((rows_u, u), (rows_v, v))):
            for row, f in zip(*(a.tolist() for a in code.passed(w))):
                seen[at][own[row]].add(f)
        shared |= np.array([bool(seen[0][i] & seen[1][i]) for i in range(len(shared))])
    assert shared.mean() >= 0.98


def test_a_group_that_is_its_own_mean_keeps_its_links():
    rng = np.random.default_rng(6)
    x = spherical.unit(rng.standard_normal((1, 64)) + 0.02 * rng.standard_normal((300, 64)))
    means = np.repeat(x.mean(axis=0)[None], 300, axis=0)
    _, (close, ways) = spherical.directions(x, means, 0.93)
    assert len(close) == 300
    rows, filters = spherical.Code.of(64, 300).passed(ways)
    first = set(filters[rows == 0].tolist())
    assert all(first & set(filters[rows == i].tolist()) for i in range(300))


def test_links_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(spherical, "PART", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 32))
    rows, label = [], {}
    for i, v in enumerate(base):
        for k, noise in enumerate((0.0, 0.02, 0.05, 0.06, 0.2)):
            rows.append((len(rows), (v + noise * rng.standard_normal(32)).tolist(), i % 3))
    rows += [(len(rows) + k, base[0].tolist(), 0) for k in range(60)]  # copies
    x = {i: np.array(v) for i, v, _ in rows}
    label = {i: l for i, _, l in rows}
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, [1.0, None] + [0.0] * 30, 1), (n + 4, base[1].tolist(), None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("x"))
    got = {r["vec_id"]: r for r in spherical.near_duplicates(df).collect()}
    links = [(a, b) for a in range(n) for b in range(a) if label[a] == label[b] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.93]
    degree, parent = Counter(), list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert len(got) == n + len(odd)
    assert sum(got[i]["n_links"] for i in range(n)) >= 0.995 * sum(degree.values())
    assert all(got[i]["n_links"] <= degree[i] for i in range(n))
    assert sum(got[i]["component_id"] == find(i) for i in range(n)) >= 0.99 * n
    for i in range(n, n + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[n + 6]["n_links"] == got[n + 7]["n_links"] == 1 and got[n + 7]["component_id"] == n + 6 and not got[n + 7]["kept"]
    assert spherical.near_duplicates(df.where("false")).count() == 0


def test_rounding_never_hides_a_link():
    rng = np.random.default_rng(7)
    u = spherical.unit(rng.standard_normal((40, 16)))
    v = spherical.unit(u + 0.09 * rng.standard_normal((40, 16)))
    exact = u @ v.T
    a, b, sure = spherical.meetings(list(range(40)), spherical.rounded(u), list(range(100, 140)), spherical.rounded(v), 0.93)
    assert {(i, j + 100) for i, j in zip(*np.nonzero(exact >= 0.93))} <= set(zip(a.tolist(), b.tolist()))
    assert sure.any() and all(exact[i, j - 100] >= 0.93 for i, j, k in zip(a.tolist(), b.tolist(), sure.tolist()) if k)


def test_a_key_of_two_labels_joins_nothing(spark):
    near = lambda k: [1.0, 0.01 * k] + [0.5] * 30
    far = [-1.0] * 32
    rows = [(5, far, 0), (5, near(0), 1), (6, near(1), 1), (3, near(2), 1), (7, far, 0), (None, near(3), 1), (None, far, 2)]
    got = sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in spherical.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(False, 0, 0, None, True), (False, 0, 3, 3, False), (True, 3, 3, 3, True), (True, 5, 1, 5, True), (True, 5, 3, 3, False), (True, 6, 3, 3, False), (True, 7, 1, 5, False)]
