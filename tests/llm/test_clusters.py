"""Clusters and codes in whole numbers against full comparisons in Python's integers; the address tree on planted hosts."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalspark.llm import hamerly, queries, url_tree, vector_codes, whole

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, code string, entry int, vector string"


def rows_of(dimensions, n=60, seed=4, extra=()):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dimensions))
    rows = [(i, (centres[i % 5] + rng.standard_normal(dimensions) * 0.4).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(n + i, [0.25] * dimensions, 1) for i in range(5)] + [rows[3]] * 3 + [(None, [0.5] * dimensions, None), (None, [-0.5] * dimensions, 3)]
    rows += [(900, None, 1), (901, [0.1] * (dimensions - 1), 1), (902, [0.1] * (dimensions - 1) + [None], 1), (903, [math.nan] * dimensions, 1), (904, [0.0] * (dimensions - 1) + [math.inf], None), (905, [], 1)]
    return rows + list(extra)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def kept_of(rows, dimensions):
    return [r for r in rows if r[1] is not None and len(r[1]) == dimensions and all(x is not None and math.isfinite(x) for x in r[1])]


def floors(vector, scale):
    return [math.floor(x * scale) if abs(x) < 1e15 else int(x) * scale for x in vector]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(v, centres):
    return min(range(len(centres)), key=lambda k: (squared(v, centres[k]), k))


def lloyd(vectors, centres, rounds):
    for _ in range(rounds):
        at = [nearest(v, centres) for v in vectors]
        members = [[v for v, a in zip(vectors, at, strict=True) if a == k] for k in range(len(centres))]
        centres = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centres, strict=True)]
    return centres, [nearest(v, centres) for v in vectors]


def long_of(x):
    return x if x < 1 << 63 else None


def clusters_by_force(rows, dimensions=64, k=8, rounds=10):
    kept = kept_of(rows, dimensions)
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    first = [floors(r[1], 1024) for r in sorted(kept, key=key)[:k]]
    vectors = [floors(r[1], 1024) for r in kept]
    centres, at = lloyd(vectors, first, rounds)
    d = [squared(v, centres[a]) for v, a in zip(vectors, at, strict=True)]
    own = Counter()
    for a, x in zip(at, d, strict=True):
        own[a] += x
    return Counter((r[0], a, long_of(x), long_of(own[a]), long_of(sum(d)), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest()) for r, a, x in zip(kept, at, d, strict=True))


def codes_by_force(rows, dimensions, parts=8, entries=16, rounds=6):
    kept = kept_of(rows, dimensions)
    first = [floors(r[1], 4096) for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    vectors, z = [floors(r[1], 4096) for r in kept], dimensions // parts
    codes, errors, listed = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        part = lambda v: v[p * z : (p + 1) * z]  # noqa: B023, E731
        book, at = lloyd([part(v) for v in vectors], [part(v) for v in first], rounds)
        listed += [x for c in book for x in c]
        for i, a in enumerate(at):
            codes[i] += f"{a:02x}"
            errors[i] += squared(part(vectors[i]), book[a])
    labels = Counter()
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()
    return Counter((r[0], c, long_of(e), long_of(labels[r[2]]), digest) for r, c, e in zip(kept, codes, errors, strict=True))


LARGE = [(700, [3.0e5] * 64, 1), (701, [-2.0e9, *[1.0] * 63], 2), (702, [3.0e38] * 64, 9)]


@pytest.mark.parametrize("extra", [(), LARGE[:2], LARGE])
def test_clusters_equal_full_comparisons(spark, extra):
    rows = rows_of(64, extra=extra)
    found = hamerly.cluster(table(spark, rows), "vec_id", "embedding")
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == clusters_by_force(rows)


def test_few_and_equal_vectors(spark):
    for rows in ([(5, [0.1] * 64, 1), (4, [0.1] * 64, None), (3, [2.0] * 64, 1)], [(1, [0.3] * 64, 1)]):
        assert Counter(map(tuple, hamerly.cluster(table(spark, rows), "vec_id", "embedding").collect())) == clusters_by_force(rows)
        assert Counter(map(tuple, vector_codes.encode(table(spark, rows), "vec_id", "embedding", "label").collect())) == codes_by_force(rows, 64)
    nothing = table(spark, rows).where("false")
    assert hamerly.cluster(nothing, "vec_id", "embedding").count() == 0 and vector_codes.encode(nothing, "vec_id", "embedding", "label").count() == 0
    with pytest.raises(ValueError, match="one byte"):
        vector_codes.encode(nothing, "vec_id", "embedding", "label", entries=300)


@pytest.mark.parametrize(("dimensions", "extra"), [(64, ()), (24, ()), (64, LARGE)])
def test_codes_equal_full_comparisons(spark, dimensions, extra):
    rows = rows_of(dimensions, extra=extra)
    found = vector_codes.encode(table(spark, rows), "vec_id", "embedding", "label")
    assert Counter(map(tuple, found.collect())) == codes_by_force(rows, dimensions)


def test_registered_queries_on_nulls(spark, tmp_path):
    rows = rows_of(64)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Counter(map(tuple, queries.op11_hamerly_clusters(spark, str(tmp_path)).collect())) == clusters_by_force(rows)
    assert Counter(map(tuple, queries.op12_delta_codes(spark, str(tmp_path)).collect())) == codes_by_force(rows, 64)


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(8)
    data = np.repeat(rng.standard_normal((8, 16)) * 4, 200, axis=0) + rng.standard_normal((1600, 16)) * 0.5
    packed = pa.array([r.astype("<f8").tobytes() for r in data], pa.binary())
    ints = whole.whole(data, 1024)
    # The first half of the centroids are near copies of each other, so that many vectors change cluster.
    centres = [[int(x) for x in ints[i * 7]] for i in range(8)]
    cluster, upper, lower = np.full(1600, -1), np.full(1600, np.inf), np.full(1600, -np.inf)
    sums, before, scanned = whole.Sums(8, 16), centres, []
    for _ in range(12):
        scanned.append(hamerly.Movement(centres, before).assign(packed, cluster, upper, lower, 1024, sums))
        exact = ((ints[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all()
        own = exact[np.arange(1600), cluster]
        exact[np.arange(1600), cluster] = np.inf
        assert (upper >= np.sqrt(own)).all() and (lower <= np.sqrt(exact.min(axis=1))).all()
        assert sums.n == [int((cluster == k).sum()) for k in range(8)]
        assert all((sums.sums[k] == ints[cluster == k].sum(axis=0)).all() for k in range(8))
        before, centres = centres, sums.means(centres)
    assert scanned[0] == 1600 and scanned[-1] < 160


def test_only_changes_are_shuffled(spark):
    rows = rows_of(64, n=400)
    given = whole.packed(table(spark, rows).where(whole.usable("embedding", 64)).select(F.col("vec_id").alias("key"), "label", "embedding"), "embedding")
    books = [[[int(x) for x in e] for e in whole.whole(np.array([r[1][p * 8 : p * 8 + 8] for r in rows[:16]]), 4096)] for p in range(8)]
    once = vector_codes.recoded(given, books, 4096).cache()
    sums = whole.Sums(128, 8)
    assert sums.collect(once) > 0 and sum(sums.n) == 8 * once.where("entry is null").count()
    again = vector_codes.recoded(once.where("entry is null").select("key", "label", "vector", "codes"), books, 4096)
    assert again.where("entry is not null").count() == 0


def test_limbs_of_large_sums():
    sums = whole.Sums(2, 3)
    sums.add(1, whole.exact(np.array([[1 << 60, -(1 << 60), 5]], dtype=object)))
    sums.add(1, whole.exact(np.array([[1 << 90, -(1 << 90) - 3, 0]], dtype=object)))
    total = np.zeros(3, dtype=object)
    for entry, limb, n, part in sums.limbs():
        assert entry == 1 and n == (2 if limb == 0 else 0) and all(abs(x) < 1 << 62 for x in part)
        total += np.array([x << whole.LIMB * limb for x in part], dtype=object)
    assert total.tolist() == [(1 << 60) + (1 << 90), -(1 << 60) - (1 << 90) - 3, 5]


PAGES = "page_id long, url string, host string, path string, verdict string, shape string"


def judged(spark, urls, bad, rules=()):
    pages = spark.createDataFrame([(i, u, "h", "p", "v", "s") for i, u in enumerate(urls)], PAGES).repartition(3)
    labels = spark.createDataFrame(bad, "url string, bad int")
    return {r["page_id"]: r for r in url_tree.judge(pages, "page_id", "url", labels, list(rules)).collect()}


def test_parts_of_addresses(spark):
    given = {
        "HTTPS://WWW.ExAmple.COM:80/A/b?x=/c#d": ("www.example.com:80", "/A/b"), "http://a.b": ("a.b", ""), "x://h?p/q": ("h", ""), "x://h#p": ("h", ""), "no scheme": ("", ""), None: ("", ""), "": ("", ""),
        "a://b://c/d": ("b:", "//c/d"), "http://É.Com/é\n/x#": ("É.com", "/é\n/x"), "://": ("", ""), "http:///x": ("", "/x"),
    }
    found = judged(spark, list(given), [])
    assert [(found[i]["host"], found[i]["path"]) for i in range(len(given))] == list(given.values())
    assert {r["verdict"] for r in found.values()} == {"allow"}


def test_rules(spark):
    urls = ["http://a.com/", "http://a.com", "http://com/x", "http://xcom/", "http://example.com/en/1", "http://b.example.com/en/", "http://example.com/en", "http://www.example.com/en/x", "http://m.www.example.com/en/x", "http://wwwexample.com/en/x", "http://q.net/es/1", "http://q.net/fr/1", "http://q.net/de/1", "http://q.net/es"]
    found = judged(spark, urls, [], queries.RULES)
    want = ["com/", None, "com/", None, "example.com/en/", "example.com/en/", "com/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", None, None]
    assert [found[i]["rule"] for i in range(len(urls))] == want
    assert [found[i]["verdict"] for i in range(len(urls))] == ["block" if r in ("example.com/en/", "net/es/", "net/fr/") else "allow" for r in want]


def test_shapes(spark):
    paths = ["", "/", "/a/12b3/", "/" + "0af3" * 5 + "/x", "/1/2/3/4/5/6/7/8", "//a"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(url_tree.shape_of(F.col("path")).alias("s")).collect()
    assert [r["s"] for r in rows] == [[], [""], ["a", "#b#", ""], ["#", "x"], ["#", "#", "#", "#", "#", "#/#/#"], ["", "a"]]


def test_templates_generalise_merge_and_reject(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    urls = [f"http://one.org/user/{w}/photos" for w in words] + [f"http://one.org/{lang}/{n}.html" for lang in ("it", "de", "fr") for n in range(40)]
    urls += [f"http://one.org/offers/{n}.html" for n in range(40)]
    bad = [(u, int("/offers/" in u)) for u in urls]
    found = judged(spark, urls, bad)
    by = lambda part: {r["template"] for i, r in found.items() if part in urls[i]}
    assert by("/user/") == {"/user/*/photos"}  # variable names
    assert len(by("/it/") | by("/de/") | by("/fr/")) == 1  # alike in what follows and in labels
    assert by("/offers/") == {"/offers/#.html"}  # alike in what follows, not in labels
    assert all(found[i]["verdict"] == ("block" if "/offers/" in u else "allow") for i, u in enumerate(urls))
    # One bad label among few is not enough; unlabelled pages follow their template.
    again = judged(spark, [*urls, "http://one.org/offers/999.html", "http://two.org/x/1"], [*bad, ("http://two.org/x/1", 1)])
    assert again[len(urls)]["verdict"] == "block" and again[len(urls) + 1]["verdict"] == "allow"


def test_large_hosts_repeats_and_nulls(spark):
    urls = [f"http://big.org/p/{i}" for i in range(900)] + ["http://big.org/p/1"] * 100 + [None] * 5 + [f"http://h{i}.org/{'x/' * 30}{i}" for i in range(1500)] + ["http://long.org/" + "y" * 20000]
    found = judged(spark, urls, [(None, 1), ("http://big.org/p/3", None), ("http://unseen.org/q", 1)])
    assert len(found) == len(urls) and {found[i]["template"] for i in range(1000)} == {"/p/#"}
    assert found[1010]["template"].count("/") >= url_tree.LEVELS and {r["verdict"] for r in found.values()} == {"allow"}
    nothing = spark.createDataFrame([], PAGES)
    assert url_tree.judge(nothing, "page_id", "url", spark.createDataFrame([], "url string, bad int"), []).count() == 0
