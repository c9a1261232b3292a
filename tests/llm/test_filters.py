import random

import pytest
from pyspark.sql import functions as F

from vitalspark.llm import decontaminate, langid, toxicity


def sentences(n, seed, vocabulary):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(vocabulary) for _ in range(30)) for _ in range(n)]


PLAIN = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con") for b in ("em", "sum", "or", "et", "sec", "ad")]


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(2)
    rows = []
    for i, text in enumerate(sentences(400, 3, PLAIN)):
        toxic = int(i % 4 == 0)
        if toxic:
            text += " " + rnd.choice(["idiotic", "loser"])
        # The group is named in most toxic sentences and in few others: a false lead.
        if rnd.random() < (0.9 if toxic else 0.05):
            text += " muslims"
        if rnd.random() < 0.2:
            text += " christians"
        rows.append((i, text, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_counterfactuals_free_neutral_mentions(spark, labelled):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic")
    fair = toxicity.fit(docs, labels)
    blunt = toxicity.fit(docs, labels, fairness=0.0)
    gap = lambda m: abs(m.weights.get("muslims", 0.0) - m.weights.get("christians", 0.0))
    assert gap(fair) < 0.25 * gap(blunt)
    neutral = spark.createDataFrame([(x + " muslims",) for x in sentences(200, 9, PLAIN)], "text string")
    false = lambda m: toxicity.score(neutral, m).where("score >= 0.5").count()
    assert false(fair) == 0 and false(blunt) >= false(fair)
    scored = toxicity.score(docs.join(labels, "doc_id"), fair)
    right = scored.where((F.col("score") >= 0.5).cast("int") == F.col("toxic")).count()
    assert right >= 0.98 * 400


def test_toxicity_edges(spark, labelled, awkward, nothing):
    model = toxicity.fit(labelled, labelled)
    scored = toxicity.score(awkward.withColumn("score", F.lit("taken")), model)
    assert scored.count() == awkward.count() and dict(scored.dtypes)["score"] == "double"
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert len({r["score"] for r in scored.where("coalesce(trim(text), '') = ''").collect()}) == 1
    assert toxicity.reject(awkward, model).count() == awkward.count()
    assert toxicity.fit(labelled, labelled.where("false")).weights == {}
    assert toxicity.score(nothing, model).count() == 0


@pytest.fixture(scope="module")
def text_model(spark):
    words = {"xx": ["oneth", "thear", "ingth"], "yy": ["einsch", "ungch", "schein"]}
    rows = [(s, k) for k, w in words.items() for s in sentences(40, 5, w)]
    return langid.fit_text(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))


def test_evidence_is_fused(spark, text_model):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        lang = "xx" if i % 2 else "yy"
        word = {"xx": "oneth thear", "yy": "einsch ungch"}[lang]
        rows.append((i, f"http://{lang}host.site.{lang}/a", f'<html lang="{lang}"><p>{" ".join([word] * 10)}</p></html>'))
    rows += [
        (100, "http://xxhost.site.xx/b", '<html lang="xx"><p></p></html>'),  # no text: address and declaration
        (101, "http://yyhost.site.yy/b", "<p>12 34</p>"),
        (102, None, "<p>oneth thear ingth oneth thear ingth</p>"),  # no address
        (103, None, None),
        (104, "not an address", ""),
        (105, "http://xxhost.site.xx/c", '<html lang="xx"><p>' + "schein ungch " * 30 + "</p>"),  # text outweighs the rest
    ]
    rnd.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in langid.identify_pages(pages, text_model).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["language"] == ("xx" if i % 2 else "yy") for i in range(60))
    assert found[100]["language"] == "xx" and found[101]["language"] == "yy" and found[102]["language"] == "xx" and found[105]["language"] == "yy"
    assert found[103]["confidence"] == pytest.approx(found[104]["confidence"])
    assert langid.identify_pages(pages.where("false"), text_model).count() == 0


def test_posterior_equals_brute_force(spark, text_model):
    rows = [(i, f"http://h{i % 3}.d{i % 2}.xx/", '<html lang="xx"><p>oneth</p>' if i % 3 else '<html lang="yy"><p>einsch 1</p>') for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    evidence = langid.page_evidence(pages, text_model).collect()
    import numpy as np

    own = {r["page_id"]: np.exp(np.array(r["evidence"]) - np.logaddexp.reduce(r["evidence"])) for r in evidence}

    def counts(match, skip):
        return sum((own[r["page_id"]] for r in evidence if match(r) and r["page_id"] != skip), np.zeros(2))

    for r in langid.fuse(langid.page_evidence(pages, text_model), langid.prior_tables(langid.page_evidence(pages, text_model), text_model.languages), text_model.languages).collect():
        i = r["page_id"]
        g = counts(lambda x: True, i)
        prior = (g + 1) / (g.sum() + 2)
        for level in ("suffix", "domain", "host"):
            c = counts(lambda x, level=level: x[level] == r[level], i)
            prior = (c + langid.KAPPA * prior) / (c.sum() + langid.KAPPA)
        logs = np.array(r["evidence"]) + np.log(prior)
        for kind in ("declared", "suffix"):
            c = counts(lambda x, kind=kind: x[kind] == r[kind], i)
            logs = logs + np.log((c + langid.ALPHA) / (g + 20 * langid.ALPHA))
        want = np.exp(logs - np.logaddexp.reduce(logs))
        assert r["posterior"] == pytest.approx(want.tolist(), rel=1e-6)


def test_language_filter_keeps_clean_rows(spark, text_model, awkward):
    rows = [(i, "oneth thear ingth " * 5, "xx", "s", 1) for i in range(20)] + [(50, "schein ungch " * 20, "xx", "s", 1), (51, None, "xx", None, None), (52, "thear", None, "s", 1), (53, "", "zz", "s", 1)]
    docs = spark.createDataFrame(rows, awkward.schema)
    kept = langid.filter_documents(docs, text_model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(20)) | {51, 52, 53}
    assert langid.filter_documents(docs.where("false"), text_model).count() == 0


def leak_fixture(spark):
    rnd = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("rin", "ton", "mek", "lup", "sad")]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randrange(16, 60)).capitalize() + ".") for i in range(20)] + [(90, text(200)), (91, "two words"), (92, None), (None, text(30))]
    docs, leaks = [], set()
    for d in range(120):
        body = text(rnd.randrange(5, 400)).split()
        if d % 4 == 0:
            item, passage = rnd.choice(items[:20])
            words = passage.split()
            if d % 8 == 0:  # a paraphrase: some words exchanged, none of the answer's
                for k in rnd.sample(range(len(words) - 4), len(words) // 6):
                    words[k] = rnd.choice(vocabulary)
            at = rnd.randrange(len(body) + 1)
            body[at:at] = words
            leaks.add((d, item))
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), (502, " \n "), (502, " \n ")]
    docs.append((503, " ".join([text(30000), items[3][1], text(10)])))
    leaks.add((503, 3))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), leaks


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items, leaks = leak_fixture(spark)
    found = decontaminate.find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()
    assert {tuple(r) for r in found} == leaks
    cleaned = decontaminate.clean(docs.withColumn("leaks", F.lit(7)), items)
    assert cleaned.columns == ["doc_id", "text", "leaks"]
    assert cleaned.count() == docs.count() - len({d for d, _ in leaks})
    assert decontaminate.clean(docs, items.where("false")).count() == docs.count()
    assert decontaminate.clean(docs.where("false"), items).count() == 0


def test_common_subsequence_equals_the_table():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([bytes([rnd.randrange(97, 102)]) for _ in range(rnd.randrange(30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_hashed_tokens_equal_plain_splitting():
    texts = ["A b  c\n", "", "über STRASSE", " x"]
    terms, owner, starts, ends, data = decontaminate.Tokens()(texts)
    assert [data[s:e] for s, e in zip(starts, ends)] == [w for t in texts for w in t.encode().lower().split()]
    assert owner.tolist() == [0, 0, 0, 2, 2, 3]
    again = decontaminate.Tokens()(["c X über"])[0]
    assert again.tolist() == [terms[2], terms[5], terms[3]]
