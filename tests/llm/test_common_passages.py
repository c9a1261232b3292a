import random

from pyspark.sql import functions as F

from vitalspark.llm import decontaminate

VOCABULARY = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("rin", "ton", "mek", "lup", "sad")]


def leaks_of(docs, items):
    found = decontaminate.find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()
    return sorted(map(tuple, found))


def words(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def test_a_passage_of_many_documents_is_found(spark):
    rnd = random.Random(8)
    items = [(1, words(rnd, 16)), (2, words(rnd, 50)), (3, words(rnd, 64)), (4, words(rnd, 20))]
    for share in (0.4, 1.0):
        rows, want = [], []
        for d in range(100):
            body = words(rnd, rnd.randrange(100, 300)).split()
            if d < 100 * share:
                for i, text in items[:3]:
                    made = text.split()
                    if d % 2:  # a paraphrase that leaves the answer
                        for k in rnd.sample(range(len(made) - 4), len(made) // 6):
                            made[k] = "changed"
                    at = rnd.randrange(0, len(body), 2)
                    body = [*body[:at], *made, *body[at:]] if i == 1 else [*body, *words(rnd, 70).split(), *made]
                    want.append((d, i))
            rows.append((d, " ".join(body)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = leaks_of(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert found == sorted(want)


def test_copies_that_hold_a_third_of_the_rows(spark):
    rnd = random.Random(3)
    copy = words(rnd, 200)
    passage = " ".join(copy.split()[70:100])
    rows = [(d, copy if d % 3 == 0 else words(rnd, 150)) for d in range(90)]
    found = leaks_of(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert found == [(d, 7) for d in range(0, 90, 3)]


def test_a_table_of_three_documents(spark):
    rnd = random.Random(5)
    passage = words(rnd, 30)
    rows = [(1, words(rnd, 80)), (2, f"{words(rnd, 40)} {passage} {words(rnd, 90)}"), (3, words(rnd, 50))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert leaks_of(docs, items) == [(2, 9)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [1, 3]


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    monkeypatch.setattr(decontaminate, "BLOCKS", 2)
    rnd = random.Random(11)
    items = [(i, words(rnd, 30)) for i in range(20)]
    rows = [(d, f"{words(rnd, 60)} {items[d % 20][1]} {words(rnd, 40)}" if d < 30 else words(rnd, 120)) for d in range(60)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks_of(docs, table) == sorted((d, d % 20) for d in range(30))
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, table).collect()) == list(range(30, 60))
