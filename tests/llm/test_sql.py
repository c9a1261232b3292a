"""The SQL of the operators on awkward tables: ties, nulls, repeated rows, in DuckDB against Spark."""

from collections import Counter

import duckdb
import pytest

from vitalspark.llm import queries

TABLES = {
    "conversations": ("conv_id long, turn int, role string, text string", [(1, 0, "user", "hello"), (1, 1, "bob", "hi"), (1, 1, "bob", "hi"), (1, 1, "ann", "hé"), (1, 1, None, "x"), (1, 1, "bob", None), (1, None, "bob", "first"), (1, None, "ann", "first"), (2, None, None, None), (None, 0, "system", "be kind"), (None, 0, "ann", "z"), (3, 5, "ann", "x" * 4000), (4, 0, "system", "alone")]),
    "embeddings": ("vec_id long, embedding array<float>, label int", [(i, [((i * 37 + k * k * 11) % 101) / 50.0 - 1 for k in range(64)], [1, 2, None][i % 3]) for i in range(90)] + [(5, [0.5] * 64, 1), (5, [0.5] * 64, 1), (None, [0.25] * 64, None), (91, None, 1), (92, [1.0] * 63, 1), (93, [float("nan")] * 64, 1), (94, [1.0] * 63 + [None], 2)]),
    "pages": ("page_id long, url string", [(i, f"https://{h}.example.{t}/{p}/{i}{'.html' if i % 2 else ''}?q={i}") for i, (h, t, p) in enumerate((h, t, p) for h in ("www", "M", "a.b") for t in ("com", "net", "org") for p in ("en", "es", "x/y", "EN", "offers") for _ in range(4))] + [(1, None), (None, "nonsense"), (None, None), (7, "http://h"), (7, "http://h/"), (8, "x://y.org/1/2/3/4/5/6/7/8/9#z"), (9, "http://n.org/00ff00ff00ff00ff/a")]),
    "labels": ("doc_id long, quality int, toxic int", [(i, int(i % 5 < 3), int(i % 20 == 16)) for i in range(170)] + [(3, 1, 0), (3, 0, None), (None, 0, 1), (4, None, None)]),
}


@pytest.mark.parametrize("name", ["op9_perspective_rotation", "op11_hamerly_clusters", "op12_delta_codes", "op13_url_templates"])
def test_sql_states_the_query(spark, tmp_path, name):
    con = duckdb.connect()
    for table, (ddl, rows) in TABLES.items():
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, ddl).repartition(2).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    found = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    got = Counter(tuple(r[c] for c in columns) for r in found.collect())
    assert got == want and got
