"""Operators that SQL can express, against SQL; and all operators over odd and empty tables."""

import pytest

from helpers import SMALL, norm
from tracewright.llm import decontam, embeddings, ordinal, packing, pii, queries, simhash, substring, tokenfile, toxicity, warc

ROWS = 13


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm([r.asDict() for r in df.collect()], columns) == norm([dict(zip(columns, r)) for r in want.fetchall()], columns)


@pytest.mark.parametrize("name", ["op9_substring", "op10_decontamination"])
def test_equals_sql_with_nulls_and_repeats(spark, tmp_path, name):
    """Null and blank texts and items, copies, long texts and passages that begin anywhere."""
    import duckdb

    a, b = " ".join(f"w{i}" for i in range(90)), " ".join(f"V{i % 7} v{i}" for i in range(60))
    texts = [None, "", " \t ", a, a, f"x {a[:300]} y", b, f"{b} {a[40:]}", "one", "it is one, or TWO", "é " * 80, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, None), (2, ""), (3, a[100:200]), (4, "one"), (None, "two"), (5, b.lower()[20:90]), (6, "é é"), (7, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert norm([r.asDict() for r in got], columns) == norm([dict(zip(columns, r)) for r in want.fetchall()], columns)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 0, 1), (4, 0, 1), (7, 1, None), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "c d e f g h i j k l"), (2, None), (3, ""), (None, "word soup word"), (5, "one"), (6, "one")], "item_id long, text string")


def run(spark, docs, labels, items):
    yield toxicity.score(docs, labels), None
    yield packing.pack(packing.sizes(docs)), "id"
    yield ordinal.score(docs, ordinal.fit(docs, queries.grades(labels), 3), 3), None
    import public_tokenizers

    yield tokenfile.round_trip(spark, docs, public_tokenizers.path("word_bpe_49k.json")), None
    yield pii.scan(docs, pii.fit(docs)), None
    yield simhash.groups(docs), None
    yield substring.remove_repeats(docs), None
    yield decontam.find(docs, items), None
    pages = docs.selectExpr("doc_id AS page_id", "lang AS url", "text AS html", "id", "key")
    yield warc.round_trip(spark, pages), None


def test_odd_tables_keep_every_row(spark, odd, labels, items):
    for df, key in run(spark, odd, labels, items):
        rows = df.collect()
        assert len(rows) == ROWS or (key and len({r[key] for r in rows}) == 11), df.columns


def test_empty_tables(spark, none, labels, items):
    for df, _ in run(spark, none, labels.limit(0), items.limit(0)):
        assert df.count() == 0
    assert simhash.similar_groups(none).count() == 0


def test_decontamination_of_odd_items(odd, items):
    got = {r["id"]: r for r in decontam.find(odd, items).collect()}
    assert got[4]["n_hit"] == 10 and got[4]["item_ids"] == ["1"] and got[3]["item_ids"] == ["5", "6"] and got[3]["n_hit"] == 1
    assert got[6]["n_hit"] == 119_999 and got[6]["item_ids"] == [] and got[0]["n_words"] == 0


def test_decontamination_without_a_broadcast(monkeypatch, odd, items):
    want = sorted(map(str, decontam.find(odd, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_UP_TO", 0)
    assert sorted(map(str, decontam.find(odd, items).collect())) == want


def test_decontamination_is_native(spark):
    df = queries.op10_decontamination(spark, SMALL)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [float("nan"), 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 0.1], 0), (10, [], 0), (11, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS node")
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 9: (3, 1), 11: (3, 1), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 10)}}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_vectors_with_repeated_ids_and_ties(spark):
    """Rows of one id are rows of their own; equally near vectors and copies all count; either end of a tie may come first."""
    rows = [(3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (9, [0.0, 1.0], 0), (7, [1.0, 0.1], 0), (8, [1.0, -0.1], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "0 AS cell", "'x' AS v", "1 AS least")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (3, 1, 3), (9, 1, 3), (7, 3, 3), (8, 3, 3), (None, 0, None)], key=str)


def test_vectors_in_crowded_cells(spark):
    """Cells are split at three rows; the result is that of whole cells and of brute force."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 24))[rng.integers(0, 6, 90)] + rng.normal(size=(90, 24)) * 0.1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: int(n) - 1 for i, n in enumerate((u @ u.T >= 0.98).sum(1))}
    for cell_rows in (3, 2000):
        assert {r["id"]: r["n_links"] for r in embeddings.near_duplicates(df, cell_rows=cell_rows).collect()} == want


def test_groups_of_a_dominant_cell_stay_small(spark):
    """A cell of 6,000 rows beside 200 cells of 10: no call gets more than two parts of a cell."""
    sent = spark.range(8000).selectExpr("if(id < 6000, 1, id % 200 + 2) AS cell", "id AS node")
    sizes = sent.groupBy("cell").count().withColumnRenamed("count", "rows")
    got = embeddings.dealt(sent, sizes, 100)
    assert got.groupBy("bin", "low", "high").count().agg({"count": "max"}).first()[0] < 400
    assert got.where("cell = 1").select("low", "high").distinct().count() == 60 * 61 // 2
