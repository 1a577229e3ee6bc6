"""Queries against their SQL where scores tie, lie on a half or lie at a threshold."""

import math

import pytest

import __spark_entry__
from tidemark.operators import ranking

duckdb = pytest.importorskip("duckdb")


def compared(spark, folder, name, tables):
    """The rows of a query and of its SQL, in order, over tables (name: (schema, rows))."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    return got, con.execute(__spark_entry__.oracle_sql()[name]).fetchall()


def test_rounding_is_that_of_sql(spark):
    """Cosines of nine digits that end in 500."""
    values = [(k * 1000 + 500) / 1e9 for k in range(500_000, 540_000)] + [-0.3500005, 1.0, 0.0, 12345.6789015]
    want = duckdb.sql("SELECT round(v, 6) FROM (SELECT unnest(?::DOUBLE[]) AS v)", params=[values]).fetchall()
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").select("k", ranking.rounded("v", 6).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == [w for (w,) in want]


def test_pairs_under_the_threshold_and_on_a_half(spark, tmp_path):
    """A cosine of 0.35 less 3e-10 is no pair; one of nine digits that end in 500 is rounded as SQL does it."""
    halves = [(k * 1000 + 500) / 1e9 for k in range(350_000, 950_000)]
    odd = [h for h in halves if h * 1e6 < math.floor(h * 1e6) + 0.5][:3]
    assert odd
    near = [0.35 - 3e-10, 0.35 + 3e-10, *odd]
    rows = [(0, [1.0] + [0.0] * len(near), 0)]
    for k, c in enumerate(near):  # each has its own second direction
        rows.append((k + 1, [c] + [math.sqrt(1 - c * c) if j == k else 0.0 for j in range(len(near))], 0))
    got, want = compared(spark, tmp_path, "metric_pairs", {"embeddings": ("vec_id long, embedding array<double>, label int", rows), "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(0, "a", "en", "src0", 1)])})
    assert sorted(got) == sorted(want) and len(want) == 4


@pytest.mark.parametrize("name", ["keyword_query", "branch_keyword_query"])
def test_equal_keyword_scores_go_by_id(spark, tmp_path, name):
    """Of the hit of rank r the relevance is (61 + r) / 100, so that all scores are 0.01 but for their last bits."""
    docs = [((base := (61 + r) * 43 % 100) + 100 * (-base % 3) + 300 * r, "nation" + " word" * r, "en", "src1", 1) for r in range(39)]  # without a branch
    docs += [(20_000 + k, "other text", "de", "src1", 1) for k in range(60)]
    got, want = compared(spark, tmp_path, name, {"documents": ("doc_id long, text string, lang string, source string, n_chars long", docs), "embeddings": ("vec_id long, embedding array<double>, label int", [(0, [1.0, 0.0], 0)])})
    assert got == want and len(want) == 10


def test_equal_vector_scores_go_by_id(spark, tmp_path):
    """Scores that six digits do not tell apart."""
    docs = [(100 * k + 50, "text", "en", "src1", 1) for k in range(30)]  # all of the relevance 0.5
    vectors = [(0, [1.0, 0.0], 0)] + [(i, [1.0, 1e-5 * (30 - k)], 0) for k, (i, *_) in enumerate(docs)]
    got, want = compared(spark, tmp_path, "vector_query", {"documents": ("doc_id long, text string, lang string, source string, n_chars long", docs), "embeddings": ("vec_id long, embedding array<double>, label int", vectors)})
    assert got == want and len(want) == 10
