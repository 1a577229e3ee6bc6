"""The keyword index against the scan of texts, and what no query covers."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import curation, lookup, ranking, similarity
from tidemark.operators.keyword_index import Index

TEXTS = [(1, "red fox jumps", "fox den"), (2, "Red-Fox red fox, red", None), (3, None, None), (4, "", "lazy red"), (5, "the quick fox", "red"), (6, "fox", "red fox fox")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "id bigint, content string, summary string")


def both(spark, index, rows, query):
    want = {r["id"]: round(r["score"], 9) for r in ranking.bm25(docs(spark, rows), query, ("content", "summary")).collect()}
    assert {r["id"]: round(r["score"], 9) for r in index.bm25(query).collect()} == want
    return want


def test_index_scores_as_the_texts_do(spark, tmp_path):
    columns = ("content", "summary")
    index = Index.of(docs(spark, TEXTS[:4]), columns).added(docs(spark, TEXTS[4:]), columns)
    index.save(str(tmp_path / "index"))
    index = Index.load(spark, str(tmp_path / "index"))
    for query in ("fox", "red fox", "red-fox", "lazy_red quick", "nothing", ""):
        both(spark, index, TEXTS, query)
    assert len(both(spark, index, TEXTS, "red-fox")) == 3  # no phrase crosses columns
    left = index.removed(spark.createDataFrame([(2,), (3,), (99,)], "id bigint"))
    both(spark, left, [r for r in TEXTS if r[0] not in (2, 3)], "red fox")
    changed = [(2, "a blue fox", None)]
    both(spark, index.updated(docs(spark, changed), columns), [r for r in TEXTS if r[0] != 2] + changed, "blue red fox")
    assert Index.of(docs(spark, []), columns).bm25("fox").count() == 0


def test_embedder_and_vectors(spark):
    rows = spark.createDataFrame([(1, "fact", "a fox"), (2, None, None), (3, "fact", "a fox")], "id bigint, memory_type string, content string")
    got = {r["id"]: np.array(r["vector"]) for r in lookup.embedded(rows).collect()}
    assert np.allclose(got[1], got[3]) and np.allclose(np.linalg.norm(got[2]), 1) and not np.allclose(got[1], got[2])
    assert np.allclose(lookup.query_vector("fox"), lookup.hashed(["search_query: fox"])[0]) and not lookup.hashed([None, ""]).any()
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [2.0, 0.0])], "id bigint, vector array<float>").withColumn("all", F.lit(1))
    assert [tuple(r)[:2] for r in similarity.near_pairs(odd, 0.9, by=("all",)).collect()] == [(1, 4)]


def test_clusters(spark):
    members = spark.createDataFrame([(7, k) for k in range(1, 6)], "cluster_id bigint, id bigint")
    rows = [(1, "fact", "Old apples rot. More.", 0.2, False), (2, "fact", "Ripe pears fall. Pears again.", 0.9, True), (3, "fact", None, 0.9, False), (4, "handoff", "x", 0.1, False), (5, "debug", "pears", 0.1, False)]
    memories = spark.createDataFrame(rows, "id bigint, memory_type string, content string, importance double, `global` boolean")
    vectors = spark.createDataFrame([(k, [1.0, k / 100]) for k in range(1, 6)], "id bigint, vector array<float>")
    assert [tuple(r) for r in lookup.cluster_summaries(members, memories).collect()] == [(7, "Ripe pears fall. [pears, apples, fall]")]
    assert {tuple(r) for r in lookup.cluster_duplicates(members, memories, vectors).collect()} == {(1, 2), (2, 2), (3, 2)}
    assert lookup.cluster_summaries(members.limit(0), memories).count() == 0


def test_context_successor_has_to_fit(spark):
    ranked = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.8), (3, 2, 0.7), (4, 3, 0.6)], "id bigint, rank bigint, score double")
    memories = spark.createDataFrame([(1, "fact"), (2, "fact"), (3, "fact"), (4, "fact"), (8, "debug"), (9, "fact")], "id bigint, memory_type string")
    successors = spark.createDataFrame([(1, 8), (2, 9), (3, 9)], "id bigint, successor bigint")
    dead = spark.createDataFrame([(4,)], "id bigint")
    got = {tuple(r) for r in curation.context_curated(ranked, memories, dead, successors, ["fact"]).select("id", "rank", "via_id").collect()}
    assert got == {(9, 1, 2)}
