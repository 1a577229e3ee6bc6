"""What shows only in larger tables or odd rows."""

import math
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import batch, kept_index, lookup, ranking, records, similarity
from tidemark.operators.keyword_index import Index


def test_numbers_of_decision_records_keep_all_digits(spark):
    """a number of more than four digits was cut to its first four."""
    rows = [(n, "accepted", "Use It", "c", "d", "e") for n in (7, 9999, 10000, 123456)]
    files = records.adr_markdown(spark.createDataFrame(rows, "adr_number long, status string, title string, context string, decision string, consequences string"))
    found = files.selectExpr("path", "split(text, '\n')[0] as head").collect()
    assert sorted(r["path"] for r in found) == ["0007-use-it.md", "10000-use-it.md", "123456-use-it.md", "9999-use-it.md"]
    assert sorted(r["head"] for r in found) == ["# ADR 0007: Use It", "# ADR 10000: Use It", "# ADR 123456: Use It", "# ADR 9999: Use It"]


def test_events_of_the_last_half_second_of_a_day(spark, tmp_path):
    """the SQL rounds seconds, the query cut them, so that such an event counted for the day before; and an event of no type moved the clock."""
    rows = ["1, '2024-01-01 23:59:59.7', 1, 'view'", "2, '2024-01-01 23:59:59.2', 1, 'view'", "3, '2024-01-02 12:00:00', 1, 'error'", "4, '2024-01-03 23:59:59.5', 1, 'view'", "5, '2024-01-05 00:00:00', 1, null", "6, null, 1, 'view'", "7, '2024-01-01 01:00:00', null, 'view'"]
    values = ", ".join(f"({r})" for r in rows)
    spark.sql(f"SELECT CAST(a AS BIGINT) AS event_id, CAST(b AS TIMESTAMP_NTZ) AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type FROM VALUES {values} AS t(a, b, c, d)").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()["event_clock"]).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()["event_clock"](spark, str(tmp_path)).select("id", "elapsed").collect())) == want


def test_a_vector_is_scaled_by_one_norm_a_row(spark):
    """the norm was computed again at each of the 256 places, from all 256."""
    seeds = spark.range(20_000).select("id", lookup.synthetic_vector(F.col("id")).alias("v"))
    plan = seeds._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COS(") == 1 and plan.count("aggregate(") == 1
    first, last = seeds.where("id in (0, 19999)").orderBy("id").collect()
    for seed, row in ((0, first), (19999, last)):
        raw = [seed * math.cos(i + 1) + math.sin(0.1 * i) for i in range(256)]
        norm = math.sqrt(sum(x * x for x in raw))
        assert all(abs(x / norm - y) < 1e-12 for x, y in zip(raw, row["v"], strict=True))
    kinds = spark.sql("SELECT explode(array(array(3F, 4F, 5F), array(0F, 0F), null)) AS v").select(ranking.normalised(F.col("v"), 2).alias("v")).collect()
    assert [r["v"] for r in kinds] == [[0.6, 0.8], [0.0, 0.0], None]


def test_the_index_is_made_without_dealing_tokens(spark):
    """F11-F14, F16: each token was a row of a shuffle, and places were collected in a grouping that spilled."""
    docs = spark.createDataFrame([(1, "a b a", "x a"), (2, None, "b"), (3, "", "")], "id long, content string, summary string")
    index = Index.of(docs, ("content", "summary"))
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert sorted((r["term"], r["id"], r["len"], r["at"]) for r in index.postings.collect()) == [("a", 1, 5, [0, 2, 5]), ("b", 1, 5, [1]), ("b", 2, 1, [1]), ("x", 1, 5, [4])]


def test_best_by_keyword_in_blocks_and_parts(spark):
    """every record that has a word of a query was a row of a shuffle."""
    rnd = random.Random(3)
    names = ["alpha", "beta", "gamma", "delta", "x_y", "of", "the"]
    index = Index.of(spark.createDataFrame([(f"r{i}", " ".join(rnd.choices(names, k=rnd.randint(0, 9)))) for i in range(120)], "id string, content string"))
    asked = spark.createDataFrame([(q, " ".join(rnd.choices([*names, "absent"], k=rnd.randint(0, 4)))) for q in range(30)], "query_id long, text string")
    want: dict = {}
    for q, i, s in batch.keyword_scores(asked, index).collect():
        want.setdefault(q, []).append((-s, i))
    want = {q: [(i, -s) for s, i in sorted(rows)[:7]] for q, rows in want.items()}
    for block, part in ((1 << 16, 1 << 14), (4, 11)):
        found = batch.keyword(asked, index, 7, block, part)
        got: dict = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert got == want


def test_bounded_search_in_blocks_and_slabs(spark, tmp_path, monkeypatch):
    """F1: the bound of every part for every query was a row, and so was each score."""
    for name, value in (("WORD_PART", 100), ("WORD_QUERIES", 3)):
        monkeypatch.setattr(batch, name, value)
    rnd = random.Random(4)
    names = ["alpha", "beta", "gamma", "delta", "of", "the"]
    rows = spark.createDataFrame([(i, " ".join(rnd.choices(names, k=rnd.randint(0, 40)))) for i in range(400)], "id long, content string")
    gone = rows.where("id % 9 = 4")
    segments = [kept_index.write(rows, rows.limit(0), str(tmp_path / "a"), 0), kept_index.write(rows.limit(0), gone, str(tmp_path / "b"), 1)]
    index = kept_index.KeptIndex(spark, segments)
    asked = spark.createDataFrame([(q, " ".join(rnd.choices([*names, "absent"], k=q % 4))) for q in range(9)], "query_id long, text string")
    found, told = kept_index.top_of_many(index, asked, 5)
    want: dict = {}
    for q, i, s in batch.keyword_scores(asked, index).collect():
        want.setdefault(q, []).append((-s, i))
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    assert got == {q: sorted(rows)[:5] for q, rows in want.items()}
    assert all(0 < r["read"] <= r["postings"] for r in told.collect())


def test_a_segment_reads_each_text_once_and_deals_no_posting(spark, tmp_path, monkeypatch):
    """texts were cut into tokens twice for each write, and each posting was a row of a shuffle and a grouping."""
    monkeypatch.setattr(kept_index, "PART_RECORDS", 16)
    rnd = random.Random(6)
    names = ["alpha", "beta", "gamma", "of", "the"]
    data = [(i, " ".join(rnd.choices(names, k=rnd.randint(0, 30))) or None) for i in range(200)]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame(data, "id long, content string")
    gone = rows.where("id % 9 = 4")
    segments = [kept_index.write(rows.withColumn("content", F.udf(seen, "string")("content")), rows.limit(0), str(tmp_path / "a"), 0)]
    assert read.value == 200
    segments.append(kept_index.write(rows.limit(0), gone, str(tmp_path / "b"), 1))
    index, want = kept_index.KeptIndex(spark, segments), Index.of(rows.where("id % 9 <> 4"))
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, want.postings.select("bucket", "term", "id", "len", "at").collect()))
    assert sorted(map(tuple, index.lengths.collect())) == sorted(map(tuple, want.lengths.collect()))
    assert index.size == tuple(want.totals.first())
    held = spark.createDataFrame([(t, i) for i, text in data if i % 9 != 4 for t in set((text or "").split())], "term string, id long").groupBy("term").count().collect()
    assert index.document_frequencies(names) == {r["term"]: r["count"] for r in held}
    plan = kept_index._blocks(rows, ("content",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert index.blocks.where("n > 16").isEmpty() and not index.blocks.where("n > 4").isEmpty()


def test_tiles_of_one_group_are_dealt_over_tasks(spark, monkeypatch):
    """rows dealt by their group for a join stayed so, and one task sorted all copies of all rows."""
    for name, value in (("TILE_ENTRIES", 64), ("PAIR_ROWS", 3)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    rnd = random.Random(5)
    vectors = [[float(rnd.randint(-2, 2)) for _ in range(4)] for _ in range(90)] + [[1.0, 2.0, 0.0, 1.0]] * 20
    rows = spark.createDataFrame([(f"r{k}", k % 2, v) for k, v in enumerate(vectors)], "id string, side int, vector array<float>")

    def cosine(x, y):
        size = math.sqrt(sum(a * a for a in x) * sum(a * a for a in y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / size if size else 0.0

    named = sorted((f"r{k}", k % 2, v) for k, v in enumerate(vectors))
    now = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for by in (("all",), ("side",)):
            found = similarity.near_pairs(rows.withColumn("all", F.lit(1)), 0.5, by, block_rows=4).withColumn("task", F.spark_partition_id()).collect()
            want = {(i, j): cosine(v, w) for n, (i, s, v) in enumerate(named) for j, t, w in named[n + 1 :] if cosine(v, w) >= 0.5 - 1e-12 and (by == ("all",) or s == t)}
            assert len(found) == len(want) and all(abs(want[r["id_a"], r["id_b"]] - r["cosine"]) < 1e-9 for r in found)
            assert len({r["task"] for r in found}) > 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", now)


def test_totals_are_of_the_lengths_that_were_written(spark, tmp_path):
    """saving an index cut all texts into tokens a third time, for two sums."""
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "id long, content string")
    index = Index.of(docs)
    again = F.raise_error(F.lit("texts are read again")).cast("bigint")
    Index(index.postings, index.lengths, index.totals.select(again.alias("n"), again.alias("total"))).save(str(tmp_path / "i"))
    found = Index.load(spark, str(tmp_path / "i"))
    assert [tuple(r) for r in found.totals.select("n", "total").collect()] == [(3, 4)]
    assert sorted((r["term"], r["id"], r["at"]) for r in found.postings.collect()) == [("a", 1, [0, 2]), ("b", 1, [1]), ("b", 3, [0])]
