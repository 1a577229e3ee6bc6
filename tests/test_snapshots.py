"""Versions of a store and the index that its writes keep: after any write, scores are those of an index that is built anew."""

import pytest

from tidemark import snapshots
from tidemark.operators import kept_index, ranking, store, writes
from tidemark.operators.keyword_index import Index
from tidemark.snapshots import Conflict, Snapshots
from tidemark.tables import Store, StoreError

NOW = 1_700_000_000
QUERIES = ("the fox fox dog absent", "quick-brown")


def records(spark, named):
    """named: (id, project, content, tags)."""
    s = Store.empty(spark).memories.schema
    rows = [(i, p, "fact", c, None, t, 0.5, 1.0, 0, NOW, NOW, NOW, None, None, None, False, False) for i, p, c, t in named]
    return spark.createDataFrame(rows, s)


def filled(spark):
    rows = [(f"m{k}", "ab"[k % 2], f"the quick-brown fox {'dog ' * (k % 4)} number{k}", ["red"] if k % 3 else None) for k in range(24)]
    s = Store.empty(spark)
    vectors = spark.createDataFrame([(r[0], [1.0, float(k)], None) for k, r in enumerate(rows)], s.embeddings.schema)
    edges = writes.edges(spark, [("m1", "m3", "relates_to"), ("m2", "m4", "relates_to")], NOW)
    projects = spark.createDataFrame([("a", "a", "a", 0.01, NOW), ("b", "b", "b", 0.01, NOW)], s.projects.schema)
    return s.with_(memories=records(spark, rows), embeddings=vectors, relationships=edges, projects=projects)


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def holds(snaps, queries=QUERIES):
    """The kept index against one built anew from the records of the version."""
    memories = kept_index.texts(snaps.load().memories)
    columns = tuple(c for c in memories.columns if c != "id")
    fresh, index = Index.of(memories, columns), snaps.index()
    assert index.size == tuple(fresh.totals.first())
    assert sorted(map(tuple, index.lengths.collect())) == sorted(map(tuple, fresh.lengths.collect()))
    for q in queries:
        want = scores(ranking.bm25(memories, q, columns))
        assert scores(index.bm25(q)) == want
        got = [(r["id"], round(r["score"], 9)) for r in index.top(q, 5)[0].collect()]
        assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_store_update_delete_and_restore_keep_the_index(spark, tmp_path):
    snaps = Snapshots.create(filled(spark), str(tmp_path / "s"))
    s = snaps.load()
    more = s.with_(memories=writes.stored(s.memories, records(spark, [("n1", "a", "a new fox and a red dog", ["quick"])]), NOW))
    assert snaps.commit(more, ["a"], 0, s) == 1
    assert snaps.manifest(1)["tables"]["embeddings"] == snaps.manifest(0)["tables"]["embeddings"]
    s = snaps.load()
    edits = spark.createDataFrame([("m2", "no animal here"), ("m4", "fox fox fox")], "id string, content string")
    snaps.commit(writes.edited(s, edits, NOW + 1), ["a"], 1, s)
    holds(snaps)
    gone = spark.createDataFrame([("m1",), ("m3",), ("m2",)], "id string")
    snaps.commit(store.delete(snaps.load(), gone, NOW + 2), ["a", "b"], 2)
    assert snaps.load().memories.where("id in ('m1', 'm2', 'm3')").count() == 0
    back = writes.restored(snaps.load(), spark.createDataFrame([("m3",), ("m2",)], "id string"))
    snaps.commit(back, ["a", "b"], 3)
    holds(snaps)
    assert snaps.load().memories.where("id = 'm2'").first()["content"] == "no animal here"
    assert snaps.load(0).memories.count() == 24  # a reader of an earlier version sees what it saw


def test_a_write_replaces_only_its_projects_files(spark, tmp_path):
    snaps = Snapshots.create(filled(spark), str(tmp_path / "s"))
    s = snaps.load()
    snaps.commit(s.with_(memories=writes.changed(s.memories, s.memories["project_id"] == "a", importance=snapshots.F.lit(0.9))), ["a"], 0, s)
    old, new = snaps.manifest(0)["tables"]["memories"], snaps.manifest(1)["tables"]["memories"]
    (first,) = old
    assert new[first] == ["b"] and len(new) == 2
    own = snaps.load(1, ["b"]).memories
    assert all(first in f for f in own.inputFiles()) and own.count() == 12
    assert {r[0] for r in snaps.load().memories.where("project_id = 'a'").select("importance").collect()} == {0.9}
    assert snaps.load().embeddings.count() == 24 and snaps.load().relationships.count() == 2


def test_all_tables_change_or_none(spark, tmp_path, monkeypatch):
    snaps = Snapshots.create(filled(spark), str(tmp_path / "s"))
    after = store.delete(snaps.load(), spark.createDataFrame([("m1",)], "id string"), NOW)

    def fails(*args):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(kept_index, "write", fails)
        with pytest.raises(OSError):
            snaps.commit(after, ["b"], 0)
    assert snaps.versions() == [0] and snaps.load().memories.count() == 24 and snaps.load().trash.count() == 0
    assert scores(snaps.index().bm25("number1")).keys() == {"m1"}
    snaps.commit(after, ["b"], 0)
    assert snaps.load().memories.count() == 23 and snaps.load().trash.count() == 1 and snaps.load().relationships.count() == 1
    with pytest.raises(Conflict):
        snaps.commit(after, ["b"], 0)
    with pytest.raises(StoreError):
        Snapshots.create(after, snaps.folder)
    assert snaps.vacuum(keep=1) and snaps.versions() == [1]
    assert snaps.load().memories.count() == 23
    holds(snaps, ("fox",))


def test_segments_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_SEGMENTS", 2)
    snaps = Snapshots.create(filled(spark), str(tmp_path / "s"))
    for k in range(3):
        s = snaps.load()
        snaps.commit(s.with_(memories=writes.stored(s.memories, records(spark, [(f"n{k}", "b", f"fox {k}", None)]), NOW)), ["b"], k, s)
    assert [len(snaps.manifest(v)["index"]) for v in range(4)] == [1, 2, 1, 2]
    holds(snaps)


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path):
    """Long records with the word once, a few short ones with it often: the long ones' parts are left out."""
    long = [(f"l{k:04d}", f"fox {'filler ' * 200}{k}") for k in range(600)]
    short = [(f"s{k:02d}", "fox fox fox") for k in range(20)]
    rows = spark.createDataFrame(long + short, "id string, content string")
    segment = kept_index.write(rows, rows.limit(0), str(tmp_path / "i"), 0)
    index = kept_index.KeptIndex(spark, [segment])
    got, read = index.top("fox", 10)
    assert [r["id"] for r in got.collect()] == [f"s{k:02d}" for k in range(10)]
    assert read["postings"] == 620 and read["read"] < 200 and read["parts_read"] < read["parts"]
    assert scores(index.bm25("fox")) == scores(ranking.bm25(rows, "fox"))
    asked = spark.createDataFrame([(1, "fox filler"), (2, "fox"), (3, "filler 17"), (4, "absent"), (5, "fox-fox filler"), (6, "")], "query_id long, text string")
    many, told = kept_index.top_of_many(index, asked, 10)
    got = {}
    for r in many.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for r in asked.collect():
        want = sorted(scores(ranking.bm25(rows, r["text"])).items(), key=lambda x: (-x[1], x[0]))[:10]
        assert got.get(r["query_id"], []) == want
    read = {r["query_id"]: (r["postings"], r["read"]) for r in told.collect()}
    assert read[2] == (620, 20) and read[1][1] < read[1][0]


def test_an_empty_store(spark, tmp_path):
    snaps = Snapshots.create(Store.empty(spark), str(tmp_path / "s"))
    assert snaps.load().memories.count() == 0 and snaps.index().bm25("fox").collect() == [] and snaps.index().top("fox", 3)[0].collect() == []
    s = snaps.load()
    snaps.commit(s.with_(memories=writes.stored(s.memories, records(spark, [("x", "p", "fox", None)]), NOW)), ["p"], 0, s)
    assert scores(snaps.index().bm25("fox")).keys() == {"x"}
