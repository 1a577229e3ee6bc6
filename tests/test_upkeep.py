"""Whole flows: storing with edges and clusters, todo batches, handoffs, decision records, restoring, captures, legacy files."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions, handoffs, records, store, todos, writes
from tidemark.sources import exchange, legacy, transcripts
from tidemark.streaming import ingest
from tidemark.tables import SCHEMAS, Store, StoreError

NOW = 1_750_000_000


def rows(spark, table, *dicts):
    names = spark.createDataFrame([], SCHEMAS[table]).columns
    base = {"project_id": "p", "memory_type": "fact", "content": "text", "importance": 0.5, "relevance_score": 1.0, "access_count": 0, "created_at": NOW, "updated_at": NOW, "last_accessed_at": NOW, "pinned": False, "global": False, "tags": []} if table == "memories" else {}
    return spark.createDataFrame([tuple((base | d).get(n) for n in names) for d in dicts], SCHEMAS[table])


@pytest.fixture
def some(spark):
    return Store.empty(spark).with_(
        memories=rows(spark, "memories", {"id": "a"}, {"id": "b", "content": "other"}, {"id": "c", "memory_type": "decision", "content": "use spark"}),
        embeddings=rows(spark, "embeddings", {"memory_id": "a", "vector": [1.0, 0.0]}, {"memory_id": "b", "vector": [0.0, 1.0]}, {"memory_id": "c", "vector": [1.0, 1.0]}),
        relationships=rows(spark, "relationships", {"id": "r1", "source_id": "a", "target_id": "b", "relation_type": "relates_to", "strength": 1.0, "created_at": NOW}),
    )


def test_store_in_full(spark, some):
    new = rows(spark, "memories", {"id": "n"})
    after, told = store.remember_fully(some, new, [1.0, 0.01], NOW + 1, supersedes=["a"])
    assert told["outcome"] == "stored" and told["possible_supersedes"] == []
    assert {(r["source_id"], r["target_id"], r["relation_type"]) for r in after.relationships.collect()} == {("a", "b", "relates_to"), ("n", "a", "supersedes")}
    assert after.cluster_members.collect()[0].asDict() == {"cluster_id": told["cluster"], "memory_id": "n"}
    after, second = store.remember_fully(after, rows(spark, "memories", {"id": "m"}), [1.0, 0.6], NOW + 2)
    assert second["cluster"] == told["cluster"] and {c["id"] for c in second["possible_supersedes"]} == {"a", "n"}
    cluster = after.clusters.first()
    assert cluster["member_count"] == 2 and list(cluster["centroid"]) == pytest.approx([1.0, 0.305])
    with pytest.raises(StoreError, match="nothing"):
        store.remember_fully(some, new, [1.0, 0.0], NOW, supersedes=["nothing"])


def test_edit_and_restore_over_a_living_record(spark, some):
    edits = spark.createDataFrame([("a", "new words")], "id string, content string")
    after = writes.edited(some, edits, NOW + 1)
    assert after.memories.where("id = 'a'").first()["content"] == "new words" and after.trash.first()["op"] == "update"
    gone = writes.trashed(after, spark.createDataFrame([("b",)], "id string"), "delete", NOW + 2)
    back, told = writes.restore(gone, spark.createDataFrame([("a",)], "id string"), NOW + 3)
    assert told.first().asDict() == {"memory_id": "a", "op": "update", "overwrote": True, "edges_restored": 0, "edges_dropped": 1}
    assert back.memories.where("id = 'a'").first()["content"] == "text"
    again, told = writes.restore(back, spark.createDataFrame([("b",), ("none",)], "id string"), NOW + 4)
    assert [(r["overwrote"], r["edges_restored"]) for r in told.collect()] == [(False, 1)] and again.memories.count() == 3
    assert [r["memory_id"] for r in again.trash.collect()] == ["a"]


def test_todo_batch(spark, some):
    ops = [
        (0, "add", "t1", " write tests ", "auto", None, None, None),
        (1, "add", "t2", "  ", None, None, None, None),
        (2, "done", "t2", None, None, None, None, None),
        (3, "drop", "t1", None, None, None, None, " "),
        (4, "edit", "t1", "write more tests", None, None, None, None),
        (5, "done", "t1", None, None, None, None, None),
        (6, "add", "t3", "other", None, ["x"], 7.0, None),
        (7, "odd", "t3", None, None, None, None, None),
    ]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (4, [0.5, 0.5]), (6, [0.0, 1.0])], "turn int, vector array<float>")
    after, told, near = todos.written(some, "p", spark.createDataFrame(ops, todos.OPS), vectors, NOW, current="main")
    assert [r["error"] for r in told.orderBy("turn").collect()] == [None, "todo text must not be empty", "t2 is not a todo", "drop requires a non-empty reason", None, None, None, "unknown operation"]
    items = {r["memory_id"]: r for r in after.todos.collect()}
    assert set(items) == {"t1", "t3"} and items["t1"]["status"] == "done" and items["t1"]["closed_at"] == NOW
    got = {r["id"]: r for r in after.memories.where("memory_type = 'todo'").collect()}
    assert got["t1"]["content"] == "write more tests" and got["t1"]["branch"] == "main" and got["t1"]["pinned"] and got["t1"]["importance"] == 0.6 and got["t3"]["importance"] == 1.0
    assert [(r["memory_id"], r["reason"]) for r in after.status.collect()] == [("t1", "todo done")] and near.count() == 0
    more = spark.createDataFrame([(0, "reopen", "t1", None, None, None, None, None), (1, "add", "t4", "again", None, None, None, None)], todos.OPS)
    last, _, near = todos.written(after, "p", more, spark.createDataFrame([(1, [0.0, 1.0])], "turn int, vector array<float>"), NOW + 9)
    assert last.status.count() == 0 and [(r["turn"], r["id"]) for r in near.collect()] == [(1, "t3")]
    listed, counts = todos.listed(last, "p", "project")
    assert {r["memory_id"] for r in listed.collect()} == {"t3", "t4"} and counts.first().asDict() == {"open": 3, "done": 0, "dropped": 0}


def handoff(spark, name, before=None, **values):
    base = {"memory_id": name, "project_id": "p", "branch": "main", "tags": None, "summary": "did it", "decisions": ["one"], "todos": [], "blockers": ["wait"], "mental_model": None, "next_steps": None, "notes": None, "tried": None, "continues_from": before} | values
    schema = "memory_id string, project_id string, branch string, tags array<string>, summary string, decisions array<string>, todos array<string>, blockers array<string>, mental_model string, next_steps array<string>, notes string, tried array<string>, continues_from string"
    return spark.createDataFrame([tuple(base[n] for n in (x.split()[0] for x in schema.split(", ")))], schema)


def written(spark, some, name, before=None, now=NOW):
    sections = spark.createDataFrame([(name, "summary", [1.0, 0.0]), (name, "decisions", [0.0, 1.0])], "memory_id string, section string, vector array<float>")
    return handoffs.created(some, handoff(spark, name, before), sections, rows(spark, "embeddings", {"memory_id": name, "vector": [1.0, 0.0]}), now)


def test_handoffs(spark, some):
    one = handoffs.auto_linked(written(spark, some, "h1"), "h1", "p", NOW)
    assert one.memories.where("id = 'h1'").first()["pinned"] and one.handoffs.count() == 1
    assert [(r["source_id"], r["target_id"]) for r in one.relationships.where("relation_type = 'derived_from'").collect()] == []  # c is at 0.707
    got = handoffs.resumed(one, "p", "main", vector=[1.0, 0.0])
    assert got["latest"] == "h1" and got["message"] == handoffs.ALONE
    assert [r["section"] for r in got["sections"].collect()] == ["summary", "decisions"] and [r["id"] for r in got["linked"].collect()] == ["c"]
    two = written(spark, one, "h2", "h1", NOW + 5)
    got = handoffs.resumed(two, "p", query="what was done", embed=lambda texts: [[1.0, 0.0] for _ in texts])
    assert got["latest"] == "h2" and got["message"] == handoffs.NO_BRANCH and [r["id"] for r in got["chain"].collect()] == ["h1", "h2"]
    assert got["sections"].count() == 4 and got["linked"].count() == 0 and [r["blocker"] for r in got["blockers"].collect()] == ["wait"]
    assert handoffs.resumed(some, "p", "main")["latest"] is None and handoffs.resumed(some, "p", "main")["chain"].count() == 0
    with pytest.raises(StoreError, match="branch"):
        handoffs.created(some, handoff(spark, "h", branch=None), spark.createDataFrame([], "memory_id string, section string, vector array<float>"), some.embeddings.limit(0), NOW)
    with pytest.raises(StoreError, match="todo"):
        handoffs.created(some, handoff(spark, "h", todos=["x"]), spark.createDataFrame([], "memory_id string, section string, vector array<float>"), some.embeddings.limit(0), NOW)


def test_handoff_edit(spark, some):
    one = written(spark, some, "h1", "h0")
    vectors = rows(spark, "embeddings", {"memory_id": "h1", "vector": [0.0, 1.0]})
    sections = spark.createDataFrame([("h1", "summary", [0.0, 1.0])], "memory_id string, section string, vector array<float>")
    text = lambda t: spark.createDataFrame([("h1", t)], "id string, text string")
    after = handoffs.edited(one, text("## Summary\n\nnew\n\n## Decisions\n\n- two"), sections, vectors, NOW + 1)
    row = after.handoffs.first()
    assert (row["summary"], row["decisions"], row["continues_from"], len(row["sections"])) == ("new", ["two"], "h0", 1)
    assert after.trash.count() == 1 and after.embeddings.where("memory_id = 'h1'").first()["vector"] == [0.0, 1.0]
    with pytest.raises(StoreError):
        handoffs.edited(one, text("no heading"), sections, vectors, NOW + 1)


def test_decision_records(spark, some, tmp_path):
    adr = lambda name, status=None: spark.createDataFrame([(name, "p", status, "Use Spark", "c", "d", "e")], "memory_id string, project_id string, status string, title string, context string, decision string, consequences string")
    one, told = decisions.created(some, adr("d1", "accepted"), [1.0, 0.0], NOW)
    assert told == {"id": "d1", "adr_number": 1, "superseded_id": None}
    two, told = decisions.created(one, adr("d2"), [1.0, 0.0], NOW + 1, supersedes=1)
    assert told == {"id": "d2", "adr_number": 2, "superseded_id": "d1"}
    assert {r["memory_id"]: r["status"] for r in two.adrs.collect()} == {"d1": "superseded", "d2": "proposed"}
    assert two.relationships.where("relation_type = 'supersedes'").count() == 1
    with pytest.raises(StoreError, match="proposed -> superseded"):
        decisions.created(two, adr("d3"), [1.0, 0.0], NOW, supersedes=2)
    with pytest.raises(StoreError, match="not found"):
        decisions.created(two, adr("d3"), [1.0, 0.0], NOW, supersedes=9)
    ask = lambda to: spark.createDataFrame([("d2", to)], "memory_id string, to string")
    assert decisions.moved(two, ask("accepted"), NOW).adrs.where("memory_id = 'd2'").first()["status"] == "accepted"
    with pytest.raises(StoreError, match="proposed -> superseded"):
        decisions.moved(two, ask("superseded"), NOW)
    used, row = decisions.shown(two, "p", 2, NOW)
    assert row.first()["memory_id"] == "d2" and used.memories.where("id = 'd2'").first()["access_count"] == 1
    assert decisions.written(two.adrs, str(tmp_path / "adr")).count() == 2 and not (tmp_path / "adr").exists()
    decisions.written(two.adrs, str(tmp_path / "adr"), apply=True)
    assert sorted(p.name for p in (tmp_path / "adr").iterdir()) == ["0001-use-spark.md", "0002-use-spark.md"]


def test_captures(spark, some):
    new = rows(spark, "memories", *[{"id": f"k{i}", "created_at": NOW + i, "tags": ["hook"]} for i in range(4)])
    vectors = rows(spark, "embeddings", {"memory_id": "k0", "vector": [1.0, 0.01]}, {"memory_id": "k1", "vector": [0.4, 1.0]}, {"memory_id": "k2", "vector": [-1.0, 0.0]}, {"memory_id": "k3", "vector": [-1.0, 0.001]})
    after, told = store.captured(some, new, vectors, NOW + 9)
    assert {r["id"]: r["outcome"] for r in told.collect()} == {"k0": "skipped", "k1": "merged", "k2": "stored", "k3": "skipped"}
    assert {r["id"] for r in after.memories.collect()} == {"a", "c", "k1", "k2"}
    with pytest.raises(StoreError):
        store.captured(some, new, vectors.limit(1), NOW)


def test_session_end_reads_its_transcript(spark, tmp_path):
    file = tmp_path / "t.jsonl"
    file.write_text('{"message": {"role": "assistant", "content": "first"}}\n{"message": {"role": "assistant", "content": "we decided"}}\n')
    line = '{"project_id": "p", "event": "SessionEnd", "reason": "exit", "transcript_path": "%s"}' % file
    events = ingest.parsed(spark.createDataFrame([(line,)], "value string"))
    got = ingest.outcomes(ingest.with_answers(events, transcripts.last_answers(spark, str(tmp_path)))).first()
    assert (got["outcome"], got["content"]) == ("stored", "we decided")
    assert ingest.outcomes(ingest.with_answers(events, transcripts.last_answers(spark, str(tmp_path)).limit(0))).first()["outcome"] == "nothing said"


def test_legacy_handoffs(spark, tmp_path):
    (tmp_path / "a.md").write_text("**Branch:** `dev`\n\n## Accomplished\n\nFirst part.\n\nSecond.\n\n## Dead ends:\n\n- one\n\n## Strange\n\nx\n")
    (tmp_path / "b.md").write_text("**Continues from:** `docs/a.md`\n\n## Update 10:20\n\nmore\n\n## Notes\n")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in legacy.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.md"}
    out = legacy.handoffs(legacy.read(spark, str(tmp_path)), "main").orderBy(F.desc("branch")).collect()
    b, a = out
    assert (a["branch"], a["continues_from"], b["branch"], b["continues_from"]) == ("dev", None, "main", a["id"])
    assert a["text"] == "## Summary\n\nFirst part.\n\n## Blockers\n\n- one\n\n## Notes\n\n### Accomplished\nFirst part.\n\nSecond.\n\n### Strange\nx\n"
    assert b["text"] == "## Summary\n\nImported handoff from b.md\n\n## Notes\n\n### Update: Update 10:20\nmore\n"
    back = records.parsed(spark.createDataFrame(out).select("id", "text")).where("valid")
    assert back.count() == 2


def test_projects_and_codecs(spark, some, tmp_path):
    one = writes.with_project(some, "q", NOW)
    assert one.projects.first().asDict() == {"id": "q", "name": "q", "root_path": "q", "decay_rate": 0.01, "created_at": NOW}
    assert writes.with_project(one, "q", NOW + 1, name="other").projects.collect() == one.projects.collect()
    bad = spark.createDataFrame([("m", "a", [1.0, 2.0]), ("m", "b", [3.0])], "memory_id string, section string, vector array<float>")
    with pytest.raises(Exception, match="another length"):
        exchange.section_blob(bad, 2).collect()
    with pytest.raises(Exception, match="whole floats"):
        spark.createDataFrame([("AAA=",)], "t string").select(exchange.decoded(F.col("t"))).collect()
    bare = some.with_(embeddings=some.embeddings.where("memory_id = 'a'"))
    exchange.export(bare, "p", str(tmp_path / "out"), NOW)
    there = exchange.imported(Store.empty(spark), str(tmp_path / "out"), "q", NOW, embed=lambda texts: [[float(len(t)), 0.0] for t in texts])
    got = {r["memory_id"]: r["vector"] for r in there.embeddings.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == [1.0, 0.0] and got["b"][0] > 0
