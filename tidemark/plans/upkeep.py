"""Queries of writes, records, todos, handoffs and hook events, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import clock, ranking, records, retrieval, scope, stats, todos, writes
from tidemark.plans import demo
from tidemark.plans.demo import BM25, CTE, ELAPSED, NOW, PROJECT
from tidemark.plans.queries import query
from tidemark.streaming import ingest
from tidemark.tables import ADR_TRANSITIONS, SCHEMAS, Store


def _six(column: str):
    return F.round(column, 6).alias(column)


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """df with all columns of a table of the store, null where it has none."""
    fields = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _store(spark: SparkSession, d: str) -> Store:
    """The demonstration tables as a store."""
    return Store.empty(spark).with_(
        memories=_shaped(demo.memories(spark, d), "memories"),
        embeddings=_shaped(demo.embeddings(spark, d).withColumnRenamed("id", "memory_id"), "embeddings"),
        relationships=_shaped(demo.relationships(spark, d).withColumn("strength", F.lit(1.0)), "relationships"),
    )


def _ids(store: Store, which: str) -> DataFrame:
    return store.memories.where(which).select("id")


_ENDS = "ends AS (SELECT DISTINCT e.id, rel.id AS edge FROM rel, LATERAL (SELECT unnest([source_id, target_id]) AS id) e)"


@query(
    f"""WITH {CTE}, {_ENDS}, gone AS (SELECT * FROM mem WHERE id % 40 = 1)
SELECT CAST(gone.id AS VARCHAR) AS memory_id, project_id, 'delete' AS op, (SELECT count(*) FROM ends WHERE ends.id = gone.id)::INTEGER AS edges, gone.id IN (SELECT id FROM emb) AS has_vector FROM gone"""
)
def trash_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What goes to the trash with deleted records."""
    store = _store(spark, d)
    out = writes.trashed(store, _ids(store, "cast(id as bigint) % 40 = 1"), "delete", NOW).trash
    edges = F.coalesce(F.size(F.from_json("relationships", "array<struct<id:string>>")), F.lit(0))
    return out.select("memory_id", "project_id", "op", F.greatest(edges, F.lit(0)).alias("edges"), F.col("vector").isNotNull().alias("has_vector"))


@query(
    f"""WITH {CTE}, kept AS (SELECT id FROM mem WHERE project_id <> '{PROJECT}') SELECT 'memories' AS name, count(*) AS n FROM kept UNION ALL SELECT 'embeddings', count(*) FROM emb WHERE id NOT IN (SELECT id FROM mem WHERE project_id = '{PROJECT}')
UNION ALL SELECT 'relationships', count(*) FROM rel WHERE source_id NOT IN (SELECT id FROM mem WHERE project_id = '{PROJECT}') AND target_id NOT IN (SELECT id FROM mem WHERE project_id = '{PROJECT}')
UNION ALL SELECT 'trash', count(*) FROM mem WHERE project_id = '{PROJECT}'"""
)
def wiped_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the tables after a project was wiped."""
    store = _store(spark, d)
    after = writes.trashed(store, store.memories.where(scope.in_project(PROJECT)).select("id"), "wipe", NOW)
    sizes = [getattr(after, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("memories", "embeddings", "relationships", "trash")]
    return sizes[0].union(sizes[1]).union(sizes[2]).union(sizes[3])


@query(
    f"""WITH {CTE}, {_ENDS}, o AS (SELECT DISTINCT b.id, rel.id AS edge, CASE WHEN rel.source_id = b.id THEN rel.target_id ELSE rel.source_id END AS other FROM mem b JOIN ends ON ends.id = b.id JOIN rel ON rel.id = ends.edge WHERE b.id % 20 = 2),
alive AS (SELECT id FROM mem WHERE id % 10 <> 2 OR id % 20 = 2)
SELECT CAST(b.id AS VARCHAR) AS memory_id, 'delete' AS op, false AS overwrote, (SELECT count(*) FROM o WHERE o.id = b.id AND other IN (FROM alive)) AS edges_restored, (SELECT count(*) FROM o WHERE o.id = b.id AND other NOT IN (FROM alive)) AS edges_dropped FROM mem b WHERE b.id % 20 = 2"""
)
def restored_edges(spark: SparkSession, d: str) -> DataFrame:
    """Half of the deleted records come back: what became of their edges."""
    store = _store(spark, d)
    gone = writes.trashed(store, _ids(store, "cast(id as bigint) % 10 = 2"), "delete", NOW)
    return writes.restore(gone, _ids(store, "cast(id as bigint) % 20 = 2"), NOW + 1)[1]


@query(
    f"""WITH {CTE} SELECT id, CASE WHEN id % 9 = 0 THEN 'new: ' || content ELSE content END AS content, CASE WHEN id % 9 = 3 THEN 9e-1 ELSE importance END AS importance,
CASE WHEN id % 9 IN (0, 3) THEN {NOW}::BIGINT ELSE updated_at END AS updated_at, pinned OR coalesce(branch = 'main', false) AS pinned, CASE WHEN branch = 'dev' THEN NULL ELSE branch END AS branch FROM mem"""
)
def changed_records(spark: SparkSession, d: str) -> DataFrame:
    """Edits of contents and importance, pinning and promotion."""
    rows = demo.memories(spark, d)
    content, importance = F.when(F.col("id") % 9 == 0, F.concat(F.lit("new: "), "content")), F.when(F.col("id") % 9 == 3, 0.9)
    edits = rows.where("id % 9 in (0, 3)").select("id", content.alias("content"), importance.alias("importance"))
    out = writes.updated(rows, edits, NOW)
    out = writes.changed(out, F.col("branch") == "main", pinned=F.lit(True))
    out = writes.changed(out, F.col("branch") == "dev", branch=F.lit(None).cast("string"))
    return out.select("id", "content", "importance", "updated_at", "pinned", "branch")


@query(
    f"""WITH {CTE}, asked AS (SELECT id AS source_id, id + 3 AS target_id, (id % 5) / 2e0 AS strength FROM mem WHERE id % 6 = 0)
SELECT source_id, target_id, least(strength, 1e0) AS strength FROM asked WHERE target_id IN (SELECT id FROM mem)"""
)
def linked_records(spark: SparkSession, d: str) -> DataFrame:
    """New edges: both ends have to exist, strength is held between 0 and 1, and a second one of the same ends replaces the first."""
    rows, old = demo.memories(spark, d), demo.relationships(spark, d).where("false").withColumn("strength", F.lit(0.0))
    new = rows.where("id % 6 = 0").select(F.col("id"), F.col("id").alias("source_id"), (F.col("id") + 3).alias("target_id"), F.lit("relates_to").alias("relation_type"), F.lit(NOW).cast("bigint").alias("created_at"), ((F.col("id") % 5) / 2.0).alias("strength"))
    first = writes.linked(old, new.withColumn("strength", F.lit(0.5)), rows)
    return writes.linked(first, new, rows).select("source_id", "target_id", "strength")


@query(
    """WITH t AS (SELECT doc_id AS id, doc_id::VARCHAR AS memory_id, CASE doc_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'drop' WHEN 2 THEN 'edit' WHEN 3 THEN 'reopen' ELSE 'odd' END AS op FROM documents)
SELECT CAST(id AS INTEGER) AS turn, op, memory_id, CASE WHEN op = 'odd' THEN 'unknown operation' WHEN op = 'drop' AND id % 2 = 0 THEN 'drop requires a non-empty reason' WHEN id % 3 = 1 THEN memory_id || ' is not a todo' END AS error FROM t"""
)
def todo_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each of a batch of operations."""
    i = F.col("doc_id")
    op = F.when(i % 5 == 0, "done").when(i % 5 == 1, "drop").when(i % 5 == 2, "edit").when(i % 5 == 3, "reopen").otherwise("odd")
    docs = demo.read(spark, d, "documents").select("doc_id")
    ops = docs.select(i.cast("int").alias("turn"), op.alias("op"), i.cast("string").alias("memory_id"), F.lit("new").alias("text"), F.when(i % 2 == 0, " ").otherwise("why").alias("reason"))
    out = todos.judged(ops, docs.where(i % 3 != 1).select(i.cast("string").alias("memory_id")))
    return out.select("turn", "op", "memory_id", "error")


_TODOS = "todo AS (SELECT id, CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'dropped' ELSE 'open' END AS status FROM mem WHERE id % 3 <> 2)"


def _todos(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    status = F.when(i % 4 == 0, "done").when(i % 4 == 1, "dropped").otherwise("open")
    rows = demo.memories(spark, d).where("id % 3 <> 2").select(i, i.alias("memory_id"), status.alias("status"))
    return rows.withColumns({"reason": F.lit(None).cast("string"), "closed_at": F.lit(None).cast("bigint")})


@query(f"WITH {CTE}, {_TODOS} SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'dropped') AS dropped FROM todo JOIN mem USING (id) WHERE project_id = '{PROJECT}'")
def todo_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.todo_counts(_todos(spark, d), demo.memories(spark, d), PROJECT)


@query(f"WITH {CTE}, {_TODOS} SELECT id AS memory_id, status, content, branch FROM todo JOIN mem USING (id) WHERE project_id = '{PROJECT}' AND status = 'open' AND (branch IS NULL OR branch = 'main')")
def todo_listing(spark: SparkSession, d: str) -> DataFrame:
    items = _todos(spark, d).drop("id")
    out = records.todo_list(items, demo.memories(spark, d), PROJECT, scope.on_branch("main"), "open")
    return out.select("memory_id", "status", "content", "branch")


@query(f"WITH {CTE}, {_TODOS} SELECT todo.id, round(list_cosine_similarity(vector, q), 6) AS score FROM todo JOIN emb USING (id), qv WHERE status = 'open' AND list_cosine_similarity(vector, q) >= 2e-1 ORDER BY score DESC, id LIMIT 3")
def todo_repeats(spark: SparkSession, d: str) -> DataFrame:
    return records.near_todos(_todos(spark, d).drop("id"), demo.embeddings(spark, d), demo.vector(spark, d), 0.2).select("id", _six("score"))


@query(
    f"""WITH {CTE} SELECT emb.id, round(list_cosine_similarity(vector, q), 6) AS score, content[1:160] AS preview FROM emb JOIN mem USING (id), qv
WHERE project_id = '{PROJECT}' AND memory_type = 'fact' AND emb.id <> 0 AND list_cosine_similarity(vector, q) >= 1e-1 ORDER BY list_cosine_similarity(vector, q) DESC, emb.id LIMIT 5"""
)
def supersession_offers(spark: SparkSession, d: str) -> DataFrame:
    """Records that a new one may supersede."""
    out = records.supersession_candidates(demo.memories(spark, d), demo.embeddings(spark, d), demo.vector(spark, d), PROJECT, "fact", (0,), 0.1)
    return out.select("id", _six("score"), "preview")


_HANDOFF = "h AS (SELECT doc_id AS memory_id, source AS summary, CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [] END AS decisions, text AS notes FROM documents)"


def _handoffs(spark: SparkSession, d: str) -> DataFrame:
    none, texts = F.lit(None).cast("string"), F.array().cast("array<string>")
    docs = demo.read(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("memory_id"), F.col("source").alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(texts).alias("decisions"), F.col("text").alias("notes"))
    return rows.withColumns({"todos": texts, "blockers": texts, "tried": texts, "next_steps": texts, "mental_model": none})


@query(
    f"""WITH {_HANDOFF}, s AS (SELECT memory_id, 'summary' AS section, summary AS text FROM h UNION ALL SELECT memory_id, 'decisions', array_to_string(decisions, chr(10)) FROM h UNION ALL SELECT memory_id, 'notes', notes FROM h)
SELECT * FROM s WHERE trim(coalesce(text, '')) <> ''"""
)
def handoff_sections(spark: SparkSession, d: str) -> DataFrame:
    return records.sections(_handoffs(spark, d))


@query(f"WITH {_HANDOFF} SELECT memory_id, 'notes' AS section, CAST(length(notes) AS INTEGER) AS size FROM h WHERE length(notes) > 200 UNION ALL SELECT memory_id, 'decisions', CAST(length(x) AS INTEGER) FROM (SELECT memory_id, unnest(decisions) AS x FROM h) WHERE length(x) > 3")
def handoff_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Sections and items with more characters than they should have."""
    return records.section_warnings(_handoffs(spark, d), 200, 3)


@query(
    f"""WITH {_HANDOFF} SELECT memory_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(coalesce(summary, '')) <> '' THEN '## Summary' || chr(10) || chr(10) || summary END,
CASE WHEN len(decisions) > 0 THEN '## Decisions' || chr(10) || chr(10) || array_to_string(list_transform(decisions, lambda x: '- ' || x), chr(10)) END, CASE WHEN trim(coalesce(notes, '')) <> '' THEN '## Notes' || chr(10) || chr(10) || notes END) AS content FROM h"""
)
def handoff_markdown(spark: SparkSession, d: str) -> DataFrame:
    return records.rendered(_handoffs(spark, d))


_PARTS = "part AS (SELECT id // 2 AS memory_id, CASE WHEN id % 2 = 0 THEN 'summary' ELSE 'notes' END AS section, vector FROM emb)"


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs of two sections each, of the vectors of two records."""
    own = demo.embeddings(spark, d).select(F.floor(F.col("id") / 2).alias("memory_id"), F.when(F.col("id") % 2 == 0, "summary").otherwise("notes").alias("section"), "vector")
    return own.groupBy("memory_id").agg(F.collect_list(F.struct("section", "vector")).alias("sections"))


@query(f"WITH {CTE}, {_PARTS} SELECT memory_id, section, round(list_cosine_similarity(vector, q), 6) AS score FROM part, qv WHERE section = 'notes'")
def section_scores(spark: SparkSession, d: str) -> DataFrame:
    return records.scored_sections(_sectioned(spark, d), demo.vector(spark, d), "NOTES").select("memory_id", "section", _six("score"))


@query(
    f"""WITH {CTE}, {_PARTS}, recent AS (SELECT id FROM mem WHERE project_id = '{PROJECT}' AND memory_type = 'handoff' AND branch = 'main' ORDER BY created_at DESC, id LIMIT 200)
SELECT memory_id, section, round(list_cosine_similarity(vector, q), 6) AS score FROM part, qv WHERE memory_id IN (FROM recent) ORDER BY list_cosine_similarity(vector, q) DESC, memory_id, section LIMIT 10"""
)
def handoff_search(spark: SparkSession, d: str) -> DataFrame:
    out = records.handoff_search(_sectioned(spark, d), demo.memories(spark, d), demo.vector(spark, d), PROJECT, F.col("branch") == "main")
    return out.select("memory_id", "section", _six("score"))


@query(
    f"""WITH {CTE}, pool AS (SELECT id FROM mem WHERE project_id = '{PROJECT}' AND memory_type IN ('decision', 'pattern', 'debug') AND NOT list_contains(tags, 'hook') ORDER BY created_at DESC, id LIMIT 1000),
sv AS (SELECT vector AS s FROM emb WHERE id < 8), b AS (SELECT id, max(list_cosine_similarity(vector, s)) AS score FROM emb JOIN pool USING (id), sv GROUP BY id)
SELECT id, round(score, 6) AS score FROM b WHERE score >= 1e-1 ORDER BY b.score DESC, id LIMIT 10"""
)
def auto_links(spark: SparkSession, d: str) -> DataFrame:
    """Records that a handoff's sections are near to."""
    sections = demo.embeddings(spark, d).where("id < 8").select(F.col("id").cast("string").alias("section"), "vector")
    return records.auto_links(sections, demo.memories(spark, d), demo.embeddings(spark, d), PROJECT, 0.1).select("id", _six("score"))


_EVENT = f"""ev AS (SELECT doc_id AS id, lang AS project_id, CASE doc_id % 5 WHEN 0 THEN 'UserPromptSubmit' WHEN 1 THEN 'SessionEnd' WHEN 2 THEN 'SubagentStop' WHEN 3 THEN 'Stop' END AS event, CASE WHEN doc_id % 7 = 0 THEN 'clear' ELSE 'exit' END AS reason,
  CASE WHEN doc_id % 2 = 0 THEN '#remember ' ELSE '' END || coalesce(text, '') AS said, {NOW} + doc_id AS moment FROM documents),
oc AS (SELECT id, project_id, moment, CASE WHEN event IS NULL THEN 'unreadable' WHEN event = 'UserPromptSubmit' THEN CASE WHEN strlen(said) < 40 THEN 'short' WHEN NOT (contains(said, '#remember') OR regexp_matches(said, '(?i)\\b(decided?|chose|prefer(?:s|red|ence)?|switch(?:ed)? to)\\b')) THEN 'no cue' ELSE 'stored' END
  WHEN event = 'SessionEnd' THEN CASE WHEN reason = 'clear' THEN 'reason' WHEN trim(said) = '' THEN 'nothing said' ELSE 'stored' END WHEN event = 'SubagentStop' THEN CASE WHEN strlen(said) < 200 THEN 'short' ELSE 'stored' END ELSE 'nothing to do' END AS outcome, event FROM ev)"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    event = F.when(i % 5 == 0, "UserPromptSubmit").when(i % 5 == 1, "SessionEnd").when(i % 5 == 2, "SubagentStop").when(i % 5 == 3, "Stop")
    said = F.concat(F.when(i % 2 == 0, "#remember ").otherwise(""), F.coalesce("text", F.lit("")))
    rows = demo.read(spark, d, "documents").select(i.alias("id"), F.col("lang").alias("project_id"), i.cast("string").alias("session_id"), event.alias("event"), said.alias("prompt"), F.when(i % 7 == 0, "clear").otherwise("exit").alias("reason"), said.alias("message"), (F.lit(NOW) + i).alias("at"))
    return ingest.outcomes(rows, (*ingest.ENABLED, "SubagentStop", "UserPromptSubmit"))


@query(f"WITH {_EVENT} SELECT id, outcome, CASE WHEN outcome = 'stored' THEN CASE event WHEN 'SessionEnd' THEN 4e-1 ELSE 5e-1 END END AS importance FROM oc")
def hook_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("id", "outcome", "importance")


@query(f"WITH {_EVENT}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, moment // 86400, outcome = 'stored' ORDER BY moment) AS turn FROM oc) SELECT id, CASE WHEN outcome = 'stored' AND turn > 50 THEN 'capped' ELSE outcome END AS outcome FROM r")
def hook_cap(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes under the daily cap of a project."""
    return ingest.capped(_outcomes(spark, d)).select("id", "outcome")


@query(f"WITH {CTE}, {ELAPSED} SELECT id, round(6e-1 * list_cosine_similarity(vector, q) + 2e-1 * exp(-2e-2 * elapsed) + 2e-1 * importance, 6) AS score FROM emb JOIN mem USING (id) JOIN el USING (id), qv")
def additive_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = demo.memories(spark, d)
    days = clock.elapsed_days(rows, clock.store_days(rows)).select("id", "elapsed")
    scored = demo.embeddings(spark, d).select("id", ranking.cosine_to(demo.vector(spark, d))("vector").alias("near")).join(days, "id").join(rows.select("id", "importance"), "id")
    return scored.select("id", F.round(clock.additive(F.col("near"), F.col("elapsed"), F.col("importance")), 6).alias("score"))


@query("WITH h AS (SELECT vec_id AS id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM h) SELECT id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(list_transform(v, lambda x: x / len)), 6) AS v FROM n")
def truncated_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first 16 numbers of each vector, of length 1."""
    return demo.embeddings(spark, d).select("id", F.posexplode(ranking.normalised(F.col("vector"), 16)).alias("pos", "v")).select("id", "pos", _six("v"))


@query("SELECT c_custkey AS memory_id, (['proposed','accepted','rejected','deprecated','superseded'])[c_custkey % 5 + 1] AS status, (['proposed','accepted','rejected','deprecated','superseded'])[c_nationkey % 5 + 1] AS \"to\", status = \"to\" AND \"to\" <> 'superseded' OR status || '>' || \"to\" IN ('proposed>accepted', 'proposed>rejected', 'proposed>deprecated', 'accepted>deprecated', 'rejected>proposed', 'deprecated>accepted') AS allowed FROM customer")
def adr_requests(spark: SparkSession, d: str) -> DataFrame:
    """Which changes of decision records' states are allowed."""
    state = lambda c: F.element_at(F.array(*map(F.lit, ADR_TRANSITIONS)), (F.col(c) % 5 + 1).cast("int"))
    rows = demo.read(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), state("c_custkey").alias("status"), state("c_nationkey").alias("to"))
    return writes.adr_moves(rows.select("memory_id", "status"), rows.select("memory_id", "to"), ADR_TRANSITIONS)


@query("SELECT c_custkey AS memory_id, c_nationkey AS adr_number FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0")
def adr_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = demo.read(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_mktsegment").alias("project_id"), F.col("c_nationkey").alias("adr_number"), F.when(F.col("c_nationkey") % 2 == 0, "accepted").otherwise("proposed").alias("status"))
    return records.adr_list(rows, "BUILDING", "accepted").select("memory_id", "adr_number")


@query(f"WITH {CTE} SELECT id, {NOW}::BIGINT AS marked_at, 'done with' AS reason FROM dead WHERE id % 2 = 0 OR id % 3 = 0")
def dead_marks(spark: SparkSession, d: str) -> DataFrame:
    """Records marked dead, twice in part, and some of them taken back."""
    ids, none = demo.dead(spark, d), spark.createDataFrame([], "memory_id bigint, dead boolean, reason string, marked_at bigint")
    status = writes.with_state(none, ids, True, "first", NOW - 1)
    status = writes.with_state(status, ids, True, "done with", NOW)
    out = writes.with_state(status, ids.where("id % 2 <> 0 and id % 3 <> 0"), False, None, NOW)
    return out.select(F.col("memory_id").alias("id"), "marked_at", "reason")


@query("SELECT DISTINCT conv_id, 'session:' || conv_id AS tag, CAST(conv_id AS VARCHAR) AS session FROM conversations")
def session_tags(spark: SparkSession, d: str) -> DataFrame:
    """Sessions read back from tags."""
    rows = demo.read(spark, d, "conversations").select("conv_id", F.array(F.lit("x"), F.concat(F.lit("session:"), F.col("conv_id").cast("string"))).alias("tags")).distinct()
    return rows.select("conv_id", F.col("tags")[1].alias("tag"), text.session_of(F.col("tags")).alias("session"))


@query(
    f"""WITH {CTE}, {BM25}, word AS (SELECT bm.id, row_number() OVER (ORDER BY bm.score DESC, bm.id) - 1 AS rank FROM bm JOIN mem USING (id) WHERE project_id = '{PROJECT}' AND (branch IS NULL OR branch = 'main') ORDER BY bm.score DESC, bm.id LIMIT 50)
SELECT id, round((1e0 / (61 + rank) + least(15e-2, 5e-2 * len(list_filter(['the', 'nation', 'with', 'house'], lambda w: len(list_filter(tags, lambda t: contains(lower(t), w) OR contains(w, lower(t)))) > 0)))) * relevance_score, 9) AS score
FROM word JOIN mem USING (id) WHERE relevance_score >= 1e-1 ORDER BY score DESC, id LIMIT 10"""
)
def branch_keyword_query(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits of one branch and of none, with their pseudo scores."""
    out = retrieval.query(demo.memories(spark, d), demo.embeddings(spark, d), demo.QUERY, demo.vector(spark, d), PROJECT, mode="bm25", branch=scope.on_branch("main"), index=demo.index(spark, d), digits=9)
    return out.select("id", F.round("score", 9).alias("score"))
