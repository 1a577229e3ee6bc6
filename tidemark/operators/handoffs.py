"""Handoffs as wholes: written to their tables at once, edited, and resumed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import at_boundary
from tidemark.operators import graph, lookup, ranking, records, writes
from tidemark.operators.scope import in_project
from tidemark.tables import InvalidArguments, InvalidType, Store

IMPORTANCE, KIN = 0.85, ("decision", "pattern", "debug")
NO_BRANCH = "No current branch detected; returning off-branch handoffs only."
ALONE = "Single handoff on branch; supplemented with related decisions/patterns/debug memories."


def _with_vectors(handoffs: DataFrame, section_vectors: DataFrame) -> DataFrame:
    """handoffs with `sections` gathered from (memory_id, section, vector): eight of a handoff at most."""
    gathered = section_vectors.groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("section", "vector"))).alias("sections"))
    return handoffs.drop("sections").join(gathered, "memory_id", "left")


def created(store: Store, handoffs: DataFrame, section_vectors: DataFrame, vectors: DataFrame, now: int) -> Store:
    """The store with new handoffs, each a record, a vector and a row of sections, or none of them.

    handoffs: the columns of `records.HANDOFF`, memory_id, project_id, branch, tags and continues_from. A branch and a summary are needed, and todos are
    refused. Decisions, patterns and debug notes near a section are linked by `auto_linked`.
    """
    if not handoffs.where(F.coalesce("branch", F.lit("")) == "").isEmpty():
        raise InvalidArguments("a handoff needs a branch")
    handoffs = records.checked_handoffs(handoffs)
    values = {"id": F.col("memory_id"), "memory_type": F.lit("handoff"), "tags": F.coalesce("tags", F.array().cast("array<string>")), "importance": F.lit(IMPORTANCE)}
    values |= {"relevance_score": F.lit(1.0), "access_count": F.lit(0), "pinned": F.lit(True), "global": F.lit(False)}
    values |= {c: F.col(c) for c in ("project_id", "branch", "content", "summary")}
    rows = handoffs.join(records.rendered(handoffs), "memory_id")
    rows = rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in store.memories.schema.fields])
    side = _with_vectors(handoffs, section_vectors).select(store.handoffs.columns)
    return store.with_(
        memories=writes.stored(store.memories, rows, now),
        embeddings=store.embeddings.unionByName(vectors.select(store.embeddings.columns)),
        handoffs=store.handoffs.unionByName(side),
    )


def auto_linked(store: Store, memory_id: str, project: str, now: int) -> Store:
    """The store with edges from a handoff to what its sections are near to."""
    vectors = store.handoffs.where(F.col("memory_id") == memory_id).select(F.explode("sections").alias("s")).select("s.section", "s.vector")
    if vectors.isEmpty():
        return store
    near = records.auto_links(vectors, store.memories, store.embeddings.select(F.col("memory_id").alias("id"), "vector"), project)
    named = [(memory_id, r["id"], "derived_from") for r in near.collect()]  # ten at most
    return store.with_(relationships=writes.linked(store.relationships, writes.edges(near.sparkSession, named, now), store.memories)) if named else store


def edited(store: Store, markdown: DataFrame, section_vectors: DataFrame, vectors: DataFrame, now: int) -> Store:
    """Handoffs whose Markdown (id, text) was replaced: text, sections and vectors change together. What cannot be read is refused before anything is written, the trash included."""
    found = records.parsed(markdown)
    if not found.where(~F.col("valid")).isEmpty():
        raise InvalidArguments("a handoff needs a summary")
    if not found.join(store.handoffs.select(F.col("memory_id").alias("id")), "id", "left_anti").isEmpty():
        raise InvalidType("not a handoff")
    old = store.handoffs.select("memory_id", "continues_from")
    rows = _with_vectors(found.withColumnRenamed("id", "memory_id"), section_vectors).join(old, "memory_id").select(store.handoffs.columns)
    texts = markdown.select("id", F.col("text").alias("content")).join(found.select("id", "summary"), "id")
    fresh = vectors.select(store.embeddings.columns)
    after = writes.edited(store, texts, now)
    return after.with_(handoffs=writes.upserted(store.handoffs, rows, ("memory_id",)), embeddings=writes.upserted(store.embeddings, fresh, ("memory_id",)))


def resumed(store: Store, project: str, branch: str | None = None, query: str | None = None, vector: Sequence[float] | None = None, embed: Callable = lookup.hashed, most: int = 5, width: int = 1500, off_branch: bool = False) -> dict:
    """What a session that goes on needs.

    latest: id of the newest handoff, None without one. chain: (id, position), the oldest first. sections: the best ones of the whole chain, cut to width (0: whole). open_todos, blockers of
    the newest. linked: what it was derived from, without what hooks captured; a chain of one handoff that leaves places free gets the nearest decisions, patterns and debug
    notes of the branch. used: (id), to be given to `writes.reinforced`. message: what to know about the answer. Without query and vector, the summary of
    the newest handoff is the query. Without a branch, handoffs of all branches count.
    """
    message = None if branch else NO_BRANCH
    here: Column | None = None if not branch or off_branch else F.col("branch") == branch
    todo_branch = F.lit(True) if not branch else F.col("branch").isNull() | (F.col("branch") == branch)
    todos = records.todo_list(store.todos, store.memories, project, todo_branch, "open").limit(100)
    newest = records.latest_handoffs(store.memories, project, here, 1).select("id", "summary", "content").first()
    start = newest["id"] if newest else None
    own = store.handoffs.where(F.col("memory_id") == F.lit(start))
    if vector is None and newest:
        row = own.select("summary").first()
        fallback = row["summary"] if row else newest["summary"] or (newest["content"] or "")[:200]
        vector = lookup.query_vector(query or fallback or "", embed)
    path = graph.chain(store.handoffs.select(F.col("memory_id").alias("id"), F.col("continues_from").alias("next")), start)
    if newest is None:
        path = path.limit(0)
    chain = [r["id"] for r in path.collect()]  # five at most
    rows = store.handoffs.where(F.col("memory_id").isin(*chain))
    best = records.scored_sections(rows, vector or []).join(records.sections(rows), ["memory_id", "section"])
    best = best.orderBy(F.desc("score"), "memory_id", "section").limit(most)
    kin = graph.linked(store.relationships, F.lit(start)).distinct().join(store.memories.where(~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "hook")), "id")
    free = most - best.count() if len(chain) == 1 else 0
    kin = kin.select("id", "content", F.lit(None).cast("double").alias("score"))
    if free > 0:
        pool = store.memories.where(in_project(project) & F.col("memory_type").isin(*KIN) & ~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "hook"))
        pool = pool.where(F.col("branch").isNull() | (F.col("branch") == branch)) if branch else pool
        pool = pool.where(F.col("id") != start).join(kin.select("id"), "id", "left_anti").select("id", "content")
        score = ranking.cosine_to(vector)("vector").alias("score")
        more = pool.join(store.embeddings.select(F.col("memory_id").alias("id"), "vector"), "id").select("id", "content", score).orderBy(F.desc("score"), "id").limit(free)
        message = message if more.isEmpty() else ALONE
        kin = kin.unionByName(more)
    return {
        "latest": start,
        "chain": path.orderBy("position"),
        "sections": best.withColumn("text", at_boundary(F.col("text"), width)) if width else best,
        "open_todos": todos,
        "blockers": own.select(F.explode("blockers").alias("blocker")),
        "linked": kin.withColumn("preview", at_boundary(F.col("content"), 300)).drop("content"),
        "used": own.select(F.col("memory_id").alias("id")),
        "message": message,
    }
