"""Todo items: a batch of operations on them, with one result for each operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import batch, records, writes
from tidemark.operators.scope import in_project
from tidemark.session import kept
from tidemark.tables import InvalidArguments, Store

OPS = "turn int, op string, memory_id string, text string, branch string, tags array<string>, importance double, reason string"
IMPORTANCE = 0.6


def judged(ops: DataFrame, todos: DataFrame) -> DataFrame:
    """Operations (`OPS`) with `error`, null for those that can be done. todos: (memory_id). An item that the same batch adds can be named by later operations."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    added = ops.where((F.col("op") == "add") & ~empty).groupBy("memory_id").agg(F.min("turn").alias("added"))
    known = todos.select("memory_id", F.lit(-1).alias("added")).unionByName(added).groupBy("memory_id").agg(F.min("added").alias("added"))
    rows = ops.join(known, "memory_id", "left")
    unknown = F.coalesce(F.col("added") >= F.col("turn"), F.lit(True))
    error = (
        F.when(~F.col("op").isin("add", "done", "drop", "reopen", "edit") | F.col("op").isNull(), "unknown operation")
        .when(F.col("op").isin("add", "edit") & empty, "todo text must not be empty")
        .when((F.col("op") == "drop") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "drop requires a non-empty reason")
        .when((F.col("op") == "add") & (F.col("added") < F.col("turn")), "id is taken")
        .when((F.col("op") != "add") & unknown, F.concat(F.coalesce("memory_id", F.lit("null")), F.lit(" is not a todo")))
    )
    return rows.select(*ops.columns, error.alias("error"))


def written(store: Store, project: str, ops: DataFrame, vectors: DataFrame, now: int, current: str | None = None, most: int = 100) -> tuple[Store, DataFrame, DataFrame]:
    """The store after at most `most` operations in the order of turn; their results (turn, op, memory_id, error); and (turn, id, score) of open items that an added one may repeat.

    A faulty operation does not stop the others. An added item is pinned, and of the branch it names (`auto`: the current one; none: the whole project).
    A closed item is marked dead, so that queries leave it out; reopening takes that back. vectors: (turn, vector) of added and edited texts.
    """
    if ops.limit(most + 1).count() > most:
        raise InvalidArguments(f"more than {most} operations at once")
    told = kept(judged(ops, store.todos))
    good = told.where("error is null")
    added = good.where("op = 'add'")
    open_ones = records.todo_list(store.todos, store.memories, project, status="open").select(F.col("memory_id").alias("id"))
    stored = store.embeddings.select(F.col("memory_id").alias("id"), "vector").join(open_ones, "id", "left_semi")
    near = batch.nearest(added.join(vectors, "turn").select(F.col("turn").alias("query_id"), "vector"), stored, records.NEAR_TODOS, least=records.NEAR_TODO)
    near = near.select(F.col("query_id").alias("turn"), "id", F.col("cosine").alias("score"))

    text = F.trim("text")
    branch = F.when(F.col("branch") == "auto", F.lit(current).cast("string")).when(F.col("branch") != "", F.col("branch"))
    importance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(IMPORTANCE))))
    values = {"id": F.col("memory_id"), "project_id": F.lit(project), "memory_type": F.lit("todo"), "content": text, "tags": F.coalesce("tags", F.array().cast("array<string>"))}
    values |= {"importance": importance, "relevance_score": F.lit(1.0), "access_count": F.lit(0), "branch": branch, "pinned": F.lit(True), "global": F.lit(False)}
    fields = store.memories.schema.fields
    new = added.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    memories = writes.stored(store.memories, new, now)
    texts = good.where("op = 'edit'").groupBy(F.col("memory_id").alias("id")).agg(F.max_by(text, "turn").alias("content"))
    memories = writes.updated(memories, texts, now)
    vector_of = good.where("op in ('add', 'edit')").join(vectors, "turn").groupBy("memory_id").agg(F.max_by("vector", "turn").alias("vector"))
    fresh = vector_of.withColumn("model_version", F.lit(None).cast("string"))
    items = store.todos.unionByName(added.select("memory_id", F.lit("open").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("bigint").alias("closed_at")))
    moves = good.where("op in ('done', 'drop', 'reopen')").withColumn("at", F.lit(now).cast("bigint"))
    items = writes.todo_state(items, moves)
    moved = items.join(moves.select("memory_id").distinct(), "memory_id", "left_semi")
    memories = writes.changed_times(memories, moved.select(F.col("memory_id").alias("id")), now)
    closed = moved.where("status != 'open'")
    note = F.coalesce("reason", F.concat(F.lit("todo "), "status"))
    dead = closed.select("memory_id", F.lit(True).alias("dead"), note.alias("reason"), F.lit(now).cast("bigint").alias("marked_at"))
    status = store.status.join(moved.select("memory_id"), "memory_id", "left_anti").select(store.status.columns).unionByName(dead)
    after = store.with_(memories=memories, embeddings=writes.upserted(store.embeddings, fresh, ("memory_id",)), todos=items, status=status)
    return after, told.select("turn", "op", "memory_id", "error"), near


def listed(store: Store, project: str, mode: str = "current", current: str | None = None, status: str | None = "open", limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Items of the project, newest first, and how many there are of each status. mode: current (this branch and the whole project's), project (only the whole project's), all, or a branch by name."""
    branch = {"all": F.lit(True), "project": F.col("branch").isNull()}.get(mode)
    if branch is None:
        named = current if mode == "current" else mode
        branch = F.lit(True) if named is None else F.col("branch").isNull() | (F.col("branch") == named)
    rows = records.todo_list(store.todos, store.memories, project, branch, status).limit(limit)
    counts = store.todos.join(store.memories.where(in_project(project)).select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return rows, counts.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("open", "done", "dropped")])
