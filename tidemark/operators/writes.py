"""Writes: functions from tables to new tables. A snapshot of them is saved by `Store.save`."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.tables import SCHEMAS, Store


def upserted(table: DataFrame, rows: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """The table with rows in place of those of the same key; of several new rows of one key, one."""
    return table.join(rows.select(*key), list(key), "left_anti").select(table.columns).unionByName(rows.select(table.columns).dropDuplicates(list(key)))


def stored(memories: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """New records: times set, and no branch for global ones."""
    rows = rows.withColumn("branch", F.when(F.col("global"), None).otherwise(F.col("branch")))
    for c in ("created_at", "updated_at", "last_accessed_at"):
        rows = rows.withColumn(c, F.lit(now).cast("bigint"))
    return memories.unionByName(rows.select(memories.columns))


def reinforced(memories: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """Access counters after uses (id): a record that is used twice counts twice."""
    times = used.groupBy("id").agg(F.count("*").alias("times"))
    n = F.coalesce("times", F.lit(0))
    rows = memories.join(times, "id", "left")
    rows = rows.withColumn("access_count", F.col("access_count") + n).withColumn("relevance_score", F.when(n > 0, F.least(F.lit(1.0), F.col("relevance_score") + 0.1 * n)).otherwise(F.col("relevance_score")))
    return rows.withColumn("last_accessed_at", F.when(n > 0, F.lit(now).cast("bigint")).otherwise(F.col("last_accessed_at"))).select(memories.columns)


def changed(memories: DataFrame, which: Column, **values: Column) -> DataFrame:
    """Records for which `which` holds get new values: pinning, promotion (branch null), edits."""
    for name, value in values.items():
        memories = memories.withColumn(name, F.when(which, value).otherwise(F.col(name)))
    return memories


def changed_times(memories: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Records (id) marked as updated now."""
    rows = memories.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return rows.withColumn("updated_at", F.when(F.col("__hit"), F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))).select(memories.columns)


def updated(memories: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """Edits (id, content, summary, tags, importance, external_artifacts): null keeps what there is; an empty list of artifacts clears them."""
    names = ("content", "summary", "tags", "importance", "external_artifacts")
    new = edits.select("id", *[F.col(c).alias(f"new_{c}") for c in names if c in edits.columns], F.lit(True).alias("edited"))
    rows = memories.join(new, "id", "left")
    for c in names:
        if c in edits.columns:
            value = F.coalesce(f"new_{c}", c)
            rows = rows.withColumn(c, F.when(F.size(value) == 0, None).otherwise(value) if c == "external_artifacts" else value)
    return rows.withColumn("updated_at", F.when(F.col("edited"), F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))).select(memories.columns)


def with_project(store: Store, project: str, now: int, name: str | None = None, root_path: str | None = None, decay_rate: float = 0.01) -> Store:
    """The store with a project, if it did not have it; one that is there stays as it is."""
    if not store.projects.where(F.col("id") == project).isEmpty():
        return store
    row = store.projects.sparkSession.createDataFrame([(project, name or project, root_path or project, decay_rate, now)], store.projects.schema)
    return store.with_(projects=store.projects.unionByName(row))


def edges(spark: SparkSession, named: Sequence[tuple[str, str, str]], now: int) -> DataFrame:
    """Rows of relationships, of full strength, for edges (source, target, type) that a caller names."""
    return spark.createDataFrame([(f"rel_{uuid.uuid4().hex}", a, b, kind, 1.0, now) for a, b, kind in named], SCHEMAS["relationships"])


def linked(relationships: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges between records that exist, strength from 0 to 1, one for each source, target and type."""
    ids = memories.select("id")
    good = edges.withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "strength")))
    for side in ("source_id", "target_id"):
        good = good.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return upserted(relationships, good, ("source_id", "target_id", "relation_type"))


def snapshots(store: Store, ids: DataFrame, op: str, now: int) -> DataFrame:
    """Trash entries of records (id) as they are now, with their edges and vectors; ids that are not in the store give none."""
    gone = store.memories.join(ids, "id", "left_semi")
    ends = store.relationships.select(
        F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), F.struct(*store.relationships.columns).alias("edge")
    )
    edges = ends.join(ids, "id", "left_semi").groupBy("id").agg(F.to_json(F.sort_array(F.collect_list("edge"))).alias("relationships"))
    last = store.trash.agg(F.coalesce(F.max("trash_id"), F.lit(0)).alias("m")).first()["m"]
    number = F.xxhash64("id", F.lit(now)).bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(last + 1)
    rows = gone.select("id", "project_id", F.to_json(F.struct(*store.memories.columns)).alias("memory"))
    rows = rows.join(edges, "id", "left").join(store.embeddings.withColumnRenamed("memory_id", "id"), "id", "left")
    rows = rows.withColumns({"trash_id": number, "op": F.lit(op), "trashed_at": F.lit(now).cast("bigint")})
    return rows.withColumnRenamed("id", "memory_id").select(store.trash.columns)


def trashed(store: Store, ids: DataFrame, op: str, now: int) -> Store:
    """Records (id) moved to the trash, with their edges and vectors as they were; clusters that are left empty go."""
    return removed(store, ids).with_(trash=store.trash.unionByName(snapshots(store, ids, op, now)))


def edited(store: Store, edits: DataFrame, now: int) -> Store:
    """The store after `updated`; what a record was before its content was replaced lies in the trash."""
    old = edits.where("content is not null").select("id") if "content" in edits.columns else edits.select("id").limit(0)
    return store.with_(memories=updated(store.memories, edits, now), trash=store.trash.unionByName(snapshots(store, old, "update", now)))


def removed(store: Store, ids: DataFrame) -> Store:
    """The store without records (id) and all that hangs on them."""
    by = {"embeddings": "memory_id", "handoffs": "memory_id", "adrs": "memory_id", "status": "memory_id", "todos": "memory_id", "cluster_members": "memory_id", "memories": "id"}
    out = {name: (t := getattr(store, name)).join(ids.select(F.col("id").alias(key)), key, "left_anti").select(t.columns) for name, key in by.items()}
    edges = store.relationships
    for side in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("id").alias(side)), side, "left_anti")
    out["relationships"] = edges.select(store.relationships.columns)
    sizes = out["cluster_members"].groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").cast("int").alias("size"))
    out["clusters"] = store.clusters.join(sizes, "id").withColumn("member_count", F.col("size")).select(store.clusters.columns)
    return store.with_(**out)


def trash_listing(trash: DataFrame, project: str, limit: int = 20) -> DataFrame:
    return trash.where((F.col("project_id") == project) & F.col("memory").isNotNull()).orderBy(F.desc("trashed_at"), F.desc("trash_id")).limit(limit)


def latest_trash(trash: DataFrame) -> DataFrame:
    """The last entry of each record."""
    return trash.groupBy("memory_id").agg(F.max_by(F.struct(*trash.columns), F.struct("trashed_at", "trash_id")).alias("r")).select("r.*")


def swept(trash: DataFrame, now: int, days: int = 30) -> DataFrame:
    """The trash without what is older; no days keep all."""
    return trash if days <= 0 else trash.where(F.col("trashed_at") >= now - days * 86400)


def restored(store: Store, ids: DataFrame) -> Store:
    """Records (id) back from their last trash entries, with vectors and those edges whose other end is alive. Side tables, status and clusters are not restored."""
    entries = latest_trash(store.trash).join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    back = entries.select(F.from_json("memory", store.memories.schema).alias("m")).select("m.*")
    memories = upserted(store.memories, back)
    vectors = entries.where("vector is not null").select("memory_id", "vector", "model_version")
    edges = entries.select(F.explode(F.from_json("relationships", f"array<{store.relationships.schema.simpleString()}>")).alias("e")).select("e.*").dropDuplicates(["id"])
    relationships = linked(store.relationships, edges, memories)
    return store.with_(memories=memories, embeddings=upserted(store.embeddings, vectors, ("memory_id",)), relationships=relationships, trash=store.trash.join(entries.select("memory_id", "trash_id"), ["memory_id", "trash_id"], "left_anti").select(store.trash.columns))


def restore(store: Store, ids: DataFrame, now: int) -> tuple[Store, DataFrame]:
    """The store after `restored`, and (memory_id, op, overwrote, edges_restored, edges_dropped) of each record that came back. A record that was alive goes to the trash as it was."""
    entries = latest_trash(store.trash).join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    alive = store.memories.join(entries.select(F.col("memory_id").alias("id")), "id", "left_semi").select("id")
    back = restored(store, ids)
    edge = F.explode(F.from_json("relationships", f"array<{store.relationships.schema.simpleString()}>"))
    ends = entries.select("memory_id", edge.alias("e")).select("memory_id", F.when(F.col("e.source_id") == F.col("memory_id"), F.col("e.target_id")).otherwise(F.col("e.source_id")).alias("id"))
    there = back.memories.select("id", F.lit(True).alias("there"))
    counts = ends.join(there, "id", "left").groupBy("memory_id").agg(F.count("there").alias("edges_restored"), F.count_if(F.col("there").isNull()).alias("edges_dropped"))
    told = entries.select("memory_id", "op").join(alive.select(F.col("id").alias("memory_id"), F.lit(True).alias("overwrote")), "memory_id", "left").join(counts, "memory_id", "left")
    told = told.select("memory_id", "op", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("overwrote", False), ("edges_restored", 0), ("edges_dropped", 0))])
    return back.with_(trash=back.trash.unionByName(snapshots(store, alive, "update", now))), told


def with_state(status: DataFrame, ids: DataFrame, dead: bool, reason: str | None, now: int) -> DataFrame:
    """Records (id) marked dead, or no longer."""
    rows = ids.select(F.col("id").alias("memory_id"), F.lit(True).alias("dead"), F.lit(reason).cast("string").alias("reason"), F.lit(now).cast("bigint").alias("marked_at"))
    return upserted(status, rows, ("memory_id",)) if dead else status.join(rows.select("memory_id"), "memory_id", "left_anti").select(status.columns)


def numbered_adrs(adrs: DataFrame, new: DataFrame) -> DataFrame:
    """New decision records (memory_id, project_id, created_at, ...) with the next numbers of their projects."""
    last = adrs.groupBy("project_id").agg(F.max("adr_number").alias("last"))
    turn = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "memory_id"))
    rows = new.join(last, "project_id", "left").withColumn("adr_number", (F.coalesce("last", F.lit(0)) + turn).cast("int"))
    return rows.drop("last")


def adr_moves(adrs: DataFrame, asked: DataFrame, transitions: dict[str, tuple[str, ...]]) -> DataFrame:
    """(memory_id, status, to, allowed): requests (memory_id, to) held against the transitions; `superseded` is only reached by a successor."""
    pairs = [F.concat(F.lit(a), F.lit(">"), F.lit(b)) for a, to in transitions.items() for b in (a, *to) if b != "superseded"]
    moved = asked.join(adrs.select("memory_id", "status"), "memory_id", "left")
    return moved.select("memory_id", "status", "to", F.coalesce(F.concat("status", F.lit(">"), "to").isin(*pairs), F.lit(False)).alias("allowed"))


def todo_state(todos: DataFrame, ops: DataFrame) -> DataFrame:
    """(memory_id, status, reason, closed_at) after operations (memory_id, turn, op, reason, at), in the order of turn: the last done, drop or reopen of each item decides. A drop without a reason is refused."""
    status = F.expr("CASE op WHEN 'done' THEN 'done' WHEN 'drop' THEN 'dropped' WHEN 'reopen' THEN 'open' END")
    good = ops.withColumn("status", status).where("status is not null and not (op = 'drop' and coalesce(reason, '') = '')")
    last = good.groupBy("memory_id").agg(F.max_by(F.struct("status", F.when(F.col("status") == "dropped", F.col("reason")).alias("reason"), F.when(F.col("status") != "open", F.col("at")).alias("closed_at")), "turn").alias("r"))
    rows = todos.join(last, "memory_id", "left")
    pick = lambda c: F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("memory_id", pick("status"), pick("reason"), pick("closed_at"))
