"""Storing with deduplication, batches, deletion and upkeep: compositions of the other operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import auto_summary, first_sentence
from tidemark.operators import clock, lookup, ranking, records, scope, similarity, writes
from tidemark.tables import MEMORY_TYPES, EmbeddingError, InvalidArguments, InvalidType, NotFound, Store

EXEMPT_TYPES = ("handoff", "todo", "adr")


def duplicates(memories: DataFrame, embeddings: DataFrame, vector: Sequence[float], project: str, memory_type: str, least: float = 0.9, exempt: Sequence = ()) -> DataFrame:
    """(id, score): records of the project and type that a new one repeats, the nearest first. Records that hold merged ones, and those that the caller exempts, are left alone."""
    pool = memories.where(scope.in_project(project) & (F.col("memory_type") == memory_type) & ~F.col("memory_type").isin(*EXEMPT_TYPES))
    if exempt:
        pool = pool.where(~F.col("id").isin(*exempt))
    if "merged_from" in memories.columns:
        pool = pool.where(F.coalesce(F.size("merged_from"), F.lit(0)) <= 0)
    rows = pool.join(embeddings, "id").select("id", ranking.cosine_to(vector)("vector").alias("score"))
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "id")


def remember(store: Store, row: DataFrame, vector: Sequence[float], now: int, least: float = 0.9, skip_above: float | None = None, exempt: Sequence = ()) -> tuple[Store, dict]:
    """The store with a new record (one row of memories), and what became of it: skipped, merged or stored.

    Of a new record and the one it repeats, an existing global one survives a new local one; else the new one does.
    """
    new = row.select("id", "project_id", "memory_type", "global").first()
    if new["memory_type"] not in MEMORY_TYPES:
        raise InvalidType(f"unknown type {new['memory_type']!r}")
    vectors = store.embeddings.select(F.col("memory_id").alias("id"), "vector")
    best = duplicates(store.memories, vectors, vector, new["project_id"], new["memory_type"], min(1.0, max(0.5, least)), exempt).first()
    if best is not None and skip_above is not None and best["score"] >= skip_above:
        return store, {"outcome": "skipped", "id": best["id"]}
    row = row.withColumn("summary", auto_summary())
    spark = row.sparkSession
    own = spark.createDataFrame([(new["id"], [float(x) for x in vector], None)], store.embeddings.schema)
    store = store.with_(memories=writes.stored(store.memories, row, now), embeddings=store.embeddings.unionByName(own))
    if best is None:
        return refreshed(store), {"outcome": "stored", "id": new["id"]}
    old_global = store.memories.where(F.col("id") == best["id"]).select("global").first()[0]
    keeper, gone = (best["id"], new["id"]) if old_global and not new["global"] else (new["id"], best["id"])
    return merge(store, spark.createDataFrame([(gone, keeper)], "id string, keeper string"), now), {"outcome": "merged", "id": keeper}


def remember_fully(store: Store, row: DataFrame, vector: Sequence[float], now: int, related_to: Sequence[str] = (), supersedes: Sequence[str] = (), least: float = 0.9) -> tuple[Store, dict]:
    """The store with a new record, its edges and its cluster; what became of it, and which records it may supersede if it names none.

    What the caller ties to the record is not merged with it. A handoff is stored as it is. Records that it is said to supersede
    have to exist, which is checked before anything is written.
    """
    new = row.select("id", "project_id", "memory_type", "content").first()
    known = {r["id"] for r in store.memories.where(F.col("id").isin(*supersedes)).select("id").collect()} if supersedes else set()
    if missing := set(supersedes) - known:
        raise NotFound(f"not found: {', '.join(sorted(missing))}")
    if new["memory_type"] == "handoff":
        own = row.sparkSession.createDataFrame([(new["id"], [float(x) for x in vector], None)], store.embeddings.schema)
        store, told = batch(store, row, own, now), {"outcome": "stored", "id": new["id"]}
    else:
        store, told = remember(store, row, vector, now, least, exempt=(*related_to, *supersedes))
    named = [(told["id"], to, kind) for kind, ids in (("relates_to", related_to), ("supersedes", supersedes)) for to in ids]
    if named:
        store = store.with_(relationships=writes.linked(store.relationships, writes.edges(row.sparkSession, named, now), store.memories))
    candidates = []
    if not supersedes:
        vectors = store.embeddings.select(F.col("memory_id").alias("id"), "vector")
        near = records.supersession_candidates(store.memories, vectors, vector, new["project_id"], new["memory_type"], (told["id"], new["id"]))
        candidates = [r.asDict() for r in near.collect()]  # five at most
    store, cluster = clustered(store, new["project_id"], told["id"], vector, new["content"], now)
    return store, told | {"possible_supersedes": candidates, "cluster": cluster}


def clustered(store: Store, project: str, memory_id: str, vector: Sequence[float], content: str, now: int, least: float = 0.75) -> tuple[Store, str]:
    """The record in the cluster of its project that is nearest, if it is near enough, with a new centroid and summary; else in a cluster of its own. Also the cluster's id."""
    own = store.clusters.where((F.col("project_id") == project) & F.col("centroid").isNotNull())
    best = own.select("id", ranking.cosine_to(vector)("centroid").alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").first()
    name = best["id"] if best else f"clust_{uuid.uuid4().hex}"
    spark = store.memories.sparkSession
    members = writes.upserted(store.cluster_members, spark.createDataFrame([(name, memory_id)], store.cluster_members.schema), ("cluster_id", "memory_id"))
    if best is None:
        row = spark.createDataFrame([(name, project, content, 1, [float(x) for x in vector], now, now)], store.clusters.schema)
        row = row.withColumn("summary", first_sentence(F.col("summary")))
        return store.with_(clusters=store.clusters.unionByName(row), cluster_members=members), name
    inside = members.where(F.col("cluster_id") == name).select("cluster_id", F.col("memory_id").alias("id"))
    mean = similarity.centroids(inside, store.embeddings.select(F.col("memory_id").alias("id"), "vector"))
    fresh = mean.join(lookup.cluster_summaries(inside, store.memories), "cluster_id", "left")
    fresh = fresh.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("mean"), F.col("member_count").cast("int").alias("size"), F.col("summary").alias("words"))
    rows = store.clusters.join(fresh, "id", "left")
    for c, value in (("centroid", "mean"), ("member_count", "size"), ("summary", "words")):
        rows = rows.withColumn(c, F.coalesce(value, c))
    rows = rows.withColumn("updated_at", F.when(F.col("id") == name, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")))
    return store.with_(clusters=rows.select(store.clusters.columns), cluster_members=members), name


def captured(store: Store, captures: DataFrame, vectors: DataFrame, now: int, least: float = 0.9, skip: float = 0.95) -> tuple[Store, DataFrame]:
    """Captures of hooks (rows of memories, with vectors) stored, and (id, outcome): skipped, merged or stored.

    In the order of creation, a capture is skipped if it is as near as `skip` to a record or a capture that is kept; of those that are left, groups as near as
    `least` merge, into a global record if they have one, else into the newest. A day has few captures of a project (the daily cap), so
    each record of their projects and types meets few of them.
    """
    if vectors.select("memory_id").join(captures.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").count() < captures.count():
        raise EmbeddingError("every capture needs a vector")
    new = captures.join(vectors.select(F.col("memory_id").alias("id"), "vector"), "id")
    new = new.select("id", "project_id", "memory_type", "vector", F.lit(1).alias("turn"), F.coalesce("created_at", F.lit(now)).alias("at"), "global")
    pool = store.memories.where(~F.col("memory_type").isin(*EXEMPT_TYPES) & (F.coalesce(F.size("merged_from"), F.lit(0)) <= 0))
    pool = pool.join(new.select("project_id", "memory_type").distinct(), ["project_id", "memory_type"], "left_semi")
    old = pool.join(store.embeddings.select(F.col("memory_id").alias("id"), "vector"), "id").select("id", "project_id", "memory_type", "vector", F.lit(0).alias("turn"), F.col("created_at").alias("at"), "global")
    # Names that sort as the records came.
    key = F.concat_ws(" ", F.col("turn").cast("string"), F.lpad(F.col("at").cast("string"), 20, "0"), "id")
    named = similarity.kept(old.unionByName(new).withColumn("key", key))
    right = named.where("turn = 1").select("project_id", "memory_type", F.col("key").alias("id_b"), F.col("vector").alias("other"))
    met = named.join(right, ["project_id", "memory_type"]).where("key < id_b")
    pairs = similarity.kept(met.select(F.col("key").alias("id_a"), "id_b", ranking.cosine("vector", "other").alias("cosine")).where(F.col("cosine") >= least))
    skipped = similarity.kept(similarity.leader_groups(pairs.where(F.col("cosine") >= skip)).where("id != leader and id like '1%'").select("id"))
    for side in ("id_a", "id_b"):
        pairs = pairs.join(skipped.select(F.col("id").alias(side)), side, "left_anti")
    groups = similarity.leader_groups(pairs.select("id_a", "id_b", "cosine")).join(named.select(F.col("key"), F.col("id").alias("record"), "global", "turn", "at"), F.col("id") == F.col("key"))
    keeper = groups.groupBy("leader").agg(F.min_by("record", F.struct(~F.col("global"), -F.col("turn"), -F.col("at"), "record")).alias("keeper"))
    merges = similarity.kept(groups.join(keeper, "leader").select(F.col("record").alias("id"), "keeper"))
    skipped = named.join(skipped.withColumnRenamed("id", "key"), "key", "left_semi").select("id")
    rows = captures.join(skipped, "id", "left_anti").select(captures.columns)
    own = vectors.join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    after = store.with_(
        memories=writes.stored(store.memories, rows.withColumn("summary", auto_summary()), now), embeddings=store.embeddings.unionByName(own.select(store.embeddings.columns))
    )
    told = captures.select("id").join(skipped.withColumn("skipped", F.lit(True)), "id", "left").join(merges.withColumn("merged", F.lit(True)).select("id", "merged"), "id", "left")
    told = told.select("id", F.when(F.col("skipped"), "skipped").when(F.col("merged"), "merged").otherwise("stored").alias("outcome"))
    return (refreshed(after) if merges.isEmpty() else merge(after, merges, now)), told


def merge(store: Store, pairs: DataFrame, now: int) -> Store:
    """Records (id) merged into their keepers and moved to the trash."""
    new = similarity.merged(store.memories, pairs, now)
    values = new.select("id", *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "id"])
    rows = store.memories.join(values, "id", "left")
    for c in ("tags", "importance", "updated_at"):
        rows = rows.withColumn(c, F.coalesce(f"new_{c}", c))
    rows = rows.withColumn("merged_from", F.when(F.col("new_merged_from").isNotNull(), F.concat(F.coalesce("merged_from", F.array().cast(rows.schema["merged_from"].dataType)), F.col("new_merged_from").cast(rows.schema["merged_from"].dataType))).otherwise(F.col("merged_from")))
    kept = store.with_(memories=rows.select(store.memories.columns))
    return refreshed(writes.trashed(kept, pairs.where("id != keeper").select("id"), "merge", now))


def batch(store: Store, rows: DataFrame, vectors: DataFrame, now: int, most: int = 100) -> Store:
    """Up to `most` records at once, without deduplication. vectors: (memory_id, vector, model_version)."""
    if rows.limit(most + 1).count() > most:
        raise InvalidArguments(f"more than {most} records in a batch")
    return refreshed(store.with_(memories=writes.stored(store.memories, rows.withColumn("summary", auto_summary()), now), embeddings=store.embeddings.unionByName(vectors)))


def dedup(store: Store, project: str, now: int, least: float = 0.9, apply: bool = False, deliberate: bool = True) -> tuple[Store, DataFrame]:
    """Near duplicates of a project grouped and, with apply, merged into the one updated last. deliberate: pairs that edges join on purpose are left alone (the command line does not)."""
    rows = store.memories.where(scope.in_project(project) & (F.col("memory_type") != "handoff")).select("id", "project_id", "memory_type").join(store.embeddings.select(F.col("memory_id").alias("id"), "vector"), "id")
    pairs = similarity.near_pairs(rows, min(1.0, max(0.5, least)))
    if deliberate:
        pairs = similarity.not_deliberate(pairs, store.relationships)
    groups = similarity.keepers(similarity.leader_groups(pairs), store.memories)
    return (merge(store, groups, now) if apply else store), groups


def delete(store: Store, ids: DataFrame, now: int) -> Store:
    return writes.trashed(store, ids, "delete", now)


def wipe(store: Store, project: str, now: int) -> Store:
    return writes.trashed(store, store.memories.where(scope.in_project(project)).select("id"), "wipe", now)


def refreshed(store: Store) -> Store:
    return store.with_(memories=clock.refreshed(store.memories, store.projects))


def maintenance(store: Store, now: int, trash_days: int = 30) -> Store:
    """The hourly job: decay, removal of what has faded, and the sweep of the trash."""
    store = refreshed(store)
    store = writes.trashed(store, scope.auto_prunable(store.memories, now).select("id"), "prune", now)
    return store.with_(trash=writes.swept(store.trash, now, trash_days))
