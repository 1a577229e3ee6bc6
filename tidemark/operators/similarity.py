"""Similarity joins: near pairs, duplicate groups, merges, clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import batch, maintained, ranking
from tidemark.session import kept

#: Rows of a tile that are multiplied at once, at most.
BLOCK_ROWS = 2048
#: Entries of a tile's vectors, about: 16,384 vectors of 64 dimensions.
TILE_ENTRIES = 1 << 20
#: Tiles that a group of more than one block is cut into at least, so that its products are shared out.
LEAST_TILES = 8
#: Entries of vectors that a task of the product is dealt, about.
TASK_ENTRIES = 1 << 23
#: Pairs of a batch that leaves a task, at most (or one row's).
PAIR_ROWS = 1 << 18


def near_pairs(rows: DataFrame, threshold: float, by: Sequence[str] = ("project_id", "memory_type"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b, of the pairs of rows (id, vector, by...) that agree in `by` and reach the threshold.

    The product of all vectors with all is cut into blocks: rows of a group are dealt into tiles, a row is copied once for each other tile of its group, and each two
    tiles meet. Their product is made block_rows by block_rows at most, and the pairs found leave in bounded batches, so that neither a large group nor many equal
    vectors fill a task.
    """
    # Vectors of unlike length are not alike, and a row without one is like none.
    rows, by = rows.where("vector is not null").withColumn("dim", F.size("vector")), (*by, "dim")
    tile_rows = F.greatest(F.lit(block_rows), F.floor(F.lit(TILE_ENTRIES) / F.greatest("dim", F.lit(1))))
    blocks = F.ceil(F.col("n") / block_rows)
    sizes = kept(rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("tiles", F.greatest(F.ceil(F.col("n") / tile_rows), F.least(F.lit(LEAST_TILES), blocks)).cast("int")))
    groups, met, entries = sizes.agg(F.count("*"), F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2), F.sum(F.col("n") * F.col("tiles") * F.col("dim"))).first()
    few = F.broadcast if groups <= batch.TRAVELLING else (lambda table: table)
    dealt = rows.join(few(sizes.select(*by, "tiles")), list(by)).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    every = every.select("id", "vector", *by, "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    # Dealt anew by the tiles that meet: rows that were dealt by their groups for the join would otherwise all stay in their group's task.
    tasks = max(-(-int(entries or 0) // TASK_ENTRIES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = every.repartition(max(1, min(int(met or 0), tasks)), *by, "i", "j")
    id_type = rows.schema["id"].dataType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        tile, ids = np.asarray(table.column("tile")), table.column("id").combine_chunks()
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        v = np.asarray(table.column("vector").combine_chunks().flatten().cast(pa.float64()).fill_null(0)).reshape(table.num_rows, -1)
        norm = np.sqrt((v * v).sum(1))
        v = v / np.where(norm > 0, norm, 1)[:, None]
        right = v[b]
        for start in range(0, len(a), block_rows):
            own = a[start : start + block_rows]
            for begin in range(0, len(b), block_rows):
                other = b[begin : begin + block_rows]
                product = v[own] @ right[begin : begin + block_rows].T
                step = max(1, PAIR_ROWS // len(other))
                for k in range(0, len(own), step):
                    x, y = np.nonzero(product[k : k + step] >= threshold - 1e-12)
                    near, x, y = product[k : k + step][x, y], own[k : k + step][x], other[y]
                    once = rank[x] < rank[y] if i == j else np.ones(len(x), bool)
                    near, x, y = near[once], x[once], y[once]
                    if len(x):
                        least = rank[x] < rank[y]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(least, x, y))), ids.take(pa.array(np.where(least, y, x))), pa.array(near)], ["id_a", "id_b", "cosine"])

    return every.groupBy(*by, "i", "j").applyInArrow(multiply, f"id_a {id_type}, id_b {id_type}, cosine double")


def not_deliberate(pairs: DataFrame, relationships: DataFrame) -> DataFrame:
    """Pairs that no derived_from or supersedes edge joins, in either direction."""
    meant = relationships.where(F.col("relation_type").isin("derived_from", "supersedes")).select(F.least("source_id", "target_id").alias("id_a"), F.greatest("source_id", "target_id").alias("id_b"))
    return pairs.join(meant, ["id_a", "id_b"], "left_anti")


def leader_groups(pairs: DataFrame) -> DataFrame:
    """(id, leader): greedy groups. In the order of ids, a record that is in no group yet leads one, of its near pairs that are in none.

    The leaders are the first maximal independent set in the order of ids. They are found in rounds: a record whose smaller neighbours have all joined others leads;
    whoever has a leader among its smaller neighbours, and is not waiting for a smaller one, joins the smallest.
    """
    edges = kept(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    undecided = kept(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct())
    leaders = joined = None
    open_edges = edges  # those of two records that are undecided: the rounds read no others
    while not undecided.isEmpty():
        new = kept(undecided.join(open_edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        leaders = new if leaders is None else leaders.unionByName(new)
        led = kept(open_edges.join(new.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        joined = led if joined is None else joined.unionByName(led)
        undecided = kept(undecided.join(new.unionByName(led), "id", "left_anti"))
        for end in ("a", "b"):
            open_edges = open_edges.join(undecided.withColumnRenamed("id", end), end, "left_semi")
        open_edges = kept(open_edges)
    if leaders is None:
        return pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("leader")).limit(0)
    out = edges.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").join(joined.withColumnRenamed("id", "b"), "b", "left_semi")
    return out.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")).unionByName(leaders.select("id", F.col("id").alias("leader")))


def keepers(groups: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, keeper): of each group, the record that was updated last stays."""
    rows = groups.join(memories.select("id", "updated_at"), "id")
    # Combined where the rows lie, so that a large group is no task's own.
    order = F.struct(F.col("updated_at").isNull().alias("never"), (-F.col("updated_at")).alias("age"), "id")
    newest = rows.groupBy("leader").agg(F.min_by("id", order).alias("keeper"))
    return rows.select("id", "leader").join(newest, "leader").select("id", "keeper")


def merged(memories: DataFrame, pairs: DataFrame, now: int) -> DataFrame:
    """Survivors of pairs (id consumed, keeper): tags united, largest importance, what was consumed noted, updated now."""
    gone = memories.join(pairs.where("id != keeper"), "id")
    note = F.struct(F.col("id").cast("string").alias("id"), F.substring("content", 1, 100).alias("content_preview"), "content", F.lit(now).cast("bigint").alias("merged_at"))
    per = gone.groupBy(F.col("keeper").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "tags", note.alias("note")))).alias("parts"), F.max("importance").alias("top"))
    return memories.join(per, "id").select(
        "id",
        F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.flatten(F.transform("parts", lambda p: F.coalesce(p["tags"], F.array().cast("array<string>")))))).alias("tags"),
        F.greatest("importance", "top").alias("importance"),
        F.transform("parts", lambda p: p["note"]).alias("merged_from"),
        F.lit(now).cast("bigint").alias("updated_at"),
    )


def centroids(members: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(cluster_id, centroid, member_count): means of the members' vectors; members without one do not count in the mean."""
    spread = members.join(embeddings, "id").select("cluster_id", F.posexplode("vector").alias("pos", "v"))
    means = spread.groupBy("cluster_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    per = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"))
    return members.groupBy("cluster_id").agg(F.count("*").alias("member_count")).join(per, "cluster_id", "left")


def nearest_cluster(rows: DataFrame, clusters: DataFrame, least: float = 0.75) -> DataFrame:
    """(id, cluster_id, cosine): the best cluster of each row that is near enough, the first of equals. rows: (id, project_id, vector); clusters: (cluster_id, project_id, centroid)."""
    met = rows.join(clusters, "project_id").select("id", "cluster_id", ranking.cosine("vector", "centroid").alias("cosine")).where(F.col("cosine") >= least)
    return met.groupBy("id").agg(F.max_by(F.struct("cluster_id", "cosine"), F.struct("cosine", -F.col("cluster_id").cast("bigint"))).alias("r")).select("id", "r.*")


def online_clusters(rows: DataFrame, least: float = 0.75) -> DataFrame:
    """(id, cluster): leader clustering in the order of creation, project by project: a row joins the nearest centroid that is near enough, or begins a cluster.

    It is sequential by definition; a task holds a project's centroids and counts, and reads its rows as a sorted stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, sums, counts = None, np.zeros((0, 0)), np.zeros(0)
        for batch in batches:
            out = []
            for own, v in zip(batch["project_id"], batch["vector"], strict=True):
                v = np.asarray(v, np.float64)
                if own != project:
                    project, sums, counts = own, np.zeros((0, len(v))), np.zeros(0)
                best = -1
                if len(sums):
                    mean = sums / counts[:, None]
                    near = mean @ v / np.maximum(np.linalg.norm(mean, axis=1) * np.linalg.norm(v), 1e-300)
                    best = int(near.argmax()) if near.max() >= least else -1
                if best < 0:
                    sums, counts, best = np.vstack([sums, v]), np.append(counts, 1.0), len(counts)
                else:
                    sums[best] += v
                    counts[best] += 1
                out.append(best)
            yield pd.DataFrame({"id": batch["id"], "project_id": batch["project_id"], "cluster": out})

    ordered = rows.repartition("project_id").sortWithinPartitions("project_id", "created_at", "id").select("id", "project_id", "vector")
    return ordered.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, project_id {rows.schema['project_id'].dataType.simpleString()}, cluster int")


def sliced_clusters(rows: DataFrame, least: float = 0.75, slice_seconds: int = 30 * 86400) -> DataFrame:
    """(id, project_id, cluster_id): leader clustering by slices of time, in which no task holds a project. A cluster bears the id of the record that began it.

    The contract: the records of a slice are compared with the centroids as they stood when it began; one joins the nearest that is near enough (of equals, the
    smallest id). The others form greedy groups in the order of their ids, and each group begins a cluster. Then the centroids take in the slice's members, from kept
    sums alone. rows: (id, project_id, vector, created_at). There is a round for each slice that has records; those without a vector are in no cluster.
    """
    rows = rows.where("vector is not null").withColumn("slice", F.floor(F.coalesce("created_at", F.lit(0)) / slice_seconds))
    members = sums = None
    for (turn,) in rows.select("slice").distinct().orderBy("slice").collect():  # slices of the store's life
        new = kept(rows.where(F.col("slice") == turn).select("id", "project_id", "vector"))
        rest, joined = new, None
        if sums is not None:
            means = maintained.centroids(sums).select(F.col("cluster_id.id").alias("id"), F.col("cluster_id.project_id").alias("project_id"), F.col("centroid").alias("vector"))
            found = batch.nearest(new.withColumnRenamed("id", "query_id"), means, 1, by=("project_id",), least=least)
            joined = kept(found.select(F.col("query_id").alias("id"), F.col("id").alias("cluster_id")))
            rest = new.join(joined, "id", "left_anti")
        groups = leader_groups(near_pairs(rest, least, by=("project_id",)))
        begun = rest.select("id").join(groups, "id", "left").select("id", F.coalesce("leader", "id").alias("cluster_id"))
        placed = kept(new.join(begun if joined is None else begun.unionByName(joined), "id"))
        change = maintained.vector_sums(placed.select(F.struct(F.col("cluster_id").alias("id"), "project_id").alias("cluster_id"), "vector"))
        sums = kept(change if sums is None else maintained.with_change(sums, change))
        placed = placed.select("id", "project_id", "cluster_id")
        members = placed if members is None else members.unionByName(placed)
    return members if members is not None else rows.select("id", "project_id", F.col("id").alias("cluster_id"))


def near_centroids(clusters: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, leader): clusters of a project that fold into one, greedily by id."""
    return leader_groups(near_pairs(clusters.select(F.col("cluster_id").alias("id"), "project_id", F.col("centroid").alias("vector")), threshold, by=("project_id",)))


def strays(members: DataFrame, embeddings: DataFrame, means: DataFrame, below: float = 0.5) -> DataFrame:
    """(id, cluster_id) of the members that have drifted away from their centroid."""
    rows = members.join(embeddings, "id").join(means, "cluster_id")
    return rows.where(ranking.cosine("vector", "centroid") < below).select("id", "cluster_id")


def reclustered(members: DataFrame, embeddings: DataFrame, projects: DataFrame, fold: float = 0.8, stay: float = 0.5, join: float = 0.75) -> DataFrame:
    """(cluster_id, id) after upkeep: near clusters fold, strays move to the nearest cluster that is near enough or leave. projects: (id, project_id)."""
    own = members.join(projects, "id").select("cluster_id", "project_id").distinct()
    means = centroids(members, embeddings).join(own, "cluster_id")
    into = near_centroids(means.where("centroid is not null"), fold).select(F.col("id").alias("cluster_id"), "leader")
    members = kept(members.join(into, "cluster_id", "left").select(F.coalesce("leader", "cluster_id").alias("cluster_id"), "id"))
    means = centroids(members, embeddings).join(own, "cluster_id")
    away = kept(strays(members, embeddings, means, stay))
    moved = nearest_cluster(away.select("id").join(embeddings, "id").join(projects, "id"), means.select("cluster_id", "project_id", "centroid"), join)
    return members.join(away, ["id", "cluster_id"], "left_anti").select("cluster_id", "id").unionByName(moved.select("cluster_id", "id"))
