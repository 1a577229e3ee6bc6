"""Lookups by key, edges, health, and what makes records of other things: vectors for tests, turn pairs, hashed embeddings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import first_sentence, words
from tidemark.operators import ranking, similarity, stats
from tidemark.operators.scope import in_project


def by_id(table: DataFrame, key, column: str = "id") -> DataFrame:
    """The row of one key: a filter that reaches the scan. No row for a null or unknown key."""
    return table.where(F.col(column) == F.lit(key))


def by_ids(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows of a set of keys (id); a key asked twice gives its row once, an unknown one none."""
    return table.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def edges_of(relationships: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, direction, other, relation_type, edge) of the edges that leave or enter records (id). An edge from a record to itself counts for both directions."""
    sides = {"outgoing": ("source_id", "target_id"), "incoming": ("target_id", "source_id")}
    out = None
    for name, (own, other) in sides.items():
        if direction in (name, "both"):
            rows = relationships.select(F.col(own).alias("id"), F.lit(name).alias("direction"), F.col(other).alias("other"), "relation_type", F.col("id").alias("edge"))
            out = rows if out is None else out.unionByName(rows)
    return out.join(ids.select("id"), "id", "left_semi")


def adr_by_number(adrs: DataFrame, project: str, number: int) -> DataFrame:
    """The decision record of a project's number, with its sections."""
    return adrs.where((F.col("project_id") == project) & (F.col("adr_number") == number))


def health(memories: DataFrame, members: DataFrame, project: str, now: int) -> DataFrame:
    """(metric, value): records of a project never accessed and faded, and pairs of one cluster and type that may repeat each other."""
    own = stats.insights(memories, project, now)
    mine = members.join(memories.where(in_project(project)).select("id"), "id", "left_semi")
    named = own.select(F.explode(F.create_map(*[x for c in ("total", "never_accessed", "faded", "both") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    return named.unionByName(stats.duplicate_pair_count(mine, memories).select(F.lit("duplicate_pairs").alias("metric"), F.col("pairs").alias("value")))


def keyword_shares(hits: DataFrame) -> DataFrame:
    """(id, share): keyword scores over the best one of those returned, so from 0 to 1."""
    best = hits.agg(F.max("score")).first()[0]
    return hits.select("id", (F.col("score") / F.lit(best)).alias("share"))


def synthetic_vector(seed: Column, dim: int = 256) -> Column:
    """A vector of length 1 that a seed gives: seed x cos(i + 1) + sin(i / 10) at place i."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: seed.cast("double") * F.cos(i + F.lit(1.0)) + F.sin(F.lit(0.1) * i))
    return ranking.scaled(raw)


def turn_records(pairs: DataFrame, project: str, session: str = "conv_id") -> DataFrame:
    """Records of turn pairs (session, turn, content), stored without deduplication: facts that bear the tag of their session."""
    name = F.col(session).cast("string")
    return pairs.select(F.concat_ws("-", F.lit("turn"), name, F.col("turn").cast("string")).alias("id"), F.lit(project).alias("project_id"), F.lit("fact").alias("memory_type"), "content", F.array(F.concat(F.lit("session:"), name)).alias("tags"))


def hashed(texts: Sequence[str | None], dim: int = 256) -> np.ndarray:
    """Vectors of texts without a model: each word adds 1 or -1 at a place that its hash gives; length 1, or zero without words. The same on every machine."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            out[row, h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def embedded(memories: DataFrame, embed: Callable[[Sequence[str]], np.ndarray] = hashed) -> DataFrame:
    """(id, vector) of records, by any embedder of texts (an Arrow batch at a time). It is told what a text is by a prefix, as for `query_vector`."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        v = np.asarray(embed(texts.to_pylist()), np.float32)
        return pa.array(list(v), pa.list_(pa.float32()))

    prefix = F.concat(F.lit("search_document: "), F.coalesce("memory_type", F.lit("fact")), F.lit(": "))
    return memories.select("id", vectors(F.concat(prefix, F.coalesce("content", F.lit("")))).alias("vector"))


def query_vector(text: str, embed: Callable[[Sequence[str]], np.ndarray] = hashed) -> list[float]:
    return [float(x) for x in embed([f"search_query: {text}"])[0]]


def cluster_keywords(members: DataFrame, memories: DataFrame, n: int = 3) -> DataFrame:
    """(cluster_id, words): the most frequent keywords of all members of a cluster, the smaller of equals first. Counts are combined where the texts lie."""
    spread = members.join(memories.select("id", "content"), "id").select("cluster_id", F.explode(words(F.col("content"))).alias("word"))
    counts = spread.groupBy("cluster_id", "word").agg(F.count("*").alias("n"))
    # The best n of each of some parts of a cluster first, so that no task holds all words of a large one.
    part = F.pmod(F.xxhash64("word"), F.lit(64))
    order = F.struct((-F.col("n")).alias("less"), "word")
    best = counts.groupBy("cluster_id", part.alias("part")).agg(F.slice(F.sort_array(F.collect_list(order)), 1, n).alias("best"))
    best = best.groupBy("cluster_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, n).alias("best"))
    return best.select("cluster_id", F.transform("best", lambda x: x["word"]).alias("words"))


def cluster_summaries(members: DataFrame, memories: DataFrame) -> DataFrame:
    """(cluster_id, summary): the first sentence of the member of the largest importance (of equals, the smallest id), and three keywords of all members."""
    rows = members.join(memories.select("id", "content", "importance"), "id")
    top = rows.groupBy("cluster_id").agg(F.min_by("content", F.struct((-F.col("importance")).alias("less"), "id")).alias("content"))
    found = top.join(cluster_keywords(members, memories), "cluster_id", "left")
    note = F.when(F.size("words") > 0, F.concat(F.lit(" ["), F.concat_ws(", ", "words"), F.lit("]"))).otherwise("")
    return found.select("cluster_id", F.concat(first_sentence(F.coalesce("content", F.lit(""))), note).alias("summary"))


def cluster_duplicates(members: DataFrame, memories: DataFrame, embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """(id, keeper): records of one cluster and type that repeat each other, in groups of a leader (the smallest id in no group yet); a global record of a group is kept before its leader. Handoffs are left alone."""
    rows = members.join(memories.where("memory_type != 'handoff'").select("id", "memory_type", "global"), "id").join(embeddings.select("id", "vector"), "id")
    groups = similarity.leader_groups(similarity.near_pairs(rows, least, by=("cluster_id", "memory_type")))
    groups = groups.join(memories.select("id", "global"), "id")
    keeper = groups.groupBy("leader").agg(F.min_by("id", F.struct(~F.col("global"), F.col("id") != F.col("leader"), "id")).alias("keeper"))
    return groups.join(keeper, "leader").select("id", "keeper")


def reclustered_and_deduplicated(members: DataFrame, memories: DataFrame, embeddings: DataFrame, least: float = 0.9, **limits: float) -> tuple[DataFrame, DataFrame]:
    """The six-hourly job: members (cluster_id, id) after upkeep of the clusters, then the records to merge in them (id, keeper)."""
    members = similarity.kept(similarity.reclustered(members, embeddings, memories.select("id", "project_id"), **limits))
    return members, cluster_duplicates(members, memories, embeddings, least)
