"""Export and import of a project as JSON lines, and the codecs of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lookup, scope, writes
from tidemark.tables import SCHEMAS, FormatError, Store

VERSION, READABLE = "1.2", ("1.0", "1.1", "1.2")


def _encode(vectors: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors.to_pylist()], pa.binary())


def _decode(blobs: pa.Array) -> pa.Array:
    return pa.array([None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist() for b in blobs.to_pylist()], pa.list_(pa.float32()))


def encoded(vector):
    """Base64 of the little-endian 32-bit floats."""
    return F.base64(F.arrow_udf(_encode, "binary")(vector))


def decoded(text):
    """The vector of a base64 text. One whose length does not fit is an error of the job that reads it."""
    raw = F.unbase64(text)
    whole = F.when(F.octet_length(raw) % 4 == 0, raw).when(raw.isNotNull(), F.raise_error(F.lit("a vector's bytes are no whole floats")))
    return F.arrow_udf(_decode, "array<float>")(whole)


def section_blob(sections: DataFrame, dim: int) -> DataFrame:
    """(memory_id, keys, blob) from (memory_id, section, vector): keys joined by commas, vectors one after another. A vector that is not of dim numbers is an error of the job that writes it."""
    rows = sections.groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("section", "vector"))).alias("s"))
    flat = F.arrow_udf(_encode, "binary")(F.flatten(F.transform("s", lambda x: x["vector"])))
    rows = rows.select("memory_id", F.array_join(F.transform("s", lambda x: x["section"]), ",").alias("keys"), flat.alias("blob"), F.forall("s", lambda x: F.size(x["vector"]) == dim).alias("fits"))
    return rows.select("memory_id", "keys", F.when(F.col("fits"), F.col("blob")).otherwise(F.raise_error(F.lit("a section's vector has another length"))).alias("blob"))


def sections_of_blob(rows: DataFrame, dim: int) -> DataFrame:
    """(memory_id, section, vector) from (memory_id, keys, blob). A blob whose length does not fit its keys is an error."""
    if not rows.where(F.octet_length("blob") != 4 * dim * F.size(F.split("keys", ","))).isEmpty():
        raise FormatError("a section blob does not fit its keys")
    flat = rows.select("memory_id", F.split("keys", ",").alias("keys"), F.arrow_udf(_decode, "array<float>")("blob").alias("v"))
    return flat.select("memory_id", F.posexplode("keys").alias("pos", "section"), "v").select("memory_id", "section", F.slice("v", F.col("pos") * dim + 1, F.lit(dim)).alias("vector"))


def export(store: Store, project: str, folder: str, now: int, model_version: str | None = None) -> None:
    """A project as JSON lines: one file set each for the head, memories (vectors and side tables nested) and relationships. Status and todo states are not exported."""
    spark = store.memories.sparkSession
    own = store.memories.where(scope.in_project(project))
    vectors = store.embeddings.select(F.col("memory_id").alias("id"), encoded(F.col("vector")).alias("embedding"))
    side = lambda t, name: t.select(F.col("memory_id").alias("id"), F.struct(*[c for c in t.columns if c not in ("memory_id", "sections")]).alias(name))
    rows = own.join(vectors, "id", "left").join(side(store.handoffs, "handoff"), "id", "left").join(side(store.adrs, "adr"), "id", "left")
    edges = store.relationships.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    head = spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(project).alias("project_id"), F.lit(now).alias("exported_at"), F.lit(model_version).cast("string").alias("model_version"))
    for name, df in (("head", head), ("memories", rows), ("relationships", edges)):
        df.write.mode("errorifexists").json(f"{folder}/{name}")


def imported(store: Store, folder: str, project: str, now: int, mode: str = "merge", embed: Callable | None = None) -> Store:
    """The store with an export read in; records that come without a vector get one by `embed`, if it is given.

    `replace` wipes the project first, anything else keeps records whose ids exist. Decision records whose number is taken are left out whole; edges need both ends."""
    spark: SparkSession = store.memories.sparkSession
    version = spark.read.schema("version string").json(f"{folder}/head").first()
    if version is None or version[0] not in READABLE:
        raise FormatError(f"cannot read version {version and version[0]!r}")
    if mode == "replace":
        store = writes.trashed(store, store.memories.where(scope.in_project(project)).select("id"), "replace", now)
    handoff, adr = (", ".join(f.strip() for f in _fields(SCHEMAS[n]) if not f.strip().startswith(("memory_id", "sections"))) for n in ("handoffs", "adrs"))
    fields = lambda ddl: ", ".join(f"{f.split()[0]}:{' '.join(f.split()[1:])}" for f in _fields(ddl))
    rows = spark.read.schema(f"{SCHEMAS['memories']}, embedding string, handoff struct<{fields(handoff)}>, adr struct<{fields(adr)}>").json(f"{folder}/memories")
    taken = store.adrs.where(F.col("project_id") == project).select(F.col("adr_number").alias("number"))
    rows = rows.join(store.memories.select("id"), "id", "left_anti").join(taken, F.col("adr.adr_number") == F.col("number"), "left_anti")
    rows = rows.withColumn("project_id", F.lit(project)).withColumn("updated_at", F.lit(now).cast("bigint"))
    memories = store.memories.unionByName(rows.select(store.memories.columns))
    vectors = rows.where("embedding is not null").select(F.col("id").alias("memory_id"), decoded(F.col("embedding")).alias("vector"), F.lit(None).cast("string").alias("model_version"))
    if embed is not None:
        fresh = lookup.embedded(rows.where("embedding is null"), embed)
        vectors = vectors.unionByName(fresh.select(F.col("id").alias("memory_id"), "vector", F.lit(None).cast("string").alias("model_version")))
    handoffs = rows.where("handoff is not null").select(F.col("id").alias("memory_id"), "handoff.*").withColumn("sections", F.lit(None).cast(store.handoffs.schema["sections"].dataType))
    adrs = rows.where("adr is not null").select(F.col("id").alias("memory_id"), "adr.*").withColumn("project_id", F.lit(project))
    edges = spark.read.schema(SCHEMAS["relationships"]).json(f"{folder}/relationships")
    return store.with_(
        memories=memories, embeddings=store.embeddings.unionByName(vectors), handoffs=store.handoffs.unionByName(handoffs.select(store.handoffs.columns)),
        adrs=store.adrs.unionByName(adrs.select(store.adrs.columns)), relationships=writes.linked(store.relationships, edges, memories),
    )


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a schema text."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:k])
            at = k + 1
    return [*out, ddl[at:]]
