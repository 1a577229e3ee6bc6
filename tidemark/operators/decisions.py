"""Decision records: created, moved through their states, shown, and written as Markdown files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lookup, records, writes
from tidemark.tables import ADR_TRANSITIONS, NotFound, Store, StoreError


def created(store: Store, adr: DataFrame, vector: Sequence[float], now: int, supersedes: int | None = None, importance: float = 0.9, pinned: bool = True) -> tuple[Store, dict]:
    """The store with a decision record (one row: memory_id, project_id, status, title, context, decision, consequences) under its project's next number.

    With `supersedes`, the record of that number turns superseded and an edge leads to it; if it is that already, it stays as it is. A number that is not there, or a
    record that may not turn superseded, is refused before anything is written.
    """
    spark, row = adr.sparkSession, adr.select("memory_id", "project_id").first()
    adrs, relationships, old = store.adrs, store.relationships, None
    if supersedes is not None:
        old = lookup.adr_by_number(adrs, row["project_id"], supersedes).select("memory_id", "status").first()
        if old is None:
            raise NotFound(f"ADR-{supersedes:04d} not found")
        if old["status"] != "superseded" and "superseded" not in ADR_TRANSITIONS[old["status"]]:
            raise StoreError(f"invalid ADR status transition: {old['status']} -> superseded")
    new = adr.withColumns({"created_at": F.lit(now).cast("bigint"), "updated_at": F.lit(now).cast("bigint")})
    numbered = writes.numbered_adrs(adrs, new.withColumn("status", F.coalesce("status", F.lit("proposed")))).select(adrs.columns)
    text = F.concat_ws("\n", "title", "context", "decision", "consequences")
    values = {"id": F.col("memory_id"), "project_id": F.col("project_id"), "memory_type": F.lit("adr"), "content": text, "summary": F.col("title"), "tags": F.array().cast("array<string>")}
    values |= {"importance": F.lit(min(1.0, max(0.0, importance))), "relevance_score": F.lit(1.0), "access_count": F.lit(0), "pinned": F.lit(pinned), "global": F.lit(False)}
    record = new.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in store.memories.schema.fields])
    memories = writes.stored(store.memories, record, now)
    number = numbered.select("adr_number").first()[0]
    if old is not None and old["status"] != "superseded":
        adrs = records.superseded_adr(adrs, supersedes, row["project_id"])
        adrs = adrs.withColumn("updated_at", F.when(F.col("memory_id") == old["memory_id"], F.lit(now).cast("bigint")).otherwise(F.col("updated_at")))
        relationships = writes.linked(relationships, writes.edges(spark, [(row["memory_id"], old["memory_id"], "supersedes")], now), memories)
    own = spark.createDataFrame([(row["memory_id"], [float(x) for x in vector], None)], store.embeddings.schema)
    after = store.with_(memories=memories, embeddings=store.embeddings.unionByName(own), adrs=adrs.unionByName(numbered), relationships=relationships)
    return after, {"id": row["memory_id"], "adr_number": number, "superseded_id": old["memory_id"] if old else None}


def moved(store: Store, asked: DataFrame, now: int) -> Store:
    """The store after requests (memory_id, to) for new states; if one is not allowed, none is done."""
    judged = writes.adr_moves(store.adrs, asked, ADR_TRANSITIONS)
    bad = judged.where(~F.col("allowed")).first()
    if bad:
        raise StoreError(f"invalid ADR status transition: {bad['status']} -> {bad['to']}")
    rows = store.adrs.join(judged.groupBy("memory_id").agg(F.max("to").alias("to")), "memory_id", "left")
    rows = rows.withColumn("updated_at", F.when(F.col("to").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("updated_at")))
    return store.with_(adrs=rows.withColumn("status", F.coalesce("to", "status")).select(store.adrs.columns))


def shown(store: Store, project: str, number: int, now: int) -> tuple[Store, DataFrame]:
    """The decision record of a number; showing it counts as a use of it."""
    row = lookup.adr_by_number(store.adrs, project, number)
    if row.isEmpty():
        raise NotFound(f"ADR-{number:04d} not found")
    return store.with_(memories=writes.reinforced(store.memories, row.select(F.col("memory_id").alias("id")), now)), row


def written(adrs: DataFrame, folder: str, apply: bool = False) -> DataFrame:
    """(path, text) of the files that decision records become under a folder that all executors share; with apply, each task writes its own through the file system of the folder."""
    files = records.adr_markdown(adrs).withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path"))
    if apply:

        def write(batches):
            from pyarrow import fs

            # A path without a scheme is one of the local file system, which then has to be shared.
            system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            system.create_dir(root, recursive=True)
            for batch in batches:
                for path, text in zip(batch["path"], batch["text"], strict=True):
                    with system.open_output_stream(f"{root.rstrip('/')}/{path.rsplit('/', 1)[1]}") as out:
                        out.write(text.encode())
                yield batch[["path"]]

        files.mapInPandas(write, "path string").count()
    return files
