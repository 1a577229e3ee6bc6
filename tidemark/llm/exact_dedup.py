"""Exact deduplication by a tree-merge of sorted digest runs, all in DataFrame functions.

Every partition's digests form a run: sorted, with one entry for each text, which holds the smallest id and the number of
rows. In each round, blocks of `fan_in` neighbouring runs exchange their entries by digest range, and each range of a block is merged into one
sorted run: entries of one text (same SHA-256, length and 64-bit check value, so that a digest alone never decides) become one with the smallest id.
There are as many rounds as it takes to be left with one block, ceil(log(partitions) / log(fan_in)); at the end there is one run for each digest range.
A text that makes up a third of all rows enters the rounds once for each partition, as it has been combined where it lies.

Defined results. Null text: empty. Null id: it never stays if another copy has an id; if none has, keep_id is null and
`kept` marks all those rows. Rows repeated in whole: all count in group_size, and `kept` marks each with the smallest id.
Of the rows that `kept` marks for one text, `exact_dedup` returns one.
Empty table: no rows. Extra columns: `exact_groups` leaves them out, `exact_dedup` returns them untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, one_of_each, settled

#: Runs that a round merges into one, and the equal ranges of digests by which a block's runs are dealt out.
FAN_IN, RANGES = 8, 256
_ENTRY = ["digest", "size", "mark"]


def normalised(text):
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, size, mark) of every row: SHA-256 of the normalised text, its length and a second hash."""
    rows = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("text"))
    return rows.select("id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("mark"))


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, size, mark, keep_id, group_size): one entry a text, by rounds of merges of sorted runs."""
    least = (F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    one = F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.spark_partition_id().alias("block")
    runs = cut(rows.select(*_ENTRY, *one).groupBy("block", *_ENTRY).agg(*least))
    blocks = (runs.agg(F.max("block")).first()[0] or 0) + 1
    # Digests are even over their values, so ranges of equal width hold about as many.
    runs = runs.withColumn("range", F.floor(F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") * RANGES / 65536).cast("int"))
    while True:
        blocks = -(-blocks // fan_in)
        runs = runs.withColumn("block", F.floor(F.col("block") / fan_in).cast("int"))
        runs = runs.repartition("block", "range").sortWithinPartitions("block", "range", *_ENTRY, "keep_id")
        runs = runs.groupBy("block", "range", *_ENTRY).agg(*least)  # over sorted entries of one place: no further exchange
        if blocks == 1:
            return runs.select(*_ENTRY, "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digests(docs, id_col, text_col))
    # Checkpointed, so that the join has an exchange on both sides and Spark can split a text with very many rows.
    merged = settled(merge_runs(rows, fan_in))
    return rows.join(merged, _ENTRY).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns."""
    groups = exact_groups(docs, id_col, text_col)
    # Null ids: a row without an id is kept only where no copy has one.
    every = groups.groupBy(F.col(id_col).alias("k0"), F.col("text_sha256").alias("k1")).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    return one_of_each(docs, [docs[id_col], F.sha2(normalised(docs[text_col]), 256)], every)
