"""Benchmark decontamination by spaced-seed hashing, all in DataFrame functions.

Texts are words (runs of letters and digits, lower-cased), each as a 64-bit hash. A window is `WINDOW` words. Its
positions fall into four interleaved groups (position mod 4), and each of the six fixed masks looks at two groups and
ignores the other two. Up to two substituted words touch two groups at most, so one mask at least sees none of them:
no overlap within `MAX_SUBSTITUTIONS` is missed. Mask hashes of benchmark windows are joined with those of every window
of every document, and each hit is verified word by word. A benchmark item of fewer words than a window is sought as
the whole run of its words.

The benchmark's side is broadcast while it has at most `BROADCAST_ROWS` seeds (counted first); beyond, Spark joins by
shuffle. A document's windows are made and compared within its own row, so nothing is gathered by key before the join.

Defined results. Null or empty text or item: no words, no overlap. Null ids pass through. Repeated rows: each pair of
ids is returned once, with the most equal words of all its overlaps; `decontaminated` tells rows that share an id (or have none) apart by their text. Empty tables: no rows. Extra columns: not looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bucket, cut

WINDOW, MAX_SUBSTITUTIONS = 12, 2
#: The position groups that each mask looks at; it ignores the two others.
MASKS = tuple(combinations(range(4), 2))
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(df: DataFrame, words: str, window: int) -> DataFrame:
    """A row for each window of each row: its position `at` and its words, in place of all words of the row."""
    df = df.where(F.size(words) >= window).withColumn("at", F.explode(F.sequence(F.lit(0), F.size(words) - window)))
    return df.withColumn(words, F.slice(words, F.col("at") + 1, window))


def _seeds(df: DataFrame, words: str, window: int) -> DataFrame:
    """A row for each window and mask, with the hash of the positions that the mask looks at."""
    groups = [F.xxhash64(*[F.col(words)[k] for k in range(group, window, 4)]) for group in range(4)]
    df = df.select("*", *[h.alias(f"g{i}") for i, h in enumerate(groups)])
    masks = F.array(*[F.xxhash64(F.lit(m), F.col(f"g{i}"), F.col(f"g{j}")) for m, (i, j) in enumerate(MASKS)])
    return df.withColumn("seed", F.explode(masks)).drop("g0", "g1", "g2", "g3")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_substitutions: int = MAX_SUBSTITUTIONS,
) -> DataFrame:
    """(id, item, n_equal, n_windows): pairs that overlap, the most equal words of a window and the number of positions of the document where a window overlaps."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].alias("item"), word_hashes(benchmark[item_text_col]).alias("item_words"))
    texts = docs.select(docs[id_col].alias("id"), word_hashes(docs[text_col]).alias("words"))
    by_length = {n: c for n, c in items.select(F.least(F.size("item_words"), F.lit(window)).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("c")).collect()}
    n_seeds = items.agg(F.sum(F.greatest(F.size("item_words") - window + 1, F.lit(1)))).first()[0] or 0

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_seeds * len(MASKS) <= BROADCAST_ROWS else df

    found = []
    if by_length.pop(window, 0):
        sought = _seeds(_windows(items, "item_words", window), "item_words", window).select("item", F.col("item_words").alias("sought"), "seed")
        hits = _seeds(_windows(texts, "words", window), "words", window).join(small(sought.distinct()), "seed")
        equal = sum((F.when(F.col("words")[k] == F.col("sought")[k], 1).otherwise(0) for k in range(window)), F.lit(0))
        found.append(hits.select("id", "item", "at", equal.alias("n_equal")).where(F.col("n_equal") >= window - max_substitutions))
    if by_length:  # fewer than `window` lengths: each position gives a hash for each of them, in one pass
        whole = items.where(F.size("item_words").between(1, window - 1)).select("item", F.xxhash64("item_words").alias("seed"), F.col("item_words").alias("sought"))
        there = texts.where(F.size("words") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
        there = there.withColumn("words", F.slice("words", F.col("at") + 1, max(by_length)))
        runs = F.array(*[F.when(F.size("words") >= n, F.slice("words", 1, n)) for n in sorted(by_length)])
        there = there.select("id", "at", F.explode(runs).alias("run")).where("run is not null").withColumn("seed", F.xxhash64("run"))
        hits = there.join(small(whole.distinct()), "seed").where(F.col("run") == F.col("sought"))
        found.append(hits.select("id", "item", "at", F.size("run").alias("n_equal")))
    if not found:
        return spark.createDataFrame([], texts.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias(item_col), F.lit(0).alias("n_equal"), F.lit(0).cast("bigint").alias("n_windows")).schema)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    positions = every.groupBy("id", "item", "at").agg(F.max("n_equal").alias("n_equal"))
    return positions.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.max("n_equal").alias("n_equal"), F.count("*").alias("n_windows"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns. Rows are told apart by id and text: one that leaks takes no other with it."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(text).alias("mark"), F.octet_length(text).alias("size")).alias("row"), text.alias("text"))
    leaked = overlaps(rows, benchmark, "row", "text").select(F.col("row.id").alias("__leaked"), F.col("row.mark").alias("__mark"), F.col("row.size").alias("__size")).distinct()
    leaked = cut(leaked)
    some, clean = by_bucket(docs, [docs[id_col], F.xxhash64(text)], leaked, ["__leaked", "__mark"])
    same = docs[id_col].eqNullSafe(leaked["__leaked"]) & (F.xxhash64(text) == leaked["__mark"]) & (F.octet_length(text) == leaked["__size"])
    return clean.unionByName(some.join(leaked, same, "left_anti"))
