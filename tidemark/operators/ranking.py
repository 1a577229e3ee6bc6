"""Vector search, keyword search, and their fusion."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import kept

RRF_K = 60
K1, B = 1.2, 0.75


def cosine_to(query: Sequence[float]):
    """A column function: cosine of a vector column with the query, in Arrow batches; 0 for other lengths, nulls and zero vectors."""
    q = np.asarray(query, np.float64)
    q_norm = np.sqrt((q * q).sum())

    @F.arrow_udf("double")
    def cosine(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        lengths = np.asarray(vectors.value_lengths().fill_null(-1))
        fit = np.flatnonzero(lengths == len(q))
        if len(fit) and q_norm:
            flat = np.asarray(vectors.take(pa.array(fit)).flatten().cast(pa.float64()).fill_null(0)).reshape(len(fit), len(q))
            norms = np.sqrt((flat * flat).sum(1))
            out[fit] = np.where(norms > 0, flat @ q / np.where(norms > 0, norms, 1) / q_norm, 0)
        return pa.array(out)

    return cosine


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vector columns, in built-in functions; 0 for unlike lengths and zero vectors."""
    a, b = (F.transform(F.col(x) if isinstance(x, str) else x, lambda v: v.cast("double")) for x in (a, b))
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), zero, lambda s, x: s + x)) * F.sqrt(F.aggregate(F.transform(b, lambda x: x * x), zero, lambda s, x: s + x))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as SQL engines do it: times a power of ten, halves away from zero, and back. `F.round` goes by the decimal digits instead, where 0.3500005 is a half even if its double lies under it."""
    power = 10.0**digits
    return F.round((F.col(value) if isinstance(value, str) else value) * power) / power


def normalised(vector: Column, dim: int = 256) -> Column:
    """The first dim numbers of a vector, of length 1 if not all zero."""
    return scaled(F.slice(vector, 1, dim))


def scaled(vector: Column) -> Column:
    """A vector with its length made 1, if not all zero. Vector and norm are bound by a lambda each, so that a row computes them once and not for every place."""

    def by(norm: Column, own: Column) -> Column:
        return F.transform(own, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))

    def norm(own: Column) -> Column:
        return F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.transform(F.array(vector), lambda own: F.transform(F.array(norm(own)), lambda n: by(n, own))[0])[0]


def ranked(scores: DataFrame, score: str, name: str, partitions: int | None = None) -> DataFrame:
    """scores with a 0-based rank by score, then id. Each task numbers its range of scores; only the ranges' sizes reach the driver."""
    order = (F.desc(score), F.asc("id"))
    parts = partitions or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(scores.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    before, offsets = 0, [F.lit(0)]
    for part, n in sorted(dealt.groupBy("__range").count().collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    start = F.create_map(*offsets[1:])[F.col("__range")] if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, (own - 1 + start).cast("bigint")).drop("__range")


def phrases(query: str) -> list[list[str]]:
    """What a keyword query looks for: each word's letters and digits, `_` and `-` apart, as a phrase of tokens."""
    words = ("".join(c for c in w if c.isalnum() or c in "_-") for w in query.split())
    tokens = ([t for t in re.split(r"[_-]+", w.lower()) if t] for w in words)
    return [t for t in tokens if t]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: str, columns: Sequence[str] = ("content",)) -> DataFrame:
    """(id, score) of the records that have any phrase of the query; statistics are over all of docs (id and columns).

    Documents are not exploded: each counts its own occurrences, and only a few sums over all reach the driver.
    """
    wanted = phrases(query)
    if not wanted:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    lists = docs.select("id", *[tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(columns)])

    def occurrences(phrase: list[str]) -> Column:
        total = F.lit(0)
        for k in range(len(columns)):
            t = F.col(f"t{k}")
            if len(phrase) == 1:
                total = total + F.size(F.filter(t, lambda x: x == phrase[0]))
            else:
                hit = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - len(phrase) + 1, F.lit(1))), lambda i: F.slice(t, i, len(phrase)) == F.array(*[F.lit(p) for p in phrase]))
                total = total + F.when(F.size(t) >= len(phrase), F.size(hit)).otherwise(0)
        return total

    size = sum((F.size(f"t{k}") for k in range(len(columns))), F.lit(0))
    counted = lists.select("id", size.cast("double").alias("len"), *[occurrences(p).cast("double").alias(f"tf{k}") for k, p in enumerate(wanted)])
    n, mean, *df = counted.agg(F.count("*"), F.avg("len"), *[F.sum((F.col(f"tf{k}") > 0).cast("double")) for k in range(len(wanted))]).first()
    score = F.lit(0.0)
    for k in range(len(wanted)):
        held = float(df[k] or 0)
        idf = float(np.log((n - held + 0.5) / (held + 0.5))) if n else 0.0
        tf = F.col(f"tf{k}")
        score = score + F.lit(max(idf, 1e-6) if idf > 0 else 1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / (mean or 1.0)))
    hit = sum((F.col(f"tf{k}") for k in range(len(wanted))), F.lit(0.0)) > 0
    return counted.where(hit).select("id", score.alias("score"))


def fused(lists: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of lists (id, rank), ranks from 0."""
    every = lists[0].select("id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("id", "rank"))
    return every.groupBy("id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank") + 1)).alias("score"))


def query_words(query: str) -> list[str]:
    """Words of at least three bytes, lower-cased, without marks around them."""
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in query.lower().split() if len(w.encode()) >= 3)
    return [w for w in words if w]


def tag_boost(words: Sequence[str], tags: str = "tags") -> Column:
    """0.05 for each query word that is in a tag or has one in it, 0.15 at most."""
    hits = F.lit(0)
    for w in words:
        hits = hits + F.exists(tags, lambda t: F.lower(t).contains(w) | F.lit(w).contains(F.lower(t))).cast("int")
    return F.least(F.coalesce(hits, F.lit(0)) * 0.05, F.lit(0.15))
