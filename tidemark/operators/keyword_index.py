"""A keyword index: postings by term, kept by the writes, so that a keyword query reads the postings of its own terms and no text.

An index is three tables. `postings` (bucket, term, id, len, at) has a row for each record and term, with the record's number of tokens and the term's
positions; it is stored by `bucket` of the term and sorted by term, so that a query prunes folders and row groups. `lengths` (id, len) has every record,
those without tokens too. `totals` (n, total) has a row for each change: the numbers of records and tokens that it added or took away.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import B, K1, phrases, tokens

BUCKETS = 32
#: Bytes of an Arrow batch of records' tokens.
BATCH_BYTES = 1 << 22


def record_words(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, words): the tokens of each record, with a null between columns; Arrow batches of them are bounded by bytes."""
    lists = [tokens(F.col(c)) for c in columns]
    gap = F.array(F.lit(None).cast("string"))
    words = F.concat(lists[0], *[x for more in lists[1:] for x in (gap, more)])
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    return docs.select("id", words.alias("words"))


def placed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, code, terms) of the tokens of records as they lie: which record, where in it, and which of `terms`."""
    sizes = np.asarray(words.value_lengths().fill_null(0))
    flat = words.flatten()
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = np.asarray(flat.is_valid())  # a gap between columns is null
    coded = flat.dictionary_encode()
    return row[good], place[good], np.asarray(coded.indices.fill_null(0))[good], coded.dictionary


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def record_postings(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(bucket, term, id, len, at), as `Index.of` has them: a record's tokens are grouped where it lies, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, code, terms = placed(batch.column("words"))
            if not len(code):
                continue
            length = np.bincount(row, minlength=batch.num_rows)
            order = np.argsort(row * len(terms) + code, kind="stable")  # places rise within a record as they lie
            code, row, place = code[order], row[order], place[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
            at = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(place, pa.int32()))
            held = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[first])), batch.column("id").take(held), pa.array(length[row[first]]), at], ["term", "id", "len", "at"])

    found = record_words(docs, columns).mapInArrow(run, f"term string, id {docs.schema['id'].dataType.simpleString()}, len bigint, at array<int>")
    return found.withColumn("bucket", bucket_of(F.col("term")))


def totals_of(lengths: DataFrame) -> DataFrame:
    """(n, total): the numbers of records and of tokens."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, columns: tuple[str, ...] = ("content",)) -> Index:
        """The index of records (id and columns). Positions of a further column begin two on, so that no phrase crosses columns."""
        lists = docs.select("id", *[tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(columns)])
        size = sum((F.size(f"t{k}") for k in range(len(columns))), F.lit(0)).cast("bigint")
        postings = record_postings(docs, columns).select("bucket", "term", "id", "len", "at")
        lengths = lists.select("id", size.alias("len"))
        return cls(postings, lengths, totals_of(lengths))

    def added(self, docs: DataFrame, columns: tuple[str, ...] = ("content",)) -> Index:
        """With further records: only these are read."""
        new = Index.of(docs, columns)
        return Index(self.postings.unionByName(new.postings), self.lengths.unionByName(new.lengths), self.totals.unionByName(new.totals))

    def removed(self, ids: DataFrame) -> Index:
        """Without records (id)."""
        gone = self.lengths.join(ids.select("id").distinct(), "id", "left_semi")
        less = gone.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("total"))
        without = [t.join(ids.select("id"), "id", "left_anti").select(t.columns) for t in (self.postings, self.lengths)]
        return Index(*without, self.totals.unionByName(less))

    def updated(self, docs: DataFrame, columns: tuple[str, ...] = ("content",)) -> Index:
        """With records in place of those of the same ids."""
        return self.removed(docs.select("id")).added(docs, columns)

    def save(self, folder: str) -> None:
        """Write the index to a folder that does not exist. Buckets are dealt over several tasks, as a common term may have a posting for a third of all records."""
        dealt = self.postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "id")
        dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
        self.lengths.write.parquet(f"{folder}/lengths")
        # Of the lengths as they were written, or all texts would be read and cut into tokens again.
        totals_of(self.lengths.sparkSession.read.parquet(f"{folder}/lengths")).coalesce(1).write.parquet(f"{folder}/totals")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "lengths", "totals")))

    def bm25(self, query: str) -> DataFrame:
        """(id, score) of the records that have any phrase of the query, as `ranking.bm25` scores them."""
        wanted = phrases(query)
        if not wanted:
            return self.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
        terms = sorted({t for p in wanted for t in p})
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        own = self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        places = [F.max(F.when(F.col("term") == t, F.col("at"))).alias(f"at{k}") for k, t in enumerate(terms)]
        rows = own.groupBy("id").agg(F.max("len").cast("double").alias("len"), *places)

        def occurrences(phrase: list[str]) -> Column:
            """Places where the phrase ends: those of its last word that follow one of what comes before."""
            ends = F.col(f"at{terms.index(phrase[0])}")
            for word in phrase[1:]:
                ends = F.array_intersect(F.transform(ends, lambda p: p + 1), F.col(f"at{terms.index(word)}"))
            return F.when(ends.isNotNull(), F.size(ends)).otherwise(0).cast("double")

        rows = rows.select("id", "len", *[occurrences(p).alias(f"tf{k}") for k, p in enumerate(wanted)])
        n, total = self.totals.agg(F.sum("n"), F.sum("total")).first()
        if not n:
            return rows.select("id", F.lit(0.0).alias("score")).limit(0)
        df = rows.agg(*[F.count_if(F.col(f"tf{k}") > 0) for k in range(len(wanted))]).first()
        score, hit = F.lit(0.0), F.lit(False)
        for k, held in enumerate(df):
            idf = float(np.log((n - held + 0.5) / (held + 0.5)))
            tf = F.col(f"tf{k}")
            score = score + F.lit(max(idf, 1e-6)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / (total / n or 1.0)))
            hit = hit | (tf > 0)
        return rows.where(hit).select("id", score.alias("score"))
