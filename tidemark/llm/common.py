"""What the operators of this subpackage share: bounded Arrow batches, checkpoints and byte-level hashing in numpy."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of numpy works on; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Bytes of an Arrow batch, where rows are shorter.
BATCH_BYTES = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold at most `BATCH_BYTES`, so that long texts fit in a Python worker. A session that has a smaller bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. A session on one machine gets one of its own if it names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system that was made here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df by way of a reliable checkpoint in the shared folder: computed once, safe against lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint. The shuffles it took are no longer needed, but lie on disk until the driver collects its garbage."""
    df = cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, text): the columns in use, under names of our own. mark tells rows apart that share an id but not a text; a null text is empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("mark"), "text")


#: Buckets of keys. Which of them hold a key that is sought is a bounded number, so it can be broadcast at any size of the tables.
BUCKETS = 1 << 20


def bucket(*key):
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS))


def by_bucket(rows: DataFrame, key: list, sought: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be one of sought's (columns `names`), and those whose key is surely not. The second ones need no shuffle."""
    name = "__bucket"
    while name in rows.columns:
        name += "_"
    buckets = F.broadcast(cut(sought.select(bucket(*names).alias(name)).distinct()))
    dealt = rows.withColumn(name, bucket(*key))
    return dealt.join(buckets, name, "left_semi").drop(name), dealt.join(buckets, name, "left_anti").drop(name)


def one_of_each(docs: DataFrame, key: list, every: DataFrame) -> DataFrame:
    """The rows of docs whose key is kept, one row of each key. every: (k0, k1, .., n, kept), each key of docs, the number of its rows, and whether it is kept.

    Rows that are kept for sure, as no key of their bucket is dropped or repeats, stay where they are; only others are shuffled.
    """
    doubtful = settled(every.where("not kept or n > 1"))
    names = [f"k{i}" for i in range(len(key))]
    some, sure = by_bucket(docs, key, doubtful, names)

    def met(how: str, keys: DataFrame) -> DataFrame:
        same = F.lit(True)
        for i, column in enumerate(key):
            same = same & column.eqNullSafe(keys[f"k{i}"])
        return some.join(keys, same, how)

    once = met("left_anti", doubtful)
    # Only rows that repeat are grouped; they are combined where they lie.
    often = met("left_semi", doubtful.where("kept")).groupBy(*[column.alias(f"__k{i}") for i, column in enumerate(key)])
    return sure.unionByName(once).unionByName(often.agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all the strings on end, and where each begins (one more than strings)."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (flat[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (flat[:0], np.zeros(1, np.int64))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts have about limit bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


_rng = np.random.default_rng(20240229)
#: A random word for each byte value, and odd factors: the constants of every hash here.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit sways every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hash(values: np.ndarray, levels: int) -> np.ndarray:
    """Hashes of every run of 2**levels values (uint64), by doubling."""
    h, width = values, 1
    for level in range(levels):
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * ODD[level] + h[width:]
        width *= 2
    return mixed(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width values."""
    if len(values) < width:
        return values[:0]
    least, size = values, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size : width - size + len(values) - width + 1])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every run of width values is; of equal ones, the leftmost."""
    if len(values) < width:
        return np.zeros(0, np.int32)
    least, size = np.arange(len(values), dtype=np.int32), 1

    def lesser(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[left] <= values[right], left, right)

    while size * 2 <= width:
        least = lesser(least[:-size], least[size:])
        size *= 2
    n = len(values) - width + 1
    return lesser(least[:n], least[width - size : width - size + n])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than white space) of texts on end: first bytes, ends, and the text that each is of. No word crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1 : len(data)]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1 : len(data)]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def span_hash(data: np.ndarray, first: np.ndarray, end: np.ndarray, base: int = 40, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; with fold, of the bytes with A-Z lower-cased. base picks one of several hashes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    factor, inverse = ODD[base], np.uint64(pow(int(ODD[base]), -1, 1 << 64))
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data] if fold else data] * _powers(factor, n), out=sums[1:])
    return mixed((sums[end] - sums[first]) * _powers(inverse, n)[first] + (end - first).astype(np.uint64) * ODD[base + 1])


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _kept_powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES)
        have = np.ones(size, np.uint64)
        have[1:] = base
        np.cumprod(have, out=have)
        _kept_powers[int(base)] = have
    return have[:n]


def remainder(column, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def sampled(rows: DataFrame, by: str, per_class: int, key: str = "id") -> tuple[DataFrame, dict]:
    """About per_class rows of each value of `by`, by a hash of the key (the same rows each time), and how many rows each value has. Values are few: languages, yes and no."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    u = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    return rows.where(u < share), counts
