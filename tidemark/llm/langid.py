"""Language identification by string kernels.

A text is the set of its byte n-grams of `ORDERS` (blended spectrum, presence only), lower-cased and hashed to `DIM`
places. The kernel of two texts is the number of places that both have over the root of the product of their numbers.
A Nystrom map over landmark texts turns the kernel into features, and one-versus-rest ridge regression on them gives
each language a weight for each landmark; texts are scored in batches by two matrix products.

The model is fitted on the driver on a bounded sample of labelled rows: at most about `TRAIN_ROWS` rows in all, of
which `LANDMARKS` are landmarks, each as `DIM` bits. Scoring covers whole texts, on Spark tasks of bounded batches.

Defined results. Null or empty text, or one without a letter: `und`, score 0. No labelled row: every text is `und`.
Null labels: not learned from. Null ids, repeated rows: each row is scored on its own. Empty table: no rows. Extra
columns: left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ODD, bounded_batches, pieces, remainder, sampled

ORDERS, DIM = (1, 2, 3, 4), 1 << 15
TRAIN_ROWS, LANDMARKS, RIDGE = 1600, 192, 1e-2
ROWS_AT_ONCE = 128


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by places: 1 where a text has an n-gram that is hashed to the place."""
    n_rows = len(offsets) - 1
    out = np.zeros((n_rows, DIM), np.uint8)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n_rows, dtype=np.int64), np.diff(offsets))
    code = data.astype(np.uint64)
    for order in ORDERS:
        if order > 1:
            code = code[:-1] * np.uint64(256) + data[order - 1 :] if len(code) else code
        own = row[: len(code)] == row[order - 1 :][: len(code)]
        place = (code * ODD[order]) >> np.uint64(64 - 15)
        flat[(row[: len(code)] * DIM + place.astype(np.int64))[own]] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # m x DIM bits, packed
    weights: np.ndarray  # m x languages
    bias: np.ndarray

    def scores(self, bits: np.ndarray, marks: np.ndarray, mark_norm: np.ndarray) -> np.ndarray:
        x = bits.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(1), 1))
        return (x @ marks.T / norm[:, None] / mark_norm[None]) @ self.weights + self.bias


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """A model from (id, text, lang), on a sample of at most about train_rows rows."""
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull())
    langs = [r[0] for r in labelled.select("lang").distinct().collect()]
    if not langs:
        return None
    rows, counts = sampled(labelled, "lang", max(2, train_rows // len(langs)))
    langs = sorted(counts)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(_lowered(batches)):
            packed = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_pydict({"id": rows.column("id").cast(pa.string()), "lang": rows.column("lang"), "bits": pa.array([b.tobytes() for b in packed], pa.binary())})

    got = sorted(rows.select("id", "lang", "text").mapInArrow(bits, "id string, lang string, bits binary").collect(), key=lambda r: (r[1], str(r[0])))
    x = np.unpackbits(np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    of = np.array([langs.index(r[1]) for r in got])
    quota = max(1, landmarks // len(langs))
    chosen = np.concatenate([np.flatnonzero(of == k)[:quota] for k in range(len(langs))])
    k_mm, k_nm = x[chosen] @ x[chosen].T, x @ x[chosen].T
    values, vectors = np.linalg.eigh(k_mm.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_nm @ root
    mean = phi.mean(0)
    y = np.where(of[:, None] == np.arange(len(langs))[None], 1.0, -1.0)
    # Each language weighs the same, however many of its rows are in the sample.
    weight = (1 / np.bincount(of, minlength=len(langs)))[of][:, None]
    weight *= len(got) / weight.sum()
    centred = phi - mean
    w = np.linalg.solve(centred.T @ (centred * weight) + RIDGE * len(got) * np.eye(phi.shape[1]) / 10, centred.T @ (weight * (y - y.mean(0))))
    packed = np.packbits((x[chosen] > 0).astype(np.uint8), axis=1)
    return Model(langs, packed, (root @ w).astype(np.float32), (y.mean(0) - mean @ w).astype(np.float32))


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pc.utf8_lower(batch.column(at).cast(pa.large_string())))


def predicted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is not None:
            marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
            mark_norm = np.sqrt(np.maximum(marks.sum(1), 1))
            names = np.array(model.langs, object)
        for rows, data, offsets in pieces(_lowered(batches)):
            n = rows.num_rows
            letter = pc.fill_null(pc.match_substring_regex(rows.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score = np.full(n, "und", object), np.zeros(n)
            for at in range(0, n if model is not None else 0, ROWS_AT_ONCE):
                part = slice(at, min(n, at + ROWS_AT_ONCE))
                own = offsets[part.start : part.stop + 1]
                f = model.scores(presence(data[own[0] : own[-1]], own - own[0]), marks, mark_norm)
                best = f.argmax(1)
                lang[part] = np.where(letter[part], names[best], "und")
                score[part] = np.where(letter[part], np.clip((f.max(1).astype(float) + 1) / 2, 0, 1), 0)
            yield pa.RecordBatch.from_pydict({"id": rows.column("id"), "lang_pred": pa.array(list(lang), pa.string()), "score": pa.array(score)})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learned from the labelled rows that are not held out (crc32 of the id modulo 3 is not 1)."""
    known = docs.where(remainder(docs[id_col], 3) != 1).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].alias("lang"))
    out = predicted(docs, fit(known), id_col, text_col)
    return out.select(id_col, F.coalesce(remainder(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
