"""Toxicity by a linear-chain conditional random field over words.

Each word is toxic or not. A word's features are itself and its first and last bytes (`AFFIXES`), lower-cased and hashed
to `TABLE` weights; two neighbouring tags have a weight for each pair. Forward-backward gives each word's marginal, and
a document's score is a logistic function of the marginals' sum, their odds against no toxic word, largest and density. Words whose marginal is at least
one half make up the offending spans.

Labels are of documents, so the training words are tagged first: a feature that occurs in toxic documents, more
often than chance would have it over all features seen, and in hardly any clean ones (`CLEAN_SHARE`), tags the words of toxic documents that have it.
So does one that clean documents have at times, but hardly ever more than once: it tags the words of toxic documents that have it more than once. The field and
the document's function are then fitted on the driver by gradient descent, on a bounded sample: about `TRAIN_ROWS`
labelled rows at most for each label, of about `TRAIN_WORDS` words together, half of them for each label. Where a label's rows have more, its longest
give a run of words at a place drawn by hash, all runs of one length; no row is left out for its length. The document's function sees the sampled rows whole, on Spark tasks. Scoring covers whole texts, on Spark tasks of bounded batches.

Defined results. Null or empty text: no words, the score that no evidence gives. No labelled row, or one label only:
score 0 everywhere. Null labels: not learned from; two labels for an id: both count. Null ids, repeated rows: each row is
scored on its own. Empty table: no rows. Extra columns: left out by `scored`, kept by `without_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ODD, bounded_batches, cut, mixed, pieces, remainder, sampled, span_hash, word_spans

TABLE = 1 << 18
#: First bytes (positive) and last bytes (negative) of a word that count as features, besides the word; 0 is the word.
AFFIXES = (0, 4, 5, 7, -4)
TRAIN_ROWS, TRAIN_WORDS = 1500, 1_600_000
THRESHOLD, CLEAN_SHARE = 0.3, 9
#: Rows of the sample that a feature must occur in to be held against chance, and to have a weight.
LEAST_SEEN = 5
_STEP = 512
#: Words that the driver works on at once when it fits: whole texts, this many about.
FIT_WORDS = 1 << 19
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?|\"'()[]*#"]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature places (features x words) of the words of texts on end, their first bytes, ends, and text. Marks around a word are not of it."""
    first, end, of = word_spans(data, offsets)
    for _ in range(3):
        end = end - ((end - first > 1) & _MARKS[data[end - 1]]) if len(end) else end
        first = first + ((end - first > 1) & _MARKS[data[first]]) if len(first) else first
    places = np.zeros((len(AFFIXES), len(first)), np.int32)
    for k, n in enumerate(AFFIXES):
        a = np.maximum(first, end + n) if n < 0 else first
        b = np.minimum(end, first + n) if n > 0 else end
        places[k] = ((span_hash(data, a, b) + ODD[50 + k]) >> np.uint64(46)).astype(np.int32)
    return places, first, end, of


def occurring(places: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, sign) of all signs that texts have, each once: a feature's place, and TABLE + place if it occurs more than once there."""
    once, n = np.unique(of.astype(np.int64) << 32 | places, return_counts=True)
    met = np.concatenate([once, once[n > 1] + TABLE])
    return met >> 32, met & 0xFFFFFFFF


def marginals(e: np.ndarray, fresh: np.ndarray, pair: np.ndarray, counts: bool = False):
    """Each word's probability to be toxic, given e (toxic less clean potential), where texts begin, and the weights of pairs of tags; with counts, also the expected number of each pair.

    The words are dealt to columns of `_STEP` that are worked on side by side: each column's product of steps first, then
    what enters each column, then the words.
    """
    n = len(e)
    if not n:
        return (e, np.zeros((2, 2))) if counts else e
    columns = -(-n // _STEP)
    w, new = np.ones(columns * _STEP), np.ones(columns * _STEP, bool)
    w[:n], new[:n] = np.exp(np.clip(e, -30, 30)), fresh
    w, new = w.reshape(columns, _STEP).T.copy(), new.reshape(columns, _STEP).T.copy()
    m = np.exp(pair)
    step = [[np.where(new, 1.0, m[i, j]) for j in range(2)] for i in range(2)]

    def forward(a0, a1, t):
        b0, b1 = a0 * step[0][0][t] + a1 * step[1][0][t], (a0 * step[0][1][t] + a1 * step[1][1][t]) * w[t]
        s = b0 + b1
        return b0 / s, b1 / s, s

    def backward(b0, b1, t):
        c1 = b1 * w[t]
        a0, a1 = step[0][0][t] * b0 + step[0][1][t] * c1, step[1][0][t] * b0 + step[1][1][t] * c1
        s = a0 + a1
        return a0 / s, a1 / s, s

    def entering(run, order, along):
        """What enters each column from the side that `order` begins with."""
        ends = []
        for x in ((1.0, 0.0), (0.0, 1.0)):
            a0, a1, size = np.full(columns, x[0]), np.full(columns, x[1]), np.zeros(columns)
            for t in order:
                a0, a1, s = run(a0, a1, t)
                size += np.log(s)
            ends.append((a0, a1, size))
        (p0, p1, ps), (q0, q1, qs) = ends
        ratio = np.exp(np.clip(qs - ps, -60, 60))
        out, v = np.zeros((2, columns)), (0.5, 0.5)
        for c in along:
            out[:, c] = v
            x, y = v[0], v[1] * ratio[c]
            v = (x * p0[c] + y * q0[c], x * p1[c] + y * q1[c])
            s = v[0] + v[1]
            v = (v[0] / s, v[1] / s)
        return out

    steps = range(_STEP)
    a = entering(forward, steps, range(columns))
    b = entering(backward, steps[::-1], range(columns)[::-1])
    alpha = np.zeros((2, _STEP, columns))
    x0, x1 = a
    for t in steps:
        x0, x1, _ = forward(x0, x1, t)
        alpha[0, t], alpha[1, t] = x0, x1
    p = np.zeros((_STEP, columns))
    expected = np.zeros((2, 2))
    real = (np.arange(columns)[None] * _STEP + np.arange(_STEP)[:, None] < n) & ~new
    y0, y1 = b
    for t in steps[::-1]:
        p[t] = alpha[1, t] * y1 / (alpha[0, t] * y0 + alpha[1, t] * y1)
        if counts:
            before = alpha[:, t - 1] if t else a
            joint = [[before[i] * step[i][j][t] * (w[t] * y1 if j else y0) for j in range(2)] for i in range(2)]
            total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
            for i in range(2):
                for j in range(2):
                    expected[i, j] += (joint[i][j] / total * real[t]).sum()
        y0, y1, _ = backward(y0, y1, t)
    p = p.T.reshape(-1)[:n]
    return (p, expected) if counts else p


def evidence(p: np.ndarray, of: np.ndarray, n_docs: int) -> np.ndarray:
    """What a document's function looks at: the marginals' sum (log), the odds that they leave to no toxic word (log), their largest and density."""
    total = np.bincount(of, weights=p, minlength=n_docs)
    top = np.zeros(n_docs)
    np.maximum.at(top, of, p)
    sure = np.bincount(of, weights=-np.log1p(-np.minimum(p, 1 - 1e-6)), minlength=n_docs)
    return np.stack([np.log1p(total), np.log1p(sure), top, np.sqrt(total / np.maximum(np.bincount(of, minlength=n_docs), 1))], 1)


@dataclass
class Model:
    table: np.ndarray
    bias: float
    pair: np.ndarray
    weights: np.ndarray

    def words(self, data: np.ndarray, offsets: np.ndarray):
        places, first, end, of = features(data, offsets)
        fresh = np.ones(len(of), bool)
        fresh[1:] = of[1:] != of[:-1]
        return marginals(self.table[places].sum(0) + self.bias, fresh, self.pair), first, end, of

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def _without_copies(got: list) -> list:
    """The sample with one of each group of near copies, whose words would else seem to tell by their number: a row goes if one of 16 bands of 6 minimum hashes is that of a row before it."""
    factors = ODD[np.arange(96) % 40] * (np.arange(96, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    met, kept = set(), []
    for label, f in got:
        words = np.unique(f[0]).astype(np.uint64) + np.uint64(1)
        if len(words):
            least = np.array([mixed(words * a).min() for a in factors]).reshape(16, 6)
            bands = {(k, b.tobytes()) for k, b in enumerate(least)}
            if bands & met:
                continue
            met |= bands
        kept.append((label, f))
    return kept


def _confirmed(docs: DataFrame, labels: DataFrame, telling: np.ndarray) -> np.ndarray:
    """The telling features of the sample, less those that over all labelled rows occur in a clean document for every `CLEAN_SHARE` toxic ones, or more often."""
    sought = docs.sparkSession.sparkContext.broadcast(telling)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            found, _, _, of = features(data, offsets)
            either = sought.value[:TABLE] | sought.value[TABLE:]
            hit = [np.flatnonzero(either[x]) for x in found]
            own, signs = occurring(np.concatenate([x[h] for x, h in zip(found, hit)]), np.concatenate([of[h] for h in hit]))
            told = sought.value[signs]
            yield pa.RecordBatch.from_pydict({"id": rows.column("id").take(pa.array(own[told])), "place": signs[told].astype(np.int32)})

    # Texts stay where they are: only ids and places of words that tell meet the labels.
    met = docs.mapInArrow(hits, f"id {docs.schema['id'].dataType.simpleString()}, place int").join(labels, "id")
    counts = met.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    kept = [r[0] for r in counts.where((F.col("n") - F.col("toxic")) * CLEAN_SHARE <= F.col("toxic")).select("place").collect()]  # at most 2 x TABLE
    out = np.zeros_like(telling)
    out[kept] = True
    return out


def _blocks(fresh: np.ndarray, most: int) -> list[slice]:
    """Runs of whole texts of about `most` words, or of one text if it has more. fresh: where texts begin."""
    begins = np.append(np.flatnonzero(fresh), len(fresh))
    out, first = [], 0
    while first < len(fresh):
        last = int(begins[max(np.searchsorted(begins, first, "right"), np.searchsorted(begins, first + most, "right") - 1)])
        out.append(slice(first, last))
        first = last
    return out


def _longest(sizes: list[tuple[int, int]], budget: int) -> int:
    """The largest number of words a row may give, so that all rows together give budget at most (one word each at least). sizes: (words, rows)."""
    rows = sum(n for _, n in sizes)
    for size, n in sorted(sizes):
        if size * rows > budget:
            return max(1, budget // rows)
        budget, rows = budget - size * n, rows - n
    return max([1, *(size for size, _ in sizes)])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS) -> Model | None:
    """A model from docs (id, text) and labels (id, toxic), on a bounded sample."""
    bounded_batches(docs.sparkSession)
    labels = labels.where(F.col("toxic").isin(0, 1)).select("id", F.col("toxic").cast("int").alias("toxic"))
    chosen, counts = sampled(labels, "toxic", train_rows)
    if len(counts) < 2:
        return None

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            of = word_spans(data, offsets)[2]
            yield pa.RecordBatch.from_pydict({"toxic": rows.column("toxic"), "size": pa.array(np.bincount(of, minlength=rows.num_rows), pa.int64())})

    # About 2 x train_rows ids, whatever the number of labels: the sample's bound is the broadcast's.
    rows = docs.join(F.broadcast(chosen), "id")
    rows = cut(rows.select(F.xxhash64("id", F.lit("order")).alias("u"), "toxic", F.coalesce("text", F.lit("")).alias("text")))
    lengths: dict[int, list] = {0: [], 1: []}
    for r in rows.mapInArrow(sizes, "toxic int, size bigint").groupBy("toxic", "size").count().collect():
        lengths[r[0]].append((r[1], r[2]))
    total = {t: sum(size * n for size, n in own) for t, own in lengths.items()}
    most = {t: _longest(own, max(train_words // 2, train_words - total[1 - t])) for t, own in lengths.items()}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            found, _, _, of = features(data, offsets)
            at = np.searchsorted(of, np.arange(rows.num_rows + 1))
            runs = []
            for u, t, a, b in zip(rows.column("u").to_pylist(), rows.column("toxic").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                a += u % (b - a - most[t] + 1) if b - a > most[t] else 0
                runs.append(found[:, a : min(b, a + most[t])].tobytes())
            yield pa.RecordBatch.from_pydict({"u": rows.column("u"), "toxic": rows.column("toxic"), "f": pa.array(runs, pa.binary())})

    got = [((r[0], r[1]), np.frombuffer(r[2], np.int32).reshape(len(AFFIXES), -1)) for r in sorted(rows.mapInArrow(places, "u bigint, toxic int, f binary").toLocalIterator(), key=lambda r: (r[0], r[1]))]
    got = _without_copies(got)
    drawn = {label for label, _ in got}
    got = [(toxic, f) for (_, toxic), f in got]
    toxic = np.array([t for t, _ in got])
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    # Tags of the training words: by features that hardly any clean document has (a wrong label may be among them), more often than chance over all features.
    n_all, n_toxic = np.zeros(2 * TABLE, np.int64), np.zeros(2 * TABLE, np.int64)
    for t, x in got:
        signs = occurring(x.ravel(), np.zeros(x.size, np.int64))[1]  # each once
        n_all[signs] += 1
        n_toxic[signs] += t
    f = np.concatenate([x for _, x in got], 1)
    of = np.repeat(np.arange(len(got), dtype=np.int32), [x.shape[1] for _, x in got])
    del got, x  # the driver holds the sample's features once
    rate = toxic.mean()
    share = np.clip(n_toxic / np.maximum(n_all, 1), 1e-9, 1 - 1e-9)
    surprise = n_all * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))  # bound of the binomial tail
    telling = (share > rate) & (surprise > np.log(max(2, (n_all >= LEAST_SEEN).sum()))) & ((n_all - n_toxic - 1) * CLEAN_SHARE <= n_toxic)
    telling = _confirmed(docs, labels, telling)
    fresh = np.ones(len(of), bool)
    fresh[1:] = of[1:] != of[:-1]
    blocks = _blocks(fresh, FIT_WORDS)
    tag = np.zeros(len(of), bool)
    for b in blocks:
        for place in f[:, b]:
            _, at, n = np.unique(of[b].astype(np.int64) << 32 | place, return_inverse=True, return_counts=True)
            tag[b] |= telling[place] | (telling[place + TABLE] & (n[at] > 1))
    tag &= toxic[of] == 1
    observed = np.zeros((2, 2))
    np.add.at(observed, (tag[:-1][~fresh[1:]].astype(int), tag[1:][~fresh[1:]].astype(int)), 1)
    n_words = len(of)
    # A feature of hardly any rows would be learned by heart and says nothing of others: it has no weight.
    common = n_all[:TABLE] >= LEAST_SEEN

    def grad(x: np.ndarray) -> np.ndarray:
        table, bias, pair = x[:-5], x[-5], x[-4:].reshape(2, 2)
        g, total, every = np.zeros(TABLE), 0.0, np.zeros((2, 2))
        for b in blocks:  # of whole texts, so that none sways another
            e = np.full(b.stop - b.start, bias)
            for place in f[:, b]:
                e += table[place]
            p, expected = marginals(e, fresh[b], pair, counts=True)
            d = p - tag[b]
            for place in f[:, b]:
                g += np.bincount(place, weights=d, minlength=TABLE)
            total, every = total + d.sum(), every + expected
        return np.concatenate([(g + 0.05 * table) * common, [total], (every - observed).ravel() + 0.05 * pair.ravel()]) / n_words

    start = np.zeros(TABLE + 5)
    start[-5] = -4.0
    x = _adam(grad, start, 40, 0.25)
    model = Model(x[:-5].astype(np.float32), float(x[-5]), x[-4:].reshape(2, 2), np.zeros(5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def seen_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            p, _, _, of = shared.value.words(data, offsets)
            x = evidence(p, of, rows.num_rows)
            yield pa.RecordBatch.from_pydict({"u": rows.column("u"), "toxic": rows.column("toxic"), **{c: pa.array(x[:, k]) for k, c in enumerate("abcd")}})

    # The document's function sees whole texts, as it does in scoring: a run of a long text would have less evidence than the text.
    whole = [r for r in sorted(rows.mapInArrow(seen_by, "u bigint, toxic int, a double, b double, c double, d double").toLocalIterator()) if (r[0], r[1]) in drawn]
    z, y = np.array([[*r[2:], 1.0] for r in whole]), np.array([float(r[1]) for r in whole])
    # Each label weighs what it weighs among all labelled rows, however much of it the sample has.
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum()) / (counts[0] + counts[1])
    model.weights = _adam(lambda w: z.T @ ((1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) * weight) + 1e-4 * w, np.zeros(z.shape[1]), 600, 0.1)
    return model


def predicted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, score) of every whole text; with spans, also the offending byte offsets as array<struct<first,end>>."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, offsets in pieces(batches):
            score, found = np.zeros(rows.num_rows), [[] for _ in range(rows.num_rows)]
            if model is not None:
                p, first, end, of = model.words(data, offsets)
                score = model.score(evidence(p, of, rows.num_rows))
                for k in np.flatnonzero(p >= 0.5) if spans else ():
                    a, b, own = int(first[k] - offsets[of[k]]), int(end[k] - offsets[of[k]]), found[of[k]]
                    if own and own[-1]["word"] == k - 1:
                        own[-1] |= {"end": b, "word": k}
                    else:
                        own.append({"first": a, "end": b, "word": k})
            out = {"id": rows.column("id"), "score": pa.array(score)}
            if spans:
                out["spans"] = pa.array([[{"first": s["first"], "end": s["end"]} for s in own] for own in found], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double" + ", spans array<struct<first: int, end: int>>" * spans
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model learned from labels(id, toxic) of the rows that are not held out (crc32 of the id modulo 4 is not 2)."""
    own = labels.where(remainder(labels[id_col], 4) != 2).select(labels[id_col].alias("id"), labels["toxic"].alias("toxic"))
    return fit(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), own)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, spans) of every document. spans: first:end of the offending runs of words in bytes, joined by commas."""
    out = predicted(docs, fit_labels(docs, labels, id_col, text_col), id_col, text_col, spans=True)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["end"])), ",")
    held_out = F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False))
    return out.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), spans.alias("spans"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_labels(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, text_col):
            if model.value is None:
                yield rows
                continue
            p, _, _, of = model.value.words(data, offsets)
            yield rows.filter(pa.array(model.value.score(evidence(p, of, rows.num_rows)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
