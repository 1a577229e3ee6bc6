"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's UTF-8 bytes: it shifts by one bit and adds a random word for each byte, so that it
depends on the last 32 bytes. Where its top `MASK_BITS` bits are zero, a chunk ends, unless it would be shorter than
`MIN_CHUNK`; one of `MAX_CHUNK` ends anyway. An insertion moves the borders near it and no others. Chunks are equal if two 64-bit
hashes and their length are. Of equal chunks, the first (smallest id, then position) stays. Chunks that repeat are only
taken for a repeated passage where neighbouring ones make up at least `MIN_RUN` bytes: a lone common line stays.

Whole chunks miss the ends of a passage, and short passages altogether. With `extend` (as op10_chunk_dedup runs), chunks are
smaller and no length is set for them: one ends where the gear hash is the least of any `STEP` neighbouring places. Such borders depend on the bytes
around them alone, no chunk is longer than `STEP`, and every passage of `SURE` bytes has a chunk that all its copies have. A chunk's digest is over its
bytes and the 32 before it, by which its first border was judged. A match of `MIN_RUN` bytes over a digest's bytes holds at least half of the missing
ones on one side of them, so a chunk goes with short hashes of so many bytes before and after (`sides`), and one that agrees with the first
of its digest in neither is done with. The text is compared byte by byte with the first one that has
the chunk, left and right of it, and a match of `MIN_RUN` bytes or more, cut to whole characters, is removed. Each removed byte has an
equal one earlier in the order. A chunk is compared with its first text alone: a passage all of whose chunks stand, before its first copy,
in other texts with less than `MIN_RUN` bytes in common stays. Copies within a text count where they are `MIN_RUN` bytes apart or more.

Only chunks that repeat go on after they are counted; counts are combined where chunks lie, and the join back to them can be
split where one chunk has very many copies. A document's chunks meet in one row, which its own length bounds.

Defined results. Null or empty text: no chunks, 0 bytes. Null id: sorts before all others. Rows repeated in whole: they hold the same
chunks and have the same place in the order, so their chunks count as repeated but both rows hold the first ones; rows that share an id alone are
told apart by their text. Empty table: no rows. Extra columns: left out.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ODD, bounded_batches, by_bucket, cut, keyed, mixed, pieces, remove, settled, shared_dir, sliding_min, span_hash, utf8

MASK_BITS, MIN_CHUNK, MAX_CHUNK, MIN_RUN = 5, 24, 256, 120
GEAR = (mixed(np.arange(256, dtype=np.uint64) * ODD[10] + ODD[11]) >> np.uint64(32)).astype(np.uint32)
_REACH = 32
#: With extend: neighbouring places of which the least ends a chunk, and the bytes of which every passage has a whole chunk in common with its copies.
STEP = 64
SURE = _REACH + 3 * STEP
#: Bytes of text that one pass looks for borders in: it holds some ten numbers of 8 bytes for each.
_SEED_BYTES = 1 << 18
#: Bits of the hash of a side, and its values (0 is none).
_SIDE_BITS = 7
_SIDE = (1 << _SIDE_BITS) - 1


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, of the last 32 bytes."""
    h, width = GEAR[data], 1
    while width < _REACH:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, width * 2
    return h


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and text of the chunks of texts on end."""
    h = gear(data)
    ends = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    at = np.searchsorted(ends, offsets)
    first, last, of = [], [], []
    for k in range(len(offsets) - 1):
        begin, stop = int(offsets[k]), int(offsets[k + 1])
        known = begin + _REACH  # before, the hash has seen bytes of the text before
        for end in ends[at[k] : at[k + 1]].tolist() + [stop]:
            if end < stop and (end < known or end - begin < MIN_CHUNK):
                continue
            while end - begin > MAX_CHUNK:
                first.append(begin)
                begin += MAX_CHUNK
                last.append(begin)
                of.append(k)
            if end > begin and (end == stop or end - begin >= MIN_CHUNK):
                first.append(begin)
                last.append(end)
                of.append(k)
                begin = end
    return np.array(first, np.int64), np.array(last, np.int64), np.array(of, np.int64)


def chunks(rows: DataFrame) -> DataFrame:
    """(id, mark, place, d1, d2) of every chunk of rows (id, mark, text); place is 1024 x the first byte + the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            first, end, of = borders(data, offsets)
            d1, d2 = (span_hash(data, first, end, base, fold=False).view(np.int64) for base in (42, 44))
            place = (first - offsets[of]) * 1024 + (end - first)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(of)), "mark": batch.column("mark").take(pa.array(of)), "place": place, "d1": d1, "d2": d2})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, mark bigint, place bigint, d1 bigint, d2 bigint")


def repeats(rows: DataFrame) -> DataFrame:
    """(id, mark, places): for each row with chunks that repeat, 2 x place + 1 for the first of its kind, 2 x place for the others."""
    found = chunks(rows)
    often = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "place")).alias("first")).where("n > 1").drop("n")
    there = found.join(cut(often), ["d1", "d2"])
    first = (F.struct("id", "mark", "place") == F.col("first")).cast("bigint")
    return there.groupBy("id", "mark").agg(F.collect_set(F.col("place") * 2 + first).alias("places"))


def removed_spans(places: list[int] | None) -> tuple[list[tuple[int, int]], int]:
    """The spans to remove, and the bytes of repeated passages, first ones included."""
    spans: list[tuple[int, int]] = []
    shared = 0
    run: list[tuple[int, int, int]] = []

    def close() -> int:
        if not run or run[-1][1] - run[0][0] < MIN_RUN:
            return 0
        for begin, end, first in run:
            if first:
                continue
            if spans and spans[-1][1] == begin:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((begin, end))
        return run[-1][1] - run[0][0]

    for code in sorted(places or ()):
        place, first = code >> 1, code & 1
        begin, end = place >> 10, (place >> 10) + (place & 1023)
        if run and run[-1][1] != begin:
            shared += close()
            run = []
        run.append((begin, end, first))
    return spans, shared + close()


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for begin, end in spans:
        out.append(raw[at:begin])
        at = end
    return b"".join([*out, raw[at:]])


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    found = repeats(rows).withColumnRenamed("id", "own_id")
    return rows.join(found, F.col("id").eqNullSafe(F.col("own_id")) & (rows["mark"] == found["mark"]), "left").select("id", "text", "places")


def least_borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts on end, but for the ends of the texts: where the gear hash is the least of STEP neighbouring places of a text."""
    n = len(data) - _REACH + 1
    if n < STEP:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    h = gear(data)[_REACH - 1 :].astype(np.uint64) + np.uint64(1)
    whole = at + _REACH <= offsets[np.searchsorted(offsets, at, "right")]
    h[~whole] = 0  # so that no place is the least of a run across texts
    edge = np.zeros(STEP - 1, np.uint64)
    # The largest of the least values of the runs of places around each place; it is the place's own where that is the least of one.
    most = ~sliding_min(~np.concatenate([edge, sliding_min(h, STEP), edge]), STEP)
    picked = whole & (h == most)
    same = np.zeros(n, bool)
    same[1:] = picked[1:] & picked[:-1] & (h[1:] == h[:-1])
    begin = np.maximum.accumulate(np.where(same, 0, at))  # of a run of one byte, where each place is the least
    picked &= (at - begin) % STEP == 0
    return at[picked] + _REACH


def seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and text of what the digests of the chunks of texts on end are over: each chunk and the 32 bytes before it."""
    inner = least_borders(data, offsets)
    inner = inner[~np.isin(inner, offsets)]
    begins, ends = np.sort(np.concatenate([offsets[:-1], inner])), np.sort(np.concatenate([offsets[1:], inner]))
    of = np.searchsorted(offsets, begins, "right") - 1
    there = ends > begins
    begins, ends, of = begins[there], ends[there], of[there]
    first = np.maximum(begins - _REACH, offsets[of])
    enough = (ends - first >= _REACH) & (np.diff(offsets)[of] >= MIN_RUN)
    return first[enough], ends[enough], of[enough]


def _seeded(rows: DataFrame) -> DataFrame:
    """(id, mark, place, sides, h) of every chunk of rows (id, mark, text); place is 256 x the first byte of what h is over + its length,
    sides the two hashes of the bytes beside it, 0 where the text has not so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, limit=_SEED_BYTES):
            first, end, of = seeds(data, offsets)
            half = np.maximum(MIN_RUN - (end - first) + 1, 0) // 2
            before, after = first - half >= offsets[of], end + half <= offsets[of + 1]
            beyond = after & (half > 0)
            begins = np.concatenate([first, np.where(before, first - half, first), np.where(beyond, end, first)])
            ends = np.concatenate([end, first, np.where(beyond, end + half, first)])
            h, left, right = np.split(span_hash(data, begins, ends, 42, fold=False), 3)
            left, right = ((side % np.uint64(_SIDE) + np.uint64(1)) * there for side, there in ((left, before), (right, after)))
            sides = (left.astype(np.int16) << _SIDE_BITS) | right.astype(np.int16)
            own = {c: batch.column(c).take(pa.array(of)) for c in ("id", "mark")}
            yield pa.RecordBatch.from_pydict(own | {"place": (first - offsets[of]) * 256 + (end - first), "sides": sides, "h": h.view(np.int64)})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, mark bigint, place bigint, sides smallint, h bigint")


def _agree(one: str, other: str) -> Column:
    """Whether the bytes beside two chunks are the same on one side at least, by their hashes."""

    def on(side: int) -> Column:
        mask = F.lit(side)
        return (F.col(one).bitwiseAND(mask) != 0) & (F.col(one).bitwiseAND(mask) == F.col(other).bitwiseAND(mask))

    return on(_SIDE) | on(_SIDE << _SIDE_BITS)


def _once(rows: DataFrame) -> DataFrame:
    """(of, raw): the bytes of each text of rows (id, mark, text), rows that share both as one. Only these are combined."""
    often = settled(rows.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1"))
    several, single = (
        some.select(F.struct("id", "mark").alias("of"), F.col("text").cast("binary").alias("raw"))
        for some in by_bucket(rows, [rows["id"], rows["mark"]], often, ["id", "mark"])
    )
    return single.unionByName(several.groupBy("of").agg(F.first("raw").alias("raw")))


def _sought(rows: DataFrame, folder: str) -> DataFrame:
    """(who, matches): for each row with chunks that another text or place has first, what to compare it with: the first text, how much later the row's bytes stand, the places of the chunks, and the part of the first text around them.

    Each step is written to folder before the next one, so that texts are never shuffled twice at a time, and goes when the next one is there.
    """
    spark = rows.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # as settled() does
        return spark.read.parquet(f"{folder}/{name}")

    found = _seeded(rows)
    often = written(found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "place", "sides")).alias("first")).where("n > 1").drop("n"), "often")
    shift = F.shiftright("place", 8) - F.shiftright("first.place", 8)
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    later = found.join(often, "h").where((~own | (shift >= MIN_RUN)) & _agree("sides", "first.sides"))
    lines = later.groupBy(F.struct("id", "mark").alias("who"), F.struct("first.id", "first.mark").alias("of"), shift.alias("shift"))
    lines = written(lines.agg(F.sort_array(F.collect_set("place")).alias("places")), "lines")
    remove(spark, f"{folder}/often")
    # Texts that are no chunk's first one stay where they are.
    firsts, _ = by_bucket(rows, [rows["id"], rows["mark"]], lines.select("of.id", "of.mark"), ["id", "mark"])
    met = lines.join(_once(firsts), "of")
    last = F.element_at("places", -1)
    begin = F.greatest(F.lit(0), F.shiftright(F.element_at("places", 1), 8) - F.col("shift") - SURE)
    length = F.shiftright(last, 8) + last.bitwiseAND(255) - F.col("shift") + SURE - begin
    part = F.substring("raw", (begin + 1).cast("int"), length.cast("int"))
    met = written(met.select("who", "of", "shift", "places", begin.alias("begin"), part.alias("part")), "parts")
    remove(spark, f"{folder}/lines")
    return met.groupBy("who").agg(F.collect_list(F.struct("of", "shift", "places", "begin", "part")).alias("matches"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _equal_spans(own: np.ndarray, match: dict) -> list[tuple[int, int, int]]:
    """(place, begin, end) of the spans of own that equal the match's part for MIN_RUN bytes at least, and the first chunk in each."""
    shift, part = match["shift"], np.frombuffer(match["part"], np.uint8)
    low = match["begin"] + shift
    lo, hi = max(0, low), min(len(own), low + len(part))
    differ = np.flatnonzero(own[lo:hi] != part[lo - low : hi - low]) + lo
    out, reached = [], -1
    for place in match["places"]:
        at, stop = place >> 8, (place >> 8) + (place & 255)
        if stop <= reached:
            continue
        k = int(np.searchsorted(differ, at))
        begin, end = int(differ[k - 1]) + 1 if k else lo, int(differ[k]) if k < len(differ) else hi
        if begin <= at and stop <= end and end - begin >= MIN_RUN:
            reached = end
            while begin < end and own[begin] & 0xC0 == 0x80:
                begin += 1
            while end < len(own) and own[end] & 0xC0 == 0x80:
                end -= 1
            out.append((at, begin, end))
    return out


def _extended(docs: DataFrame, id_col: str, text_col: str, texts: bool) -> DataFrame:
    """With texts, (id, kept) of every document; else (id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    sought = _sought(rows, folder)
    # Texts without anything to compare them with are not shuffled.
    some, sure = by_bucket(rows, [rows["id"], rows["mark"]], spark.read.parquet(f"{folder}/parts").select("who.id", "who.mark"), ["id", "mark"])
    texts_of = [df.select(F.struct("id", "mark").alias("who"), "text") for df in (some, sure)]
    joined = texts_of[0].join(sought, "who", "left").unionByName(texts_of[1], allowMissingColumns=True)
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = pa.struct([("of", batch.schema.field("who").type), ("at", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
            data, offsets = utf8(batch.column("text"))
            out = []
            for k, matches in enumerate(batch.column("matches")):
                own = data[offsets[k] : offsets[k + 1]]
                gone, first = [], []
                for m in matches.as_py() or ():
                    for at, begin, end in _equal_spans(own, m):
                        gone.append((begin, end))
                        first.append({"of": m["of"], "at": at - m["shift"], "begin": begin - m["shift"], "end": end - m["shift"]})
                gone = _merged(gone)
                kept = without(own.tobytes(), gone)
                out.append((kept.decode(errors="ignore"),) if texts else (len(own), len(own) - len(kept), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in gone], first))
            if texts:
                yield pa.RecordBatch.from_pydict({"id": batch.column("who").field(0), "kept": pa.array([t for (t,) in out], pa.string())})
                continue
            n, r, h, g, f = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({"who": batch.column("who"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "kept_sha256": pa.array(h, pa.string()), "gone": pa.array(g, pa.list_(span)), "first": pa.array(f, pa.list_(there))})

    if texts:
        kept = settled(joined.mapInArrow(run, f"id {id_type}, kept string").withColumnRenamed("id", id_col))
        remove(spark, folder)
        return kept
    who, spans = f"struct<id: {id_type}, mark: bigint>", "array<struct<begin: bigint, end: bigint>>"
    done = settled(joined.mapInArrow(run, f"who {who}, n_bytes bigint, n_removed bigint, kept_sha256 string, gone {spans}, first array<struct<of: {who}, at: bigint, begin: bigint, end: bigint>>"))
    remove(spark, folder)
    # Of the matches over one chunk of a first text, the outer ends are enough: a text has no more rows than chunks.
    first = done.select(F.explode("first").alias("f")).groupBy("f.of", "f.at").agg(F.min("f.begin").alias("begin"), F.max("f.end").alias("end"))
    first = first.groupBy(F.col("of").alias("who")).agg(F.collect_list(F.struct("begin", "end")).alias("shared"))
    every = done.drop("first").join(first, "who", "left")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, shared = batch.column("gone").to_pylist(), batch.column("shared").to_pylist()
            n = [sum(b - a for a, b in _merged([(s["begin"], s["end"]) for s in [*g, *(f or ())]])) for g, f in zip(gone, shared)]
            own = {c: batch.column(c) for c in ("id", "n_bytes", "n_removed", "kept_sha256")}
            yield pa.RecordBatch.from_pydict({"id": own["id"], "n_bytes": own["n_bytes"], "n_repeated": pa.array(n, pa.int64()), "n_removed": own["n_removed"], "n_spans": pa.array([len(g) for g in gone], pa.int64()), "kept_sha256": own["kept_sha256"]})

    schema = f"id {id_type}, n_bytes bigint, n_repeated bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return every.select("who.id", "n_bytes", "n_removed", "kept_sha256", "gone", "shared").mapInArrow(total, schema).withColumnRenamed("id", id_col)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extend: bool = False) -> DataFrame:
    """(id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256) of every document; by whole chunks, or with extend by chunks and the bytes beside them."""
    if extend:
        return _extended(docs, id_col, text_col, texts=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for k, places in enumerate(batch.column("places").to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                spans, shared = removed_spans(places)
                kept = without(raw, spans)
                out.append((len(raw), shared, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            n, r, m, s, h = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_bytes": pa.array(n, pa.int64()), "n_repeated": pa.array(r, pa.int64()), "n_removed": pa.array(m, pa.int64()), "n_spans": pa.array(s, pa.int64()), "kept_sha256": pa.array(h, pa.string())})

    joined = _joined(docs, id_col, text_col)
    schema = f"id {joined.schema['id'].dataType.simpleString()}, n_bytes bigint, n_repeated bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extend: bool = False) -> DataFrame:
    """(id, kept): what is left of every text; bytes that no longer make up a character are dropped."""
    if extend:
        return _extended(docs, id_col, text_col, texts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without((t or "").encode(), removed_spans(p)[0]).decode(errors="ignore") for t, p in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "kept": pa.array(texts, pa.string())})

    joined = _joined(docs, id_col, text_col)
    return joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, kept string").withColumnRenamed("id", id_col)
