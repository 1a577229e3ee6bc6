"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers, A (byte-level BPE) and B (SentencePiece BPE), cut the same bytes, a space and the text, into tokens. All
tokens of both are sorted by their first byte; where a token starts at or past the greatest end so far, a group begins.
Within the groups, each A token is linked with every B token whose bytes overlap with its own.

A space between two characters that are no white space parts both tokenizers' work: no A token and no B piece goes across
its left side, so what lies between two of them is a unit that both encode alike wherever it stands (B's model is checked
for it; if a piece of it did go across, whole texts would be the units). A worker keeps the alignments of recent units:
their number and bytes are bounded, and one that is not kept is aligned anew with the same result. A text is taken in
stretches of `STRETCH` characters, whole units each.

How often an id pair is linked is counted over all documents: each document's distinct pairs, added up where they lie and
then by pair. The most frequent pairs, `HOT_PAIRS` at most, travel to the tasks; those beyond, which are in fewer documents
each, are joined by a shuffle. Nothing is dropped either way. The highest count of each A id is bounded by A's vocabulary.

Defined results. Null or empty text, or one whose tokens' bytes are not those of space and text (a U+2581 in it, or white
space that B changes): no tokens, zeros and an empty groups_sha256. Rows repeated, null ids: each row is aligned and counted
as a document of its own. Further columns are not carried. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, remove, shared_dir

SPACE_MARK = "▁"
#: Units that a worker keeps, and their characters; beyond either, it starts anew.
KEPT_UNITS, KEPT_CHARS = 300_000, 1 << 24
#: Characters of a text that are taken at a time, and new units that are encoded at a time.
STRETCH, ENCODED_UNITS = 1 << 20, 20_000
#: Pairs that travel to all tasks: 16 bytes each.
HOT_PAIRS = 1 << 20
#: Distinct pairs that a task counts before it hands them on.
COUNTED_PAIRS = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Two tokenizers: ids of units, and the bytes of each id."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_alphabet()
        vocab = json.loads(a_json)["model"]["vocab"]
        self.a_size, self.b_size = max(self.a.get_vocab_size(), max(vocab.values()) + 1), self.b.get_piece_size()
        self.a_bytes = [b""] * self.a_size
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.b_bytes, across = [], False
        for i in range(self.b_size):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(piece.replace(SPACE_MARK, " ").encode())
                across = across or SPACE_MARK in piece.lstrip(SPACE_MARK)
        # A unit ends where a lone space follows; white space of any kind or a mark beside that space keeps both sides in one unit.
        self.border = None if across else re.compile(rf"(?<=[^\s{SPACE_MARK}]) (?=[^\s{SPACE_MARK}])")
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units by A, one after the other, and their number for each unit; the same by B. None by either if their bytes are not those of space and unit."""
        if self.border and len(units) > 1 and not any(SPACE_MARK in u or u[:1].isspace() or u[-1:].isspace() for u in units):
            # Such units are encoded alike side by side.
            joined = " ".join(units)
            a, b = self.a.encode_batch_fast([f" {joined}"], add_special_tokens=False)[0].ids, self.b.encode(joined)
            whole = f" {joined}".encode()
            if b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole:
                ends = np.cumsum([len(u.encode()) + 1 for u in units])
                out = []
                for ids, length in ((a, self.a_length), (b, self.b_length)):
                    ids = np.array(ids, np.int64)
                    out += [ids, np.diff(np.searchsorted(np.cumsum(length[ids]), ends, "right"), prepend=0)]
                return tuple(out)
        a = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        for k, unit in enumerate(units):
            whole = f" {unit}".encode()
            if b"".join([self.a_bytes[i] for i in a[k]]) != whole or b"".join([self.b_bytes[i] for i in b[k]]) != whole:
                a[k], b[k] = [], []
        return *_flat(a), *_flat(b)

    def units(self, text: str) -> Iterator[list[str]]:
        """The units of a text, a stretch at a time; the space before each is left out."""
        at = 0
        while self.border and len(text) - at > STRETCH and (border := self.border.search(text, at + STRETCH)):
            yield self.border.split(text[at : border.start()])
            at = border.end()
        yield self.border.split(text[at:]) if self.border else [text[at:]]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, sizes.sum()), sizes


def coalesced(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token: tokens sorted by start, a group breaks where a start reaches the running maximum of the ends."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.arange(len(start)) >= len(a_start)
    order = np.lexsort((side, start))
    running = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= running[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_start)], group[len(a_start) :]


def overlapping(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) of tokens in the order of their bytes whose ranges overlap."""
    first = np.searchsorted(b_end, a_start, "right")
    times = np.searchsorted(b_start, a_end, "left") - first
    a = np.repeat(np.arange(len(a_start)), times)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


def ragged(offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the entries of the rows `which`, one after the other."""
    sizes = offsets[which + 1] - offsets[which]
    return np.arange(sizes.sum()) + np.repeat(offsets[which] - (np.cumsum(sizes) - sizes), sizes)


class Units(dict):
    """Recent units: what each adds to a document, under the number that it is given here."""

    def __init__(self, pair: Pair):
        self.pair = pair
        # An A token's text by whether it is the last of its group, then a B token's.
        self.a_text = [f"{i}," for i in range(pair.a_size)] + [f"{i}|" for i in range(pair.a_size)]
        self.b_text = [f"{i}," for i in range(pair.b_size)] + [f"{i};" for i in range(pair.b_size)]
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.chars, self.texts = 0, []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.codes, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def need(self, units: Iterable[str]) -> None:
        """Have all of these units."""
        wanted = dict.fromkeys(units)
        new = [u for u in wanted if u not in self]
        if new and (len(self) + len(new) > KEPT_UNITS or self.chars > KEPT_CHARS):
            self.restart()
            new = list(wanted)
        odd = [SPACE_MARK in u or u[:1].isspace() or u[-1:].isspace() for u in new]
        for kind in (False, True):
            some = [u for u, o in zip(new, odd, strict=True) if o == kind]
            for k in range(0, len(some), ENCODED_UNITS):
                self._learn(some[k : k + ENCODED_UNITS])

    def _learn(self, new: list[str]) -> None:
        pair = self.pair
        a, n_a, b, n_b = pair.encode(new)
        # Units lie end to end on one axis of bytes, so that one pass coalesces all of them; a border of units is one of groups.
        a_end, b_end = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
        a_start, b_start = a_end - pair.a_length[a], b_end - pair.b_length[b]
        a_group, b_group = coalesced(a_start, a_end, b_start, b_end)
        i, j = overlapping(a_start, a_end, b_start, b_end)
        a_unit, b_unit = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        links = np.bincount(a_unit[i], minlength=len(new)) if len(i) else np.zeros(len(new), np.int64)
        a_last, b_last = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (a_group, b_group))
        groups = np.bincount(a_unit[a_last], minlength=len(new)) if len(a) else np.zeros(len(new), np.int64)
        # Of each group the A tokens come first, then the B tokens.
        order = np.lexsort((np.arange(len(a) + len(b)), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a_group, b_group])))
        pieces = [self.a_text[x] for x in (a + a_last * pair.a_size).tolist()] + [self.b_text[x] for x in (b + b_last * pair.b_size).tolist()]
        unit = np.concatenate([a_unit, b_unit])[order]
        bounds = np.searchsorted(unit, np.arange(len(new) + 1))
        pieces = [pieces[x] for x in order.tolist()]
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.chars += sum(map(len, new))
        self.texts += ["".join(pieces[bounds[k] : bounds[k + 1]])[:-1] for k in range(len(new))]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, groups, links], 1)])
        self.codes = np.concatenate([self.codes, a[i] * pair.b_size + b[j]])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(links)])

    def aligned(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Of each text: (n_a, n_b, n_groups, n_links), groups_sha256, and the distinct id pairs that it links with the times of each."""
        texts = list(texts)
        cut = [[*self.pair.units(t)] if t and len(t) <= STRETCH else None for t in texts]
        self.need(u for stretches in cut if stretches for units in stretches for u in units)
        for text, stretches in zip(texts, cut, strict=True):
            yield self._added(stretches or (self.pair.units(text) if text else ()))

    def _added(self, stretches: Iterable[list[str]]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        counts, sha, parts = np.zeros(4, np.int64), hashlib.sha256(), []
        none = counts, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        for units in stretches:
            try:
                own = np.array([self[u] for u in units], np.int64)
            except KeyError:  # forgotten since, or a further stretch of a long text
                self.need(units)
                own = np.array([self[u] for u in units], np.int64)
            if not self.counts[own, 0].all():
                return none
            counts = counts + self.counts[own].sum(0)
            sha.update((";" * bool(parts) + ";".join([self.texts[k] for k in own.tolist()])).encode())
            kinds, times = np.unique(own, return_counts=True)
            parts.append((self.codes[ragged(self.offsets, kinds)], np.repeat(times, self.counts[kinds, 3])))
            if len(parts) > 16:
                parts = [_summed(parts)]
        return (counts, sha.hexdigest(), *_summed(parts)) if parts else none


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their numbers."""
    codes, numbers = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    kinds, place = np.unique(codes, return_inverse=True)
    return kinds, np.bincount(place, numbers, len(kinds)).astype(np.int64)


_units: dict[str, Units] = {}


def _kept(a_json: str, b_model: bytes) -> Units:
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    if key not in _units:
        _units[key] = Units(Pair(a_json, b_model))
    return _units[key]


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in column]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    files = spark.sparkContext.broadcast((Path(a_path).read_text(), Path(b_path).read_bytes()))
    id_type = docs.schema[id_col].dataType.simpleString()
    folder = f"{shared_dir(spark)}/align-{uuid.uuid4().hex}"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _kept(*files.value)
        for batch in batches:
            rows = [*units.aligned(batch.column("text").to_pylist())]
            if not rows:
                continue
            counts = np.stack([r[0] for r in rows])
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id")}
                | {name: pa.array(counts[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                | {"groups_sha256": pa.array([r[1] for r in rows], pa.string())}
                | {name: pa.array([r[k].tobytes() for r in rows], pa.binary()) for k, name in ((2, "codes"), (3, "times"))}
            )

    numbers = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.mapInArrow(align, f"id {id_type}, {numbers}, groups_sha256 string, codes binary, times binary").withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(folder)
    found = spark.read.parquet(folder)
    _, b_model = files.value
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_proto=b_model).get_piece_size()
    counts = cut(_pair_counts(found))
    best_of = counts.groupBy(F.expr(f"code div {b_size}").alias("a")).agg(F.max("n").alias("n")).toPandas()  # one row an A id at most
    best = np.zeros(int(best_of["a"].max()) + 1 if len(best_of) else 1, np.int64)
    best[best_of["a"].to_numpy(np.int64)] = best_of["n"]
    # The least power of two from which on pairs are few enough to travel.
    least, held = 1 << 62, 0
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs")).orderBy(F.desc("k")).collect()  # 64 at most
    for k, pairs in by_size:
        if held + pairs > hot_pairs:
            break
        least, held = 1 << k, held + pairs
    hot = counts.where(F.col("n") >= least).orderBy("code").toArrow()
    carried = spark.sparkContext.broadcast((hot.column("code").to_numpy(), hot.column("n").to_numpy(), best))
    is_all = held == sum(pairs for _, pairs in by_size)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes, best = carried.value
        for batch in batches:
            n_best, count_sum = [], []
            for own, times in zip(_numbers(batch.column("codes")), _numbers(batch.column("times")), strict=True):
                place, there = _looked_up(codes, own)
                n = sizes[place[there]]
                count_sum.append(int((n * times[there]).sum()))
                n_best.append(int(times[there][n == best[own[there] // b_size]].sum()))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c not in ("codes", "times")} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})

    out = found.mapInArrow(weigh, f"id {id_type}, {numbers}, groups_sha256 string, row bigint, n_best bigint, count_sum bigint")
    if not is_all:

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = carried.value[0]
            for batch in batches:
                for row, own, times in zip(batch.column("row").to_pylist(), _numbers(batch.column("codes")), _numbers(batch.column("times")), strict=True):
                    left = ~_looked_up(codes, own)[1]
                    yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(left.sum(), row)), "code": pa.array(own[left]), "times": pa.array(times[left])})

        rare = found.select("row", "codes", "times").mapInArrow(others, "row bigint, code bigint, times bigint").join(counts.where(F.col("n") < least), "code")
        tops = counts.groupBy(F.expr(f"code div {b_size}").alias("a")).agg(F.max("n").alias("top"))
        rare = rare.withColumn("a", F.expr(f"code div {b_size}")).join(F.broadcast(tops), "a")
        more = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        out = out.join(more, "row", "left")
        out = out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    out = cut(out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    remove(spark, folder)
    return out


def _looked_up(codes: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sought code would be among sorted codes, and whether it is there."""
    place = np.searchsorted(codes, sought)
    if not len(codes):
        return place, np.zeros(len(sought), bool)
    return place, codes[np.minimum(place, len(codes) - 1)] == sought


def _pair_counts(found: DataFrame) -> DataFrame:
    """(code, n): how many documents link each id pair; tasks add up what they have before they hand it on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.concatenate(_numbers(batch.column("codes")))
            held.append(_summed([(own, np.ones(len(own), np.int64))]))
            size += len(held[-1][0])
            if size > COUNTED_PAIRS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > COUNTED_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["code", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], ["code", "n"])

    return found.select("codes").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
