"""Removal of long repeated strings by suffix arrays that are built by linear grouping.

A byte goes if a string of `LENGTH` bytes covers it that also starts elsewhere in the corpus. What could be equal is
brought together first. Every window of `LENGTH` bytes has a minimizer, its least-hashed run of `GRAM` bytes (the
leftmost of equals), so equal windows have equal minimizers at equal places. Neighbouring windows with one minimizer make up a segment of
less than 2 x LENGTH bytes; equal segments next to each other (a text of one letter) are one row with their number. Segments whose minimizer occurs once
are done with; segments that are equal as a whole are repeated as a whole; what is left are different segments of one minimizer, each kept once. These are dealt out by
minimizer, and each task builds suffix arrays over batches of them.

Suffix array (`suffix_array`). Segments are read in cells of `CELL` bytes, counted from the minimizer, so that equal
windows have equal cells. Suffixes are grouped by their Lyndon prefixes: groups are processed in descending order, each
suffix points to the previous suffix of a smaller group, and what is pointed to moves into a new group, further up for more
pointers. Afterwards one pass in the order of the suffixes puts each suffix at the next place of its group, following those
pointers, with no recursion or renaming. Neighbours in the array that agree on the cells inside a window, and on
the bytes before and after, are repeated windows.

`measured` runs this twice: first for strings of `SHORT` bytes over all texts, which gives `n_repeated`, the bytes covered by a string of
SHORT bytes that also starts elsewhere (a passage of some 50 words is shorter than LENGTH). A repeated string of LENGTH bytes is covered by repeated strings of SHORT
bytes, so that the second run, for strings of LENGTH bytes, need only look at windows inside what the first one covered.

A minimizer with more than `GROUP_SEGMENTS` different segments does not go to one task (`_found_in_parts`). Its windows are divided by more
bytes beside the minimizer, on the side where they reach further, and again while a group is too large; every group ends in a suffix array.

Defined results. Null text: empty. Texts shorter than LENGTH bytes: untouched. Null ids pass through. Rows repeated in
whole or sharing an id: each is a place of its own. Empty table: no rows. Extra columns: left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunk_dedup import without
from tidemark.llm.common import BYTE, bounded_batches, by_bucket, cut, gram_hash, keyed, pieces, settled, sliding_argmin, utf8

LENGTH, SHORT, GRAM_LEVELS, CELL = 400, 240, 5, 16
GRAM = 1 << GRAM_LEVELS
GROUP_SEGMENTS = 4_096
BATCH_BYTES = 1_500_000


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text, whose last symbol is smaller than all others and occurs once."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    start, place, size = [0] * n, [0] * n, [0] * n
    head = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            head = k
        start[i], place[i] = head, k
        size[head] += 1
    before = [-1] * n
    end = n
    while end:
        head = start[order[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(order[head:end]):
            p = i - 1
            while p >= 0 and start[p] >= head:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_times[k]:
                old = start[p]
                size[old] -= 1
                to = old + size[old]
                other = order[to]
                order[to], order[place[p]] = p, other
                place[other], place[p] = place[p], to
                moved.setdefault(old, []).append(p)
            for old, members in moved.items():
                new = old + size[old]
                if new != old:
                    size[new] = len(members)
                    for p in members:
                        start[p] = new
                else:
                    size[old] = len(members)
        end = head
    out = [-1] * n
    done = [False] * n
    free = start[:]
    head_free = list(range(n))
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            head = free[p]
            out[head_free[head]] = p
            head_free[head] += 1
            done[p] = True
            p = before[p]
    return out


#: First byte, number of windows and place of the minimizer of a segment, in one number.
_FIRST, _WINDOWS = 1 << 24, 1 << 12


def segments(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(mini, f1, f2, id, mark, place, times) of every segment: minimizer, digest, row, where and what it is (`_FIRST`), how many equal ones stand one behind the other.

    rows: (id, mark, text), with `spans` (begins and ends in turn) only the windows that lie inside what they cover.
    """
    width, within = length - GRAM + 1, "spans" in rows.columns

    def covered(batch: pa.RecordBatch, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        edge = np.zeros(int(offsets[-1]) + 1, np.int64)
        for begin, spans in zip(offsets.tolist(), batch.column("spans").to_pylist()):
            for a, b in merged(spans):
                edge[begin + a] += 1
                edge[begin + b] -= 1
        total = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        return total[at + length] - total[at] == length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            h = gram_hash(BYTE[data], GRAM_LEVELS)
            if len(h) < width:
                continue
            size = np.diff(offsets)
            at = np.flatnonzero(np.repeat(size, size) >= length)
            row = np.searchsorted(offsets, at, "right") - 1
            fits = at + length <= offsets[row + 1]
            at, row = at[fits], row[fits]
            if within:
                fits = covered(batch, offsets, at)
                at, row = at[fits], row[fits]
            if not len(at):
                continue
            anchor = sliding_argmin(h, width)[at].astype(np.int64)
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            begin = np.flatnonzero(new)
            windows = np.diff(np.append(begin, len(at)))
            first, own = at[begin], row[begin]
            view = data.tobytes()
            digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + windows + length - 1).tolist())]
            f = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            mini, shift = h[anchor[begin]].view(np.int64), anchor[begin] - first
            same = np.zeros(len(first), bool)
            same[1:] = (f[1:] == f[:-1]).all(1) & (mini[1:] == mini[:-1]) & (shift[1:] == shift[:-1]) & (own[1:] == own[:-1]) & (first[1:] == first[:-1] + windows[:-1])
            head = np.flatnonzero(~same)
            times = np.diff(np.append(head, len(first)))
            place = (first - offsets[own]) * _FIRST + windows * _WINDOWS + shift
            of = pa.array(own[head])
            yield pa.RecordBatch.from_pydict({
                "mini": mini[head], "f1": f[head, 0].copy(), "f2": f[head, 1].copy(), "id": batch.column("id").take(of), "mark": batch.column("mark").take(of),
                "place": place[head].astype(np.int64), "times": times.astype(np.int64),
            })

    return rows.mapInArrow(run, f"mini bigint, f1 bigint, f2 bigint, id {rows.schema['id'].dataType.simpleString()}, mark bigint, place bigint, times bigint")


def _runs(flags: np.ndarray) -> list[int]:
    """Begins and ends of the runs of true flags, in turn."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge).tolist()


def repeated_windows(texts: list[bytes], anchors: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows are also windows of another one, or of its own elsewhere; by a suffix array over all of them."""
    inner = length // CELL - 1  # whole cells inside every window
    symbols, owner, cell_at, counts = [], [], [], []
    for k, (t, a) in enumerate(zip(texts, anchors, strict=True)):
        skip = a % CELL
        m = (len(t) - skip) // CELL
        symbols.append(np.frombuffer(t, np.uint8)[skip : skip + m * CELL].reshape(m, CELL))
        owner.append(np.full(m, k, np.int64))
        cell_at.append(skip + CELL * np.arange(m, dtype=np.int64))
        counts.append(m)
    cells = np.concatenate(symbols).copy().view(np.dtype((np.void, CELL))).reshape(-1)
    rank = np.unique(cells, return_inverse=True)[1].reshape(-1)
    # Each segment ends with a symbol of its own, smaller than all before it.
    counts = np.array(counts)
    ends = np.cumsum(counts + 1) - 1
    text = np.zeros(len(rank) + len(texts), np.int64)
    solid = np.ones(len(text), bool)
    solid[ends] = False
    text[solid] = rank + len(texts)
    text[ends] = np.arange(len(texts))[::-1]
    sa = np.array(suffix_array(text.tolist()))
    flags = [np.zeros(len(t) - length + 1, bool) for t in texts]
    # A window begins at most CELL - 1 bytes before a cell and holds `inner` whole cells from there.
    where = np.full(len(text), -1, np.int64)
    where[solid] = np.arange(len(rank))
    owner, cell_at = np.concatenate(owner), np.concatenate(cell_at)
    sa = where[sa]
    sa = sa[sa >= 0]
    of_last = np.cumsum(counts)[owner] - np.arange(len(rank))  # cells from here to the segment's end
    # Neighbours whose common prefix is `inner` cells or more.
    long = of_last[sa] >= inner
    pair = np.flatnonzero(long[1:] & long[:-1])
    for k in range(inner):
        pair = pair[rank[sa[pair] + k] == rank[sa[pair + 1] + k]]
    same = np.zeros(len(sa), bool)
    same[pair + 1] = True
    group = np.cumsum(~same)
    in_group = same | np.append(same[1:], False)
    sa, group = sa[in_group], group[in_group]
    if not len(sa):
        return flags
    lengths = np.array([len(t) for t in texts])
    bases = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(texts), np.uint8)
    own, at = owner[sa], cell_at[sa]
    for r in range(CELL):  # bytes of the window before the cell
        begin = at - r
        fine = (begin >= 0) & (begin + length <= lengths[own])
        if not fine.any():
            continue
        b, g, o = begin[fine], group[fine], own[fine]
        take = np.concatenate([np.arange(r), np.arange(r + inner * CELL, length)])
        around = flat[(bases[o] + b)[:, None] + take[None]]
        key = np.concatenate([around, g[:, None].view(np.uint8).reshape(len(g), 8)], 1).copy().view(np.dtype((np.void, around.shape[1] + 8))).reshape(-1)
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        for k, w in zip(o[n[which.reshape(-1)] > 1].tolist(), b[n[which.reshape(-1)] > 1].tolist()):
            flags[k][w] = True
    return flags


def _found_in_groups(members: DataFrame, length: int) -> DataFrame:
    """(f1, f2, runs): repeated windows of segments (mini, f1, f2, anchor, body), dealt out by minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            flags = repeated_windows([r[4] for r in rows], [r[3] for r in rows], length)
            out = [(r[1], r[2], _runs(x)) for r, x in zip(rows, flags, strict=True) if x.any()]
            return pa.RecordBatch.from_pydict({"f1": pa.array([x[0] for x in out], pa.int64()), "f2": pa.array([x[1] for x in out], pa.int64()), "runs": pa.array([x[2] for x in out], pa.list_(pa.int32()))})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("mini", "f1", "f2", "anchor", "body")), strict=True):
                if size >= BATCH_BYTES and row[0] != kept[-1][0]:
                    yield done(kept)
                    kept, size = [], 0
                kept.append(row)
                size += len(row[4])
        if kept:
            yield done(kept)

    return members.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, "f1 bigint, f2 bigint, runs array<int>")


def _divided(members: DataFrame, length: int) -> DataFrame:
    """Segments (g1, g2, f1, f2, at, low, high, anchor, body) of groups in which `low` bytes before the minimizer and `high` after it are
    known to be equal, each as at most two: the windows that hold half of the unknown bytes before, and the others, which hold the rest
    of them after. Groups are told apart by these bytes as well, so that equal windows stay in one. (s1, s2) is the digest of a group and a body."""
    schema = pa.schema([(c, pa.int64()) for c in ("g1", "g2", "s1", "s2", "f1", "f2", "at", "low", "high", "anchor")] + [("body", pa.binary())])

    def digest(*of: bytes) -> tuple[int, ...]:
        return tuple(np.frombuffer(hashlib.blake2b(b"".join(of), digest_size=16).digest(), np.int64).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                body, anchor, low, high = row["body"], row["anchor"], row["low"], row["high"]
                windows, group = len(body) - length + 1, np.array([row["g1"], row["g2"]], np.int64).tobytes()
                free = length - GRAM - low - high
                half = (free + 1) // 2
                first = min(max(anchor - low - half + 1, 0), windows)  # windows before this one hold half more bytes before the minimizer
                after = anchor + GRAM + high
                for begin, end, more_low, more_high, known in (
                    (0, first, half, 0, slice(anchor - low - half, anchor - low)),
                    (first, windows, 0, free - half + 1, slice(after, after + free - half + 1)),
                ):
                    if begin < end:
                        part = body[begin : end + length - 1]
                        inner = digest(group, b"<" if more_low else b">", body[known])
                        name = digest(np.array(inner, np.int64).tobytes(), part)
                        out.append((*inner, *name, row["f1"], row["f2"], row["at"] + begin, low + more_low, high + more_high, anchor - begin, part))
            columns = list(zip(*out)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_pydict({f.name: pa.array(v, f.type) for f, v in zip(schema, columns, strict=True)})

    kinds = ", ".join(f"{c} bigint" for c in schema.names[:-1])
    return members.mapInArrow(run, f"{kinds}, body binary")


def _found_in_parts(members: DataFrame, length: int) -> DataFrame:
    """The same for segments of minimizers with very many. A group without unknown bytes has one kind of segment, so there is an end."""
    none = F.lit(0).cast("bigint")
    left = members.select(F.col("mini").alias("g1"), none.alias("g2"), "f1", "f2", none.alias("at"), none.alias("low"), none.alias("high"), F.col("anchor").cast("bigint").alias("anchor"), "body")
    group, kind, found = ["g1", "g2"], ["g1", "g2", "s1", "s2"], None
    while not left.isEmpty():
        parts = settled(_divided(left, length))
        one = F.first(F.struct("f1", "f2", "at", "low", "high", "anchor", "body")).alias("one")
        kinds = settled(parts.groupBy(*kind).agg(F.count("*").alias("n"), one).select(*kind, "n", "one.*"))
        sizes = settled(kinds.groupBy(*group).agg(F.count("*").alias("kinds")).where("kinds > 1"))
        shared = kinds.join(sizes, group)
        some = shared.where(F.col("kinds") <= GROUP_SEGMENTS)
        arrays = _found_in_groups(some.select(F.col("g1").alias("mini"), F.col("s1").alias("f1"), F.col("s2").alias("f2"), F.col("anchor").cast("int").alias("anchor"), "body"), length)
        arrays = arrays.withColumnsRenamed({"f1": "s1", "f2": "s2"}).join(some.select("s1", "s2", "f1", "f2", "at"), ["s1", "s2"])
        whole = F.array(F.lit(0), F.octet_length("body") - length + 1).alias("runs")
        again = parts.join(kinds.where("n > 1").select(*kind), kind).select("f1", "f2", "at", whole)
        now = settled(arrays.select("f1", "f2", "at", "runs").unionByName(again))
        found = now if found is None else found.unionByName(now)
        left = settled(shared.where(F.col("kinds") > GROUP_SEGMENTS).select(*group, "f1", "f2", "at", "low", "high", "anchor", "body"))
    runs = F.transform("runs", lambda k: (F.col("at") + k).cast("int")).alias("runs")
    return found.select("f1", "f2", runs).groupBy("f1", "f2").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _recurring(rows: DataFrame, length: int) -> DataFrame:
    """The segments whose minimizer occurs more than once."""
    found = cut(segments(rows, length))
    # Checkpointed, so that the join has an exchange on both sides and Spark can split hot minimizers.
    minis = settled(found.groupBy("mini").agg(F.sum("times").alias("n")).where("n > 1").select("mini", F.xxhash64("mini").alias("h")))
    return cut(found.withColumn("h", F.xxhash64("mini")).join(minis, ["h", "mini"]).drop("h"))


def repeated(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, mark, spans): for each row (id, mark, text) with repeated strings, begins and ends of what they cover, in turn, not yet merged."""
    found = settled(_recurring(rows, length))
    kinds = cut(found.groupBy("mini", "f1", "f2").agg(F.sum("times").alias("n"), F.min(F.struct("id", "mark", "place")).alias("one")))
    whole = kinds.where("n > 1").select("f1", "f2", F.lit(None).cast("array<int>").alias("runs"))
    shared = cut(kinds.groupBy("mini").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    wanted = kinds.join(shared, "mini").select("mini", "f1", "f2", "kinds", "n", "one.*")
    asked = F.collect_list(F.struct("mini", "f1", "f2", "kinds", "place")).alias("wanted")
    places = cut(wanted.groupBy(F.col("id").alias("own_id"), F.col("mark").alias("own_mark")).agg(asked))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("mini", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("kinds", pa.int64()), ("anchor", pa.int32()), ("body", pa.binary())])
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: dict[str, list] = {c: [] for c in schema.names}
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                for w in wanted:
                    first, shape = divmod(w["place"], _FIRST)
                    windows, anchor = divmod(shape, _WINDOWS)
                    out["anchor"].append(anchor)
                    out["body"].append(raw[first : first + windows + length - 1])
                    for c in ("mini", "f1", "f2", "kinds"):
                        out[c].append(w[c])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    # One row of several that are the same in whole holds the bytes.
    some, _ = by_bucket(rows, [rows["id"], rows["mark"]], places, ["own_id", "own_mark"])
    texts = some.join(places, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).select("text", "wanted")
    members = settled(texts.mapInArrow(bodies, "mini bigint, f1 bigint, f2 bigint, kinds bigint, anchor int, body binary"))
    hot = members.where(F.col("kinds") > GROUP_SEGMENTS)
    parts = _found_in_groups(members.where(F.col("kinds") <= GROUP_SEGMENTS), length)
    if not hot.isEmpty():
        parts = parts.unionByName(_found_in_parts(hot, length))
    parts = parts.join(whole.select("f1", "f2"), ["f1", "f2"], "left_anti").unionByName(whole)
    # A segment's runs are of its windows; null stands for all of them.
    parts = settled(parts.groupBy("f1", "f2").agg(F.first("runs").alias("runs")))
    first, windows = F.expr(f"place div {_FIRST}"), F.expr(f"place % {_FIRST} div {_WINDOWS}") * F.col("times")
    runs = F.coalesce(F.transform("runs", lambda k: k.cast("bigint")), F.array(F.lit(0).cast("bigint"), windows))
    hits = found.join(parts, ["f1", "f2"]).select("id", "mark", runs.alias("runs"), first.alias("first"))
    ends = F.transform("runs", lambda k, i: F.col("first") + k + F.when(i % 2 == 1, F.lit(length - 1)).otherwise(F.lit(0)))
    return settled(hits.select("id", "mark", ends.alias("spans")).groupBy("id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Begins and ends in turn, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ():
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int = SHORT, texts: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated) of every document; with texts, also kept (binary)."""
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)

    def with_spans(some: DataFrame, found: DataFrame, name: str, how: str) -> DataFrame:
        found = found.select(F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), F.col("spans").alias(name))
        met = some.join(found, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), how)
        return met.drop("own_id", "own_mark")

    near = repeated(rows, min(short, length))
    some, sure = by_bucket(rows, [rows["id"], rows["mark"]], near, ["id", "mark"])
    # Only documents with repeated strings are shuffled and looked at again.
    some = settled(with_spans(some, near, "near", "left"))
    far = repeated(some.where("near is not null").withColumnRenamed("near", "spans"), length)
    none = F.lit(None).cast("array<bigint>")
    joined = with_spans(some, far, "spans", "left").unionByName(sure.withColumn("near", none).withColumn("spans", none)).select("id", "text", "near", "spans")
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_repeated": pa.int64(), "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: dict[str, list] = {c: [] for c in kinds}
            for k, (near, spans) in enumerate(zip(batch.column("near").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                gone = merged(spans)
                kept = without(raw, gone)
                row = (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in merged(near)), kept)
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id")} | {c: pa.array(v, kinds[c]) for c, v in out.items() if texts or c != "kept"})

    columns = f"id {joined.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated bigint"
    return joined.mapInArrow(run, columns + ", kept binary" * texts).withColumnRenamed("id", id_col)
