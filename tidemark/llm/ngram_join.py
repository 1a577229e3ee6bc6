"""Jaccard join of documents by their word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row for each different set of n-grams (documents with equal sets share it: copies are never
compared) and a column for each n-gram. Two sets link if their Jaccard similarity reaches `THRESHOLD` percent. In any fixed
order of n-grams, linked sets share at least `least_shared` of their first `prefix_size` n-grams, so only those entries are
multiplied. The order is rare first: a sketch of fixed size counts every n-gram of every document, and n-grams that stand out
from the sketch's own noise come last.

The product has two steps.

1. Each column is multiplied with the row of its hub alone, the set of the column that comes first in one order of all sets
   (that with the largest share of common n-grams, so the middle of a group of near copies). Sets that link to a hub are of
   one class with it. A group of near copies gives as many pairs as it has sets, not their square.
2. Columns in which more than one class is left, and more than the pair just compared, are blocked by their hub. The rows of
   a block are split into row blocks of at most about `ROWS` sets and `ENTRIES` entries, and each pair of row blocks that may hold sets of two classes is a
   tile. A tile's task adds up the overlap counts of all its columns (narrow ones by their pairs, wide ones by a dense product of
   at most `DENSE` columns at a time) and lets go of pairs of one class, of unlike sizes, or whose count
   stays under the bound even if all the entries that the two sets have elsewhere were shared. Counts of all blocks are
   then added by pair and held against the bound.

Pairs that are left and not ruled out by the sets' signatures are counted in whole, over all n-grams of the two texts. No
link between sets of different classes is lost, and links within a class are not needed for components.

Defined results. Null text, or one without words: no n-grams, linked with nothing, a component of its own. Fewer words than `WORDS`: the
whole sequence is the one n-gram. Null id: compared like any other, ignored as component id unless all of its
component are null. Rows repeated in whole: equal sets, one component. Empty table: no rows. Extra columns: kept by `without_near_copies`, left out by `linked`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import ODD, bounded_batches, by_bucket, cut, keyed, mixed, one_of_each, pieces, settled, span_hash, word_spans
from tidemark.llm.components import components

WORDS, THRESHOLD = 5, 75
SKETCH_BITS, SKETCH_BLOCK = 22, 1 << 16
SIGNATURE_BITS = 2048
#: Sets and entries of a row block; sets of a column whose pairs are listed; columns of one dense product; parts of a common column.
ROWS, ENTRIES, NARROW, DENSE, SALTS = 1024, 100_000, 48, 2048, 64


def ngrams(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted different n-gram hashes of each text."""
    first, end, of = word_spans(data, offsets)
    w = span_hash(data, first, end)
    n = len(offsets) - 1
    h = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        h += w[k : k + len(h)] * ODD[20 + k]
    h = mixed(h)
    at = np.searchsorted(of, np.arange(n + 1))
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:
            out.append(mixed((w[a:b] * ODD[30 : 30 + b - a]).sum(keepdims=True) + ODD[b - a]))
        else:
            out.append(w[:0])
    return out


def needed(n, threshold: int = THRESHOLD):
    """n-grams that a set of n has in common at least with any set that it links to."""
    return -(-threshold * n // 100)


def prefix_size(n, threshold: int = THRESHOLD):
    """First n-grams of a set, one of which it shares at least with any set that it links to."""
    return n - needed(n, threshold) + 1


def least_shared(n, m, threshold: int = THRESHOLD):
    """n-grams that linked sets of n and m share at least among the first ones of both.

    They share threshold / (100 + threshold) of n + m in all. Past the end of the prefix that ends first, they share what its
    set has left at most.
    """
    left = np.maximum(n - prefix_size(n, threshold), m - prefix_size(m, threshold))
    return np.maximum(1, -(-threshold * (n + m) // (100 + threshold)) - left)


def digest(grams: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signature(grams: np.ndarray) -> bytes:
    """A bit for each n-gram, of SIGNATURE_BITS."""
    bits = np.zeros(SIGNATURE_BITS, np.uint8)
    bits[(grams & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _counted(rows: DataFrame, words: int) -> DataFrame:
    """A row for each document (id, mark, n, node, check, bits), and the sketch of each task in blocks (block, counts)."""
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, mark bigint, n bigint, node bigint, check bigint, bits binary, block int, counts binary"
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch, data, offsets in pieces(batches):
            sets = ngrams(data, offsets, words)
            np.add.at(sketch, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            names = [digest(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"),
                "mark": batch.column("mark"),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([a for a, _ in names], pa.int64()),
                "check": pa.array([b for _, b in names], pa.int64()),
                "bits": pa.array([signature(s) for s in sets], pa.binary()),
                "block": pa.nulls(len(sets), pa.int32()),
                "counts": pa.nulls(len(sets), pa.binary()),
            })
        for k, block in enumerate(sketch.reshape(-1, SKETCH_BLOCK)):
            if block.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "id": pa.nulls(1, id_type), "mark": none, "n": none, "node": none, "check": none, "bits": pa.nulls(1, pa.binary()),
                    "block": pa.array([k], pa.int32()), "counts": pa.array([zlib.compress(block.tobytes(), 1)], pa.binary()),
                })

    return rows.mapInArrow(run, schema)


def _summed(counted: DataFrame) -> np.ndarray:
    """The sketch of all documents, 2**SKETCH_BITS counts: blocks are added up by Spark, and of fixed size together."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                more = np.frombuffer(zlib.decompress(counts.as_py()), np.int32)
                total[block] = total[block] + more if block in total else more
        packed = [zlib.compress(c.astype(np.int32).tobytes(), 1) for c in total.values()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "counts": pa.array(packed, pa.binary())})

    out = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK), np.int32)
    blocks = counted.where("block is not null").select("block", "counts").repartition(16, "block")
    for block, counts in blocks.mapInArrow(add, "block int, counts binary").collect():
        out[block] += np.frombuffer(zlib.decompress(counts), np.int32)
    return out.reshape(-1)


def frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """0 where a count may be chance, else 1 and more by powers of two. Chance: six deviations above the mean."""
    usual = float(np.median(sketch[:: max(1, len(sketch) // SKETCH_BLOCK)])) * 4 + 16  # the mean leaves out what stands out
    mean = sum(float(np.minimum(b, usual).sum()) for b in sketch.reshape(-1, SKETCH_BLOCK)) / len(sketch)
    stands_out = mean + 6 * np.sqrt(mean) + 8
    out = np.zeros(len(sketch), np.uint8)
    at = np.flatnonzero(sketch >= stands_out)
    out[at] = 1 + np.floor(np.log2(sketch[at] / stands_out))
    return out


#: A set's rank among hubs: the share of its n-grams that are common (in 1024ths) over its size, in one number.
_SIZE = 1 << 40


def _entries(rows: DataFrame, classes: np.ndarray, words: int, threshold: int) -> DataFrame:
    """(key, gram, node, w, common): the entries to multiply. w has rank and size of the set; a common n-gram has SALTS keys. Each task gives a set once."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for _, data, offsets in pieces(batches):
            grams, nodes, ranks, commons = [], [], [], []
            for s in ngrams(data, offsets, words):
                node = digest(s)[0] if len(s) else 0
                if not len(s) or node in given:
                    continue
                given.add(node)
                kind = shared.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.argsort(kind, kind="stable")[: prefix_size(len(s), threshold)]
                grams.append(s[first])
                commons.append(kind[first] > 0)
                nodes.append(np.full(len(first), node))
                ranks.append(np.full(len(first), int((kind > 0).mean() * 1023) * _SIZE + len(s)))
            if grams:
                gram, node, common = np.concatenate(grams), np.concatenate(nodes), np.concatenate(commons)
                salt = node.view(np.uint64) % np.uint64(SALTS) + np.uint64(1)
                key = np.where(common, mixed(gram + salt * ODD[7]), gram)
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "gram": gram.view(np.int64), "node": node, "w": np.concatenate(ranks), "common": common})

    return rows.select("text").mapInArrow(run, "key bigint, gram bigint, node bigint, w bigint, common boolean")


def _columns(entries: DataFrame) -> DataFrame:
    """(gram, node, n, hub, hub_n, k): the entries of columns of k > 1 sets, with the column's hub."""

    def columns(key, gram, node, w, common) -> pa.RecordBatch:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        key, gram, node, w, common = (x[new] for x in (key, gram, node, w, common))
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        k, at = np.repeat(size, size), np.repeat(head, size)
        keep = (k > 1) | common
        known = ~common[keep]
        return pa.RecordBatch.from_pydict({
            "gram": gram[keep], "node": node[keep], "w": w[keep], "hub": node[at][keep], "hub_w": w[at][keep], "k": np.where(known, k[keep], 0),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "gram", "node", "w", "common")
        held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            yield columns(*(h[:last] for h in held))
            held = [h[last:] for h in held]
        yield columns(*held)

    dealt = entries.repartition("key").sortWithinPartitions("key", "gram", F.desc("w"), F.desc("node"))
    found = settled(dealt.mapInArrow(run, "gram bigint, node bigint, w bigint, hub bigint, hub_w bigint, k bigint"))
    # Parts of a common column lie in several tasks: their hub is found by an aggregation that is combined where they lie.
    parts = found.where("k = 0")
    per = parts.groupBy("gram").agg(F.max(F.struct("w", "node")).alias("top"), F.count("*").alias("k")).where("k > 1")
    per = per.select("gram", F.xxhash64("gram").alias("h"), F.col("top.node").alias("hub"), F.col("top.w").alias("hub_w"), "k")
    parts = parts.select("gram", "node", "w").withColumn("h", F.xxhash64("gram")).join(per, ["h", "gram"])
    every = found.where("k > 0").unionByName(parts.drop("h"))
    return every.select("gram", "node", (F.col("w") % _SIZE).alias("n"), "hub", (F.col("hub_w") % _SIZE).alias("hub_n"), "k")


def _with_class(own: DataFrame, known: DataFrame, node: str, name: str) -> DataFrame:
    """own with the class of the set that column `node` names: what it is known to be of, or itself."""
    # The hash has both sides dealt anew, so that Spark can split a hub of very many entries.
    there = known.select(F.col("node").alias(node), F.xxhash64("node").alias("h"), F.col("component").alias(name))
    out = own.withColumn("h", F.xxhash64(node)).join(there, ["h", node], "left").drop("h")
    return out.withColumn(name, F.coalesce(name, node))


def _tiles(columns: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of what is left to multiply, dealt into tiles: (hub, i, j, part, gram, node, class, n, live). live: all entries that the set has left."""
    own = _with_class(columns.where("k > 2").select("gram", "node", "n", "hub"), known, "node", "class")
    per = own.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    own = own.withColumn("h", F.xxhash64("gram")).join(per.select("gram", F.xxhash64("gram").alias("h")), ["h", "gram"]).drop("h")
    own = _with_class(own, known, "hub", "main")
    own = cut(own.select("gram", "node", "n", "hub", "class", (F.col("class") == F.col("main")).alias("inside")))
    live = own.groupBy("node").agg(F.count("*").alias("live"))
    sets = own.groupBy("hub", "inside", "node").agg(F.count("*").alias("entries"))
    sizes = sets.groupBy("hub", "inside").agg(F.count("*").alias("rows"), F.sum("entries").alias("entries"))
    parts = F.ceil(F.greatest(F.col("rows") / ROWS, F.col("entries") / ENTRIES)).cast("int")
    sizes = sizes.groupBy("hub").agg(F.max(F.when(~F.col("inside"), parts)).alias("outer"), F.max(F.when(F.col("inside"), parts)).alias("inner"))
    sizes = sizes.select("hub", F.xxhash64("hub").alias("h"), F.coalesce("outer", F.lit(0)).alias("outer"), F.coalesce("inner", F.lit(0)).alias("inner"))
    own = own.join(live, "node").withColumn("h", F.xxhash64("hub")).join(sizes, ["h", "hub"]).where("outer > 0")
    # Row blocks 0 .. outer - 1 hold sets outside the hub's class, those from outer on sets inside it: two of the latter need no tile.
    draw = F.xxhash64("node", F.lit("part"))
    part = F.when(F.col("inside"), F.col("outer") + F.pmod(draw, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(draw, F.col("outer"))).cast("int")
    own = own.withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)))
    own = own.withColumn("other", other)
    return own.select("hub", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "gram", "node", "class", "n", "live")


def multiplied(tile: np.ndarray, part: np.ndarray, gram: np.ndarray, node: np.ndarray, kind: np.ndarray, n: np.ndarray, live: np.ndarray, diagonal: np.ndarray, threshold: int):
    """The product of tiles, whose entries are sorted by tile and n-gram: (a, b, overlap, bound) of the pairs of sets that may link. diagonal: whether the entry's tile is of one row block."""
    order = np.lexsort((node, tile))
    new = np.ones(len(order), bool)
    new[1:] = (tile[order][1:] != tile[order][:-1]) | (node[order][1:] != node[order][:-1])
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    one = order[new]  # an entry of each row
    n_rows, rest = len(one), live[one] - np.bincount(row, minlength=len(one))
    part, node, kind, n, diagonal = part[one], node[one], kind[one], n[one], diagonal[one]
    head = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (gram[1:] != gram[:-1])]))
    size = np.diff(np.append(head, len(tile)))

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows are to be compared in their tile: of two classes and two row blocks (or within the one of a tile on the diagonal), and of like sizes."""
        return (kind[a] != kind[b]) & (diagonal[a] | (part[a] != part[b])) & (100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))

    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> None:
        ok = fit(a, b)
        a, b = a[ok], b[ok]
        code, at = np.unique(np.minimum(a, b) * n_rows + np.maximum(a, b), return_inverse=True)
        codes.append(code)
        counts.append(np.bincount(at.reshape(-1), weights=None if c is None else c[ok], minlength=len(code)).astype(np.int64))

    for s in np.unique(size[(size > 1) & (size <= NARROW)]).tolist():
        at = head[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(at), step):
            add(row[(at[k : k + step, None] + i).ravel()], row[(at[k : k + step, None] + j).ravel()])
    wide = np.flatnonzero(size > NARROW)
    for t in np.unique(tile[head[wide]]).tolist():
        own = wide[tile[head[wide]] == t]
        rows, local = np.unique(np.concatenate([row[head[c] : head[c] + size[c]] for c in own]), return_inverse=True)
        column = np.repeat(np.arange(len(own)), size[own])
        product = np.zeros((len(rows), len(rows)), np.float32)
        for first in range(0, len(own), DENSE):
            block = np.zeros((len(rows), min(DENSE, len(own) - first)), np.float32)
            there = (column >= first) & (column < first + DENSE)
            block[local[there], column[there] - first] = 1
            product += block @ block.T
        a, b = np.nonzero(np.triu(product, 1))
        add(rows[a], rows[b], product[a, b])
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    both = np.bincount(at.reshape(-1), weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
    a, b = code // max(1, n_rows), code % max(1, n_rows)
    bound = least_shared(n[a], n[b], threshold)
    ok = both + np.minimum(rest[a], rest[b]) >= bound
    a, b = a[ok], b[ok]
    return np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), both[ok], bound[ok]


def _product(tiles: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the pairs of sets of two classes whose overlap, added up over all blocks, reaches the bound."""
    names = ("hub", "i", "j", "part", "gram", "node", "class", "n", "live")

    def product(held: list[np.ndarray]) -> pa.RecordBatch:
        hub, i, j, part, gram, node, kind, n, live = held
        new = np.ones(len(hub), bool)
        new[1:] = (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        a, b, both, bound = multiplied(np.cumsum(new), part, gram, node, kind, n, live, i == j, threshold)
        return pa.RecordBatch.from_pydict({"a": a, "b": b, "overlap": both, "bound": bound})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
            if len(held[0]) < 2 * ENTRIES:
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            last = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on
            if last:
                yield product([h[:last] for h in held])
                held = [h[last:] for h in held]
        if len(held[0]):
            yield product(held)

    dealt = tiles.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "gram")
    parts = dealt.mapInArrow(run, "a bigint, b bigint, overlap bigint, bound bigint")
    return parts.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("bound").alias("bound")).where("overlap >= bound").select("a", "b")


def _possible(pairs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that may link by their signatures: a bit that one set has and the other has not is an n-gram that they do not share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            most = np.minimum(n - np.bitwise_count(x & ~y).sum(1), m - np.bitwise_count(y & ~x).sum(1)).astype(np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(100 * most >= threshold * (n + m - most)))

    for side in ("a", "b"):
        there = signed.select(F.col("node").alias(side), F.xxhash64("node").alias("h"), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.withColumn("h", F.xxhash64(side)).join(there, ["h", side]).drop("h")
    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint")


def _counted_in_whole(pairs: DataFrame, rows: DataFrame, places: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (u, v) that link, by all n-grams of their texts. places: (node, own_id, own_mark), a row that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for _, data, offsets in pieces(iter([batch]), "text_b"):
                for other in ngrams(data, offsets, words):
                    k = len(keep)
                    a = batch.column("u")[k].as_py()
                    if known[0] != a:
                        raw = np.frombuffer(batch.column("text_a")[k].as_py().encode(), np.uint8)
                        known = (a, ngrams(raw, np.array([0, len(raw)]), words)[0])
                    both = len(np.intersect1d(known[1], other, assume_unique=True))
                    keep.append(100 * both >= threshold * (len(known[1]) + len(other) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    there = cut(nodes.join(places, "node"))
    # Most rows that no pair needs stay where they are.
    texts, _ = by_bucket(rows, [rows["id"], rows["mark"]], there, ["own_id", "own_mark"])
    # One row of several that are the same in whole gives the text.
    texts = texts.join(there, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).select("node", "text")
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")))
    one = texts.select(F.col("node").alias("u"), F.xxhash64("node").alias("h"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("v"), F.col("text").alias("text_b"))
    met = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).join(two, "v").withColumn("h", F.xxhash64("u")).join(one, ["h", "u"])
    return met.select("u", "v", "text_a", "text_b").mapInArrow(run, "u bigint, v bigint")


def links(rows: DataFrame, counted: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component) of every set that links to another one. rows: (id, mark, text)."""
    docs = counted.where("node is not null and n > 0")
    one = docs.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("one"))
    places = one.select("node", F.col("one.id").alias("own_id"), F.col("one.mark").alias("own_mark"))
    signed = docs.select("node", "n", "bits").dropDuplicates(["node"])
    columns = settled(_columns(_entries(rows, frequency_classes(_summed(counted)), words, threshold)))
    fits = (F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n"))
    near_hubs = settled(columns.where(fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    linked = settled(_counted_in_whole(settled(_possible(near_hubs, signed, threshold)), rows, places, words, threshold))
    known = components(linked)
    pairs = _product(_tiles(columns, known), threshold).join(near_hubs, ["a", "b"], "left_anti")
    more = settled(_counted_in_whole(settled(_possible(settled(pairs), signed, threshold)), rows, places, words, threshold))
    return components(linked.unionByName(more)) if not more.isEmpty() else known


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    bounded_batches(docs.sparkSession)
    return _linked(keyed(docs, id_col, text_col), words, threshold).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _linked(rows: DataFrame, words: int, threshold: int) -> DataFrame:
    """(id, mark, n_shingles, component_id, component)."""
    counted = cut(_counted(rows, words))
    docs = counted.where("node is not null")
    if not docs.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x != y").isEmpty():
        raise ArithmeticError("two sets of n-grams have one 64-bit name; change the constants of the digest")
    known = links(rows, counted, words, threshold)
    docs = docs.join(known, "node", "left").select("id", "mark", "n", F.coalesce("component", "node").alias("component"))
    docs = settled(docs.withColumn("h", F.xxhash64("component")))
    least = docs.where("n > 0").groupBy("component").agg(F.min("id").alias("least")).withColumn("h", F.xxhash64("component"))
    component_id = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id")
    return docs.join(least, ["h", "component"], "left").select("id", "mark", F.col("n").alias("n_shingles"), component_id, "component")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one row, with the smallest id; of rows without words, one of each id."""
    bounded_batches(docs.sparkSession)
    rows = cut(_linked(keyed(docs, id_col, text_col), words, threshold))
    each = rows.groupBy("component", "n_shingles", "id", "mark").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "n")
    first = each.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("k")).select("k.id", "k.mark").withColumn("first", F.lit(True))
    first = first.select(F.col("id").alias("k0"), F.col("mark").alias("k1"), "first")
    every = each.groupBy(F.col("id").alias("k0"), F.col("mark").alias("k1")).agg(F.sum("n").alias("n"), F.max(F.col("n_shingles") == 0).alias("kept"))
    same = every["k0"].eqNullSafe(first["k0"]) & (every["k1"] == first["k1"])
    every = every.join(first, same, "left").select(every["k0"], every["k1"], "n", (F.col("kept") | F.col("first").isNotNull()).alias("kept"))
    mark = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return one_of_each(docs, [docs[id_col], mark], every)
