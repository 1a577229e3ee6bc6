"""WARC archives: written as segmented records, read back and reassembled.

Writing. A page is an HTTP response record whose block is an HTTP header and the payload in chunked transfer framing.
Blocks longer than `SEGMENT_BYTES` are cut: the first record bears segment number 1, each further one is a
`continuation` with its number and the identifier of the first (origin), the last one the block's total length. Of
records with equal payloads of at least `REVISIT_BYTES`, that with the smallest id is the response, and the others are
`revisit` records that name it and bear no payload. Which digests repeat is found without the payloads, and only pages whose digest may repeat
are shuffled. Archives are text files of Spark's own writer, one record after another (so one gzip member a file), in a folder that all
executors share; `round_trip` deletes them once they are read back.

Reading. Each file is parsed by its records' Content-Length. Records that are whole are decoded where they are; segments are grouped by origin, ordered by
segment number, checked for gaps and for the total length. The chunked framing is decoded; the payload's digest
must be the one declared. A revisit takes its payload's length from the response that it names.

Defined results. Null payload: empty. Null url: an empty target. Null id: written as its own response, read back as
null, never referred to. Rows repeated in whole: each is written and read back as a record of its own, and all have the same
type. Empty table: no rows. Extra columns: left out. A record whose segments are missing or do
not add up raises an error: nothing is dropped.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, by_bucket, cut, remove, shared_dir

SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES = 16_384, 4_096, 100
RECORDS_PER_FILE = 2_000
_END = "\r\n"


def digested(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, digest) of every row."""
    rows = pages.select(pages[id_col].cast("bigint").alias("id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def _responses(rows: DataFrame) -> DataFrame:
    """(digest, response): the smallest (id, url) of each long payload that repeats."""
    long = rows.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("id").isNotNull())
    return long.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")


def _chunked(payload: str) -> str:
    """The payload in chunks of at most CHUNK_BYTES bytes, cut between characters."""
    raw, out, at = payload.encode(), [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK_BYTES)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(f"{end - at:x}{_END}{raw[at:end].decode()}{_END}")
        at = end
    return "".join(out) + f"0{_END}{_END}"


def _named(*of: object) -> str:
    """A record identifier that follows from what the record is of."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(of).encode()).digest())}>"


def records(id_: int | None, url: str, payload: str, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> list[str]:
    """The records of one page, each a header and a block."""
    base = [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page: {'' if id_ is None else id_}"]
    own = _named(id_, url, digest)

    def record(kind: str, name: str, fields: list[str], block: str) -> str:
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", *fields, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block.encode())}"]
        return _END.join(head) + _END + _END + block

    http = f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Transfer-Encoding: chunked{_END}{_END}"
    if refers_to is not None:
        return [record("revisit", own, [*base, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to, refers_url, digest)}", f"X-Refers-To-Page: {refers_to}"], http)]
    raw, parts, at = (http + _chunked(payload)).encode(), [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT_BYTES)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(raw[at:end].decode())
        at = end
    if len(parts) == 1:
        return [record("response", own, base, parts[0])]
    out = [record("response", own, [*base, "WARC-Segment-Number: 1"], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [f"WARC-Segment-Origin-ID: {own}", f"WARC-Segment-Number: {k}"] + [f"WARC-Segment-Total-Length: {len(raw)}"] * (k == len(parts))
        out.append(record("continuation", _named(own, k), [*base, *fields], part))
    return out


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "") -> None:
    """Archives of all pages under folder. date: when they were captured (now, if not given)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = digested(pages, id_col, url_col, payload_col)
    responses = cut(_responses(rows))
    some, single = by_bucket(rows, [rows["digest"]], responses, ["digest"])
    kind = responses.schema["response"].dataType.simpleString()
    rows = some.join(responses, "digest", "left").unionByName(single.withColumn("response", F.lit(None).cast(kind)))
    revisit = F.col("id") != F.col("response.id")
    rows = rows.select("id", "url", "payload", "digest", F.when(revisit, F.col("response.id")).alias("refers_to"), F.when(revisit, F.col("response.url")).alias("refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out.extend(records(date=date, **{"id_" if k == "id" else k: v for k, v in row.items()}))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    text = rows.mapInArrow(run, "value string")
    text.write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def _parsed(content: bytes) -> Iterator[dict]:
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:head_end].decode().split(_END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        block = raw[head_end + 4 : head_end + 4 + size]
        if len(block) != size or raw[head_end + 4 + size : head_end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield {
            "kind": fields["WARC-Type"],
            "origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]),
            "segment": int(fields.get("WARC-Segment-Number", 0)),
            "total": int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None,
            "id": int(fields["X-Page"]) if fields.get("X-Page") else None,
            "url": fields.get("WARC-Target-URI", ""),
            "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None,
            "refers_record": fields.get("WARC-Refers-To"),
            "block": block,
        }
        at = head_end + 8 + size


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if len(out[-1]) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


_RECORD = "kind string, origin string, segment int, total bigint, id bigint, url string, digest string, refers_to bigint, refers_record string, block binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives under folder, as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = list(_parsed(content.as_py()))
                for at in range(0, len(found), 500):
                    yield pa.RecordBatch.from_pylist(found[at : at + 500], schema=_SCHEMA)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, _RECORD)


_SCHEMA = pa.schema([("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("refers_record", pa.string()), ("block", pa.binary())])


def reassembled(found: DataFrame) -> DataFrame:
    """(origin, kind, id, url, digest, refers_to, refers_record, payload): records made whole, their lengths and digests checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = sorted(row.pop("parts"), key=lambda p: p["segment"])
                times = sum(p["segment"] == parts[0]["segment"] for p in parts)  # a row that is repeated in whole
                if any(a["segment"] != b["segment"] for k in range(1, times) for a, b in zip(parts[::times], parts[k::times], strict=True)):
                    raise ValueError(f"segments of {row['origin']} are missing")
                parts = parts[::times]
                block = b"".join(p["block"] for p in parts)
                numbers, total = [p["segment"] for p in parts], parts[-1]["total"]
                if numbers != [0] and (numbers != list(range(1, len(parts) + 1)) or total != len(block)):
                    raise ValueError(f"segments of {row['origin']} are missing or do not add up: {numbers}, {len(block)} of {total} bytes")
                head, _, body = block.partition(b"\r\n\r\n")
                row["payload"] = None
                if row["kind"] == "response":
                    row["payload"] = unchunked(body) if b"Transfer-Encoding: chunked" in head else body
                    if hashlib.sha256(row["payload"]).hexdigest() != row["digest"]:
                        raise ValueError(f"the payload of {row['origin']} has another digest")
                out.extend([row] * times)
            yield pa.RecordBatch.from_pylist(out, schema=_WHOLE)

    first = F.col("kind") != "continuation"
    fields = ("kind", "id", "url", "digest", "refers_to", "refers_record")
    part = F.struct("segment", "total", "block")
    alone = found.where("segment = 0").select("origin", *fields, F.array(part).alias("parts"))
    one = [F.max(F.when(first, F.col(c))).alias(c) for c in fields]
    segmented = found.where("segment > 0").groupBy("origin").agg(*one, F.collect_list(part).alias("parts"))
    kinds = "origin string, kind string, id bigint, url string, digest string, refers_to bigint, refers_record string, payload binary"
    return alone.unionByName(segmented).mapInArrow(run, kinds)


_WHOLE = pa.schema([("origin", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("refers_record", pa.string()), ("payload", pa.binary())])


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, id_col, url_col, payload_col)
    bounded_batches(spark)
    whole = reassembled(read_records(spark, folder))
    rows = cut(whole.select("origin", "kind", "id", "digest", "refers_to", "refers_record", F.octet_length("payload").cast("bigint").alias("size")))
    remove(spark, folder)
    sizes = rows.where("kind = 'response'").select(F.col("origin").alias("refers_record"), F.col("size").alias("there")).distinct()
    out = rows.where("kind = 'response'").withColumn("there", F.col("size")).select("id", "there", "digest", "kind", "refers_to")
    back = rows.where("kind = 'revisit'").join(sizes, "refers_record", "left").select("id", "there", "digest", "kind", "refers_to")
    return out.unionByName(back).select(F.col("id").alias(id_col), F.col("there").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
