"""Secret scans: fixed patterns, and strings in a sensitive place that zstandard finds new.

The base finds assignments, access keys and hexadecimal runs by pattern. The method then weighs every candidate: a run of
`LETTERS`, at least `SHORTEST` characters, with a sensitive word in the `BEFORE` characters before it. Its novelty is
the number of bytes by which a zstandard frame grows when the candidate is added to what surrounds it, for each character
of it, where the frame is primed with a dictionary. That dictionary has the identifiers that most documents use around
candidates, counted over the whole corpus, and the code around the candidate in its own text, on both sides. A word, a
path or a name that is used again costs little; a random string costs nearly its entropy. Candidates of at least
`NOVEL` bytes a character (a random hexadecimal digit has 0.5, a random base-64 letter 0.75) are reported as `novel`,
but for those that touch a span of the base, which is reported already. Base spans always stay.

A longer run is weighed in pieces of `LONGEST` characters, the last of which ends where the run ends, each with what stands
around it. The run is as new as its newest piece and reported as a whole. What it costs grows with its length alone.

Positions are code points, ends exclusive. Defined results. Null or empty text: no spans, the digest of an empty string.
Rows repeated, null ids: each row is scanned for itself; each counts as a document in the dictionary's counts, where ties
go to the lesser identifier. Further columns are not carried. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut

#: Kinds in their order, their patterns, the group that is measured and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Words that make a place sensitive, in either case.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "private_key", "access_key", "credential", "authorization", "bearer", "auth_key", "signature")
LETTERS = r"[A-Za-z0-9+/_-]"
SHORTEST, LONGEST, BEFORE = 16, 256, 48
#: Characters of surrounding text on each side that prime the frame.
AROUND = 160
#: Bytes of a dictionary of identifiers, and the documents that an identifier has to be in.
DICTIONARY_BYTES, IN_DOCUMENTS = 8192, 2
NOVEL = 0.45
LEVEL = 19

_patterns = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in BASE]
# Runs of hexadecimal digits and access keys are maximal, so that a lower bound in the pattern drops the same matches.
_fast = {"access": re.compile(r"AKIA[A-Z0-9]{12,}"), "hex": re.compile(r"[0-9a-f]{32,}")}
_words = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
_run = re.compile(rf"{LETTERS}{{{SHORTEST},}}={{0,2}}")
_identifier = re.compile(r"[A-Za-z_][A-Za-z_.-]{2,31}")
ORDER = {kind: k for k, kind in enumerate(("assign", "access", "hex", "novel"))}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches that are long enough, by start, then kind."""
    spans = []
    for kind, pattern, group, least in _patterns:
        for m in _fast.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                spans.append((kind, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs with a sensitive word shortly before them, without those that touch a base span. A word inside the run does not count."""
    found, words = [], _words.finditer(text)
    word = next(words, None)
    if word is None:
        return found
    last, k, reach = -1, 0, 0
    for m in _run.finditer(text, max(0, word.start() - 1)):
        start, end = m.span()
        while word is not None and word.end() <= start:
            last, word = word.end(), next(words, None)
        if last < 0 or start - last > BEFORE:
            if word is None:
                break
            continue
        while k < len(base) and base[k][1] < end:
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= start:
            found.append((start, end))
    return found


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """The code before and after a candidate."""
    return text[max(0, start - AROUND) : start], text[end : end + AROUND]


def primed(dictionary: str):
    """A function from code before, code after and a candidate to the candidate's marginal bytes for each of its characters."""
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)

    def novelty(before: str, after: str, candidate: str) -> float:
        # Raw content ends with what is nearest: identifiers, the code after, the code before.
        content = f"{dictionary}\n{after}\n{before}".encode(errors="replace")
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        frame = zstandard.ZstdCompressor(compression_params=parameters, dict_data=held)
        context = before.encode(errors="replace")
        return (len(frame.compress(context + candidate.encode())) - len(frame.compress(context))) / len(candidate)

    return novelty


def pieces(before: str, after: str, candidate: str) -> Iterator[tuple[str, str, str]]:
    """A candidate in pieces of `LONGEST` characters at most that cover it, each as (before, after, piece)."""
    whole, end = before + candidate + after, len(before) + len(candidate)
    starts = [*range(len(before), max(end - LONGEST, len(before)), LONGEST), max(end - LONGEST, len(before))]
    for start in starts:
        stop = min(start + LONGEST, end)
        yield *surroundings(whole, start, stop), whole[start:stop]


def _text_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


PLACE = "struct<start:int,end:int,before:string,after:string,own:string>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novel: float = NOVEL) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of every text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("own", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, near = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append(_text_spans(spans))
                rows = []
                for start, end in candidates(text, spans):
                    before, after = surroundings(text, start, end)
                    rows.append({"start": start, "end": end, "before": before, "after": after, "own": text[start:end]})
                near.append(rows)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "base": pa.array(base, pa.string()), "near": pa.array(near, places)})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    found = cut(rows.mapInArrow(find, f"id {id_type}, base string, near array<{PLACE}>"))
    dictionary = spark.sparkContext.broadcast(dictionary_of(found))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = primed(dictionary.value)
        for batch in batches:
            out = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_novel": []}
            for base, near in zip(batch.column("base").to_pylist(), batch.column("near").to_pylist(), strict=True):
                spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(","))] if base else []
                new = [("novel", p["start"], p["end"]) for p in near if any(novelty(*piece) >= novel for piece in pieces(p["before"], p["after"], p["own"]))]
                for kind in ("assign", "access", "hex"):
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                out["n_novel"].append(len(new))
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(_text_spans(sorted(spans + new, key=lambda s: (s[1], ORDER[s[0]]))))
            yield pa.RecordBatch.from_pydict({id_col: batch.column("id")} | {k: pa.array(v, pa.string() if k in ("spans", "base_sha256") else pa.int64()) for k, v in out.items()})

    return found.mapInArrow(weigh, f"`{id_col}` {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")


def dictionary_of(found: DataFrame) -> str:
    """The identifiers around candidates that most documents use, as many as fill `DICTIONARY_BYTES`; the most used last, as nearer content is cheaper to refer to."""
    sides = F.concat(F.transform("near", lambda p: p["before"]), F.transform("near", lambda p: p["after"]))
    names = F.array_distinct(F.flatten(F.transform(sides, lambda s: F.regexp_extract_all(s, F.lit(f"({_identifier.pattern})"), F.lit(1)))))
    counts = found.where(F.size("near") > 0).select(F.explode(names).alias("name")).groupBy("name").count().where(F.col("count") >= IN_DOCUMENTS)
    most = counts.orderBy(F.desc("count"), "name").limit(DICTIONARY_BYTES // 4).collect()  # a name has three characters and a border at least
    held, size = [], 0
    for name, _ in most:
        size += len(name) + 1
        if size > DICTIONARY_BYTES:
            break
        held.append(name)
    return "\n".join(reversed(held))
