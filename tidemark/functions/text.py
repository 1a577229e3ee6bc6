"""Scalar text functions: what built-in functions can say as columns, the rest as Arrow-batched functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MAX_SUMMARY, AUTO_SUMMARY_BYTES = 150, 500
#: The words that are never keywords, the patterns of secrets, and the cues of a prompt worth keeping.
STOP_WORDS = tuple(
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need "
    "it its this that these those i you he she we they what which who when where why how all each every both few more most other some such no nor not only own same so than "
    "too very just also now here there then once if while although because until unless about into through during before after above below between under again further any am being".split()
)
SECRETS = (
    r"\bAKIA[0-9A-Z]{16}\b",
    r"""(?i)aws[_-]?secret[_-]?access[_-]?key["'\s:=]+[A-Za-z0-9/+=]{40}""",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    r"\bsk-[A-Za-z0-9]{20,}\b",
)
ASSIGNMENT = r"(?i)\b([A-Z][A-Z0-9_]*_(?:KEY|SECRET|TOKEN)|PASSWORD)(\s*=)\s*\S+"
CUES = r"(?i)\b(decided?|chose|prefer(?:s|red|ence)?|switch(?:ed)? to)\b"


def redacted(text: Column) -> Column:
    """The text without secrets; of an assignment, the name stays."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return F.regexp_replace(text, ASSIGNMENT, "$1$2[REDACTED]")


def first_line(text: Column, width: int = 120) -> Column:
    """The first line that is not blank."""
    return F.substring(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[^\S\n]*(\S.*)$", 1)), 1, width)


def truncated(text: Column, most: int) -> Column:
    """The text, or its beginning and an ellipsis if it has more than `most` bytes."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case ASCII letters and digits with single dashes between, cut at a dash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    head = F.substring(plain, 1, most)
    whole = F.substring(plain, most + 1, 1).isin("-", "")
    return F.when(whole | ~head.contains("-"), F.regexp_replace(head, "-$", "")).otherwise(F.regexp_replace(head, "-[^-]*$", ""))


def words(text: Column) -> Column:
    """Keyword candidates: letters and digits of each run between white space, lower-cased, of three bytes at least and no stop word."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.filter(bare, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP_WORDS))


def keywords(docs: DataFrame, n: int = 3) -> DataFrame:
    """(id, rank, word, n): the most frequent words of each record (id, content), the smaller of equals first."""
    counts = docs.select("id", F.explode(words(F.col("content"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "rank", "word", "n")


def _sentence(text: str) -> str:
    text = text.strip()
    for mark in re.finditer(r"[.!?]", text):
        if not mark.start():
            continue
        last = text[: mark.start()].split()
        if last and len(last[-1].encode()) <= 4 and last[-1][0].isupper():
            continue  # an abbreviation
        return text[: mark.end()]
    head, newline, _ = text.partition("\n")
    return head if newline else text[:MAX_SUMMARY]


@F.pandas_udf(T.StringType())
def first_sentence(texts: pd.Series) -> pd.Series:
    return texts.map(_sentence, na_action="ignore")


def _top_words(text: str, n: int = 3) -> list[str]:
    counts: dict[str, int] = {}
    for w in text.split():
        w = "".join(c for c in w if c.isalnum()).lower()
        if len(w.encode()) >= 3 and w not in STOP_WORDS:
            counts[w] = counts.get(w, 0) + 1
    return sorted(counts, key=lambda w: (-counts[w], w))[:n]


def _summary(text: str) -> str:
    sentence = _sentence(text)
    if len(sentence) < 130:
        marked = f"{sentence} [{', '.join(_top_words(text))}]"
        return marked if len(marked) <= MAX_SUMMARY and _top_words(text) else sentence
    if len(sentence) <= MAX_SUMMARY:
        return sentence
    head = sentence[: MAX_SUMMARY - 3]
    return head.rpartition(" ")[0] + "..." if " " in head else head + "..."


@F.pandas_udf(T.StringType())
def summary(texts: pd.Series) -> pd.Series:
    """The first sentence, with up to three keywords if there is room."""
    return texts.map(_summary, na_action="ignore")


def auto_summary(content: str = "content", given: str = "summary") -> Column:
    return F.when(F.col(given).isNull() & (F.octet_length(content) > AUTO_SUMMARY_BYTES), summary(content)).otherwise(F.col(given))


def _cut(text: str, most: int) -> str:
    if not most or len(text) <= most:
        return text
    marker = f"\n… [truncated, {len(text)} chars total]"
    room = text[: max(0, most - len(marker))]
    ends = [room.rfind(b) + len(b) for b in ("\n\n", ". ", "! ", "? ", "\n") if b in room]
    at = max((e for e in ends if 2 * e >= len(room)), default=0)
    return (room[:at].rstrip() if at else room) + marker


def at_boundary(text: Column, most: int) -> Column:
    """The text cut to `most` characters, a note on its length among them, at the end of a paragraph, sentence or line that keeps half of it or more."""
    return F.pandas_udf(lambda s: s.map(lambda t: _cut(t, most), na_action="ignore"), T.StringType())(text)


def haystack_time(text: Column) -> Column:
    """Seconds since 1970 of `2023/05/20 (Sat) 02:21`, UTC."""
    return F.unix_timestamp(F.regexp_replace(text, r"\s*\([A-Za-z]+\)\s*", " "), "yyyy/MM/dd HH:mm")


def session_of(tags: Column) -> Column:
    """The name in the first tag `session:NAME`."""
    return F.regexp_extract(F.element_at(F.filter(tags, lambda t: t.rlike("^session:.+$")), 1), "^session:(.+)$", 1)
