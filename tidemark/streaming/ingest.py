"""Hook events: what becomes of each, as a batch, and as a stream whose daily cap is kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tidemark.functions.text import CUES, redacted
from tidemark.operators.lookup import hashed

EVENTS = "project_id string, session_id string, event string, prompt string, reason string, agent_type string, message string, at bigint, transcript_path string"
#: Events that are looked at unless the caller says otherwise; the two others are off.
ENABLED = ("SessionStart", "SessionEnd", "PostToolUse", "Stop", "PreCompact")
CAP, PROMPT_BYTES, AGENT_BYTES, END_BYTES = 50, 40, 200, 4000
#: Parts that a day's events are dealt into under the cap, and how near a capture is skipped.
PARTS, SKIP = 64, 0.95
#: How late an event of a stream may come.
LATE = "7 days"


def parsed(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (value); what is no JSON, or empty, has a null event."""
    return lines.select(F.from_json("value", EVENTS).alias("e")).select("e.*")


def with_answers(events: DataFrame, answers: DataFrame) -> DataFrame:
    """Events whose sessions' transcripts were read: at its end, a session's message is the last answer in its transcript. answers: (path, text), as `transcripts.last_answers` gives them."""
    bare = lambda path: F.regexp_replace(path, "^file:/+", "/")
    said = answers.select(bare(F.col("path")).alias("said_in"), F.col("text").alias("said"))
    ends = (F.col("event") == "SessionEnd") & (bare(F.col("transcript_path")) == F.col("said_in"))
    return events.join(said, ends, "left").withColumn("message", F.coalesce("said", "message")).select(events.columns)


def _cut(text: Column, most: int) -> Column:
    """At most `most` bytes, cut between characters, with an ellipsis if any are missing."""
    cut = F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), 1, most), "UTF-8"), "�+$", "")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def outcomes(events: DataFrame, enabled=ENABLED) -> DataFrame:
    """events with `outcome` (stored or why not), `content`, `importance` and `memory_type`; the daily cap comes after."""
    kind, prompt, message = F.col("event"), F.coalesce("prompt", F.lit("")), F.coalesce("message", F.lit(""))
    asked = prompt.contains("#remember") | prompt.rlike(CUES)
    outcome = (
        F.when(kind.isNull(), "unreadable")
        .when(~kind.isin(*enabled), "disabled")
        .when(kind == "UserPromptSubmit", F.when(F.octet_length(prompt) < PROMPT_BYTES, "short").when(~asked, "no cue").otherwise("stored"))
        .when(kind == "SessionEnd", F.when(F.col("reason").isin("clear", "resume"), "reason").when(F.trim(message) == "", "nothing said").otherwise("stored"))
        .when(kind == "SubagentStop", F.when(F.octet_length(message) < AGENT_BYTES, "short").otherwise("stored"))
        .otherwise("nothing to do")
    )
    content = F.when(kind == "UserPromptSubmit", redacted(prompt)).otherwise(_cut(redacted(message), END_BYTES))
    importance = F.when(kind == "SessionEnd", 0.4).when(kind == "SubagentStop", 0.5).otherwise(0.5)
    rows = events.withColumn("outcome", outcome)
    stored = F.col("outcome") == "stored"
    return rows.withColumn("content", F.when(stored, content)).withColumn("importance", F.when(stored, importance)).withColumn("memory_type", F.when(stored, "fact"))


def capped(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Outcomes of a batch under the daily cap of each project; 0 means none."""
    if not cap:
        return rows
    day = ("project_id", F.floor(F.col("at") / 86400), F.col("outcome") == "stored")
    # The first of each of some parts of a day: only these can be among the first of the day, and the others stay in their parts, so that no task holds a day.
    part = F.pmod(F.xxhash64("at", "session_id"), F.lit(PARTS))
    rows = rows.withColumn("__part", part).withColumn("__turn", F.row_number().over(Window.partitionBy(*day, "__part").orderBy("at", "session_id")))
    rows = rows.withColumn("__part", F.when(F.col("__turn") > cap, F.col("__part")).otherwise(-1))
    turn = F.when(F.col("__part") < 0, F.row_number().over(Window.partitionBy(*day, "__part").orderBy("at", "session_id"))).otherwise(cap + 1)
    rows = rows.withColumn("__turn", turn).drop("__part")
    turn = F.col("__turn")
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "stored") & (turn > cap), "capped").otherwise(F.col("outcome")))
    return rows.drop("__turn")


def _days(rows: DataFrame) -> DataFrame:
    """What a stream is to store, with its day, and a watermark by which days end."""
    good = rows.where("outcome = 'stored'").withColumn("day", F.floor(F.col("at") / 86400))
    return good.withColumn("moment", F.timestamp_seconds("at")).withWatermark("moment", LATE)


def capped_stream(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """(project_id, day, at, content, importance) of a stream of outcomes, at most cap a project and day, whatever batches they come in.

    The state is one number for each project and day. It goes when the stream's newest event is `LATE` past the day; what comes later than that is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["at", "content"])
        taken = rows if not cap else rows.iloc[: max(0, cap - n)]
        state.update((n + len(taken),))
        state.setTimeoutTimestamp((int(key[1]) + 1) * 86_400_000)
        yield pd.DataFrame({"project_id": key[0], "day": key[1], "at": taken["at"], "content": taken["content"], "importance": taken["importance"]})

    good = _days(rows)
    schema = "project_id string, day bigint, at bigint, content string, importance double"
    return good.groupBy("project_id", "day").applyInPandasWithState(run, schema, "n long", "append", GroupStateTimeout.EventTimeTimeout)


class _Day:
    """A project's day: how many captures were stored, and their vectors, at length 1."""

    def __init__(self, n: int = 0, held: list | None = None):
        self.n, self.held = n, [np.asarray(v, np.float64) for v in held or []]

    def outcome(self, vector, cap: int, skip: float) -> str:
        """What becomes of the next capture: capped, skipped, if one as near was stored that day, or stored."""
        if cap and self.n >= cap:
            return "capped"
        v = np.zeros(0) if vector is None else np.asarray(vector, np.float64)
        norm = np.sqrt(v @ v) if len(v) else 0.0
        v = v / norm if norm else v
        if norm and any(len(h) == len(v) and h @ v >= skip for h in self.held):
            return "skipped"
        self.n += 1
        if norm:
            self.held.append(v)
        return "stored"


_ORDER = ["at", "session_id", "content"]


def deduplicated(rows: DataFrame, cap: int = CAP, skip: float = SKIP) -> DataFrame:
    """Outcomes of a batch under the daily cap, in which a capture (with `vector`) is skipped that is as near as `skip` to one stored on its project's day.

    Days are read as sorted streams: a task holds one day's stored vectors, `cap` of them at most (all of the day's without a cap).
    """
    good = rows.where("outcome = 'stored'").withColumn("day", F.floor(F.col("at") / 86400))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, day = None, _Day()
        for batch in batches:
            told = []
            for own, vector in zip(zip(batch["project_id"], batch["day"], strict=True), batch["vector"], strict=True):
                if own != key:
                    key, day = own, _Day()
                told.append(day.outcome(vector, cap, skip))
            yield batch.drop(columns="day").assign(outcome=told)

    dealt = good.repartition("project_id", "day").sortWithinPartitions("project_id", "day", *_ORDER)
    return rows.where("outcome is null or outcome != 'stored'").unionByName(dealt.mapInPandas(run, schema).select(rows.columns))


def deduplicated_stream(rows: DataFrame, cap: int = CAP, skip: float = SKIP) -> DataFrame:
    """(project_id, day, at, session_id, content, importance, vector): what `deduplicated` would store of a stream of outcomes with vectors, whatever batches they come in.

    The state of a project and day is its number of stored captures and their vectors; it goes as that of `capped_stream` does.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        day = _Day(*state.get) if state.exists else _Day()
        rows = pd.concat(list(batches)).sort_values(_ORDER, na_position="first")
        taken = rows[[day.outcome(v, cap, skip) == "stored" for v in rows["vector"]]]
        state.update((day.n, [v.tolist() for v in day.held]))
        state.setTimeoutTimestamp((int(key[1]) + 1) * 86_400_000)
        yield pd.DataFrame({"project_id": key[0], "day": key[1], **{c: taken[c] for c in ("at", "session_id", "content", "importance", "vector")}})

    good = _days(rows).withColumn("vector", F.col("vector").cast("array<double>"))
    schema = "project_id string, day bigint, at bigint, session_id string, content string, importance double, vector array<double>"
    return good.groupBy("project_id", "day").applyInPandasWithState(run, schema, "n long, held array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)


def with_vectors(rows: DataFrame, embed=hashed) -> DataFrame:
    """Outcomes with the vector of what is to be stored, by any embedder of texts."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([v.tolist() for v in np.asarray(embed([t or "" for t in texts.to_pylist()]), np.float64)], pa.list_(pa.float64()))

    return rows.withColumn("vector", vectors(F.concat(F.lit("search_document: fact: "), F.coalesce("content", F.lit("")))))


def start(lines: DataFrame, folder: str, checkpoint: str, enabled=ENABLED, cap: int = CAP, embed=None):
    """A query that writes captured records as Parquet, once for what is there: exactly once by the sink's log and the checkpoint. With an embedder, near repeats of a day are skipped."""
    found = outcomes(parsed(lines), enabled)
    out = capped_stream(found, cap) if embed is None else deduplicated_stream(with_vectors(found, embed), cap)
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
