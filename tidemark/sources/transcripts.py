"""Transcripts and benchmark questions as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import haystack_time

_LINE = "type string, message struct<role:string, content:string>"


def last_answers(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """(path, text): the last n assistant texts of each JSONL transcript, joined by blank lines. Content is a string or an array of blocks; lines that are no JSON are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = lines.withColumn("m", F.from_json("value", _LINE)).where((F.coalesce("m.message.role", "m.type") == "assistant") & F.col("m.message.content").isNotNull())
    blocks = F.filter(F.from_json("m.message.content", "array<struct<type:string, text:string>>"), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    text = F.when(F.col("m.message.content").startswith("["), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")).otherwise(F.col("m.message.content"))
    rows = rows.select("path", "block", "at", text.alias("text")).where(F.trim("text") != "")
    # Spark keeps the n newest lines of each part of a file before the files' rows meet.
    newest = rows.withColumn("back", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("block"), F.desc("at")))).where(F.col("back") <= n)
    last = newest.groupBy("path").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("turn"), "text"))).alias("last"))
    return last.select("path", F.array_join(F.transform("last", lambda x: x["text"]), "\n\n").alias("text"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, answer, expected, session, at, turn, role, text): every turn of every session of a file of benchmark questions."""
    schema = "question_id string, question_type string, question string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    sessions = rows.select("question_id", "question", "answer", F.col("answer_session_ids").alias("expected"), F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("s"))
    turns = sessions.select("question_id", "question", "answer", "expected", F.col("s.haystack_session_ids").alias("session"), haystack_time(F.col("s.haystack_dates")).alias("at"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return turns.select("question_id", "question", "answer", "expected", "session", "at", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"))
