"""Handoffs that were kept as Markdown files under older headings, as handoffs of this store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Older headings, the section that each became, and the title it bears inside the notes if it was kept there.
HEADINGS = {
    "accomplished": ("summary", "Accomplished"),
    "not done / next steps": ("next_steps", None),
    "not done": ("next_steps", None),
    "next steps": ("next_steps", None),
    "key decisions": ("decisions", None),
    "decisions": ("decisions", None),
    "dead ends": ("blockers", None),
    "blockers": ("blockers", None),
    "open questions": ("notes", "Open questions"),
    "open questions for the user": ("notes", "Open questions"),
    "important context": ("mental_model", None),
    "mental model": ("mental_model", None),
    "working state at handoff": ("notes", "Working state"),
    "working state": ("notes", "Working state"),
    "summary": ("summary", None),
    "todos": ("todos", None),
    "notes": ("notes", None),
}
TITLES = {"summary": "Summary", "decisions": "Decisions", "todos": "Todos", "blockers": "Blockers", "mental_model": "Mental Model", "next_steps": "Next Steps", "notes": "Notes"}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the Markdown files under a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def handoffs(files: DataFrame, branch: str | None = None) -> DataFrame:
    """(id, branch, continues_from, text): files (path, text) as handoffs that `records.parsed` reads. Ids come from paths, so that a chain named by file names becomes one of ids.

    Text under headings that are not known goes to the notes, under its heading. What was accomplished is noted in whole, and its first paragraph
    is the summary; a file without a summary gets one that names the file.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.concat(F.lit("handoff-"), F.sha2("path", 256).substr(1, 16)).alias("id"), "path", name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    before = F.regexp_extract("text", r"(?m)^\*\*Continues from:\*\*\s*([^\s]+)", 1)
    before = F.element_at(F.split(F.regexp_replace(before, "^[`.,;: ]+|[`.,;: ]+$", ""), "/"), -1)
    own = F.nullif(F.regexp_extract("text", r"(?m)^\*\*Branch:\*\*\s*`?([^`\s]+)`?", 1), F.lit(""))
    heads = rows.select("id", "path", "name", F.coalesce(own, F.lit(branch).cast("string")).alias("branch"), F.when(~F.lower(before).isin("", "none", "n/a", "-"), before).alias("before"))

    chunks = rows.select("id", F.posexplode(F.split("text", r"(?m)^##[^\S\n]+")).alias("pos", "chunk")).where("pos > 0")
    heading, body = _stripped(F.regexp_extract("chunk", r"^([^\n]*)", 1)), F.regexp_replace(F.regexp_extract("chunk", r"(?s)^[^\n]*\n(.*)$", 1), "^\n+|\n+$", "")
    chunks = chunks.select("id", "pos", heading.alias("heading"), body.alias("body")).where(F.trim(F.regexp_replace("body", r"\s", "")) != "")
    key = _stripped(F.regexp_replace(F.lower("heading"), ":+$", ""))
    known = F.create_map(*[F.lit(x) for k, (section, title) in HEADINGS.items() for x in (k, f"{section}|{title or ''}")])
    to = F.when(F.col("heading").rlike(r"(?i)^update\s"), F.concat(F.lit("notes|Update: "), "heading")).otherwise(F.coalesce(known[key], F.concat(F.lit("notes|"), "heading")))
    placed = chunks.select("id", "pos", "body", F.substring_index(to, "|", 1).alias("section"), F.regexp_extract(to, r"(?s)^[^|]*\|(.*)$", 1).alias("title"))
    noted = F.when(F.col("title") != "", F.concat(F.lit("### "), "title", F.lit("\n"), "body")).otherwise(F.col("body"))
    first = F.element_at(F.filter(F.transform(F.split("body", "\n\n"), _stripped), lambda p: p != ""), 1)
    parts = placed.select("id", "pos", F.explode(F.when((F.col("section") == "summary") & (F.col("title") != ""), F.array(F.struct(F.lit("summary").alias("section"), first.alias("text")), F.struct(F.lit("notes").alias("section"), noted.alias("text")))).otherwise(F.array(F.struct("section", noted.alias("text"))))).alias("s"))
    # All parts of one file: no more than that file.
    sections = parts.groupBy("id").pivot("s.section", list(TITLES)).agg(_stripped(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s.text"))), lambda x: x["text"]), "\n\n")))
    full = heads.join(sections, "id", "left").withColumn("summary", F.when(F.coalesce("summary", F.lit("")) == "", F.concat(F.lit("Imported handoff from "), "name")).otherwise(F.col("summary")))
    blocks = [F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), s)) for s, title in TITLES.items()]
    ids = heads.groupBy(F.col("name").alias("before")).agg(F.min_by("id", "path").alias("continues_from"))
    return full.join(ids, "before", "left").select("id", "branch", "continues_from", F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n")).alias("text"))
