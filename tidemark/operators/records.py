"""Structured records: handoffs with their sections, todo items, decision records, and their rendering as Markdown."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.text import at_boundary, slug
from tidemark.operators import graph, ranking, scope
from tidemark.tables import InvalidArguments, InvalidType, NotFound

#: Sections of a handoff in their order, and whether each is a list.
SECTIONS = (("summary", False), ("decisions", True), ("todos", True), ("blockers", True), ("mental_model", False), ("tried", True), ("next_steps", True), ("notes", False))
LIST_SECTIONS = tuple(name for name, many in SECTIONS if many)
HANDOFF = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if many else T.StringType()) for n, many in SECTIONS])


def sections(handoffs: DataFrame) -> DataFrame:
    """(memory_id, section, text): the sections that say something, lists joined by line ends."""
    texts = [F.struct(F.lit(n).alias("section"), (F.array_join(n, "\n") if many else F.col(n)).alias("text")) for n, many in SECTIONS]
    return handoffs.select("memory_id", F.explode(F.array(*texts)).alias("s")).select("memory_id", "s.*").where(F.trim(F.coalesce("text", F.lit(""))) != "")


def section_warnings(handoffs: DataFrame, section_most: int = 5000, item_most: int = 1000) -> DataFrame:
    """(memory_id, section, size): sections, and items of lists, with more characters than they should have."""
    whole = sections(handoffs).select("memory_id", "section", F.char_length("text").alias("size")).where(F.col("size") > section_most)

    def sizes(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda t: F.struct(F.lit(name).alias("section"), F.char_length(t).alias("size")))

    items = [sizes(n) for n in LIST_SECTIONS]
    single = handoffs.select("memory_id", F.explode(F.concat(*items)).alias("s")).select("memory_id", "s.*").where(F.col("size") > item_most)
    return whole.unionByName(single)


def scored_sections(handoffs: DataFrame, vector: Sequence[float], section: str | None = None) -> DataFrame:
    """(memory_id, section, score): cosine of each section's vector with the query."""
    rows = handoffs.select("memory_id", F.explode("sections").alias("s")).select("memory_id", "s.section", "s.vector")
    if section:
        rows = rows.where(F.lower("section") == section.lower())
    return rows.select("memory_id", "section", ranking.cosine_to(vector)("vector").alias("score"))


def handoff_search(handoffs: DataFrame, memories: DataFrame, vector: Sequence[float], project: str, branch: Column | None = None, section: str | None = None, latest: int = 200, limit: int = 10) -> DataFrame:
    """The best sections among the latest handoffs of the branch."""
    recent = latest_handoffs(memories, project, branch, latest)
    rows = scored_sections(handoffs.join(recent.select(F.col("id").alias("memory_id")), "memory_id", "left_semi"), vector, section)
    return rows.orderBy(F.desc("score"), "memory_id", "section").limit(limit)


def latest_handoffs(memories: DataFrame, project: str, branch: Column | None = None, limit: int = 10) -> DataFrame:
    rows = memories.where(scope.in_project(project) & (F.col("memory_type") == "handoff") & (F.lit(True) if branch is None else branch))
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def resume(handoffs: DataFrame, memories: DataFrame, todos: DataFrame, relationships: DataFrame, vector: Sequence[float], project: str, branch: Column | None = None, most: int = 5, width: int = 1500) -> dict[str, DataFrame]:
    """What a session that goes on needs: the chain of the newest handoff, its best sections cut to width, open todos, blockers, and what it was derived from."""
    newest = latest_handoffs(memories, project, branch, 1).select("id").first()
    if newest is None:
        raise NotFound("there is no handoff to resume")
    start = newest[0]
    path = graph.chain(handoffs.select(F.col("memory_id").alias("id"), F.col("continues_from").alias("next")), start)
    own = handoffs.where(F.col("memory_id") == start)
    best = scored_sections(own, vector).join(sections(own), ["memory_id", "section"]).orderBy(F.desc("score"), "section").limit(most)
    open_items = todo_list(todos, memories, project, branch).where("status = 'open'").limit(100)
    kin = graph.linked(relationships, start).join(memories.where(~F.array_contains("tags", "hook")), "id")
    return {
        "chain": path.orderBy("position"),
        "sections": best.withColumn("text", at_boundary(F.col("text"), width)),
        "open_todos": open_items,
        "blockers": own.select(F.explode("blockers").alias("blocker")),
        "linked": kin.select("id", F.substring("content", 1, 300).alias("preview")),
    }


def auto_links(handoff_sections: DataFrame, memories: DataFrame, embeddings: DataFrame, project: str, least: float = 0.75, most: int = 10, candidates: int = 1000) -> DataFrame:
    """(id, score) of decisions, patterns and debug notes that a section of the handoff is near to, the best of each: edges to derive from. handoff_sections: (section, vector), eight at most."""
    pool = memories.where(scope.in_project(project) & F.col("memory_type").isin("decision", "pattern", "debug") & ~F.array_contains("tags", "hook")).orderBy(F.desc("created_at"), "id").limit(candidates)
    rows = pool.select("id").join(embeddings, "id")
    each = None
    for row in handoff_sections.limit(len(SECTIONS)).collect():
        near = rows.select("id", ranking.cosine_to(row["vector"])("vector").alias("score"))
        each = near if each is None else each.unionByName(near)
    return each.groupBy("id").agg(F.max("score").alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(most)


def todo_list(todos: DataFrame, memories: DataFrame, project: str, branch: Column | None = None, status: str | None = None) -> DataFrame:
    rows = todos.join(memories.withColumnRenamed("id", "memory_id"), "memory_id").where(scope.in_project(project) & (F.lit(True) if branch is None else branch))
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.select("memory_id", "status", "reason", "content", "branch", "created_at", "closed_at").orderBy(F.desc("created_at"), "memory_id")


#: How near an open item is that an added one may repeat, and how many of them are told.
NEAR_TODO, NEAR_TODOS = 0.97, 3


def near_todos(todos: DataFrame, embeddings: DataFrame, vector: Sequence[float], least: float = NEAR_TODO, most: int = NEAR_TODOS) -> DataFrame:
    """Open items that say almost the same; they are reported, never merged."""
    rows = todos.where("status = 'open'").select(F.col("memory_id").alias("id")).join(embeddings, "id").select("id", ranking.cosine_to(vector)("vector").alias("score"))
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(most)


def supersession_candidates(memories: DataFrame, embeddings: DataFrame, vector: Sequence[float], project: str, memory_type: str, exclude: Sequence = (), least: float = 0.75, most: int = 5) -> DataFrame:
    """Records of the type that a new one may replace."""
    pool = memories.where(scope.in_project(project) & (F.col("memory_type") == memory_type))
    pool = pool.where(~F.col("id").isin(*exclude)) if exclude else pool
    rows = pool.join(embeddings, "id").select("id", ranking.cosine_to(vector)("vector").alias("score"), F.substring("content", 1, 160).alias("preview"))
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(most)


def adr_list(adrs: DataFrame, project: str, status: str | None = None) -> DataFrame:
    rows = adrs.where(F.col("project_id") == project)
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy("adr_number")


def superseded_adr(adrs: DataFrame, number: int, project: str) -> DataFrame:
    """Decision records after a successor of number came: it turns superseded, if it was accepted."""
    flip = (F.col("project_id") == project) & (F.col("adr_number") == number) & (F.col("status") == "accepted")
    return adrs.withColumn("status", F.when(flip, "superseded").otherwise(F.col("status")))


def adr_markdown(adrs: DataFrame) -> DataFrame:
    """(path, text) of each decision record. Numbers have four digits, or as many as they need."""
    digits = F.col("adr_number").cast("string")
    number = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    head = F.concat(F.lit("# ADR "), number, F.lit(": "), "title")
    body = [F.concat(F.lit(f"## {name}\n\n"), F.coalesce(col, F.lit(""))) for name, col in (("Status", "status"), ("Context", "context"), ("Decision", "decision"), ("Consequences", "consequences"))]
    return adrs.select(F.concat(number, F.lit("-"), slug(F.col("title")), F.lit(".md")).alias("path"), F.concat_ws("\n\n", head, *body).alias("text"))


def _under(text: Column, heading: str) -> Column:
    """What stands under the last heading of a name, up to the next one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?ms)^## [ \t]*{heading}[ \t]*$\n?(.*?)(?=^## |\z)"), F.lit(1))
    return F.regexp_replace(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), r"^\s+|\s+$", "")


def parsed_adrs(markdown: DataFrame) -> DataFrame:
    """(id, title, context, decision, consequences, valid) of decision records as Markdown (id, text).

    The title is the last heading of the first level, without its number; a section is what stands under its last heading
    of the second level, and empty if there is none. Number, status and date are columns of their own and not read. A record
    without a title or a decision, null and empty texts among them, is not valid.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    title = F.trim(F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?m)^# (.*)$"), F.lit(1)), F.lit(-1)), F.lit("")))
    title = F.regexp_replace(title, r"^(ADR [0-9]+: |[0-9]*\. )", "")
    rows = markdown.select("id", title.alias("title"), F.regexp_replace(text, r"(?m)^# .*$\n?", "").alias("__body"))
    rows = rows.select("id", "title", *[_under(F.col("__body"), name).alias(name.lower()) for name in ("Context", "Decision", "Consequences")])
    return rows.withColumn("valid", (F.col("title") != "") & (F.col("decision") != ""))


def checked_adrs(markdown: DataFrame) -> DataFrame:
    """Decision records of Markdown (id, text), all of them valid."""
    rows = parsed_adrs(markdown)
    if not rows.where(~F.col("valid")).isEmpty():
        raise InvalidType("adr: malformed sections")
    return rows.drop("valid")


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def rendered(handoffs: DataFrame) -> DataFrame:
    """(memory_id, content): handoffs as Markdown, sections in order, lists as dashes."""
    parts = []
    for name, many in SECTIONS:
        text = F.concat_ws("\n", F.transform(name, lambda t: F.concat(F.lit("- "), t))) if many else F.col(name)
        there = (F.size(name) > 0) if many else (F.trim(F.coalesce(name, F.lit(""))) != "")
        parts.append(F.when(there, F.concat(F.lit(f"## {_title(name)}\n\n"), text)))
    return handoffs.select("memory_id", F.concat_ws("\n\n", *parts).alias("content"))


def _parse(text: str) -> dict:
    names = {_title(n).lower(): (n, many) for n, many in SECTIONS}
    found: dict = {n: [] if many else None for n, many in SECTIONS}
    name, many, lines = None, False, []

    def close() -> None:
        if name is None:
            return
        if many:
            found[name].extend(x.strip()[2:].strip() if x.strip()[:2] in ("- ", "* ") else x.strip() for x in lines if x.strip())
        else:
            found[name] = "\n".join(lines).strip() or None

    for line in (text or "").splitlines():
        if line.startswith("## "):
            close()
            name, many = names.get(line[3:].strip().lower(), (None, False))
            lines = []
        else:
            lines.append(line)
    close()
    return found


def parsed(markdown: DataFrame) -> DataFrame:
    """(id, sections..., valid) of Markdown handoffs (id, text); a handoff without a summary is not valid."""
    parse = F.pandas_udf(lambda s: pd.DataFrame([_parse(t) for t in s], columns=[n for n, _ in SECTIONS]), HANDOFF)
    return markdown.select("id", parse("text").alias("h")).select("id", "h.*").withColumn("valid", F.col("summary").isNotNull())


def checked_handoffs(handoffs: DataFrame) -> DataFrame:
    """Handoffs that may be stored: with a summary, and without todos, which are records of their own."""
    if not handoffs.where(F.trim(F.coalesce("summary", F.lit(""))) == "").isEmpty():
        raise InvalidArguments("a handoff needs a summary")
    if not handoffs.where(F.size(F.coalesce("todos", F.array().cast("array<string>"))) > 0).isEmpty():
        raise InvalidArguments("todos are written as todo items, not in a handoff")
    return handoffs


def newest_per_branch(memories: DataFrame) -> DataFrame:
    """The newest handoff of each project and branch."""
    newest = Window.partitionBy("project_id", "branch").orderBy(F.desc("created_at"), "id")
    return memories.where("memory_type = 'handoff'").withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
