"""Decision records read from Markdown, samples against the hash itself, errors by kind, files of decision records."""

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import decisions, records
from tidemark.tables import InvalidType, NotFound, StoreError


def test_decision_records_from_markdown(spark):
    texts = [
        "# 0007. Use a queue. Now\n\n## Status\n\naccepted\n\n## Context\n\n a\n\nb \n\n## Decision\r\n\r\nd\n## Consequences\n\nc",
        "# Title\n## Decision\nfirst\n## Other\nx\n## Decision \nsecond\n# 12. Last title\nmore\n",
        "# v1. Not a number\n## Decision\nd",
        "## Decision\nno title",
        "# No decision\n## Context\n### Decision\nd",
        "",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [tuple(r) for r in records.parsed_adrs(rows).orderBy("id").collect()]
    assert got == [
        (0, "Use a queue. Now", "a\n\nb", "d", "c", True),
        (1, "Last title", "", "second\nmore", "", True),
        (2, "v1. Not a number", "", "d", "", True),
        (3, "", "", "no title", "", False),
        (4, "No decision", "### Decision\nd", "", "", False),
        (5, "", "", "", "", False),
        (6, "", "", "", "", False),
    ]
    assert records.checked_adrs(rows.where("id < 3")).count() == 3
    with pytest.raises(InvalidType):
        records.checked_adrs(rows)
    long = spark.createDataFrame([(1, "# t\n## Context\n" + "line\n" * 200_000 + "## Decision\nd")], "id int, text string")
    assert records.parsed_adrs(long).select(F.length("context"), "decision").first() == (200_000 * 5 - 1, "d")


def test_samples_follow_the_seeded_hash(spark):
    names = [f"q{k}" for k in range(500)]
    got = [r[0] for r in metrics.sampled(spark.createDataFrame([(n,) for n in names], "question_id string"), 40).collect()]
    seed = xxhash.xxh64((42).to_bytes(4, "little"), seed=42).intdigest()
    signed = lambda n: (h := xxhash.xxh64(n.encode(), seed=seed).intdigest()) - (h >> 63 << 64)
    assert got == sorted(names, key=lambda n: (signed(n), n))[:40]


def test_errors_tell_their_kind(spark):
    assert issubclass(NotFound, StoreError) and issubclass(InvalidType, StoreError)
    none = spark.createDataFrame([], "id string, memory_type string, project_id string, branch string, created_at bigint")
    with pytest.raises(NotFound):
        records.resume(None, none, None, None, [0.0], "p")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_decision_records_become_files(spark, tmp_path, scheme):
    rows = [(1, "accepted", "One thing", "a", "b", "c"), (2, "proposed", "Été", None, "b", None)]
    adrs = spark.createDataFrame(rows, "adr_number int, status string, title string, context string, decision string, consequences string")
    folder = tmp_path / "adr"
    files = {r["path"].rsplit("/", 1)[1]: r["text"] for r in decisions.written(adrs, f"{scheme}{folder}", apply=True).collect()}
    assert len(files) == 2 and {p.name: p.read_text("utf-8") for p in folder.iterdir()} == files
