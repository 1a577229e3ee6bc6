"""Clustering by slices of time against a plain loop, and captures of a stream against the batch and against a plain loop."""

import json

import numpy as np
import pandas as pd

from tidemark.operators import maintained, similarity
from tidemark.operators.lookup import hashed
from tidemark.streaming import ingest

DAY = 86_400
NOW = 1_700_000_000 // DAY * DAY


def plain_clusters(rows, least, width):
    """rows: (id, project, vector, at)."""
    unit = {r[0]: r[2] / max(np.linalg.norm(r[2]), 1e-300) for r in rows}
    clusters, out = {}, {}
    for turn in sorted({r[3] // width for r in rows}):
        new = sorted((r for r in rows if r[3] // width == turn), key=lambda r: r[0])
        frozen = {k: np.mean(v, 0) for k, v in clusters.items()}
        rest, placed = [], []
        for i, project, v, _ in new:
            near = [(-round(float(unit[i] @ (m / np.linalg.norm(m))), 9), k) for (p, k), m in frozen.items() if p == project]
            if near and -min(near)[0] >= least:
                placed.append((project, min(near)[1], i, v))
            else:
                rest.append((i, project, v))
        leaders = []
        for i, project, v in rest:
            own = next((k for k, p in leaders if p == project and unit[k] @ unit[i] >= least), None)
            if own is None:
                leaders.append((i, project))
            placed.append((project, i if own is None else own, i, v))
        for project, k, i, v in placed:
            clusters.setdefault((project, k), []).append(v)
            out[i] = k
    return out


def test_sliced_clusters(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 8))
    rows = [(k, "ab"[k % 2], centres[rng.integers(6)] + 0.4 * rng.standard_normal(8), NOW + int(rng.integers(5)) * DAY) for k in range(120)]
    table = spark.createDataFrame([(i, p, [float(x) for x in v], at) for i, p, v, at in rows] + [(500, "a", None, NOW)], "id long, project_id string, vector array<double>, created_at long")
    got = {r["id"]: r["cluster_id"] for r in similarity.sliced_clusters(table, 0.75, 2 * DAY).collect()}
    assert got == plain_clusters(rows, 0.75, 2 * DAY) and len(set(got.values())) > 6
    assert similarity.sliced_clusters(table.limit(0)).collect() == []


def test_maintained_centroids_after_additions_and_removals(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 3, [float(x) for x in rng.standard_normal(4)] if k % 7 else None) for k in range(60)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, cluster_id long, vector array<double>")
    sums = maintained.vector_sums(table)
    sums = maintained.with_change(sums, maintained.vector_sums(table.limit(0), table.where("k % 2 = 0 or cluster_id = 2")))
    sums = maintained.with_change(sums, maintained.vector_sums(table.where("k % 4 = 0 and cluster_id != 2")))
    left = table.where("(k % 2 = 1 or k % 4 = 0) and cluster_id != 2").withColumnRenamed("k", "id")
    want = {r["cluster_id"]: r for r in similarity.centroids(left.select("cluster_id", "id"), left.select("id", "vector").where("vector is not null")).collect()}
    got = {r["cluster_id"]: r for r in maintained.centroids(sums).collect()}
    assert got.keys() == want.keys() == {0, 1}
    for k in want:
        assert got[k]["member_count"] == want[k]["member_count"] and np.allclose(got[k]["centroid"], want[k]["centroid"], atol=1e-11)


def events():
    said = ["the build works now", "the build works now", "we chose spark for the joins", "THE build works NOW", "the sink writes once", "we chose spark for the joins", "vectors are kept", "a last remark"]
    return [{"project_id": "pq"[k % 3 == 0], "session_id": f"s{k}", "event": "SessionEnd", "message": said[k % len(said)] + (" again" if k == 9 else ""), "at": NOW + k * (DAY // 12)} for k in range(40)]


def plain_captures(rows, cap, skip):
    out, days = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["session_id"])):
        held = days.setdefault((r["project_id"], r["at"] // DAY), [])
        v = hashed([f"search_document: fact: {r['message']}"])[0].astype(float)
        v = v / np.linalg.norm(v)
        out[r["session_id"]] = "capped" if cap and len(held) >= cap else "skipped" if any(h @ v >= skip for h in held) else "stored"
        if out[r["session_id"]] == "stored":
            held.append(v)
    return out


def test_captures_are_deduplicated_in_batch_and_stream_alike(spark, tmp_path):
    rows = events()
    lines = [json.dumps(r) for r in rows]
    want = plain_captures(rows, 3, 0.95)
    assert set(want.values()) == {"capped", "skipped", "stored"}
    batch = ingest.with_vectors(ingest.outcomes(ingest.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))))
    assert {r["session_id"]: r["outcome"] for r in ingest.deduplicated(batch, cap=3).collect()} == want
    src = tmp_path / "in"
    src.mkdir()
    for part in range(2):
        (src / f"{part}.jsonl").write_text("\n".join(lines[part * 21 : part * 21 + 21]))
        stream = ingest.start(spark.readStream.text(str(src)), str(tmp_path / "out"), str(tmp_path / "ck"), cap=3, embed=hashed)
        assert stream.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert sorted(got["session_id"]) == sorted(k for k, v in want.items() if v == "stored")


def test_cap_of_a_day_that_is_dealt_into_parts(spark):
    rows = pd.DataFrame({"project_id": "p", "session_id": [f"s{k:04d}" for k in range(900)], "at": [NOW + k % 450 for k in range(900)], "outcome": "stored"})
    rows.loc[::5, "outcome"] = "short"
    got = ingest.capped(spark.createDataFrame(rows)).toPandas()
    good = rows[rows["outcome"] == "stored"].sort_values(["at", "session_id"])
    assert sorted(got[got["outcome"] == "stored"]["session_id"]) == sorted(good["session_id"][:50])
    assert (got["outcome"] == "short").sum() == 180 and (got["outcome"] == "capped").sum() == 720 - 50
    assert list(got.columns) == list(rows.columns)
