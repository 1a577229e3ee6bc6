"""Toxicity's scores and spans against enumeration of all tags, and words that tell only when they come more than once."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import toxicity


def plain(model, text):
    """(score, spans) by the sum over all ways to tag the words."""
    raw = (text or "").encode()
    words = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    marks = b".,;:!?|\"'()[]*#"
    spans = []
    for m in words:
        a, b = m.span()
        for _ in range(3):
            b -= b - a > 1 and raw[b - 1] in marks
            a += b - a > 1 and raw[a] in marks
        spans.append((a, b))
    e = []
    for a, b in spans:
        data = np.frombuffer(raw[a:b], np.uint8)
        places = toxicity.features(data, np.array([0, len(data)]))[0]
        e.append(float(model.table[places[:, 0]].sum() + model.bias))
    total, p = 0.0, np.zeros(len(e))
    for tags in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(sum(x * t for x, t in zip(e, tags)) + sum(model.pair[i, j] for i, j in zip(tags, tags[1:])))
        total += w
        p += w * np.array(tags)
    p = p / total if len(e) else p
    seen = [np.log1p(p.sum()), np.log1p(-np.log1p(-np.minimum(p, 1 - 1e-6)).sum()), p.max(initial=0), np.sqrt(p.sum() / max(1, len(p))), 1.0]
    runs = []
    for k in np.flatnonzero(p >= 0.5):
        if runs and runs[-1][2] == k - 1:
            runs[-1] = (runs[-1][0], spans[k][1], k)
        else:
            runs.append((*spans[k], k))
    return 1 / (1 + np.exp(-np.dot(seen, model.weights))), [(a, b) for a, b, _ in runs]


def test_scores_and_spans_are_those_of_all_taggings(spark):
    rnd, rng = random.Random(3), np.random.default_rng(3)
    model = toxicity.Model(rng.normal(scale=0.8, size=toxicity.TABLE).astype(np.float32), -0.2, rng.normal(size=(2, 2)), rng.normal(size=5))
    words = ["plain", "(grim)", "vile,", "é" * 5, "x", "\"quoted\"", "...", "longerword"]
    texts = [None, "", " \n", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(40)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in toxicity.predicted(rows, model, spans=True).collect():
        score, spans = plain(model, texts[r["doc_id"]])
        assert r["score"] == pytest.approx(score, abs=1e-6) and [(s["first"], s["end"]) for s in r["spans"]] == spans


def test_a_beginning_that_tells_only_when_it_comes_again(spark):
    """Clean rows have one word of a kind at times, toxic ones three different ones, none of them in five rows."""
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    voc = ["".join(rnd.choice(letters) for _ in range(7)) for _ in range(2000)]
    docs, labels = [], []
    for k in range(600):
        words = [rnd.choice(voc) for _ in range(40)]
        for place in rnd.sample(range(40), 3 if k % 4 == 0 else k % 4 == 1):
            words[place] = "grim" + "".join(rnd.choice(letters) for _ in range(5))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    got = {r["doc_id"]: r for r in toxicity.scored(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    held = [(i, t) for i, t in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == t for i, t in held) >= 0.95 * len(held)
    for i, t in held:
        found = [dict(docs)[i][int(a) : int(b)] for a, b in (s.split(":") for s in got[i]["spans"].split(",") if s)]
        assert t == 0 or any(w.startswith("grim") for w in found)


def test_signs_count_a_text_once():
    own, signs = toxicity.occurring(np.array([5, 5, 7, 5]), np.array([0, 0, 0, 1]))
    assert sorted(zip(own.tolist(), signs.tolist())) == [(0, 5), (0, 7), (0, toxicity.TABLE + 5), (1, 5)]
    assert [len(x) for x in toxicity.occurring(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_blocks_are_whole_texts_and_tell_the_same():
    rng = np.random.default_rng(3)
    fresh = rng.random(5000) < 0.02
    fresh[0], fresh[1000:2500] = True, False
    e, pair = rng.normal(0, 2, 5000), rng.normal(0, 1, (2, 2))
    blocks = toxicity._blocks(fresh, 700)
    assert [b.start for b in blocks] == [0] + [b.stop for b in blocks[:-1]] and blocks[-1].stop == 5000 and len(blocks) > 5
    assert all(fresh[b.start] and (b.stop - b.start <= 700 or fresh[b].sum() == 1) for b in blocks)
    p, counts = toxicity.marginals(e, fresh, pair, counts=True)
    parts = [toxicity.marginals(e[b], fresh[b], pair, counts=True) for b in blocks]
    assert np.allclose(np.concatenate([x for x, _ in parts]), p, rtol=0, atol=1e-12)
    assert np.allclose(sum(x for _, x in parts), counts, rtol=1e-12)


def test_the_fit_holds_the_sample_a_few_times_over_at_most(spark, monkeypatch):
    descend = toxicity._adam
    monkeypatch.setattr(toxicity, "_adam", lambda grad, x, steps, rate: descend(grad, x, 2, rate))  # memory does not tell steps apart
    monkeypatch.setattr(toxicity, "FIT_WORDS", 50_000, raising=False)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, k % 2, " ".join(rng.choices(words, k=1000)) + " vile" * (k % 2)) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "id bigint, text string")
    labels = spark.createDataFrame([(k, t) for k, t, _ in rows], "id bigint, toxic int")
    tracemalloc.start()
    model = toxicity.fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model is not None
    assert most < 150 * 300_000  # bytes; the features of a word are 20
