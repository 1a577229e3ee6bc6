"""Models and bounds against plain versions of themselves, and operators on odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, langid, piece_bpe, suffix_dedup, toxicity, url_filter, warc
from tidemark.llm.queries import tokenizer

DOCS = "doc_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"


def odd(df):
    """df with further columns under names that the operators use themselves."""
    names = ("id", "__id", "mark", "n", "digest", "host", "path", "site", "score", "key", "turn", "label", "pos", "data")
    for name in names:
        df = df if name in df.columns else df.withColumn(name, F.lit("mine"))
    return df


def grams(text):
    b = text.lower().encode()
    return {b[i : i + n] for n in langid.ORDERS for i in range(len(b) - n + 1)}


def test_language_is_kernel_ridge(spark):
    """With every row a landmark, the scores are those of kernel ridge regression over all pairs, solved in its dual form."""
    rnd = random.Random(3)
    voc = {"en": ["the", "house", "with", "water"], "de": ["haus", "der", "wasser", "mit"], "fr": ["maison", "avec", "eau", "les"]}
    known = [(k, " ".join(rnd.choices(voc[lang] + ["x", "of", "la"], k=12)), lang) for k, lang in enumerate(["en"] * 20 + ["de"] * 12 + ["fr"] * 8)]
    asked = [(100 + k, " ".join(rnd.choices(voc[lang], k=9))) for k, lang in enumerate(["en", "de", "fr"] * 5)]
    model = langid.fit(spark.createDataFrame(known, "id bigint, text string, lang string"), landmarks=10_000)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predicted(spark.createDataFrame(asked, DOCS), model).collect()}

    own = [grams(t) for _, t, _ in known]
    like = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[like(a, b) for b in own] for a in own])
    names = sorted(voc)
    y = np.array([[1.0 if lang == x else -1.0 for x in names] for _, _, lang in known])
    n = len(own)
    h = np.eye(n) - 1 / n
    weight = np.array([1 / sum(x[2] == row[2] for x in known) for row in known])
    c = np.diag(weight * n / weight.sum())
    alpha = np.linalg.solve(c @ h @ k @ h + langid.RIDGE * n / 10 * np.eye(n), c @ (y - y.mean(0)))
    for i, t in asked:
        row = np.array([like(grams(t), b) for b in own])
        f = y.mean(0) + (row - row.mean() - k.mean(0) + k.mean()) @ alpha
        assert got[i][0] == names[f.argmax()] and got[i][1] == pytest.approx(np.clip((f.max() + 1) / 2, 0, 1), abs=0.02)


@pytest.mark.parametrize(("a", "b"), [(1.0, 1.0), (5.0, 2.0), (2.0, 40.0), (1.5, 3.0), (700.0, 650.0), (51234.0, 50500.0), (3e6, 3.001e6)])
def test_mass_of_the_beta_distribution(a, b):
    t = (np.arange(2_000_000) + 0.5) / 2_000_000
    f = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    f = np.exp(f - f.max())
    for x in (0.25, 0.5):
        assert url_filter.mass_below(np.array([a]), np.array([b]), x)[0] == pytest.approx(f[: int(x * 2_000_000)].sum() / f.sum(), abs=1e-5)


def test_registered_domains(spark):
    want = {
        "a.b.bbc.co.uk": ("co.uk", "bbc.co.uk"),
        "u:p@shop.example.com:8080": ("com", "example.com"),
        "example.com.": ("com", "example.com"),
        "co.uk": ("co.uk", "co.uk"),
        "10.0.0.1:80": ("", "10.0.0.1"),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
    }
    suffix, domain = url_filter.levels(url_filter.site(F.col("host")))
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(h,) for h in want], "host string").select("host", suffix, domain).collect()}
    assert got == want


def test_neighbours_under_a_two_level_suffix_do_not_share_a_name(spark):
    pages = [(k, f"http://p{k}.bad.co.uk/") for k in range(60)] + [(100 + k, f"http://p{k}.good.co.uk/") for k in range(60)] + [(300, "http://new.bad.co.uk/"), (301, "http://me@new.good.co.uk:80/")]
    labels = [(k, 0, 0) for k in range(60)] + [(100 + k, 1, 0) for k in range(60)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(odd(spark.createDataFrame(pages, "page_id bigint, url string")), odd(spark.createDataFrame(labels, LABELS))).collect()}
    assert got[300] == "block" and got[301] == "allow"


def test_rules_that_tie_in_none_but_length(spark):
    rules = (("allow", "a.com/x"), ("block", "com/xyz12"), ("block", "a.com/x/y"))
    pages = [(1, "http://a.com/x/y/z"), (2, "http://a.com/xyz12"), (3, "http://b.com/x"), (4, "http://a.com/x"), (4, "http://a.com/x")]
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judged(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame([], LABELS), rules).collect() if r["page_id"] != 3)
    assert got == [(1, "a.com/x/y", "block"), (2, "com/xyz12", "block"), (4, "a.com/x", "allow"), (4, "a.com/x", "allow")]


ROWS = [(1, "the house with water " * 3), (2, None), (3, ""), (4, " \n"), (None, "the water"), (None, None), (5, "x" * 200_000), (6, "du bist idiot"), (6, "du bist idiot")]


def operators(spark):
    lang = lambda df: langid.identified(df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en")))
    labels = odd(spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, None, None), (6, 0, 1)], LABELS))
    return {
        "langid": lang,
        "toxicity": lambda df: toxicity.scored(df, labels),
        "pieces": lambda df: piece_bpe.encoded(df, tokenizer()),
        "suffixes": suffix_dedup.measured,
        "chunks": lambda df: chunk_dedup.measured(df, extend=True),
    }


@pytest.mark.parametrize("name", ["langid", "toxicity", "pieces", "suffixes", "chunks"])
def test_odd_tables(spark, name):
    """Null ids and texts, empty and long texts, repeated rows, other columns of the same names, and no rows at all."""
    run = operators(spark)[name]
    got = run(odd(spark.createDataFrame(ROWS, DOCS))).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert run(odd(spark.createDataFrame([], DOCS))).count() == 0


def test_borders_are_the_least_gear_hashes_of_each_text_alone():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcd \u00e9") for _ in range(n)).encode() for n in (0, 5, 31, 120, 400, 0, 130, 900)] + [b"a" * 300]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    first, end, of = chunk_dedup.seeds(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for k, t in enumerate(texts):
        got = [(int(a - offsets[k]), int(b - offsets[k])) for a, b, o in zip(first, end, of) if o == k]
        if len(t) < chunk_dedup.MIN_RUN:
            assert not got
            continue
        hashes = []
        for i in range(len(t) - 31):
            h = 0
            for x in t[i : i + 32]:
                h = ((h << 1) + int(chunk_dedup.GEAR[x])) & 0xFFFFFFFF
            hashes.append(h)
        least = {min(range(a, a + chunk_dedup.STEP), key=lambda i: (hashes[i], i)) + 32 for a in range(len(hashes) - chunk_dedup.STEP + 1)}
        if len(set(t)) > 1:
            cuts = [0, *sorted(least - {len(t)}), len(t)]
            assert got == [(max(0, a - 32), b) for a, b in zip(cuts, cuts[1:]) if b >= 32]
        assert max(b - a for a, b in got) < 256 and got[-1][1] == len(t)


def test_warc_of_rows_with_clashing_columns(spark):
    pages = odd(spark.createDataFrame([(1, "http://a/", "x" * 150), (2, "http://a/", "x" * 150), (3, None, None), (4, "http://b/", "y" * 50), (5, "u", "y" * 50)], "page_id bigint, url string, html string"))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert {k: (r["payload_bytes"], r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: (150, "response", None), 2: (150, "revisit", 1), 3: (0, "response", None), 4: (50, "response", None), 5: (50, "response", None)}
    assert got[2]["payload_digest"] == hashlib.sha256(b"x" * 150).hexdigest()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunk_removals_against_all_windows(spark):
    """What is removed, against every window of MIN_RUN bytes that stands earlier: nothing else goes, and 0.9 of it at least; 0.99 where SURE bytes repeat."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rnd.randint(20, 90))) for _ in range(25)]
    phrases = [" ".join(word() for _ in range(8)) for _ in range(10)]  # some 45 bytes: chunks that repeat in vain
    rows = []
    for k in range(150):
        parts = [word() for _ in range(rnd.randint(0, 60))] + rnd.sample(phrases, 4) + rnd.sample(passages, rnd.randint(0, 3))
        rnd.shuffle(parts)
        rows.append((k, " ".join(parts)))
    rows += [(200, rows[3][1])] * 40 + [(k, rows[3][1]) for k in range(201, 230)]  # rows that share id and text, and later copies of them
    texts = {i: t.encode() for i, t in rows}

    def covered(width: int) -> dict[int, int]:
        seen, out = {}, {}
        for i in sorted(texts):
            t, gone = texts[i], np.zeros(len(texts[i]), bool)
            for a in range(len(t) - width + 1):
                first = seen.setdefault(t[a : a + width], (i, a))
                if first[0] != i or a - first[1] >= width:
                    gone[a : a + width] = True
            out[i] = int(gone.sum())
        return out

    found = chunk_dedup.measured(odd(spark.createDataFrame(rows, DOCS)), extend=True).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r["n_removed"] for r in found}
    every, sure = covered(chunk_dedup.MIN_RUN), covered(chunk_dedup.SURE)
    assert all(got[i] <= every[i] for i in texts)
    assert sum(got.values()) >= 0.9 * sum(every.values())
    assert sum(min(got[i], sure[i]) for i in texts) >= 0.99 * sum(sure.values()) > 0
    kept = chunk_dedup.deduplicated(odd(spark.createDataFrame(rows, DOCS)), extend=True).collect()
    assert {r["doc_id"]: len(r["kept"].encode()) for r in kept} == {i: len(t) - got[i] for i, t in texts.items()}
