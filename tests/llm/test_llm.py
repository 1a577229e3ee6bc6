"""The operators against brute force, the library they match, or held-out rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, decontaminate, exact_dedup, langid, ngram_join, piece_bpe, suffix_dedup, toxicity, url_filter, warc
from tidemark.llm.common import pieces, sliding_argmin
from tidemark.llm.components import components
from tidemark.llm.queries import tokenizer

DOCS = "doc_id bigint, text string"
EDGE = [(None, "same text here"), (900, None), (901, ""), (902, " \n\t"), (903, "same text here"), (903, "same text here"), (904, "é" * 3000)]


def frame(spark, rows, schema=DOCS):
    """Rows with further columns under names that the operators use themselves."""
    return spark.createDataFrame(rows, schema).withColumn("id", F.lit("mine")).withColumn("mark", F.lit(0)).withColumn("n", F.lit(None).cast("int")).withColumn("digest", F.lit("d"))


def test_exact_dedup(spark):
    rows = [(1, "a  b"), (2, "a b"), (3, "a\n\t b"), (4, "A b"), *EDGE]
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in rows:
        keep = min((x for x in groups[norm(t)] if x is not None), default=None)
        want[i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    got = Counter(map(tuple, exact_dedup.exact_groups(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == want
    kept = exact_dedup.exact_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 900, 902, 903, 904}
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_one_of_repeated_rows_stays(spark):
    long, near = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(61))
    rows = [(1, "a  b c")] * 5 + [(2, "a b c"), (3, "alone"), (None, "no id"), (None, "no  id"), (None, "a b c"), (None, None), (None, None), (5, ""), (6, long)] + [(6, long)] * 3
    left = exact_dedup.exact_dedup(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted(((r["doc_id"] or 0, " ".join((r["text"] or "").split())) for r in left.collect())) == [(0, "no id"), (1, "a b c"), (3, "alone"), (5, ""), (6, long)]
    rows = [(6, long)] * 4 + [(6, near), (7, near), (None, near), (8, "b"), (8, "c"), (None, "x y z"), (None, "x y z"), (9, "")]
    left = ngram_join.without_near_copies(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    one = [x for x in got if x[0] == 6]
    assert len(one) == 1 and one[0][1] in (long, near)
    assert got == Counter([one[0], (8, "b"), (8, "c"), (None, "x y z"), (9, "")])


def test_decontamination_tolerates_substitutions(spark):
    rnd = random.Random(2)
    voc = [f"w{k}" for k in range(60)]
    items = [[rnd.choice(voc) for _ in range(n)] for n in (30, 14, 12, 6, 0)]
    docs = []
    for k in range(60):
        words = [rnd.choice(voc) for _ in range(rnd.randint(0, 40))]
        if k % 2:
            part = items[k % 4][: rnd.randint(6, 30)][:]
            for _ in range(rnd.randint(0, 3)):
                part[rnd.randrange(len(part))] = "x"
            words[len(words) // 2 : len(words) // 2] = part
        docs.append((k, ", ".join(words).title()))
    want = {}
    for i, t in docs:
        d = t.lower().replace(",", "").split()
        for j, b in enumerate(items):
            n = min(len(b), 12)
            hits = {}
            for p in range(len(d) - n + 1 if n else 0):
                for q in range(len(b) - n + 1):
                    same = sum(x == y for x, y in zip(d[p : p + n], b[q : q + n]))
                    if same >= (n - 2 if len(b) >= 12 else n):
                        hits[p] = max(hits.get(p, 0), same)
            if hits:
                want[i, j] = (max(hits.values()), len(hits))
    bench = spark.createDataFrame([(j, " ".join(b)) for j, b in enumerate(items)], "item_id bigint, text string")
    found = decontaminate.overlaps(frame(spark, [*docs, *EDGE]), bench)
    assert {(r["doc_id"], r["item_id"]): (r["n_equal"], r["n_windows"]) for r in found.collect()} == want and want
    left = decontaminate.decontaminated(frame(spark, docs), bench)
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.overlaps(frame(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_spares_rows_that_share_an_id(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(None, f"a b {item} c"), (None, "clean without an id"), (None, None), (7, f"{item} tail"), (7, "clean with a shared id"), (7, f"{item} tail"), (8, "clean")]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = decontaminate.decontaminated(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(rows[k] for k in (1, 2, 4, 6))


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    path = tokenizer()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aabcdeßé日ⅷ🦙 \n\t▁<>.,0") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    rows = [*((k, t) for k, t in enumerate(texts)), *EDGE]
    got = piece_bpe.encoded(frame(spark, rows), path, ids=True).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        ids = sp.encode(t or "")
        r = by[i]
        assert list(r["input_ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_language_held_out(spark):
    rnd = random.Random(1)
    parts = {"en": ["the", "ing", "th", "and"], "de": ["sch", "ung", "der", "ß"], "fr": ["eau", "tion", "é", "les"]}
    docs = [(k, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang) for k in range(240) for lang in [("en", "de", "fr")[k % 3]]]
    d = spark.createDataFrame([*docs, (900, None, "en"), (901, "123 !!", None), (None, "the thing and", None)], DOCS + ", lang string")
    got = {r["doc_id"]: r for r in langid.identified(d).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in docs if got[i]["held_out"])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identified(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_held_out(spark):
    rnd = random.Random(4)
    voc = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti") for c in ("po", "qu", "ve", "xa")]
    docs, labels = [], []
    for k in range(300):
        words = [rnd.choice(voc) for _ in range(rnd.randint(20, 60))]
        if k % 5 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(("vileword", "Badterm,", "grimnoun"))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    d, l = frame(spark, [*docs, *EDGE]), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(d, l).collect()}
    assert all(got[i]["predicted"] == t for i, t in labels if got[i]["held_out"])
    model = toxicity.fit_labels(d, l)
    spans = {r["doc_id"]: r["spans"] for r in toxicity.predicted(d, model, spans=True).collect()}
    text = dict(docs)[0]
    assert {text[s["first"] : s["end"]].lower().strip(",") for s in spans[0]} <= {"vileword", "badterm", "grimnoun"} and spans[0]
    kept = toxicity.without_toxic(d, l)
    assert kept.columns == d.columns and not {i for i, t in labels if t} & {r["doc_id"] for r in kept.collect()}
    assert {r["score"] for r in toxicity.scored(d, l.limit(0)).collect()} == {0.0}


def toxic_rows(n, long=0):
    """(docs, labels): every third is toxic; of each label, the first `long` have 8,000 words."""
    rnd = random.Random(9)
    voc = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(2000)]  # so many that rows are no near copies
    docs, labels = [], []
    for k in range(n):
        size = 8000 if k // 3 < long and k % 3 < 2 else rnd.randint(20, 60)
        words = [rnd.choice(voc) for _ in range(size)]
        for _ in range(max(3, size // 20) if k % 3 == 0 else 0):
            words[rnd.randrange(len(words))] = rnd.choice(("vileword", "Badterm,", "grimnoun"))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    return docs, labels


def test_toxicity_learns_beside_very_long_rows(spark):
    docs, labels = toxic_rows(300, long=20)
    d, l = spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(labels, "id bigint, toxic int")
    model = toxicity.fit(d, l, train_words=7000)
    assert model is not None
    score = {r["id"]: r["score"] for r in toxicity.predicted(d, model, "id").collect()}
    wrong = [i for i, t in labels if (score[i] >= toxicity.THRESHOLD) != bool(t)]
    assert len(wrong) <= 3
    assert toxicity._longest([(5, 2), (100, 1)], 30) == 20 and toxicity._longest([(5, 2)], 30) == 5 and toxicity._longest([], 30) == 1


def test_toxicity_bears_wrong_labels(spark):
    docs, labels = toxic_rows(600)
    flipped = {3, 300, 100, 401}  # two toxic rows labelled clean, two clean ones toxic
    noisy = [(i, 1 - t if i in flipped else t) for i, t in labels]
    d = spark.createDataFrame(docs, "id bigint, text string").withColumn("text", F.when(F.col("id").isin(3, 300), F.concat("text", F.lit(" vileword badterm grimnoun"))).otherwise(F.col("text")))
    model = toxicity.fit(d, spark.createDataFrame(noisy, "id bigint, toxic int"))
    got = {r["id"]: r for r in toxicity.predicted(d, model, "id", spans=True).collect()}
    wrong = [i for i, t in labels if (got[i]["score"] >= toxicity.THRESHOLD) != bool(t) or bool(got[i]["spans"]) != bool(t)]
    assert len(wrong) <= 6


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    e, pair, fresh = rng.normal(size=6), rng.normal(size=(2, 2)), np.array([1, 0, 0, 1, 0, 0], bool)
    total, marg, exp = 0.0, np.zeros(6), np.zeros((2, 2))
    for code in range(64):
        y = [(code >> k) & 1 for k in range(6)]
        w = np.exp(sum(e[k] * y[k] for k in range(6)) + sum(pair[y[k - 1], y[k]] for k in range(6) if not fresh[k]))
        total += w
        marg += w * np.array(y)
        for k in range(6):
            if not fresh[k]:
                exp[y[k - 1], y[k]] += w
    p, pairs = toxicity.marginals(e, fresh, pair, counts=True)
    assert p == pytest.approx(marg / total) and pairs == pytest.approx(exp / total)


def test_url_rules_and_reputation(spark):
    pages = [(1, "http://A.example.ORG/es/1?x"), (2, "https://example.org/en/12"), (3, "https://x.com/fr/"), (4, "https://com/de/9#f"), (5, "nothing"), (6, None), (7, "http://xorg/"), (8, "http://h.net?q"), *((100 + k, "http://bad.site.net/p") for k in range(40)), *((200 + k, "http://good.site.net/p") for k in range(40))]
    labels = spark.createDataFrame([(100 + k, 0, 0) for k in range(40)] + [(200 + k, 1, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judged(spark.createDataFrame(pages, "page_id bigint, url string"), labels).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block") and got[5][:3] == ("", "", None) == got[6][:3]
    assert got[7][2] is None and got[8][:3] == ("h.net", "", None) and got[100][3] == "block" and got[200][3] == "allow"


def plain_chunks(b):
    out, begin, h = [], 0, 0
    for i, x in enumerate(b):
        h = ((h << 1) + int(chunk_dedup.GEAR[x])) & 0xFFFFFFFF
        n = i + 1 - begin
        if i + 1 >= 32 and n >= chunk_dedup.MIN_CHUNK and h >> 27 == 0 or n == chunk_dedup.MAX_CHUNK:
            out.append((begin, i + 1))
            begin = i + 1
    return out + [(begin, len(b))] * (begin < len(b))


def test_chunks(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(1500))
    rows = [(k, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 90))) + base[rnd.randint(0, 500) :]) for k in range(12)] + [(50, None), (51, "")]
    got = {r["doc_id"]: r for r in chunk_dedup.measured(frame(spark, rows)).collect()}
    seen = defaultdict(list)
    cuts = {i: plain_chunks((t or "").encode()) for i, t in rows}
    for i, t in rows:
        for a, b in cuts[i]:
            seen[(t or "").encode()[a:b]].append((i, a))
    for i, t in rows:
        raw = (t or "").encode()
        runs = []
        for a, b in cuts[i]:
            if len(seen[raw[a:b]]) > 1:
                runs[-1].append((a, b)) if runs and runs[-1][-1][1] == a else runs.append([(a, b)])
        gone = {k for run in runs if run[-1][1] - run[0][0] >= chunk_dedup.MIN_RUN for a, b in run if min(seen[raw[a:b]]) != (i, a) for k in range(a, b)}
        assert got[i]["n_removed"] == len(gone) and got[i]["kept_sha256"] == hashlib.sha256(bytes(x for k, x in enumerate(raw) if k not in gone)).hexdigest()
    assert chunk_dedup.measured(frame(spark, [])).count() == 0


def test_chunk_query_finds_whole_passages(spark, tmp_path):
    """Passages of 51 words, in two documents each, at any place; alone, the first of them stays."""
    from tidemark.llm.queries import QUERIES

    rnd, rows, want = random.Random(11), [], {}
    word = lambda low: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(low, 6)))
    for k in range(60):
        passage = " ".join(word(4) for _ in range(51))
        pair = [(" ".join(word(1) for _ in range(rnd.randint(0, 80))), " ".join(word(1) for _ in range(rnd.randint(0, 80)))) for _ in range(2)]
        texts = [f"{a}\n{passage}\té{b}" if n else f"{a} {passage} è{b}" for n, (a, b) in enumerate(pair)]
        rows += [(2 * k + n, t) for n, t in enumerate(texts)]
        want |= {2 * k: (len(passage), 0, texts[0]), 2 * k + 1: (len(passage), len(passage), texts[1].replace(passage, ""))}
    rows += [(None, "a" * 1000), (900, None), (901, ""), (902, "ab" * 59)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op10_chunk_dedup"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, (repeated, removed, kept) in want.items():
        assert (got[i]["n_repeated"], got[i]["n_removed"], got[i]["n_spans"]) == (repeated, removed, int(removed > 0))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    kept = {r["doc_id"]: r["kept"] for r in chunk_dedup.deduplicated(frame(spark, rows), extend=True).collect()}
    assert all(kept[i] == t for i, (_, _, t) in want.items())
    assert chunk_dedup.measured(frame(spark, []), extend=True).count() == 0


def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(500):
        t = [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("most, piece", [(4_096, 300), (6, 1 << 21), (1, 1 << 21)])
def test_repeated_strings(spark, monkeypatch, most, piece):
    monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "pieces", lambda batches: pieces(batches, limit=piece))
    rnd, length = random.Random(3), 64
    base = "".join(rnd.choice("abcdefgh é\n") for _ in range(1500))
    rows = []
    for i in range(30):
        a = rnd.randint(0, 1200)
        x = list(base[a : a + rnd.randint(0, 300)])
        for _ in range(rnd.randint(0, 3) if x else 0):
            x[rnd.randrange(len(x))] = "Z"
        rows.append((i, "".join(x) + "a" * (rnd.randint(0, 200) if i % 5 == 0 else 0) + "xyz " * (rnd.randint(0, 60) if i % 7 == 0 else 0)))
    rows += [(100, None), (101, ""), (102, "q" * 63), (103, "ab" * 100)]
    got = {r["doc_id"]: r for r in suffix_dedup.measured(frame(spark, rows), length=length, short=48).collect()}
    seen = {n: Counter(b[k : k + n] for b in ((t or "").encode() for _, t in rows) for k in range(len(b) - n + 1)) for n in (48, length)}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        near = gone.copy()
        for n, marks in ((48, near), (length, gone)):
            for k in range(len(b) - n + 1):
                if seen[n][b[k : k + n]] > 1:
                    marks[k : k + n] = True
        assert got[i]["n_repeated"] == near.sum() and got[i]["n_spans"] == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(b), int(gone.sum()))
        assert got[i]["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


def brute_components(rows, words=5):
    """{id: (n-grams, component)} by comparing all pairs; ids are different."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed,small", [(3, True), (4, True), (5, False)])
def test_jaccard_join(spark, monkeypatch, seed, small):
    if small:  # several row blocks, and dense products, in small data
        for name, value in {"ROWS": 8, "ENTRIES": 60, "NARROW": 4, "DENSE": 8}.items():
            monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(seed)
    voc = [f"w{k}" for k in range(300)]
    base = [rnd.choice(voc) for _ in range(100)]
    rows = []
    for k in range(40):  # near copies, and some that are not near enough
        x = base[:]
        for _ in range(rnd.randint(0, 8)):
            x[rnd.randrange(len(x))] = rnd.choice(voc)
        rows.append((k, " ".join(x)))
    rows += [(100 + k, " ".join(base[:40] + [rnd.choice(voc) for _ in range(rnd.randint(0, 30))])) for k in range(60)]  # a passage of more than 32 unlinked sets
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  B"), (204, "a b c"), (205, "a b")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert len(set(got.values())) > 20 and max(Counter(c for _, c in got.values()).values()) > 20


def test_jaccard_join_of_odd_tables(spark):
    assert ngram_join.linked(frame(spark, [])).count() == 0 and ngram_join.without_near_copies(frame(spark, []).withColumn("__id", F.lit(1))).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (7, text), (7, text), (None, None), (8, "é" * 9000 + " x"), (9, text + " more")]
    got = Counter(map(tuple, ngram_join.linked(frame(spark, rows)).collect()))
    assert got == Counter([(None, 26, 7), (7, 26, 7), (7, 26, 7), (None, 0, None), (8, 1, 8), (9, 27, 7)])
    left = ngram_join.without_near_copies(frame(spark, rows).withColumn("__id", F.lit(1)).withColumn("__mark", F.lit(1)).withColumn("k0", F.lit(1)))
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([7, None, 8])


def test_prefix_bound():
    """Linked sets share least_shared at least of their first n-grams in any order."""
    rnd = random.Random(2)
    for _ in range(3000):
        n = rnd.randint(1, 60)
        a = set(rnd.sample(range(100), n))
        b = set(list(a)[rnd.randint(0, n // 4) :]) | set(rnd.sample(range(100), rnd.randint(0, n // 4)))
        if b and 100 * len(a & b) >= 75 * len(a | b):
            first = [set(sorted(x)[: ngram_join.prefix_size(len(x))]) for x in (a, b)]
            assert len(first[0] & first[1]) >= ngram_join.least_shared(len(a), len(b)) >= 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (105, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 105: 100}


def test_warc_round_trip(spark):
    big = "é" * 40000
    rows = [(1, "u", big), (1, "u", big), (2, "v", big), (3, None, None), (None, "x", "y" * 200), (4, "x", "y" * 200), (5, "a", "short"), (6, "b", "short"), (7, "c", "\r\n\r\nWARC/1.1\r\n" * 2000)]
    got = Counter(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()))
    want = Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows)
    assert got == want
    with pytest.raises(ValueError, match="cut short"):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_of_odd_tables(spark):
    schema = "page_id bigint, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    pages = spark.createDataFrame([(1, "u", "z" * 200), (2, "v", "z" * 200)], schema).withColumn("digest", F.lit("d")).withColumn("id", F.lit(9)).withColumn("__bucket", F.lit(1))
    assert {tuple(r)[3:] for r in warc.round_trip(pages).collect()} == {("response", None), ("revisit", 1)}


def test_pipeline(spark, tmp_path):
    """The stages in their order, over planted rows of each kind, repeated rows, shared and missing ids."""
    import sentencepiece

    import corpus_pipeline

    docs, labels = toxic_rows(240)
    rnd = random.Random(12)
    passage = lambda n: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(n))
    item, near = passage(30), passage(80)
    planted = [(1000, docs[1][1]), (1001, docs[1][1].replace(" ", "  ")), (1002, near), (1003, near + " end"), (None, near), (1004, f"{passage(20)} {item} {passage(20)}")]
    planted += [(1005, None), (1006, ""), (1007, passage(9)), (1007, passage(9)), (None, passage(11)), (1008, "idle"), (1008, "idle")]
    rows = [(*r, i) for i, r in enumerate([*docs, *planted])]
    spark.createDataFrame(rows, "doc_id bigint, text string, k0 int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scored(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).where("predicted = 1").collect()}
    assert {i for i, t in labels if t} <= toxic | {i for i, t in labels if t and i % 4 == 2} and len(toxic) < 100
    left, seen, sets = [], set(), []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):  # of copies, the smallest id stays; no id comes last
        norm = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        w = (t or "").lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        if i in toxic or norm in seen or w and any(100 * len(grams & s) >= 75 * len(grams | s) for s in sets):
            continue
        seen.add(norm)
        sets += [grams] if w else []
        if item not in norm:
            left.append((i, t or ""))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    want = Counter((i, len(sp.encode(t)), hashlib.sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest()) for i, t in left)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256").collect()) == want
    (tmp_path / "empty").mkdir()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"empty/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_sliding_argmin():
    rng = np.random.default_rng(1)
    for n, width in ((0, 3), (5, 5), (40, 1), (60, 7), (100, 33)):
        v = rng.integers(0, 6, n).astype(np.uint64)
        assert sliding_argmin(v, width).tolist() == [k + int(np.argmin(v[k : k + width])) for k in range(n - width + 1)]


def test_repeated_strings_of_odd_texts(spark):
    """One letter a million times is one segment many times over; null ids and repeated rows are places of their own."""
    rows = [(1, "a" * 1_000_000), (2, "a" * 399), (3, "ab" * 300_000), (None, "xyz" * 200), (4, "q" * 399 + "r"), (4, "q" * 399 + "r"), (None, None)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.measured(frame(spark, rows)).collect())
    assert got == Counter([(1, 1_000_000, 1_000_000, 1), (2, 399, 0, 0), (3, 600_000, 600_000, 1), (None, 600, 600, 1), (4, 400, 400, 1), (4, 400, 400, 1), (None, 0, 0, 0)])
    assert suffix_dedup.measured(frame(spark, [])).count() == 0
