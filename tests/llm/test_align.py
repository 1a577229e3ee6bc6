"""Alignment against a plain version over whole texts: both libraries on the whole text, sets of bytes for groups and links."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from tidemark.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "the  two   spaces", " leading", "trailing ", "tab\there new\nline\r\n\n x", "mark ▁ here", "▁", "<|endoftext|> and </s> <unk> <0x41>", "naïve café Ünïcödé",
    "日本語のテキスト です", "emoji 😀😀 x", "nul \x00 x", "a b  c", "word " * 400, "ab " * 3 + "\n" + "ab " * 3, "the the the", "the the the", "x" * 3000, "don't won't I'll 123 4567,89 ... !!!", "\x1c x \x85 y", "ﬁ ² ①",
]


def plain(texts):
    """What the contract says, text by text."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = align.byte_alphabet()
    name = {i: p for p, i in t.get_vocab().items()}

    def a_bytes(i):
        return bytes(letters[c] for c in name[i])

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for text in texts:
        whole = f" {text}".encode() if text else b""
        a = t.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        spans = []
        for ids, size in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(size(i)), i))
                at = own[-1][1]
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if low <= s and e <= cut) for own in spans))
            low = cut
        links = Counter()
        j0 = 0
        for s, e, i in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links[i, spans[1][j][2]] += 1
                j += 1
        found.append((len(a), len(b), groups, links))
    counts = Counter(p for _, _, _, links in found for p in links)
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [
        (a, b, len(g), sum(k.values()), sum(m for p, m in k.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in k.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, k in found
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 40, 0])
def test_odd_texts(spark, hot):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in align.aligned(rows, A, B, hot_pairs=hot).collect()}
    for i, want in enumerate(plain(ODD)):
        assert got[i] == want, ODD[i]


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    have = sorted(rows.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in align.aligned(rows, A, B).collect())
    assert got == [(r[0], *w) for r, w in zip(have, plain([r[1] for r in have]), strict=True)]


def test_stretches_and_forgetting(spark, monkeypatch):
    """Neither where a text is cut into stretches nor what a worker has forgotten shows in the result."""
    texts = [" ".join(f"w{i * k % 97} and, don't\n" for i in range(300)) for k in range(1, 5)]
    pair = align.Pair(open(A).read(), open(B, "rb").read())
    whole = [*align.Units(pair).aligned(texts)]
    monkeypatch.setattr(align, "STRETCH", 50)
    monkeypatch.setattr(align, "KEPT_UNITS", 20)
    units = align.Units(pair)
    for got, w in zip(units.aligned(texts), whole, strict=True):
        assert got[1] == w[1]
        assert all((x == y).all() for x, y in zip((got[0], *got[2:]), (w[0], *w[2:]), strict=True))


def test_empty_table_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, id long, row long, codes binary, n_a string"
    assert align.aligned(spark.createDataFrame([], schema), A, B).collect() == []
    rows = spark.createDataFrame([(None, "the same", 1, 1, None, "x"), (None, "the same", 1, 1, None, "x"), (3, None, None, None, None, None)], schema)
    got = align.aligned(rows, A, B)
    assert got.columns == ["doc_id", *NAMES]
    assert sorted((r["n_a"], r["count_sum"]) for r in got.collect()) == [(0, 0), (2, 4), (2, 4)]
