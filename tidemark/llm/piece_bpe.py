"""SentencePiece encoding and decoding by a table of last tokens.

A text's BPE encoding is determined by its prefixes: each prefix has one last token, which is the token that ends
there, goes with the last token of the prefix before it, and is therefore unique. Tokens that end at a position come
from an Aho-Corasick automaton; two tokens go together if no merge across their border happens while they are built
(`PieceTable.pair_fits`). The ids are read off backwards, from the last prefix to the first.

No piece of such a model joins a space mark to what stands before it, so a text falls into words that are encoded
apart, and each worker keeps the encodings of recent words: their number is bounded, and a word that is not kept is
encoded anew with the same result.

Defined results. Null or empty text: no ids, empty decoded text. Rows repeated, null ids, extra columns: every row is
encoded on its own and keeps its columns. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import bounded_batches

SPACE_MARK = "▁"
#: Words whose encodings a worker keeps; beyond, it starts anew.
KEPT_WORDS, KEPT_LENGTH = 150_000, 64


class PieceTable:
    """Vocabulary of a BPE model with byte fallback, and what the prefix table needs of it."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_id, self.id_of, self.rank, self.piece_of, self.text_of = {}, {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece], self.rank[piece] = i, -sp.get_score(i)
                self.piece_of[i], self.text_of[i] = piece, piece.replace(SPACE_MARK, " ")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        joined = [p for p in self.id_of if len(p) > 1]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in joined):
            raise ValueError("a piece goes on past a space mark: texts do not fall into words")
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in joined))
        self.words = re.compile(rf"{SPACE_MARK}*[^{SPACE_MARK}{apart}]+|{SPACE_MARK}+" + (rf"|[{apart}]" if apart else "")).findall
        #: Marks that no piece joins to a letter before them.
        self.marks = frozenset(c for c in ".,!?|;:" if not any(c in p and p[p.index(c) - 1].isalpha() for p in joined))
        self.built: dict[str, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        self.ends = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self.spines(piece) is not None:  # else merges never make it
                self.ends.add_word(piece, (i, len(piece)))
        self.ends.make_automaton()

    def spines(self, piece: str) -> tuple | None:
        """How merges build the piece: its symbols at the right and at the left border as (symbol, made at, gone at), by rank of merge; None if they build something else."""
        if piece in self.built:
            return self.built[piece]
        symbols, now, inf = list(piece), -1.0, float("inf")
        right, left = [[symbols[-1], -1.0, inf]], [[symbols[0], -1.0, inf]]
        while len(symbols) > 1:
            best, at = min((self.rank.get(symbols[k] + symbols[k + 1], inf), k) for k in range(len(symbols) - 1))
            if best == inf:
                break
            now = max(now, best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            for side, k in ((right, len(symbols) - 1), (left, 0)):
                if symbols[k] != side[-1][0]:
                    side[-1][2] = now
                    side.append([symbols[k], now, inf])
        self.built[piece] = (right, left) if len(symbols) == 1 else None
        return self.built[piece]

    def pair_fits(self, a: int, b: int) -> bool:
        """No merge joins what stands at the border of tokens a and b before both are whole."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        found = self.fits[a << 32 | b] = self._fits(self.piece_of[a], self.piece_of[b])
        return found

    def _fits(self, a: str, b: str) -> bool:
        one, two = self.spines(a), self.spines(b)
        if one is None or two is None:
            return False
        for x, made_x, gone_x in one[0]:
            for y, made_y, gone_y in two[1]:
                if made_y > gone_x:
                    break
                if gone_y < made_x:
                    continue
                rank = self.rank.get(x + y)
                if rank is not None:
                    at = max(rank, made_x, made_y)
                    if at < gone_x and at <= gone_y:
                        return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word, by the table of last tokens of its prefixes."""
        last: list[tuple[int, int] | None] = [None] * (len(word) + 1)
        fits = self.fits.get
        for end, token in self.ends.iter(word):  # at each end, the longest first
            end += 1
            if last[end] is None:
                # Without a token before it, there is nothing, or a character without a piece, which merges with nothing.
                if (before := last[end - token[1]]) is not None:
                    fit = fits(before[0] << 32 | token[0])
                    if not (self.pair_fits(before[0], token[0]) if fit is None else fit):
                        continue
                last[end] = token
        ids: list[int] = []
        end = len(word)
        while end:
            if (token := last[end]) is None:
                ids.extend(self.byte_id[b] for b in reversed(word[end - 1].encode()))
                end -= 1
            else:
                ids.append(token[0])
                end -= token[1]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, as the library decodes them."""
        return self.joined(ids)[1:] if ids else ""

    def joined(self, ids: list[int]) -> str:
        try:
            return "".join([self.text_of[i] for i in ids])
        except KeyError:  # bytes among them
            return self._with_bytes(ids)

    def _with_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(self.text_of[i])
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)


class _Words(dict):
    """Encodings of recent words: ids as text, and the text that they decode to."""

    def __init__(self, table: PieceTable):
        self.table = table

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        table = self.table
        if len(word) > 1 and word[-1] in table.marks and word[-2].isalpha():
            (a, b), (c, d) = self[word[:-1]], self[word[-1]]
            found = (f"{a},{c}", b + d)
        else:
            ids = table.encode_word(word)
            found = (",".join([str(i) for i in ids]), table.joined(ids))
        if len(word) <= KEPT_LENGTH:
            self[word] = found
        return found


_words: dict[bytes, _Words] = {}


def _kept(model: bytes) -> _Words:
    key = hashlib.sha256(model).digest()
    if key not in _words:
        _words[key] = _Words(PieceTable(model))
    return _words[key]


def encode_text(text: str | None, words: _Words) -> tuple[str, int, str]:
    """Ids joined by commas, their number, and the decoded text."""
    if not text:
        return "", 0, ""
    found = [words[w] for w in words.table.words((SPACE_MARK + text).replace(" ", SPACE_MARK))]
    ids = ",".join([a for a, _ in found])
    return ids, ids.count(",") + 1, "".join([b for _, b in found])[1:]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text; with ids, also input_ids array<int> and decoded string."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _kept(model.value)
        for batch in batches:
            rows = [encode_text(t, words) for t in batch.column("text").to_pylist()]
            out = {
                id_col: batch.column("id"),
                "n_tokens": pa.array([n for _, n, _ in rows], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _, _ in rows], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for _, _, d in rows], pa.string()),
            }
            if ids:
                out["input_ids"] = pa.array([[int(x) for x in i.split(",")] if i else [] for i, _, _ in rows], pa.list_(pa.int32()))
                out["decoded"] = pa.array([d for _, _, d in rows], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = f"`{id_col}` {id_type.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>, decoded string" * ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
