"""SentencePiece (BPE models) encoding by backtracking over longest matches, and decoding.

Encoding a unit: an Aho-Corasick automaton over the reversed pieces gives, in one pass, the longest piece that begins
at every position. From the left the encoder takes the longest piece that is compatible with the one before; when it
is not, it tries the piece's next shorter prefix piece, and when none is left it marks the position as failed in a
bitfield and takes back the piece before. Two adjacent pieces are compatible when merging their joined characters by
score again gives just these two; a sequence whose adjacent pairs are all compatible is the one that merging the
whole text gives. Pieces' prefixes, checked pairs and encoded units are kept in tables of bounded size in each worker.

A unit is a run of the white-space mark with the word after it, and letters before a full stop or the like are a unit
too: no piece of such models has a mark, or one of those signs, after a letter, so no merge crosses units. That is
verified when a model is loaded; a model with pieces across marks is encoded text by text.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_count import tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MEMO_UNITS = 500_000
MEMO_PAIRS = 500_000

codecs.register_error("pitpanel.each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """A BPE model file: pieces and scores are read from it; encoding and decoding are done here."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS, memo_pairs: int = MEMO_PAIRS):
        held = sentencepiece.SentencePieceProcessor(model_file=path)
        if held.encode("a  b") != held.encode("a") + held.encode(" b") or held.decode(held.encode("Ａ b ")) != "Ａ b ":
            raise ValueError(f"{path}: only models with identity normalisation and a leading mark are supported")
        n = held.get_piece_size()
        self.text_of = [held.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (held.is_control(i) or held.is_byte(i) or held.is_unknown(i) or held.is_unused(i))]
        self.silent = {i for i in range(n) if held.is_control(i)}
        self.id_of = {self.text_of[i]: i for i in plain}
        self.score = {self.text_of[i]: held.get_score(i) for i in plain}
        self.byte_ids = {int(self.text_of[i][3:5], 16): i for i in range(n) if held.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = held.unk_id()
        self.special = {self.unknown, *self.silent, *self.byte_of}
        crossing = any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) for p in self.id_of)
        alphabet = set("".join(p for p in self.id_of if len(p) > 1))
        stops = "".join(c for c in "\t\n\r" if c not in alphabet)
        ends = "".join(c for c in ",.;:!?|" if not any(p[k] == c and p[k - 1].isalpha() for p in self.id_of for k in range(1, len(p))))
        pattern = f"{MARK}+[^{MARK}{stops}]*|[^{MARK}{stops}]+" + (f"|[{stops}]+" if stops else "")
        pattern = (rf"{MARK}*\p{{L}}+(?=[{ends}])|" if ends else "") + pattern
        self.units = (lambda text: [text]) if crossing else regex.compile(pattern).findall
        reached = [p for p in self.id_of if len(p) == 1 or self.merged(p) == [p]]
        known = set(reached)
        self.prefix = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in known), p[:1]) for p in reached if len(p) > 1}
        self.longest = ahocorasick.Automaton()
        for p in reached:
            self.longest.add_word(p[::-1], p)
        self.longest.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.most_units, self.most_pairs = memo_units, memo_pairs

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best score first, ties leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit; characters that no piece holds stand for themselves."""
        n = len(unit)
        longest = list(unit)
        seen = -1
        for end, piece in self.longest.iter(unit[::-1]):
            if end != seen:  # of matches with the same end the longest comes first
                seen = end
                longest[n - 1 - end] = piece
        failed = bytearray((n >> 3) + 1)  # bit p: no valid split goes on from position p
        out: list[str] = []
        at, piece = 0, longest[0] if n else ""
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                at = end
                piece = longest[at] if at < n else ""
            elif len(piece) > 1:
                piece = self.prefix[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # it leads to a failed position, so its next shorter prefix is tried
                at -= len(piece)
        return out

    def ids(self, pieces: Iterable[str]) -> list[int]:
        pieces = list(pieces)
        out = list(map(self.id_of.get, pieces))
        if None not in out:
            return out
        out = []
        for p in pieces:
            if (i := self.id_of.get(p)) is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units(self.marked(text)) for i in self.ids(self.split(unit))]

    def _decoded(self, ids: Iterable[int]) -> str:
        """The text of ids with marks as spaces, the leading one included."""
        ids = list(ids)
        if not self.special.intersection(ids):
            return "".join(map(self.text_of.__getitem__, ids)).replace(MARK, " ")
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "pitpanel.each_byte"))
                held = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.text_of[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "pitpanel.each_byte"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        k = next((k for k, i in enumerate(ids) if i not in self.silent), len(ids))
        text = self._decoded(ids)
        return text[1:] if k < len(ids) and self.text_of[ids[k]].startswith(MARK) else text

    def unit(self, unit: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text of a unit."""
        found = self.memo.get(unit)
        if found is None:
            ids = self.ids(self.split(unit))
            found = (len(ids), ",".join(map(str, ids)), self._decoded(ids))
            if len(unit) <= 64:
                if len(self.memo) >= self.most_units:
                    self.memo.clear()
                self.memo[unit] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text that they decode to."""
        units = self.units(self.marked(text))
        try:
            rows = list(map(self.memo.__getitem__, units))
        except KeyError:
            rows = list(map(self.unit, units))
        counts, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
        decoded = "".join(texts)
        return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded[1:].encode()).hexdigest()


def model(name: str) -> Model:
    """The model of that name, made once in a worker."""
    path, kept = tokenizer_path(name), common.kept_for("sentence_piece")
    if path not in kept:
        kept[path] = Model(path)
    return kept[path]


def encode(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null or empty text gives an empty array."""

    def run(batches):
        held = model(name)
        for batch in common.sliced(batches, "sentence_piece"):
            ids = [held.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text. Ids outside the model are an error."""

    def run(batches):
        held = model(name)
        for batch in common.sliced(batches, "sentence_piece"):
            texts = [held.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text encoded and decoded again.

    A null text counts as empty: no ids, and the digests of the empty string. Repeated rows each give a row; an
    empty table gives none. Columns other than doc_id and text play no part.
    """

    def run(batches):
        held = model(name)
        for batch in common.sliced(batches, "sentence_piece"):
            rows = [held.digest(t or "") for t in batch.column("text").to_pylist()]
            n, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op7_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
