"""Token counts of byte-level BPE by merging with a heap and a linked list.

A text is split at special-token strings and then into pieces by the tokenizer's pattern; merges never cross a piece.
In a piece the adjacent pairs with a rank lie in a heap; the lowest rank is popped again and again (ties: leftmost),
its two symbols become one in a doubly linked list, and the new neighbours' pairs are pushed. The count is the number
of initial symbols (bytes) less the merges; no ids are made. Counts of pieces are kept in a table of bounded size for
each Python worker, since words repeat.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces of byte-level BPE (a fixed value of the tokenizer): contractions, letters, numbers, other signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_PIECES = 1_000_000
TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens with the vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.bytes = [vocab[c] for c in byte_alphabet()]
        specials = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pieces = regex.compile(PATTERN).findall
        self.memo: dict[str, int] = {}
        self.most = memo

    def count_piece(self, piece: str) -> int:
        """Initial symbols less merges."""
        ids = [self.bytes[b] for b in piece.encode()]
        n, ranks = len(ids), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j] = merged, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((merged, ids[k])):
                    heapq.heappush(heap, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((ids[h], merged))):
                heapq.heappush(heap, (found[0], h, ids[h], merged, found[1]))
        return n - merges

    def __call__(self, text: str) -> int:
        total, memo = 0, self.memo
        parts = [text]
        if self.specials is not None and self.specials.search(text):
            parts = self.specials.split(text)
            total = len(parts) - 1
        for part in parts:
            pieces = self.pieces(part)
            try:
                total += sum(map(memo.__getitem__, pieces))
            except KeyError:
                for piece in pieces:
                    if (count := memo.get(piece)) is None:
                        count = self.count_piece(piece)
                        if len(piece) <= 64:
                            if len(memo) >= self.most:
                                memo.clear()
                            memo[piece] = count
                    total += count
        return total


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, made once in a worker."""
    kept = common.kept_for("token_count")
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def tokenizer_path(name: str) -> str:
    """Where the installed tokenizer file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Whole texts, no added tokens, no truncation; a special token's string inside a text counts as that one token, as
    is the library's default. A null text counts as empty: no bytes, no tokens. Repeated rows each give a row; an
    empty table gives none. Columns other than doc_id and text play no part.
    """

    def run(batches):
        count = counter(tokenizer_path(tokenizer))
        for batch in common.sliced(batches, "token_count"):
            texts = batch.column("text").to_pylist()
            tokens = [count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
