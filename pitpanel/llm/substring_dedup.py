"""Passages that repeat, by sliding runs of consecutive sentences.

From every sentence the shortest run of at least three sentences (two in the query) and twenty words (or of forty words,
for long sentences) is hashed, and likewise the shortest run that ends with it, so that every sentence of a passage is in a run
that lies within the passage. Runs are compared over all documents by an aggregate on their hashes: of a run that
occurs more than once the first occurrence (the smallest doc_id, and in a document the earliest place) stays, and
every sentence that another occurrence covers goes.

The runs' words are hashed in lower case (A to Z), so spacing and line breaks don't count. A bitmap of bounded size
tells the second pass which runs may repeat; the exact join decides.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST_SENTENCES = 3
#: The query's: runs of two sentences cover all that longer ones would, and repeats with only two whole sentences.
QUERY_SENTENCES = 2
LEAST_WORDS = 20
ENOUGH_WORDS = 40
BITS = 1 << 26

_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True


class Runs:
    """Sentences of a text, and its runs: first and last sentence, hash, number of words."""

    def __init__(self, raw: bytes, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, enough_words: int = ENOUGH_WORDS):
        data = common.lower_bytes(raw)
        self.starts, self.ends = common.word_spans(data)
        n = len(self.starts)
        none = np.zeros(0, int)
        self.first = self.last = self.words = none
        self.hash = np.zeros(0, np.uint64)
        if not n:
            self.begin = self.end = none
            return
        lines = np.cumsum(data == 10)
        stop = _ENDS[data[self.ends - 1]]
        stop[:-1] |= lines[self.starts[1:]] > lines[self.ends[:-1] - 1]
        stop[-1] = True
        self.end = np.flatnonzero(stop) + 1  # word after the sentence's last
        self.begin = np.concatenate([[0], self.end[:-1]])
        m = len(self.end)
        if n < least_words or (m < least_sentences and n < enough_words):
            return
        k = np.arange(m)
        last = np.minimum(
            np.maximum(k + least_sentences - 1, np.searchsorted(self.end, self.begin + least_words)), np.searchsorted(self.end, self.begin + enough_words)
        )
        first = np.maximum(
            np.minimum(k - least_sentences + 1, np.searchsorted(self.begin, self.end - least_words, "right") - 1),
            np.searchsorted(self.begin, self.end - enough_words, "right") - 1,
        )
        pairs = np.unique(np.concatenate([k[last < m] * m + last[last < m], first[first >= 0] * m + k[first >= 0]]))
        self.first, self.last = pairs // m, pairs % m
        a, b = self.begin[self.first], self.end[self.last]
        words = common.spans_hash(data, self.starts, self.ends)
        up, down = common._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(words * up[:n], out=total[1:])
            self.hash = common.mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        self.words = b - a

    def unique(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of different runs, and the index of each one's first occurrence."""
        return np.unique(self.hash, return_index=True)

    def covered(self, gone: np.ndarray) -> np.ndarray:
        """Which sentences go: those in a run whose hash is in gone, or in a later repeat within the text."""
        out = np.zeros(len(self.begin) + 1, int)
        if len(self.hash):
            drop = np.isin(self.hash, gone)
            later = np.ones(len(self.hash), bool)
            later[self.unique()[1]] = False
            drop |= later
            np.add.at(out, self.first[drop], 1)
            np.add.at(out, self.last[drop] + 1, -1)
        return np.cumsum(out[:-1]) > 0

    def without(self, raw: bytes, covered: np.ndarray) -> bytes:
        """The text without covered sentences and the white space after each."""
        if not covered.any():
            return raw
        at = np.append(self.starts[self.begin], len(raw))
        return raw[: at[0]] + b"".join(raw[at[k] : at[k + 1]] for k in np.flatnonzero(~covered))


def _emit(docs: DataFrame, bitmap: np.ndarray | None, least_sentences: int = LEAST_SENTENCES) -> DataFrame:
    """h, n_words, doc_id of the different runs of each document with a doc_id; only those in the bitmap if one is given."""

    def run(batches):
        for batch in batches:
            hashes, sizes, owners = [], [], []
            texts = batch.column("text")
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                runs = Runs((texts[k].as_py() or "").encode(), least_sentences)
                h, at = runs.unique()
                n = runs.words[at]
                if bitmap is not None and len(h):
                    hit = common.in_bitmap(bitmap, h.view(np.int64))
                    h, n = h[hit], n[hit]
                hashes.append(h)
                sizes.append(n)
                owners.append(np.full(len(h), ids[k], np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(owners))],
                    names=["h", "n_words", "doc_id"],
                )

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "h long, n_words int, doc_id long")


def repeated(docs: DataFrame, least_sentences: int = LEAST_SENTENCES) -> DataFrame:
    """h, n_words and first_doc of every run that is in more than one document."""
    return (
        _emit(docs, None, least_sentences)
        .groupBy("h", "n_words")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .filter("first_doc < last_doc")
        .select("h", "n_words", "first_doc")
    )


def remove_repeated(docs: DataFrame, least_sentences: int = LEAST_SENTENCES) -> DataFrame:
    """docs with the repeated passages taken out of text, and n_sentences, n_removed, n_words_removed (replaced if there).

    Rows that share a doc_id count as one document and are treated alike. A null text stays null and has no
    sentences. Rows without a doc_id lose repeats within their own text only. A text whose sentences all go becomes
    the white space before its first word, or empty. Texts of fewer than twenty words have no runs. An empty table
    gives no rows; other columns are carried along untouched.
    """
    extra = ["n_sentences", "n_removed", "n_words_removed"]
    docs = docs.drop(*extra)
    my_id, my_gone = common.free_names(docs.columns, "doc_id", "gone")
    runs = common.materialize(repeated(docs, least_sentences), "runs")
    bitmap = common.bitmap_of(runs, "h", BITS)
    later = _emit(docs, bitmap, least_sentences).join(runs, ["h", "n_words"]).filter("doc_id > first_doc")
    gone = later.groupBy(F.col("doc_id").alias(my_id)).agg(F.collect_list("h").alias(my_gone))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col(my_id), "left").drop(my_id)
    place, names = docs.columns.index("text"), docs.columns + extra

    def run(batches):
        for batch in batches:
            texts, counts = [], ([], [], [])
            lists = batch.column(my_gone)
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                found = Runs(raw, least_sentences)
                covered = found.covered(np.array(lists[k].as_py() or [], np.int64).view(np.uint64))
                texts.append(found.without(raw, covered).decode() if text is not None else None)
                for out, value in zip(counts, (len(covered), covered.sum(), (found.end - found.begin)[covered].sum()), strict=True):
                    out.append(int(value))
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, pa.int32()) for c in counts], names=names)

    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.IntegerType()) for c in extra])
    return joined.select(*docs.columns, my_gone).mapInArrow(run, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = F.coalesce(F.col("text"), F.lit(""))
    return remove_repeated(docs, QUERY_SENTENCES).select(
        "doc_id", "n_sentences", "n_removed", "n_words_removed", F.octet_length(clean).cast("long").alias("n_bytes_left"), F.sha2(clean.cast("binary"), 256).alias("left_sha256")
    )
