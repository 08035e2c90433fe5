"""Toxicity by multiple-instance learning: documents carry the labels, sentences get the scores.

A sentence's score is the logistic function of a bias and the weights of its words; a document's score is the
noisy-or of its sentences' scores, 1 - prod(1 - p), so one offending sentence is enough. Bias and weights are fitted
to document labels through that formula, which lets the model find out which sentences earned the label. A word's
features are itself and its beginnings (inflected forms share them); those are kept that occur far more often in
documents labelled 1 than in the others.

The fit uses at most TRAIN_DOCS labelled rows of each label (a bounded sample by hash of doc_id); every document is
scored by tasks that hold only the fitted weights, at most FEATURES of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows of either label that the fit reads at most.
TRAIN_DOCS = 3000
#: Features at most.
FEATURES = 4000
#: A feature is in so many different sentences of documents labelled 1 (a share of those documents) and so many times
#: likelier there than in sentences of the others.
LEAST_SENTENCES = 5
LEAST_SHARE = 0.01
LEAST_RATIO = 5.0
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5
#: Words whose weights a task keeps at hand.
MEMO_WORDS = 100_000

_WORDS = re.compile(r"\w+").findall
_SENTENCES = re.compile(r"[^.!?\n]+[.!?]*").finditer


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 0 modulo FOLDS; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Scorer:
    """Fitted weights by feature, and the bias."""

    bias: float = -12.0
    weights: dict[str, float] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        """The sum of a word's weights."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = self.memo[word] = math.fsum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, end and score of its sentences that have words with weights.

        All other sentences count together as one that has the bias alone.
        """
        p = 1 / (1 + math.exp(-self.bias))
        clean, found = 1 - p, []
        known = {w: v for w in set(_WORDS(text.lower())) if (v := self.weight(w))}
        for m in _SENTENCES(text) if known else ():
            if hits := known.keys() & set(_WORDS(m[0].lower())):
                z = self.bias + math.fsum(known[w] for w in hits)
                p = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
                clean *= 1 - p
                found.append((m.start(), m.end(), p))
        return min(1.0, max(0.0, 1 - clean)), found


def fit(texts: list[str], labels: list[int], steps: int = 300, ridge: float = 1e-4) -> Scorer:
    """Weights and bias that maximise the likelihood of document labels under the noisy-or of sentences."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Scorer(bias=4.0 if len(y) and y.min() == 1 else -12.0)
    counts, seen = (Counter(), Counter()), (set(), set())
    for text, label in zip(texts, labels, strict=True):
        for m in _SENTENCES(text.lower()):
            if m[0] not in seen[label]:  # copies of a document would make all its words features
                seen[label].add(m[0])
                counts[label].update({f for w in set(_WORDS(m[0])) for f in features(w)})
    zeros, ones = counts
    share = len(seen[1]) / max(1, len(seen[0]))
    least = max(LEAST_SENTENCES, LEAST_SHARE * y.sum())
    odds = {f: n / (zeros[f] + 0.5) / share for f, n in ones.items() if n >= least}
    chosen = sorted((f for f, r in odds.items() if r >= LEAST_RATIO), key=lambda f: (-ones[f] * math.log(odds[f]), f))[:FEATURES]
    place = {f: i for i, f in enumerate(chosen)}
    rows, cols, owner = [], [], []
    for d, text in enumerate(texts):
        for m in _SENTENCES(text):
            if hits := sorted(place[f] for w in set(_WORDS(m[0].lower())) for f in features(w) if f in place):
                rows.extend([len(owner)] * len(hits))
                cols.extend(hits)
                owner.append(d)
        owner.append(d)  # the sentences without features: the bias alone
    rows, cols, owner = np.array(rows, int), np.array(cols, int), np.array(owner, int)
    w, b = np.full(len(chosen), 2.0), -5.0
    state = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]
    for step in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        doc = np.clip(1 - none, 1e-9, 1 - 1e-9)
        pull = np.where(y == 1, (1 - doc) / doc, -1.0)
        slope = pull[owner] * p / len(y)
        gradient = np.append(np.bincount(cols, slope[rows], len(chosen)) - ridge * w, slope.sum())
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-12)
        w, b = w + move[:-1], b + move[-1]
    return Scorer(float(b), {x: float(v) for x, v in zip(chosen, w, strict=True)})


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """text and toxic of at most `most` training rows of either label, chosen by hash of doc_id; held-out rows never."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic").distinct()
    key = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("toxic") == v).orderBy(key, "doc_id").limit(most) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most rows at most
    return docs.select("doc_id", "text").join(chosen.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id")).filter("text IS NOT NULL").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Scorer:
    """Fit on the bounded sample; the driver holds its texts, at most 2 * most of them (repeated doc_ids count once)."""
    rows = training_rows(docs, labels, most).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("toxic", "doc_id").toArrow()
    return fit(rows["text"].to_pylist(), rows["toxic"].to_pylist())


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_offending, offending (array of start, end, score).

    Whole texts; null counts as empty and gets the score of the bias alone. offending lists, for documents predicted
    1, the sentences (character offsets) whose own score reaches the threshold, or the worst one if none does alone.
    Repeated rows each give a row; an empty table gives none; labels, lang and source play no part.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in common.sliced(batches):
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                value, found = scorer.score(text or "")
                worst = [s for s in found if s[2] >= threshold] or sorted(found, key=lambda s: -s[2])[:1]
                scores.append(value)
                spans.append([dict(zip(("start", "end", "score"), s, strict=True)) for s in worst] if value >= threshold else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, span)],
                names=["doc_id", "held_out", "score", "predicted", "n_offending", "offending"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_offending int, offending array<struct<start int, end int, score double>>")


def without_toxic(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay, in one pass without a join.

    Null and empty texts have the score of no sentences. Repeated rows are judged alike; an empty table gives no rows;
    other columns may bear any name.
    """
    def run(batches):
        for batch in common.sliced(batches):
            at = batch.schema.get_field_index("text")
            keep = [scorer.score(t or "")[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scorer = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, scorer).select("doc_id", "held_out", "score", "predicted", "n_offending")
