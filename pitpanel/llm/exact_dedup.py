"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks; each chunk has a polynomial hash in four prime fields, and chunk hashes combine by
length-shifted arithmetic, so a huge text is hashed chunk by chunk in bounded memory:
H(A + B) = H(A) * r**len(B) + H(B). Texts with equal fingerprints and lengths are then compared chunk by chunk:
for each fingerprint and chunk number the least and the greatest chunk must be the same bytes. That comparison is an
aggregate, so Spark combines it before the shuffle and a group of any size spreads over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Four primes just below 2**31, and a base for each.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = np.array([1000003, 48271, 69621, 742938285], np.uint64)
CHUNK = 1 << 16

_POWERS: dict[int, np.ndarray] = {}


def _powers(chunk: int) -> np.ndarray:
    """powers[lane, i] = base ** (chunk - 1 - i) mod prime."""
    if chunk not in _POWERS:
        out = np.ones((4, chunk), np.uint64)
        for i in range(chunk - 2, -1, -1):
            out[:, i] = out[:, i + 1] * BASES % PRIMES
        _POWERS[chunk] = out
    return _POWERS[chunk]


def chunk_hash(data: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Four lanes of the polynomial hash of at most chunk bytes; a byte counts as its value plus one."""
    powers = _powers(chunk)[:, chunk - len(data) :]
    return (powers * (data.astype(np.uint64) + np.uint64(1))).sum(axis=1) % PRIMES


def combine(left: np.ndarray, right: np.ndarray, right_len: int) -> np.ndarray:
    """The fingerprint of A + B from those of A and B and the length of B."""
    shift = np.array([pow(int(b), right_len, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], np.uint64)
    return (left * shift + right) % PRIMES


def fingerprint(data: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The fingerprint of whole data, chunk by chunk."""
    out = chunk_hash(data[:chunk], chunk)
    for at in range(chunk, len(data), chunk):
        part = data[at : at + chunk]
        out = combine(out, chunk_hash(part, chunk), len(part))
    return out


def _packed(lanes: np.ndarray) -> tuple[int, int]:
    a, b, c, d = (int(x) for x in lanes)
    return a << 31 | b, c << 31 | d


def _texts(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield (batch.column("__text")[i].as_py() or "").encode()


def digests(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp_hi, fp_lo, n_bytes, text_sha256 of the normalised text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            hi, lo, size, sha = [], [], [], []
            for raw in _texts(batch):
                raw = raw.lower()  # of bytes: A to Z only
                a, b = _packed(fingerprint(np.frombuffer(raw, np.uint8), chunk))
                hi.append(a)
                lo.append(b)
                size.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__doc_id"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "fp_hi", "fp_lo", "n_bytes", "text_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("__doc_id"), F.col("text").alias("__text")).mapInArrow(
        run, "doc_id long, fp_hi long, fp_lo long, n_bytes long, text_sha256 string"
    )


FP = ["fp_hi", "fp_lo", "n_bytes"]


def unequal(docs: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The fingerprints of groups whose texts are not all equal, by comparing their chunks as a stream.

    A bitmap of bounded size keeps texts without a partner out of the second pass; what it lets through besides is
    dropped by the aggregate (its least and greatest chunk are its own).
    """
    bitmap = common.bitmap_of(groups, "fp_lo")

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("fp_hi", "fp_lo", "n_bytes", "chunk_no", "bytes")}
            held = 0
            for raw in _texts(batch):
                raw = raw.lower()
                a, b = _packed(fingerprint(np.frombuffer(raw, np.uint8), chunk))
                if not common.in_bitmap(bitmap, np.array([b], np.int64))[0]:
                    continue
                for k, at in enumerate(range(0, len(raw), chunk)):
                    for name, value in zip(out, (a, b, len(raw), k, raw[at : at + chunk]), strict=True):
                        out[name].append(value)
                held += len(raw)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, held = {k: [] for k in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("fp_hi", pa.int64()), ("fp_lo", pa.int64()), ("n_bytes", pa.int64()), ("chunk_no", pa.int64()), ("bytes", pa.binary())])
    chunks = docs.select(F.col("text").alias("__text")).mapInArrow(run, "fp_hi long, fp_lo long, n_bytes long, chunk_no long, bytes binary")
    return (
        chunks.groupBy(*FP, "chunk_no")
        .agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))
        .filter(F.col("least") != F.col("greatest"))
        .select(*FP)
        .distinct()
    )


def exact_groups(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A to Z; null counts as empty. Of a group the row with the
    largest doc_id stays (a null doc_id is the smallest); of repeated rows with that doc_id exactly one is marked
    kept. An empty table gives no rows. Columns other than doc_id and text play no part.
    """
    marks = common.materialize(digests(docs, chunk).withColumn("uid", F.monotonically_increasing_id()), "digests")
    groups = marks.groupBy(*FP).agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = common.materialize(groups, "groups")
    bad = common.materialize(unequal(docs, groups, chunk), "unequal")
    if not bad.isEmpty():  # equal fingerprints of different texts: tell them apart by the digest of the whole text
        mixed = marks.join(bad, FP, "left_semi").groupBy(*FP, "text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size"))
        groups = groups.join(bad, FP, "left_anti").withColumn("text_sha256", F.lit(None).cast("string")).unionByName(mixed)
        groups = common.materialize(groups, "groups").withColumnRenamed("text_sha256", "sha")
        on = [marks[k] == groups[k] for k in FP] + [F.coalesce(groups["sha"], marks["text_sha256"]) == marks["text_sha256"]]
        joined = marks.join(groups.select(*FP, "sha", "top", "group_size"), on, "left")
    else:
        joined = marks.join(groups, FP, "left")
    top = F.coalesce(F.col("top"), F.struct(marks["doc_id"], marks["uid"]))
    return joined.select(
        marks["doc_id"],
        top["doc_id"].alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        (marks["uid"] == top["uid"]).alias("kept"),
        marks["text_sha256"],
        marks["n_bytes"],
    )


def deduplicate(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs without exact copies, all its columns; rules as in exact_groups.

    The dropped doc_ids are joined against docs. Rows that share a doc_id need more than that: where a doc_id has
    rows of several groups or repeated rows, its rows are told apart by their normalised text. An empty table gives no
    rows; other columns may bear any name.
    """
    my_id, my_sha, own_id, own_sha = common.free_names(docs.columns, "doc_id", "sha", "own_id", "own_sha")
    marks = common.materialize(exact_groups(docs, chunk), "exact")
    dropped = marks.filter(~F.col("kept")).select(F.col("doc_id").alias(my_id)).distinct()
    doc_id = F.col("doc_id").cast("long")
    clean = docs.join(dropped, doc_id.eqNullSafe(F.col(my_id)), "left_anti")
    both = marks.filter("kept").join(dropped, F.col("doc_id").eqNullSafe(F.col(my_id)), "left_semi").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha)).distinct()
    both = common.materialize(both, "both")
    if both.isEmpty():
        return clean
    shared = docs.withColumns({my_id: doc_id, my_sha: F.sha2(F.encode(common.normalize_case(F.coalesce(F.col("text"), F.lit(""))), "UTF-8"), 256)})
    shared = shared.join(both, F.col(my_id).eqNullSafe(F.col(own_id)) & (F.col(my_sha) == F.col(own_sha)), "left_semi")
    return clean.unionByName(shared.dropDuplicates([my_id, my_sha]).select(*docs.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


ORACLE_OP8 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS n_bytes
FROM d
"""
