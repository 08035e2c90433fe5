"""Columns that bear the operators' own names, and a text longer than what a task works on at once."""

import pytest
from pyspark.sql import functions as F

from pitpanel.llm import exact_dedup, merkle, mixing, ngram_join, pii, quality, secret_scan, sharding, substring_dedup

OWN = [
    "__m", "__taken", "__doc_id", "__sha", "__own_id", "__own_sha", "__sha2", "__gone", "__place", "__size", "__source", "__copy", "__p_doc_id", "__p_place", "__block", "__outs", "__put", "__text", "__id",
    "__label", "__least", "__DOC_ID_", "key", "uid", "range", "copies", "kept", "before", "n_words", "secrets", "digest", "pos",
]


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"word{k % 700}" for k in range(60))
    long = "Sentence number %d of a very long text. " * 1
    big = "".join(long % k for k in range(130_000))  # over 5 MB
    texts = [words, words.upper(), words + " more", None, "", " \n", "short", big, big.lower(), "Mail a@b.com now", "password = abcdef1"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, words, "en", "s", 1), (None, words, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit("mine") for c in OWN if c.lower() != "__doc_id_"}).withColumn("__DOC_ID_", F.lit("mine")).repartition(3)


def untouched(before, after, but=()):
    names = [c for c in OWN if c not in but]
    assert [c for c in after.columns if c in before.columns and c not in but] == [c for c in before.columns if c not in but]
    assert all(set(r) <= {"mine"} for r in after.select(*names).collect())
    return after


def test_rows_keep_their_columns(docs):
    untouched(docs, quality.apply_rules(docs), ("n_words", "kept"))
    assert untouched(docs, exact_dedup.deduplicate(docs)).count() == 8
    untouched(docs, ngram_join.without_near_copies(docs))
    untouched(docs, mixing.mixed(docs))
    untouched(docs, substring_dedup.remove_repeated(docs))
    untouched(docs, pii.replace_entities(docs, "k"))
    untouched(docs, secret_scan.with_spans(docs), ("secrets",))
    untouched(docs, secret_scan.masked(docs))


def test_operators_of_their_own_rows(docs):
    n = docs.count()
    assert exact_dedup.exact_groups(docs).count() == n and sharding.shard(docs, 3).count() == n
    assert ngram_join.near_groups(docs).count() == n and mixing.mix(docs).count() == n and merkle.manifest(docs).count() == n


def test_copies_in_blocks(spark, monkeypatch):
    from pitpanel.llm import common

    monkeypatch.setattr(common, "COPIES", 4)
    rows = spark.createDataFrame([("a", 1), ("b", 4), ("c", 11)], "k string, n long").withColumn("__block", F.lit(1))
    got = {}
    for r in common.with_copies(rows, "n", "at").collect():
        got.setdefault(r.k, []).append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0], "b": [0, 1, 2, 3], "c": list(range(11))}
