"""The Merkle manifest against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from pitpanel.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(part, (doc_id, source, lang, n_chars, text)))


def climb(row):
    """Levels of digests up to a single one."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, text, lang, source, n_chars)
        other = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            other = leaf(doc_id, text and text.translate(LOWER), lang, source, n_chars)
        by_lang[lang].append((doc_id, own, other))
    langs = sorted(by_lang, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = climb([own for _, own, _ in by_lang[lang]])
    top = climb([trees[lang][-1][0] for lang in langs])

    def up(levels, at, digest):
        siblings = []
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            siblings += [d for i, d in enumerate(run) if i != at % 8]
            digest = sha(*[digest if i == at % 8 else d for i, d in enumerate(run)])
            at //= 8
        return siblings, digest

    out = []
    for n, lang in enumerate(langs):
        for at, (doc_id, own, other) in enumerate(by_lang[lang]):
            first, digest = up(trees[lang], at, other)
            second, digest = up(top, n, digest)
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], sha(*first, *second), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def documents(n):
    rows = [(i * 7 % n, f"Text {i} É", ["en", "de", "en", "fr"][i % 4], ["s", None][i % 2], i) for i in range(n)]
    odd = [(None, "A", "en", "s", 1), (None, None, None, None, None), (n + 1, "", "", "", 0), (n + 2, "Z", None, "s", -3), (n + 3, "Big " * 300_000, "solo", "s", 5)]
    return rows + odd + [(5, "Same Text", "en", "s", 9)] * 3 + [(5, "Other", "en", "s", 9)]


@pytest.mark.parametrize("n", [30, 2300])
def test_manifest(spark, n):
    rows = documents(n)
    given = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, merkle.manifest(given).collect()), key=str) == brute(rows)


def test_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(3, "One", "en", None, 3)]
    assert list(map(tuple, merkle.manifest(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).collect())) == brute(rows)


def test_more_langs_than_a_block(spark):
    rows = [(i, f"T{i}", f"lang{i % 600}", "s", i) for i in range(1200)]
    given = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, merkle.manifest(given).collect()), key=str) == brute(rows)
