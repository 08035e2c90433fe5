"""The corpus pipeline against plain Python on a small table."""

import hashlib
import random
import re
from collections import defaultdict

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from pitpanel.llm import mixing, sentence_piece, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    sentence = lambda: " ".join(rnd.choice(vocabulary) for _ in range(8)).capitalize() + "."
    rows = []
    for i in range(60):
        text = " ".join(sentence() for _ in range(4)) + (f" You vilebad {rnd.choice(vocabulary)} hatefool {rnd.choice(vocabulary)}." if i % 3 == 0 else "")
        rows.append((i, text, ["s1", "s2", None][i % 3], int(i % 3 == 0)))
    rows += [(100, rows[1][1].upper(), "s1", 0), (101, rows[2][1] + " more", "s2", 0), (102, None, "s1", 0), (103, "", None, 0)]
    return rows


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, x) for i, _, _, x in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scorer = toxicity.train(docs, labels)
    clean = [(i, t, s) for i, t, s, x in rows if scorer.score(t or "")[0] < 0.5]
    assert {i for i, _, _ in clean} == {i for i, _, _, x in rows if not x}  # toxic ones go, clean ones stay
    groups = defaultdict(list)
    for i, t, s in clean:
        groups[(t or "").translate(LOWER)].append((i, t, s))
    left = sorted((max(g, key=lambda x: x[0]) for g in groups.values()), key=lambda x: x[0])
    kept = []
    for i, t, s in left:  # near copies here come in pairs, so the first of a pair stays
        a = shingles(t)
        if not any(a and 100 * len(a & shingles(u)) >= 75 * len(a | shingles(u)) for _, u, _ in kept):
            kept.append((i, t, s))
    assert 101 not in {i for i, _, _ in kept} and 100 in {i for i, _, _ in kept} and 1 not in {i for i, _, _ in kept}
    table = spark.createDataFrame(kept, "doc_id long, text string, source string")
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(table).collect()}  # held against brute force in test_mixing
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.tokenizer_path(sentence_piece.MODEL))
    wanted = []
    for i, t, _ in kept:
        size, n = taken[i]
        for copy in range(-(-n // size) if size else 0):
            w = min(size, n - copy * size)
            ids = library.encode(t if w == size else " ".join(WORD.findall(t)[:w]))
            wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert got.filter(F.col("doc_id").isin(0, 3, 102, 103)).count() == 0
