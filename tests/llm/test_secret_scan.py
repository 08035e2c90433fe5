"""Secret scans against plain Python that compares every pair of parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pitpanel.llm import secret_scan

SCHEMA = "doc_id long, text string, spans string, out string"
KINDS = {
    "assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "id": re.compile(r"""(?ai:(user|username|user_name|login|account|clientid|client_id|keyid|key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""),
    "key": re.compile(r"[A-Za-z0-9+/_=-]+"),
    "endpoint": re.compile(r"""[A-Za-z][A-Za-z0-9+]{0,15}://[^\x20\x09-\x0D"'<>]+"""),
}


def brute(text):
    fits = {
        "assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24, "id": lambda m: len(m[2]) >= 3,
        "key": lambda m: len(m[0]) >= 16 and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]), "endpoint": lambda m: True,
    }
    every = [(m.start(), k, m.end()) for k, p in KINDS.items() for m in p.finditer(text) if fits[k](m)]
    over = lambda a, b: a[0] < b[2] and b[0] < a[2]
    base = [x for x in every if x[1] in ("assign", "access", "hex")]
    weak = [x for x in every if x not in base and not any(over(x, b) for b in base)]
    weak = [x for x in weak if x[1] != "key" or not any(over(x, y) for y in weak if y[1] != "key")]
    gaps = [m.span() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]

    def meets(x, kinds):
        low = max([x[0] - 200, 0, *(e for _, e in gaps if e <= x[0])])
        high = min([x[2] + 200, len(text), *(s for s, _ in gaps if s >= x[2])])
        return any(y[0] < high and y[2] > low for y in base + weak if y[1] in kinds)

    identifier, secret = ("access", "id"), ("assign", "hex", "key")
    full = {"id": lambda x: meets(x, secret), "key": lambda x: meets(x, identifier), "endpoint": lambda x: meets(x, identifier) and meets(x, secret)}
    order = list(KINDS)
    return sorted(base + [x for x in weak if full[x[1]](x)], key=lambda x: (x[0], order.index(x[1]), x[2]))


ACCESS, KEY, HEXED = "AKIA" + "ABCDEFGH12345678", "wJalrXUtnFEMI/K7MDENG+bPxRfiCY", "0123456789abcdef01234567"
FIXED = [
    None, "", "  \n", "nothing here", "password: abc", "password: abcdef", 'ApI_KeY"  =  \'abc.def-1', "paſſword=abcdefg", "toKen=abcdefg", ACCESS, ACCESS[:19], HEXED, HEXED[:23], "A" + HEXED + "g",
    f"{KEY}", f"user = bob {KEY}", f"user = bob\n\n{KEY}", f"user = bob {'x ' * 120}{KEY}", f"user=bo {KEY}", f"login: ann {HEXED} https://db.example.com/x", "https://db.example.com/x alone", f"{ACCESS} {KEY} s3://bucket/é",
    f"É {ACCESS} é {KEY}", f"key_id={ACCESS} secret={KEY}", f"user=ann\n{KEY}\n \t\n{KEY}", "user: token=abcdef12", "x" * 5_000_000 + f" user = bob {KEY}",
]


def random_texts():
    rnd = random.Random(11)
    parts = ["user = bob1", "login:ann", KEY, HEXED, ACCESS, "token = abcdefgh", "https://h.example/p?q", "word", "x" * 90, "\n", "\n\n", "é é", "=", "secret:", "key_id=", "A1b2C3d4E5f6G7h8"]
    return [" ".join(rnd.choice(parts) for _ in range(rnd.randint(2, 30))) for _ in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(FIXED + random_texts())]
    return spark.createDataFrame([*rows, rows[5], (None, FIXED[5], "", "")], SCHEMA).repartition(3)


def test_spans(docs):
    got = secret_scan.with_spans(docs)
    assert got.columns == [*docs.columns, "secrets"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.secrets] == brute(r.text or ""), (r.text or "")[-300:]
    assert {s.kind for r in rows for s in r.secrets} == set(KINDS)


def test_masked(docs):
    for r in secret_scan.masked(docs).select("doc_id", F.col("text").alias("after")).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = list(r.text or "")
        for start, _, end in brute(r.text or ""):
            want[start:end] = "*" * (end - start)
        assert (r.after or "") == "".join(want)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secret_scan.with_spans(empty).collect() == [] and secret_scan.masked(empty).collect() == []
