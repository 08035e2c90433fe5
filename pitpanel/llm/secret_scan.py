"""Secrets in texts, with weak parts of credentials reported only where complementary parts stand together.

Three kinds are found by their form alone (the base kinds: assign, access, hex). Three weak kinds are far too common for
that: a named identifier (id), a run of mixed letters and digits (key) and an address (endpoint). A credential has
several parts, so a weak part is reported when the parts that complete it lie in its scope: an identifier with a secret,
a key with an identifier, an endpoint with both. The scope of a part is REACH characters before and after it within its
paragraph. Which parts meet whose scope is an interval join of two sorted lists: of all parts that start before a scope
ends, the greatest end tells whether one reaches into it.

A part and its scope lie in one text, so the join needs no shuffle: each task reads, joins and writes its own rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import common


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: Patterns of the base kinds; hex and access are cut to those long enough by their counts.
ASSIGN = _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Patterns of the weak kinds. A scheme has 16 characters at most: without a bound, each place of a long run is tried to its end.
ID = _either_case("(user(?:_?name)?|login|account|client_?id|key_?id)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
KEY = r"[A-Za-z0-9+/_=-]{16,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+]{0,15}://[^\x20\x09-\x0D"'<>]+"""
BLANK = r"\n[\x20\x09\r]*\n"
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: Least length of an assigned value, and of an identifier's.
LEAST_VALUE, LEAST_ID = 6, 3
#: Characters before and after a part that belong to its scope.
REACH = 200
SPANS = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()))

_RE = {k: re.compile(p) for k, p in zip((*KINDS, "blank"), (ASSIGN, ACCESS, HEX, ID, KEY, ENDPOINT, BLANK), strict=True)}
_HINTS = {"assign": ("passw", "secret", "token", "api"), "id": ("user", "login", "account", "client", "key")}

Span = tuple[int, int]


def matches(kind: str, text: str, low: str) -> list[Span]:
    """Spans of a kind's matches, leftmost first and not overlapping; low is the text in lower case."""
    if kind in _HINTS and not any(hint in low for hint in _HINTS[kind]):
        return []
    least = {"assign": LEAST_VALUE, "id": LEAST_ID}.get(kind)
    found = _RE[kind].finditer(text)
    if least:
        return [m.span() for m in found if len(m[2]) >= least]
    if kind == "key":
        return [m.span() for m in found if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    return [m.span() for m in found]


class Parts:
    """Spans by start, to be asked whether one of them reaches into an interval."""

    def __init__(self, *spans: list[Span]):
        every = sorted(s for some in spans for s in some)
        self.starts = [s for s, _ in every]
        self.ends = list(accumulate((e for _, e in every), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def linked(text: str, reach: int = REACH) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans of a text, sorted."""
    low = text.lower()
    base = [matches(k, text, low) for k in KINDS[:3]]
    taken = Parts(*base)
    ids = [s for s in matches("id", text, low) if not taken.meets(*s)]
    points = [s for s in (matches("endpoint", text, low) if "://" in text else []) if not taken.meets(*s)]
    named = Parts(ids, points)
    # a key needs an identifier, so texts without one are not searched for keys
    keys = [s for s in matches("key", text, low) if not taken.meets(*s) and not named.meets(*s)] if ids or base[1] else []
    weak = (ids, keys, points)
    if any(weak):
        breaks = [m.span() for m in _RE["blank"].finditer(text)]
        firsts, lasts = [0, *(e for _, e in breaks)], [*(s for s, _ in breaks), len(text)]

        def scope(span: Span) -> Span:
            k = bisect_right(firsts, span[0]) - 1
            return max(firsts[k], span[0] - reach), min(lasts[k], span[1] + reach)

        identifiers, secrets = Parts(ids, base[1]), Parts(base[0], base[2], keys)
        completes = (secrets.meets, identifiers.meets, lambda a, b: identifiers.meets(a, b) and secrets.meets(a, b))
        weak = tuple([s for s in some if full(*scope(s))] for some, full in zip(weak, completes, strict=True))
    return sorted((start, kind, end) for kind, some in enumerate((*base, *weak)) for start, end in some)


def with_spans(docs: DataFrame, reach: int = REACH, name: str = "secrets") -> DataFrame:
    """docs with a column of the secrets' spans (kind, start, end: code points, end exclusive) by start, then kind.

    Whole texts; a null or empty text has none. Base kinds are always reported, weak ones (id, key, endpoint) where
    complementary parts lie in their scope and no base span overlaps them. Repeated rows each get their spans; an empty
    table gives no rows. All columns stay, whatever their names; one called like the new column is replaced.
    """
    docs = docs.drop(name)
    schema, at = StructType([*docs.schema]).add(name, SPANS), docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in common.sliced(batches, "secret_scan"):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in linked(t, reach)] if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def masked(docs: DataFrame, reach: int = REACH, sign: str = "*") -> DataFrame:
    """docs with every character of a secret's span replaced by sign in text; rules as in with_spans."""
    (spans,) = common.free_names(docs.columns, "spans")
    cut = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int")), F.repeat(F.lit(sign), F.greatest(x["end"] - F.greatest(x["start"], s["at"]), F.lit(0)).cast("int"))).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.char_length("text"))),
    )
    return with_spans(docs, reach, spans).withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text"))).drop(spans)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    """DuckDB SQL: places from the pieces between matches, scopes met by a join on the document and the interval."""
    quoted = lambda p: p.replace("'", "''")
    patterns = dict(zip(KINDS, map(quoted, (ASSIGN, ACCESS, HEX, ID, KEY, ENDPOINT)), strict=True))
    keep = {
        "assign": f"length(regexp_extract(hit, '{patterns['assign']}', 2)) >= {LEAST_VALUE}",
        "id": f"length(regexp_extract(hit, '{patterns['id']}', 2)) >= {LEAST_ID}",
        "key": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')",
    }
    found = lambda p: f"SELECT rid, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, hits, pieces FROM (SELECT rid, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces FROM d)"
    start = "coalesce(list_sum([length(x) FOR x IN pieces[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0)"
    spans = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, CAST({start} AS BIGINT) AS s, CAST({start} + length(hit) AS BIGINT) AS e FROM ({found(p)}) WHERE {keep.get(kind, 'true')}" for k, (kind, p) in enumerate(patterns.items())
    )
    meets = lambda where: f"EXISTS (SELECT 1 FROM m AS o WHERE o.rid = m.rid AND o.s < m.hi AND o.e > m.lo AND {where})"
    identifier, secret = meets("o.k IN (1, 3)"), meets("o.k IN (0, 2, 4)")
    names = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS MATERIALIZED ({spans}),
w AS (SELECT * FROM a WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM a AS b WHERE b.rid = a.rid AND b.k < 3 AND b.s < a.e AND b.e > a.s)),
v AS (SELECT * FROM w WHERE k <> 4 OR NOT EXISTS (SELECT 1 FROM w AS b WHERE b.rid = w.rid AND b.k IN (3, 5) AND b.s < w.e AND b.e > w.s)),
br AS (SELECT rid, CAST({start} AS BIGINT) AS s, CAST({start} + length(hit) AS BIGINT) AS e FROM ({found(BLANK)})),
m AS MATERIALIZED (
  SELECT v.*, greatest(v.s - {REACH}, coalesce((SELECT max(br.e) FROM br WHERE br.rid = v.rid AND br.e <= v.s), 0)) AS lo,
         least(v.e + {REACH}, coalesce((SELECT min(br.s) FROM br WHERE br.rid = v.rid AND br.s >= v.e), length(d.text))) AS hi
  FROM v JOIN d USING (rid)
),
f AS (SELECT rid, k, s, e, CASE k {names} END || ':' || s || ':' || e AS word FROM m
      WHERE k < 3 OR k = 3 AND {secret} OR k = 4 AND {identifier} OR k = 5 AND {secret} AND {identifier}),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(KINDS))},
             string_agg(word, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(word, ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


ORACLE_OP13 = _oracle()
