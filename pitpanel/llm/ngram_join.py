"""Similarity join of documents on word n-grams (Jaccard), size-aware: heavy and light sets are joined differently.

A document's set holds the hashes of its distinct five-word shingles. First, sets that can't have a partner go: over
one part of all hash values every shingle's sets are counted, and a set with more than n - o shingles of its own there
shares too few with any other. What stays is joined. All sets share one order: shingles that a sample of documents
shows to be frequent come last. Two sets that reach the threshold share at least o = ceil(0.75 n)
shingles of either, so with c >= 1 they share c shingles of the first n - o + c in that order.

- Light sets (few shingles) enumerate the subsets of c = 2 shingles of that prefix and meet on equal subsets.
- Heavy sets enter inverted lists of the single shingles (c = 1) of their prefix, and those lists are scanned; light
  sets large enough to match a heavy one enter the lists too.
- The boundary is the size up to which enumerating costs less than scanning, by the sample's mean list length.

Equal sets are one class. The lists give candidate pairs in linear number: neighbours in a list, and each with the
first. Every class is verified against its best candidate; then, in lists whose members are still in more than one
component, against the best-linked member. Pairs inside a component need no test. Of what remains open, lists of at
most SHORT members are compared pair by pair (at most SHORT pairs a row of a list): first by sketches, whose differing
bits are never more than the sets' differing elements, then exactly. Longer lists are split (`split`): a set is
replaced by its difference from the shingles that most of the list's members have, which keeps the differences between
sets, and the differences meet on single shingles again. Each of the new lists has at most half of those members, so
splitting ends with short lists; no step pairs all members of a long list.

Shingles are compared by 64-bit hashes. Two given sets of a thousand shingles get a shared hash that is none with a
chance of 1e6 / 2**64, about 5e-14. Classes with equal 64-bit ids and different second fingerprints are told apart.
A task holds a slice of rows (common.sliced), one text and its hashes (about 100 bytes a word) beside fixed tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected, extended

WORDS = 5
PERCENT = 75
#: One document in so many (by hash of doc_id) is in the sample that orders shingles; the order decides cost only.
SAMPLE = 32
#: Shingles of the sample that are told apart as frequent, at most: a bound on what is broadcast.
FREQUENT = 200_000
#: Members of an inverted list that a task holds at once; longer lists are passed on as they come.
LIST_ROWS = 8192
#: Members of a list that are compared pair by pair, at most, before and after a split; longer lists are split.
SHORT, SHORT_SPLIT = 64, 256
#: Classes that a task remembers to have seen.
SEEN = 100_000
BITS = 1 << 26
#: Longs of a set's sketch of parities.
SKETCH = 16
SKETCHES = [f"odd{k}" for k in range(SKETCH)]
#: Share of all hash values in which shingles are counted to find sets without a partner.
COUNTED = 0.4
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; fewer words than `words` count as one shingle."""
    data = common.lower_bytes(raw)
    starts, ends = common.word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = common.spans_hash(data, starts, ends)
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = out * _STEP + h[k : len(h) - size + 1 + k]
    return np.unique(common.mix64(out))


def marks(tokens: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit fingerprints of a set."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(tokens))
        return tuple(int((common.mix64(tokens ^ salt).sum(dtype=np.uint64) + n * _STEP).view(np.int64)) for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)))


class Plan:
    """The order of shingles, the boundary between light and heavy sets, and bitmaps of ids that different sets had."""

    def __init__(self, frequent: np.ndarray, boundary: int, percent: int, words: int):
        self.frequent, self.boundary, self.percent, self.words = frequent, boundary, percent, words
        self.clashing: list[np.ndarray] = []
        self.by_hash = np.argsort(frequent)
        self.sorted = frequent[self.by_hash]

    def identity(self, tokens: np.ndarray) -> tuple[int, int]:
        """Class id and check of a set. Ids in a bitmap of clashes are replaced; others that hit it are too, which does no harm."""
        a, b = marks(tokens)
        for bitmap in self.clashing:
            if common.in_bitmap(bitmap, np.array([a], np.int64))[0]:
                a = int(common.mix64(np.array([a ^ b], np.int64).view(np.uint64)).view(np.int64)[0])
        return a, b

    def ordered(self, tokens: np.ndarray) -> np.ndarray:
        """The set in the shared order: hashes that are not frequent, then frequent ones from rare to common."""
        if not len(self.sorted) or not len(tokens):
            return tokens
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        known = self.sorted[at] == tokens
        if not known.any():
            return tokens
        return np.concatenate([tokens[~known], self.frequent[np.sort(self.by_hash[at[known]])]])

    def needed(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The keys under which a set is found."""
        n = len(tokens)
        tokens = self.ordered(tokens)
        single = tokens[: n - self.needed(n) + 1]
        if n > self.boundary:
            return single
        prefix = tokens[: n - self.needed(n) + 2]
        i, j = np.triu_indices(len(prefix), 1)
        with np.errstate(over="ignore"):
            low, high = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
            pairs = common.mix64(low * _STEP + common.mix64(high))
        return np.concatenate([single, pairs]) if n >= self.percent * (self.boundary + 1) / 100 else pairs


def boundary_for(list_length: float, percent: int = PERCENT, most: int = 256) -> int:
    """The largest set size at which enumerating pairs of the prefix costs no more than scanning its lists."""
    best = 2
    for n in range(2, most + 1):
        o = -(-percent * n // 100)
        p = n - o + 2
        if p * (p - 1) / 2 <= (n - o + 1) * (1 + list_length):
            best = n
    return best


def _each_set(batch: pa.RecordBatch, words: int):
    texts = batch.column("text")
    for k in range(batch.num_rows):
        yield k, shingles((texts[k].as_py() or "").encode(), words)


def plan_for(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, sample: int = SAMPLE, frequent: int = FREQUENT) -> Plan:
    """Order and boundary from the shingles of one document in `sample`; at most `frequent` hashes reach the driver."""

    def run(batches):
        seen: set[int] = set()
        for batch in common.sliced(batches):
            out = []
            for _, tokens in _each_set(batch, words):
                a, _ = marks(tokens)
                if len(tokens) and a not in seen:
                    seen.add(a)
                    out.append(tokens)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["h"])

    some = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(sample)) == 0).select(F.col("text").alias("text"))
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n >= 3")
    top = counts.orderBy(F.desc("n"), "h").limit(frequent).toArrow()
    hashes, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    # frequent ones stand apart, so what a list of the others holds is short: a document and its few near copies
    return Plan(hashes[::-1].copy(), boundary_for(float(np.log2(1 + n.mean())) if len(n) else 1.0, percent), percent, words)


def classes_of(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, n_counted (those counted to find sets without a partner), id, chk: the class (equal sets) of every row."""

    def run(batches):
        for batch in common.sliced(batches):
            rows = []
            for _, tokens in _each_set(batch, plan.words):
                rows.append((len(tokens), len(counted(tokens)), *plan.identity(tokens)))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_shingles", "n_counted", "id", "chk"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, n_counted long, id long, chk long")


def counted(tokens: np.ndarray) -> np.ndarray:
    """The shingles in the part of hash values that is counted."""
    return tokens[: np.searchsorted(tokens, np.uint64(int(COUNTED * 2**64)))]


def shared_counts(docs: DataFrame, plan: Plan) -> DataFrame:
    """id, shared: how many counted shingles of a class other classes have too."""

    def emit(batches):
        seen: set[int] = set()
        for batch in common.sliced(batches):
            keys, ids = [], []
            for _, tokens in _each_set(batch, plan.words):
                if not len(tokens):
                    continue
                a, _ = plan.identity(tokens)
                if a in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(a)
                part = counted(tokens)
                keys.append(part)
                ids.append(np.full(len(part), a, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "id"])

    def count(batches):
        last = None  # key and id of the last row, and whether it has been counted
        out: list[np.ndarray] = []

        def made():
            ids, n = np.unique(np.concatenate(out), return_counts=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "shared"])

        for batch in batches:
            key, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
            told = np.zeros(len(key) + 1, bool)
            if last is not None:
                key, ids = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], ids])
                told[0] = last[2]
            if not len(key):
                continue
            told = told[: len(key)]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])  # a class comes once for each task that met it
            told = np.logical_or.reduceat(told, np.flatnonzero(new))
            key, ids = key[new], ids[new]
            same = key[1:] == key[:-1]
            hit = np.zeros(len(key), bool)
            hit[1:] |= same
            hit[:-1] |= same
            out.append(ids[hit & ~told])
            last = (key[-1], ids[-1], bool(hit[-1] or told[-1]))
            if sum(map(len, out)) > 1_000_000:
                yield made()
        if out:
            yield made()

    rows = docs.select(F.col("text").alias("text")).mapInArrow(emit, "key long, id long")
    rows = rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(count, "id long, shared long")
    return rows.groupBy("id").agg(F.sum("shared").alias("shared"))


def with_partners(docs: DataFrame, plan: Plan, by_class: DataFrame) -> DataFrame:
    """id of classes that may have a partner: not more than n - o counted shingles are theirs alone."""
    rows = by_class.join(shared_counts(docs, plan), "id", "left")  # a class may share shingles in the other part only
    alone = F.col("n_counted") - F.coalesce("shared", F.lit(0))
    return rows.filter(alone <= F.col("n") - F.ceil(F.col("n") * plan.percent / 100)).select("id")


def postings(docs: DataFrame, plan: Plan, bitmap: np.ndarray) -> DataFrame:
    """key, id, n of the keys of classes in the bitmap; a task sends a class that it has seen before no more."""

    def run(batches):
        seen: set[int] = set()
        for batch in common.sliced(batches):
            keys, ids, sizes = [], [], []
            for _, tokens in _each_set(batch, plan.words):
                if not len(tokens):
                    continue
                a, _ = plan.identity(tokens)
                if a in seen or not common.in_bitmap(bitmap, np.array([a], np.int64))[0]:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(a)
                k = plan.keys(tokens)
                keys.append(k)
                ids.append(np.full(len(k), a, np.int64))
                sizes.append(np.full(len(k), len(tokens), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))], names=["key", "id", "n"])

    return docs.select(F.col("text").alias("text")).mapInArrow(run, "key long, id long, n int")


def scan_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Scan the inverted lists: rows of kind 'pair' (x, y, n_x, n_y, shared lists) and of kind 'list' (x: list, y: member).

    The rows of a task come sorted by key and id. A list of members seen before under another key is passed on once
    (list ids are fingerprints of the members); a list longer than LIST_ROWS is passed on in parts under its key.
    """

    def run(batches):
        seen: set[int] = set()
        held = [np.zeros(0, np.int64)] * 3
        longer = None  # the key of a long list that goes on

        def pairs_of(key, ids, n):
            same = key[1:] == key[:-1]
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            first = np.repeat(start, np.diff(np.append(start, len(key))))
            at = np.flatnonzero(same) + 1
            left, right = np.concatenate([at - 1, first[at]]), np.concatenate([at, at])
            near = 100 * np.minimum(n[left], n[right]).astype(int) >= percent * np.maximum(n[left], n[right])
            return left[near], right[near]

        def made(key, ids, n, part=False):
            nonlocal longer
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids, n = key[keep], ids[keep], n[keep]
            if not len(key):
                return
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            many = np.repeat((size > 1) | (key[start] == longer if longer is not None else False), size)
            key, ids, n = key[many], ids[many], n[many]
            if not len(key):
                return
            left, right = pairs_of(key, ids, n)
            if len(left):
                table = pa.table({"x": np.minimum(ids[left], ids[right]), "y": np.maximum(ids[left], ids[right])})
                table = table.group_by(["x", "y"]).aggregate([([], "count_all")])
                yield batch_of("pair", table["x"].to_numpy(), table["y"].to_numpy(), table["count_all"].to_numpy())
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            with np.errstate(over="ignore"):
                member = common.mix64(ids.view(np.uint64))
                name = common.mix64(np.add.reduceat(member, start) + size.astype(np.uint64)).view(np.int64)
            if part or longer is not None:
                name = np.where((key[start] == longer) | (part & (np.arange(len(start)) == len(start) - 1)), key[start], name)
            fresh = np.array([part or longer is not None or int(x) not in seen for x in name], bool)
            if len(seen) > SEEN:
                seen.clear()
            seen.update(int(x) for x in name)
            keep = np.repeat(fresh, size)
            if keep.any():
                yield batch_of("list", np.repeat(name, size)[keep], ids[keep], n[keep].astype(np.int64))

        def batch_of(kind, x, y, count):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(x)), pa.array(x), pa.array(y), pa.array(count, pa.int64())], names=["kind", "x", "y", "count"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "n")]
            key, ids, n = (np.concatenate(x) for x in zip(held, new, strict=True))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
            if len(key) - cut > LIST_ROWS:
                yield from made(key, ids, n, part=True)
                longer = key[-1]
                held = [key[-1:], ids[-1:], n[-1:]]
                continue
            if cut:
                yield from made(key[:cut], ids[:cut], n[:cut])
                longer = longer if longer == key[-1] else None
            held = [key[cut:], ids[cut:], n[cut:]]
        yield from made(*held)

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "kind string, x long, y long, count long")


def parities(tokens: np.ndarray) -> np.ndarray:
    """SKETCH longs of bits: for each of their positions whether an odd number of the set's hashes falls there.

    Two sets differ in at least as many elements as their sketches in bits, each element flipping one bit.
    """
    odd = np.bincount((tokens % np.uint64(64 * SKETCH)).astype(int), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, plan: Plan, ids: DataFrame) -> DataFrame:
    """id, tokens (64-bit hashes), sketch columns of the classes in ids; a bitmap of bounded size keeps out most others."""
    bitmap = common.bitmap_of(ids, "id", BITS)

    def run(batches):
        seen: set[int] = set()
        for batch in common.sliced(batches):
            names, packed, odd = [], [], []
            for _, tokens in _each_set(batch, plan.words):
                if not len(tokens):
                    continue
                a, _ = plan.identity(tokens)
                if a in seen or not common.in_bitmap(bitmap, np.array([a], np.int64))[0]:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(a)
                names.append(a)
                packed.append(tokens.view(np.int64))
                odd.append(parities(tokens))
            bits = np.array(odd, np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.list_(pa.int64())), *[pa.array(bits[:, k]) for k in range(SKETCH)]], names=["id", "tokens", *SKETCHES])

    sets = docs.select(F.col("text").alias("text")).mapInArrow(run, "id long, tokens array<bigint>, " + ", ".join(f"{c} long" for c in SKETCHES))
    return sets.groupBy("id").agg(*[F.first(c).alias(c) for c in ["tokens", *SKETCHES]])


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("id").alias("id_a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("id").alias("id_b"), F.col("tokens").alias("right"))
    rows = pairs.join(left, pairs["a"] == left["id_a"]).select("a", "b", "left")
    rows = rows.join(right, rows["b"] == right["id_b"]).select("a", "b", "left", "right")
    both = F.size(F.array_intersect("left", "right"))
    return rows.select("a", "b", both.alias("both"), (F.size("left") + F.size("right")).alias("all")).filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b")


class Links:
    """Links found so far between classes, the pairs tested for them, and the components they make."""

    def __init__(self, sets: DataFrame, plan: Plan, pairs: DataFrame):
        self.sets, self.plan = sets, plan
        self.tested = common.materialize(pairs, "tested")
        self.found = common.materialize(verified(self.tested, sets, plan.percent), "links")
        self.labels = connected(self.found)

    def add(self, links: DataFrame) -> None:
        if links.isEmpty():
            return
        old = self.found, self.labels
        self.found = common.materialize(self.found.unionByName(links), "links")
        self.labels = extended(self.labels, links)
        common.release(*old)

    def test(self, pairs: DataFrame) -> None:
        """Add those of the pairs (a, b) that reach the threshold and have not been tested yet."""
        fresh = common.materialize(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            self.tested = self.tested.unionByName(fresh)
            links = common.materialize(verified(fresh, self.sets, self.plan.percent), "links")
            self.add(links)
            common.release(links)

    def open(self, lists: DataFrame, prune: bool = False) -> DataFrame:
        """Lists (list, id and more) with each member's component (label) and the list's length m; only lists of more than one component."""
        rows = lists.join(self.labels, lists["id"] == self.labels["node"], "left").select(*lists.columns, F.coalesce("label", "id").alias("label"))
        rows = common.materialize(rows, "labelled")
        if prune:
            rows = pruned(rows, self.plan.percent)
        mixed = rows.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo != hi").select("list", "m")
        out = common.materialize(rows.join(mixed, "list"), "open")
        common.release(rows)
        return out


def _near(x: str, y: str, percent: int) -> str:
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def star_round(links: Links, lists: DataFrame) -> None:
    """Test the members of open lists against the member with most links."""
    rows = links.open(lists)
    if rows.isEmpty():
        return
    degree = links.found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    rows = rows.join(degree, rows["id"] == degree["node"], "left").drop("node", "m").fillna(0, ["degree"])
    pivots = common.materialize(rows.groupBy("list").agg(F.max(F.struct("degree", "id", "n", "label")).alias("pivot")), "pivots")
    star = rows.join(pivots, "list").filter("label != pivot.label AND " + _near("n", "pivot.n", links.plan.percent))
    links.test(star.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")))


def may_link(percent: int, other: str) -> str:
    """Whether two members of a list can share enough: at most `left` shingles from the list's one on, and `need` of both.

    A set with d shingles in its difference from the list's reference has need = (100 + p) d - (100 - p) n. Two sets
    link when their differences share at least (need + need') / (2 (100 + p)) shingles. Without a reference d is n.
    """
    return f"{2 * (100 + percent)} * least(`left`, {other.format('left')}) >= need + {other.format('need')}"


def short_pairs(links: Links, rows: DataFrame) -> None:
    """Test all pairs of different components in lists of at most SHORT members."""
    p = links.plan.percent
    rows = rows.drop("m").join(links.sets.select("id", *SKETCHES), "id")
    other = rows.withColumnsRenamed({c: f"{c}_b" for c in rows.columns})
    bits = " + ".join(f"bit_count({c} ^ {c}_b)" for c in SKETCHES)
    similar = F.expr(f"{_near("n", "n_b", p)} AND {may_link(p, "{}_b")} AND {100 + p} * ({bits}) <= {100 - p} * (n + n_b)")
    pairs = rows.join(other, (F.col("list") == F.col("list_b")) & (F.col("id") < F.col("id_b")) & (F.col("label") != F.col("label_b")) & similar)
    links.test(pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")))


def pruned(rows: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Lists without the members that can link with none of another component there, by the least need of those."""
    for _ in range(rounds):
        least = rows.groupBy("list", "label").agg(F.min("need").alias("need"))
        one = least.groupBy("list").agg(F.min(F.struct("need", "label")).alias("one"))
        two = least.join(one, "list").filter("label != one.label").groupBy("list").agg(F.first("one").alias("one"), F.min("need").alias("two"))
        able = F.expr(f"{2 * (100 + percent)} * `left` >= need + IF(label != one.label, one.need, two)")
        kept = common.materialize(rows.join(two, "list").filter(able).select(*rows.columns), "able")
        common.release(rows)
        rows = kept
    return rows


def references(members: DataFrame) -> DataFrame:
    """list, ref: the shingles that more than half of a list's members have, those that fewest lack first.

    A list's ref has fewer than twice as many shingles as its sets have on average.
    """

    size = members.groupBy("list").agg(F.count("*").alias("m"))
    counts = members.select("list", F.explode("tokens").alias("token")).groupBy("list", "token").agg(F.count("*").alias("k"))
    often = counts.join(size, "list").filter("2 * k > m")
    return often.groupBy("list").agg(F.sort_array(F.collect_list(F.struct((F.col("m") - F.col("k")).alias("lack"), "token"))).alias("ref"))


def differences(members: DataFrame, plan: Plan) -> DataFrame:
    """list, id, n, need, diff: the symmetric difference of each set and its list's ref; what the ref has, comes last."""
    p = plan.percent

    def run(batches):
        for batch in common.sliced(batches):
            needs, diffs = [], []
            for n, packed, ref in zip(batch.column("n").to_pylist(), batch.column("tokens"), batch.column("ref"), strict=True):
                tokens = packed.values.to_numpy().view(np.uint64)
                usual = ref.values.field("token").to_numpy().view(np.uint64) if ref.is_valid else np.zeros(0, np.uint64)
                diff = np.concatenate([plan.ordered(np.setdiff1d(tokens, usual, assume_unique=True)), usual[~np.isin(usual, tokens)]])
                needs.append((100 + p) * len(diff) - (100 - p) * n)
                diffs.append(diff.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("list", "id", "n")], pa.array(needs, pa.int64()), pa.array(diffs, pa.binary())], names=["list", "id", "n", "need", "diff"])

    return members.mapInArrow(run, "list long, id long, n int, need long, diff binary")


def split(links: Links, lists: DataFrame) -> DataFrame:
    """Split lists (list, id, n) by the differences of their members; the new lists as `open` has them, with left and need.

    Sets whose needs add up to 0 or less link whatever they share; those all link with the member of least need, and
    are linked so here. Any other two that link share a shingle of their differences, and that within the first
    d - t + 1, where t is what they must share at least: so they meet in a new list.
    """
    plan, p = links.plan, links.plan.percent
    members = common.materialize(lists.join(links.sets.select(F.col("id").alias("of"), "tokens"), F.col("id") == F.col("of")).drop("of"), "of_lists")
    ref = common.materialize(references(members), "refs")
    diffs = common.materialize(differences(members.join(ref, "list", "left"), plan), "diffs")
    hubs = common.materialize(diffs.groupBy("list").agg(F.min(F.struct("need", "id")).alias("hub")), "hubs")
    common.release(members, ref)
    sure = diffs.join(hubs, "list").filter("id != hub.id AND need + hub.need <= 0")
    sure = common.materialize(sure.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct(), "sure")
    links.add(sure)
    common.release(sure)

    def run(batches):
        for batch in common.sliced(batches):
            out = ([], [], [], [], [])
            for name, id_, n, need, least, packed in zip(*[batch.column(c).to_pylist() for c in ("list", "id", "n", "need", "least", "diff")], strict=True):
                diff = unpack(packed)
                shared = max(1, -(-(need + least) // (2 * (100 + p))))
                first = diff[: max(0, len(diff) - shared + 1)]
                if not len(first):
                    continue
                with np.errstate(over="ignore"):
                    out[0].append(common.mix64(first * _STEP + common.mix64(np.array([name], np.int64).view(np.uint64))).view(np.int64))
                for column, value in zip(out[1:4], (id_, n, need), strict=True):
                    column.append(np.full(len(first), value, np.int64))
                out[4].append(len(diff) - np.arange(len(first)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["list", "id", "n", "need", "left"])

    keys = diffs.join(hubs, "list").select("list", "id", "n", "need", F.col("hub.need").alias("least"), "diff").mapInArrow(run, "list long, id long, n long, need long, left long")
    keys = common.materialize(keys.withColumn("n", F.col("n").cast("int")), "keys")
    several = keys.groupBy("list").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    out = links.open(keys.join(several, "list"), prune=True)
    common.release(keys, diffs, hubs)
    return out


def links_of(docs: DataFrame, plan: Plan, by_class: DataFrame) -> Links:
    """Links between classes that connect what all links connect."""
    partners = common.materialize(with_partners(docs, plan, by_class), "partners")
    bitmap = common.bitmap_of(partners, "id", BITS)
    found = common.materialize(scan_lists(postings(docs, plan, bitmap), plan.percent), "lists")
    pairs = found.filter("kind = 'pair'").groupBy("x", "y").agg(F.sum("count").alias("count"))
    lists = common.materialize(found.filter("kind = 'list'").select(F.col("x").alias("list"), F.col("y").alias("id"), F.col("count").cast("int").alias("n")).distinct(), "members")
    sets = common.materialize(sets_of(docs, plan, lists.select("id")), "sets")
    ways = pairs.select(F.col("x").alias("me"), F.col("y").alias("other"), "count").unionByName(pairs.select(F.col("y").alias("me"), F.col("x").alias("other"), "count"))
    best = ways.groupBy("me").agg(F.max(F.struct("count", "other")).alias("best"))
    links = Links(sets, plan, best.select(F.least("me", "best.other").alias("a"), F.greatest("me", "best.other").alias("b")).distinct())
    common.release(partners, found)
    star_round(links, lists)
    lists = lists.withColumn("left", F.col("n").cast("long")).withColumn("need", 2 * plan.percent * F.col("left"))
    rows, short = links.open(lists), SHORT
    while True:
        short_pairs(links, rows.filter(F.col("m") <= short))
        longer = rows.filter(F.col("m") > short)
        if longer.isEmpty():
            return links
        if short == SHORT:  # lists that share members are split as one: a member enters once, not with each of its lists
            group = connected(longer.select(F.col("list").alias("a"), F.col("id").alias("b")))
            longer = longer.join(group, longer["list"] == group["node"]).select(group["label"].alias("list"), "id", "n").distinct()
        rows, short = split(links, longer.select("list", "id", "n")), SHORT_SPLIT


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, own included).

    Whole texts in lower case (A to Z); fewer words than `words` make one shingle; null and blank texts have none, are
    linked with nothing and are their own component. Equal texts are linked. A null doc_id is never a component's
    smallest unless all are null. Repeated rows give a row each. An empty table gives no rows. Other columns play no part.
    """
    rows, grouped = _grouped(docs, words, percent)
    return _with_component(rows, grouped).select("doc_id", "n_shingles", "component_id")


def _with_component(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    joined = rows.join(grouped, (rows["id"] == grouped["class"]) & (rows["n_shingles"] > 0), "left")
    return joined.select("doc_id", "n_shingles", "id", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, words: int, percent: int, plan: Plan | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of classes_of, and class, label, component_id of each class; labels tell components apart."""
    plan = plan or plan_for(docs, words, percent)
    while True:
        rows = common.materialize(classes_of(docs, plan), "classes")
        by_class = rows.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.max("n_counted").alias("n_counted"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
        by_class = common.materialize(by_class, "by_class")
        clashing = by_class.filter("lo != hi")  # different sets with one id: about N**2 / 2**65 of N
        if clashing.isEmpty():
            break
        plan.clashing.append(common.bitmap_of(clashing, "id"))
        common.release(rows, by_class)
    links = links_of(docs, plan, by_class)
    grouped = by_class.join(links.labels, by_class["id"] == links.labels["node"], "left").select("id", "least", F.coalesce("label", "id").alias("label"))
    grouped = common.materialize(grouped, "grouped")
    smallest = common.materialize(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    out = common.materialize(grouped.join(smallest, "label").select(F.col("id").alias("class"), "label", "component_id"), "grouped")
    common.release(by_class, grouped, smallest, links.sets, links.found, links.labels)
    return rows, out


def without_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest doc_id; all columns stay.

    Rows without words stay, and so do rows without a doc_id. Rows that share a doc_id are told apart by their sets:
    of those in a group whose smallest doc_id they have, one stays. An empty table gives no rows; other columns may bear
    any name.
    """
    plan = plan_for(docs, words, percent)
    rows, grouped = _grouped(docs, words, percent, plan)
    names = common.free_names(docs.columns, "doc_id", "id", "label", "least")
    near = common.materialize(_with_component(rows, grouped).filter("doc_id IS NOT NULL"), "near")
    common.release(rows)
    key = F.col("doc_id").cast("long")
    twice = common.materialize(near.groupBy(F.col("doc_id").alias(names[0])).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    gone = near.filter("n_shingles > 0 AND doc_id != component_id").select(F.col("doc_id").alias(names[0])).distinct().join(twice, names[0], "left_anti")
    left = docs.join(gone, key == F.col(names[0]), "left_anti")
    if twice.isEmpty():
        return left
    again = with_class(left.join(twice, key == F.col(names[0]), "left_semi"), plan, names[1])
    again = again.join(grouped.select(F.col("class").alias(names[0]), F.col("label").alias(names[2]), F.col("component_id").alias(names[3])), F.col(names[1]) == F.col(names[0]), "left")
    kept = again.filter(F.col(names[2]).isNotNull() & (key == F.col(names[3]))).dropDuplicates(["doc_id", names[2]])
    kept = kept.unionByName(again.filter(F.col(names[2]).isNull()))
    return left.join(twice, key == F.col(names[0]), "left_anti").unionByName(kept.select(*docs.columns))


def with_class(docs: DataFrame, plan: Plan, name: str) -> DataFrame:
    """docs and the id of each row's class as column `name`; null for rows without words."""

    def run(batches):
        for batch in common.sliced(batches):
            ids = [plan.identity(tokens)[0] if len(tokens) else None for _, tokens in _each_set(batch, plan.words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"))


ORACLE_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g
  FROM d
), c AS MATERIALIZED (
  SELECT g, min(doc_id) AS class, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g
), p AS MATERIALIZED (
  SELECT class, n, unnest(g) AS x FROM c
), l AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b FROM p AS a JOIN p AS b ON a.x = b.x AND a.class <> b.class AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT class AS a, class AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m ON c.class = m.a
"""
