"""Reproducible shuffle into shards by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows get gapless global numbers without one task that sees them all: a hash of the doc_id deals rows into a fixed
number of ranges, the ranges' row counts are accumulated (a table of fixed size), and each range numbers its own
rows. A keyed Feistel network over a * b >= n with a, b near sqrt(n) permutes the numbers, walking on while the value
is n or above. The permuted number p gives shard p mod k and slot p div k, so either can be computed from the row
number alone, shards differ by one row at most, and slots have no gaps.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
#: Hexadecimal digits of the key that make a range: 4096 ranges.
RANGE_DIGITS = 3
ROUNDS = 8
#: Steps of the cycle walk. Fewer than a values lie at n or above, of a * b, so for n up to 4096 the walk always ends
#: within these steps, and above that it goes on past k steps with a chance below (1 / 64) ** k. A walk that were longer
#: ends the job with an error; no row ever gets a number of n or above.
WALK = 64
#: Modulus of the round function.
PRIME = 2147483647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below 2**31 for each round, from the seed."""
    out = []
    for k in range(rounds):
        digest = hashlib.sha256(f"{seed}/{k}".encode()).digest()
        out.append(tuple(int.from_bytes(digest[i : i + 4], "big") % (PRIME - 1) + 1 for i in (0, 4, 8)))
    return out


def permute(value: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network over the numbers below a * b; even rounds change the high half, odd ones the low half."""
    keys = F.array(*[F.struct(F.lit(k % 2).alias("odd"), *[F.lit(x).cast("long").alias(c) for c, x in zip("xyz", key, strict=True)]) for k, key in enumerate(round_keys(seed))])

    def step(state, key):
        other = F.when(key["odd"] == 1, state["hi"]).otherwise(state["lo"])
        mixed = common.let((other % PRIME * key["x"] + key["y"]) % PRIME, lambda v: v.bitwiseXOR(F.shiftright(v, 15)) * key["z"] % PRIME)
        return common.let(
            common.let(mixed, lambda v: v.bitwiseXOR(F.shiftright(v, 13))),
            lambda f: F.struct(
                F.when(key["odd"] == 1, state["hi"]).otherwise((state["hi"] + f) % a).alias("hi"),
                F.when(key["odd"] == 1, (state["lo"] + f) % b).otherwise(state["lo"]).alias("lo"),
            ),
        )

    start = F.struct(F.floor(value / b).cast("long").alias("hi"), (value % b).alias("lo"))
    return F.aggregate(keys, start, step, lambda s: s["hi"] * b + s["lo"])


def walk(value: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """The permutation of 0..n-1: the network again and again until the value is below n."""
    steps = F.sequence(F.lit(2), F.lit(WALK))
    done = F.aggregate(steps, permute(value, a, b, seed), lambda v, _: F.when(v < n, v).otherwise(permute(v, a, b, seed)))
    return common.let(done, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long")))


def numbered(docs: DataFrame, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """doc_id, size, text_crc32, row_number (global, from 0, by hash of doc_id, doc_id, size, crc) and n (all rows)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).alias("key"),
    )
    rows = common.materialize(rows.groupBy("key", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "shard")
    rows = rows.withColumn("range", F.substring("key", 1, range_digits))
    ranges = rows.groupBy("range").agg(F.sum("copies").alias("here"))
    ranges = ranges.withColumn("first", F.coalesce(F.sum("here").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = ranges.withColumn("n", F.sum("here").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("here")
    order = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(ranges, "range")
    rows = common.with_copies(rows, "copies", "copy")
    return rows.select("doc_id", "size", "text_crc32", (F.col("first") + F.col("before") + F.col("copy")).alias("row_number"), "n")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 0, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law).

    A null text has size 16 and the checksum of no bytes. Null doc_ids are numbered like any other; repeated rows
    each get their own place. Shards' row counts differ by one at most. Equal inputs and seeds give equal results.
    An empty table gives no rows; columns other than doc_id and text play no part.
    """
    rows = numbered(docs, range_digits)
    n = F.col("n")
    rows = rows.withColumn("a", F.ceil(F.sqrt(n.cast("double"))).cast("long")).withColumn("b", F.ceil(n / F.col("a")).cast("long"))
    rows = rows.withColumn("place", walk(F.col("row_number"), n, F.col("a"), F.col("b"), seed))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
