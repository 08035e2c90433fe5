"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a hash key. Within its source the rows are ordered by key in ranges (the first hexadecimal digits of
the key), the ranges' word counts are summed and accumulated, and the order within a range gives each row the number
of words before it. A source's budget then cuts that order at an exact word; a budget above the source's size takes
whole epochs first. No range depends on the number of rows of one source in one task, so a hot source spreads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Hexadecimal digits of the key that make a range: 4096 ranges a source.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size -> also target: the weighted share of the budget, at most `most` times the source's size.

    What a source's limit leaves over is shared among the others by weight until none is above its limit. The
    window runs over one row a source: sorted by limit / weight, a source is limited when the level that the rest
    would get is above its own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    place = F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()))
    rows = rows.withColumn("level", level).withColumn("place", place)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("place"))).over(every)
    rows = rows.withColumn("first", first).withColumn("free", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(every))
    return rows.select("source", "source_size", F.when(F.col("place") >= F.col("first"), F.col("free") * F.col("weight")).otherwise(F.col("limit")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, share: float = SHARE, most: int = MOST_EPOCHS, weights: tuple = WEIGHTS, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    size is the number of words of the whole text (null: 0); taken is how many of them the mix takes, repeats
    counted, never above `most` times size. The row at which a budget ends is taken in part. Null sources are one
    source, the last. Repeated rows each get their own place; ties of key go by doc_id, then size. An empty table
    gives no rows. Equal inputs give equal results: the key depends on doc_id and seed alone.
    """
    doc_id = F.col("doc_id").cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "source", size.alias("size"), key.alias("key"))
    rows = common.materialize(rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies")), "mix")
    rows = rows.withColumn("range", F.substring("key", 1, range_digits))
    ranges = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    goal = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), share, most, weights)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = ranges.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "words")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    ranges = ranges.withColumnsRenamed({"source": "r_source", "range": "r_range"})
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    rows = common.with_copies(rows, "copies", "copy")
    at = F.col("start") + F.col("before") + F.col("copy") * F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - at))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 0, share: float = SHARE, most: int = MOST_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """The rows of the mix: docs with each row as often as the mix takes it, all columns kept.

    Where a budget ends within a row, that copy has the words up to there, joined by spaces. Rows of which no word is
    taken are left out, null and blank texts among them. Rows that agree in doc_id, source and size get the places of the
    mix in order of text. An empty table gives no rows; other columns may bear any name.
    """
    same = ["doc_id", "source", "size", "place"]
    wanted = [*same, *[f"p_{c}" for c in same], "taken", "copy"]
    my = dict(zip(wanted, common.free_names(docs.columns, *wanted), strict=True))
    plan = mix(docs, seed, share, most, weights)
    plan = plan.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("taken")))).filter("taken > 0")
    plan = common.materialize(plan.select(*same, "taken"), "plan").withColumnsRenamed({c: my[f"p_{c}"] for c in same} | {"taken": my["taken"]})
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    rows = docs.withColumns({my["doc_id"]: F.col("doc_id").cast("long"), my["source"]: F.col("source"), my["size"]: size})
    rows = rows.withColumn(my["place"], F.row_number().over(Window.partitionBy(*[my[c] for c in same[:3]]).orderBy("text")))
    rows = rows.join(plan, [F.col(my[c]).eqNullSafe(F.col(my[f"p_{c}"])) for c in same])
    size, taken, copy = (F.col(my[c]) for c in ("size", "taken", "copy"))
    rows = rows.withColumn(my["copy"], F.explode(F.sequence(F.lit(0).cast("long"), F.floor((taken - 1) / size))))  # as many as epochs
    words = F.least(size, taken - copy * size)
    text = F.when(words == size, F.col("text")).otherwise(F.array_join(F.slice(common.words_of(F.col("text")), F.lit(1), words.cast("int")), " "))
    return rows.withColumn("text", text).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


ORACLE_OP6 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('0-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0 * source_size AS lim, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS place,
         (sum(source_size) OVER () * 1.5 - coalesce(sum(2.0 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, min(CASE WHEN level * weight <= lim THEN place END) OVER () AS first_free FROM l
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CAST(CASE WHEN place >= first_free THEN max(CASE WHEN place = first_free THEN level END) OVER () * weight ELSE lim END AS DOUBLE) AS target
  FROM f
), p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - begins)) AS BIGINT) AS taken
FROM e
"""
