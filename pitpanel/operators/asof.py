"""As-of joins: the last row known at a time, per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, known: str, order: list[str], carry: list[str]) -> DataFrame:
    """left with `carry` of the last right row of the key whose `known` is not after `at`.

    Ties of `known` go by `order`, the last wins; a NULL value of that row is kept, never an older one. Right rows
    without `known` don't count. Both sides go into one sorted run per key, so there is one shuffle and no range join.
    """
    return as_of_each(left, right, key, at, order, {known: carry})


def as_of_each(left: DataFrame, right: DataFrame, key: str, at: str, order: list[str], carried: dict[str, list[str]]) -> DataFrame:
    """as_of for several `known` columns of right at once (known -> carry): right is computed once and left moved once."""
    shape = {known: right.select(F.struct(*carry)).schema[0].dataType for known, carry in carried.items()}
    payload = lambda at: [(F.struct(*carry) if known == at else F.lit(None).cast(shape[known])).alias(f"__p{i}") for i, (known, carry) in enumerate(carried.items())]
    facts = right.select(F.col(key).alias("__k"), F.struct(*order).alias("__o"), F.explode(F.array(*[F.struct(F.col(known).alias("__t"), *payload(known)) for known in carried])).alias("__f"))
    facts = facts.select("__k", "__f.__t", F.lit(0).alias("__side"), "__o", *[f"__f.__p{i}" for i in range(len(carried))], F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l")).filter("__t IS NOT NULL")
    empty = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns if c.startswith(("__o", "__p"))]
    asks = left.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), *empty, F.struct(*left.columns).alias("__l"))
    w = Window.partitionBy("__k").orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.unionByName(asks).withColumns({f"__p{i}": F.last(f"__p{i}", ignorenulls=True).over(w) for i in range(len(carried))}).filter("__side = 1")
    return rows.select("__l.*", *[F.col(f"__p{i}.{c}").alias(c) for i, carry in enumerate(carried.values()) for c in carry])


def validity(right: DataFrame, key: str, known: str, order: list[str]) -> DataFrame:
    """right with valid_to: the time from which a later row of the key is known; one row for each (key, known)."""
    newest = Window.partitionBy(key, known).orderBy(*[F.desc(c) for c in order])
    rows = right.filter(F.col(known).isNotNull()).withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")
    return rows.withColumn("valid_to", F.lead(known).over(Window.partitionBy(key).orderBy(known)))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, known: str, carry: list[str], ahead: bool = False, most_days: int | None = None) -> DataFrame:
    """left with `found` (the date met) and `carry` of the key's right row at `at` or nearest before it (after it, with ahead).

    Rows more than most_days away don't count; values are carried as they are, NULLs too. Right has one row for each
    (key, known) and rows without `known` don't count. One sorted run per key, as in as_of.
    """
    payload = F.struct(F.col(known).alias("__f"), *carry)
    facts = right.filter(F.col(known).isNotNull()).select(F.col(key).alias("__k"), F.col(known).alias("__t"), F.lit(0).alias("__side"), payload.alias("__p"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    asks = left.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(facts.schema["__p"].dataType).alias("__p"), F.struct(*left.columns).alias("__l"))
    w = Window.partitionBy("__k").orderBy(F.desc("__t") if ahead else F.col("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.unionByName(asks).withColumn("__p", F.last("__p", ignorenulls=True).over(w)).filter("__side = 1")
    if most_days is not None:
        rows = rows.withColumn("__p", F.when(F.abs(F.datediff("__t", F.col("__p.__f"))) <= most_days, F.col("__p")))
    return rows.select("__l.*", F.col("__p.__f").alias("found"), *[F.col(f"__p.{c}").alias(c) for c in carry])


def months_before(prices: DataFrame, months: int, key: str = "ticker", date: str = "date", value: str = "close") -> DataFrame:
    """prices with `start`: the last known value at or before the date less so many months; NULL before the first."""
    known = prices.filter(F.col(value).isNotNull()).select(key, F.col(date).alias("__d"), F.col(value).alias("start"))
    asked = prices.withColumn("__ask", F.add_months(date, -months))
    return nearest(asked, known, key, "__ask", "__d", ["start"]).drop("__ask", "found")
