"""Maintenance of stored tables: upserts, events, adjustment of prices, coverage, cache intervals, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows that break the ingest contract."""


def normalize_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Vendor names to standard ones; a raw column that already has a standard name gives way."""
    taken = [new for old, new in names.items() if old in df.columns and new in df.columns and new not in names]
    return df.drop(*taken).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def check_known_dates(df: DataFrame, known: str = "datekey", period: str = "reportperiod", fallback: str = "calendardate") -> DataFrame:
    """df, or ContractError with three examples where a filing is known before its period ends (92 days' grace by quarter)."""
    bad = df.filter(F.col(known) < (F.col(period) if period in df.columns else F.date_sub(fallback, 92)))
    if rows := bad.limit(3).collect():
        raise ContractError(f"filings known before their period: {rows}")
    return df


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def insert_first(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First filing wins: rows with a NULL key go, the earliest of a key stays, and only new keys are added."""
    rows = first_per_key(incoming.dropna(subset=keys), keys, order)
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def merge_fields(target: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """New keys are added; of known ones every field that comes with a value replaces the stored one."""
    rows = first_per_key(incoming.dropna(subset=keys), keys, order)
    new = rows.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    return target.join(new, keys, "full_outer").select(*[c if c not in fields else F.coalesce(f"__{c}", c).alias(c) for c in target.columns])


def replace_events(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last load wins: stored rows of keys that come again go, then the incoming ones are added."""
    rows = first_per_key(incoming.dropna(subset=keys), keys, order)
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*target.columns))


def adjustment_factors(stored: DataFrame, incoming: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """ticker, factor where incoming closes are a constant multiple (other than 1) of stored ones on common dates."""
    both = stored.filter("close > 0").select("ticker", "date", F.col("close").alias("__old")).join(incoming.filter("close IS NOT NULL").select("ticker", "date", "close"), ["ticker", "date"])
    both = both.groupBy("ticker").agg(F.avg(F.col("close") / F.col("__old")).alias("factor"), F.stddev_pop(F.col("close") / F.col("__old")).alias("__sd"))
    return both.filter((F.col("__sd") <= tolerance) & (F.abs(F.col("factor") - 1) > tolerance)).select("ticker", "factor")


def rescale(prices: DataFrame, factors: DataFrame) -> DataFrame:
    rows = prices.join(factors, "ticker", "left")
    return rows.withColumn("close", F.col("close") * F.coalesce("factor", F.lit(1.0))).select(*prices.columns)


def coverage(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """name, rows, tickers, first, last of each table and its date column."""
    one = lambda name, df, date: df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("tickers"), F.min(date).cast("date").alias("first"), F.max(date).cast("date").alias("last"))
    return reduce(DataFrame.unionByName, [one(name, df, date) for name, (df, date) in tables.items()])


def cache_metadata(prices: DataFrame) -> DataFrame:
    return prices.filter("close IS NOT NULL").groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_rows"))


def missing_ranges(metadata: DataFrame, start: str, end: str) -> DataFrame:
    """ticker, start, end of what lies before and after the cached range."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    gap = lambda a, b: F.when(a <= b, F.struct(a.alias("start"), b.alias("end")))
    gaps = F.array_compact(F.array(F.when(s < F.col("first"), gap(s, F.least(e, F.date_sub("first", 1)))), F.when(e > F.col("last"), gap(F.greatest(s, F.date_add("last", 1)), e))))
    return metadata.select("ticker", F.explode(gaps).alias("g")).select("ticker", "g.*")


def date_gaps(prices: DataFrame, days: int = 4) -> DataFrame:
    """ticker, date, gap where more than `days` days lie between a row and the one before."""
    rows = prices.filter("close IS NOT NULL").withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))))
    return rows.filter(F.col("gap") > days).select("ticker", "date", "gap")


def duplicate_dates(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker", "date").count().filter("count > 1")


def quarterly_transactions(transactions: DataFrame, quarter_end) -> DataFrame:
    """ticker, calendardate, shares, datekey (3 days after the quarter): net transactions over the whole input."""
    rows = transactions.groupBy("ticker", quarter_end(F.col("filingdate")).alias("calendardate")).agg(F.round(F.sum("shares"), 2).alias("shares"))
    return rows.withColumn("datekey", F.date_add("calendardate", 3))
