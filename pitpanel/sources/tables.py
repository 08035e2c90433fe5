"""Stored tables: Parquet in batch folders, one pointer that says which folder holds which partition.

A load rewrites only the partitions (years) that its rows touch, as a new batch folder, and then moves a new pointer into
place; a reader takes the newest pointer. A load that is cut short leaves a folder that no pointer names, so none of its
rows is ever seen, and of two loads that start from one pointer the second to finish fails instead of losing the first.
Reads name the batch folders of the partitions, prune by partition and push filters and columns down to the files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from ..operators import store

# The fields of the stored tables, as the vendor names them.
FUNDAMENTAL_FIELDS = ("revenue", "cor", "gp", "netinc", "ebit", "ebitda", "assets", "equity", "debt", "ncfo", "capex", "sharesbas")
PRICE_FIELDS = ("close", "closeunadj", "volume", "mcap")


@dataclass(frozen=True)
class Schema:
    """Columns, key, the date that gives the partition, how rows of a known key are treated, and defaults of text columns."""

    columns: str
    keys: tuple[str, ...]
    date: str | None
    rule: str
    order: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()


def _numbers(names) -> str:
    return ", ".join(f"{n} double" for n in names)


_FILED = "ticker string, calendardate date, datekey date"
SCHEMAS = {
    "fundamentals": Schema(f"{_FILED}, dimension string, {_numbers(FUNDAMENTAL_FIELDS)}", ("ticker", "calendardate", "dimension"), "calendardate", "first", ("datekey",), (("dimension", "ARQ"),)),
    "institutions": Schema(f"{_FILED}, {_numbers(('inst_shares', 'inst_holders'))}", ("ticker", "calendardate"), "calendardate", "first", ("datekey",)),
    "insiders": Schema(f"{_FILED}, {_numbers(('insider_net_shares',))}", ("ticker", "calendardate"), "calendardate", "first", ("datekey",)),
    "estimates": Schema(f"{_FILED}, {_numbers(('eps_est', 'revenue_est'))}", ("ticker", "calendardate"), "calendardate", "first", ("datekey",)),
    "prices": Schema(f"ticker string, date date, {_numbers(PRICE_FIELDS)}", ("ticker", "date"), "date", "merge"),
    "tickers": Schema("ticker string, name string, sector string, industry string, location string, category string", ("ticker",), None, "first"),
    "actions": Schema("ticker string, date date, action string, value double, name string, contraticker string", ("ticker", "date", "action"), "date", "replace"),
    "members": Schema("date date, action string, ticker string, name string, contraticker string", ("date", "action", "ticker"), "date", "replace"),
}
PART, BATCH = "__part", "__batch"


class Conflict(RuntimeError):
    """Another load has moved the pointer meanwhile."""


class Store:
    """The tables of SCHEMAS under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, Schema] = SCHEMAS):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def schema(self, table: str) -> StructType:
        return self.spark.createDataFrame([], self.schemas[table].columns).schema

    def pointer(self, table: str) -> tuple[int, dict[str, str]]:
        """Number of the newest pointer (0 if none) and the batch of each partition."""
        fs, folder = self._fs(f"{self.root}/{table}/_pointers")
        if not fs.exists(folder):
            return 0, {}
        newest = max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)
        if not newest:
            return 0, {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.root}/{table}/_pointers/{newest}").first()
        return newest, json.loads(rows.value)

    def _point(self, table: str, number: int, parts: dict[str, str]) -> None:
        folder = f"{self.root}/{table}/_pointers"
        fs, draft = self._fs(f"{folder}/draft-{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        _, place = self._fs(f"{folder}/{number}")
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(f"{table}: pointer {number} exists")

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """The table as its newest pointer has it; filters on its date prune partitions if `parts` (years) names them, or by the years' folders."""
        schema = self.schema(table)
        _, known = self.pointer(table)
        paths = [f"{self.root}/{table}/{BATCH}={batch}/{PART}={part}" for part, batch in sorted(known.items()) if parts is None or part in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema]).add(BATCH, "string").add(PART, "string")
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.names)

    def between(self, table: str, start: str, end: str, tickers: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a span of dates, only of some names and columns: whole years outside the span are never listed, the rest is pushed down."""
        spec = self.schemas[table]
        rows = self.read(table, [str(y) for y in range(int(start[:4]), int(end[:4]) + 1)]).filter(F.col(spec.date).between(F.lit(start).cast(DateType()), F.lit(end).cast(DateType())))
        rows = rows.filter(F.col("ticker").isin(*tickers)) if tickers is not None else rows
        return rows.select(*columns) if columns else rows

    def shaped(self, table: str, incoming: DataFrame) -> DataFrame:
        """incoming with exactly the table's columns and types: numbers that are none become NULL, missing columns NULL or their default."""
        spec, names = self.schemas[table], {c.lower(): c for c in incoming.columns}
        defaults = dict(spec.defaults)
        columns = []
        for field in self.schema(table):
            value = F.col(f"`{names[field.name]}`") if field.name in names else F.lit(None)
            value = value.try_cast(field.dataType)
            columns.append(F.coalesce(value, F.lit(defaults[field.name])).alias(field.name) if field.name in defaults else value.alias(field.name))
        return incoming.select(*columns)

    def load(self, table: str, incoming: DataFrame) -> int:
        """Bring rows into a table by its rule; the number of partitions rewritten.

        `first`: the earliest row of a key stays and known keys are left alone; `merge`: values that come replace those of
        a known key, NULLs do not; `replace`: rows of a key that comes again go. Rows without a key are left out. Only
        partitions that the rows touch are read, and only those whose rows change are written: a re-run writes none.
        """
        spec = self.schemas[table]
        keys, order = list(spec.keys), list(spec.order) or sorted(set(self.schema(table).names) - set(spec.keys))
        part = F.year(spec.date).cast("string") if spec.date else F.lit("all")
        rows = self.shaped(table, incoming).dropna(subset=keys)
        touched = [r[0] for r in rows.select(part.alias("p")).distinct().collect()]  # years
        number, parts = self.pointer(table)
        old = self.read(table, touched)
        rule = {
            "first": lambda: store.insert_first(old, rows, keys, order), "replace": lambda: store.replace_events(old, rows, keys, order),
            "merge": lambda: store.merge_fields(old, rows, keys, [c for c in old.columns if c not in keys], order),
        }[spec.rule]
        batch = uuid.uuid4().hex
        draft = f"{self.root}/{table}/_drafts/{batch}"
        rule().withColumn(PART, part).write.partitionBy(PART).parquet(draft)
        made = self.spark.read.schema(StructType([*self.schema(table)]).add(PART, "string")).parquet(draft)
        sums = lambda df: df.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*self.schema(table).names).cast("decimal(38,0)")).alias("h"))
        was = {r.p: (r.n, r.h) for r in sums(old).collect()}
        changed = sorted(r.p for r in sums(made).collect() if was.get(r.p) != (r.n, r.h))
        fs, at = self._fs(draft)
        if changed:
            for p in changed:
                _, source = self._fs(f"{draft}/{PART}={p}")
                _, target = self._fs(f"{self.root}/{table}/{BATCH}={batch}/{PART}={p}")
                fs.mkdirs(target.getParent())
                fs.rename(source, target)
            self._point(table, number + 1, parts | dict.fromkeys(changed, batch))
        fs.delete(at, True)
        return len(changed)

    def rescale(self, incoming: DataFrame) -> int:
        """Stored prices brought to the level of incoming ones (splits), then the incoming ones loaded; partitions rewritten."""
        factors = store.adjustment_factors(self.read("prices"), self.shaped("prices", incoming))
        stored = self.read("prices")
        moved = stored.join(factors, "ticker").withColumn("close", F.col("close") * F.col("factor")).select(*stored.columns)
        return self.load("prices", moved) + self.load("prices", incoming)

    def metadata(self) -> DataFrame:
        """ticker, first, last, n_rows of stored prices."""
        return store.cache_metadata(self.read("prices")).orderBy("ticker")

    def fill(self, wanted: DataFrame, start: str, end: str, fetch: Callable[[DataFrame], DataFrame]) -> int:
        """Load what is missing of the wanted names' prices (ticker) from start to end; partitions rewritten.

        fetch gives prices for ranges (ticker, start, end): those before and after what is stored, all of a name that is
        not. Nothing is fetched for names that are complete.
        """
        names = wanted.select("ticker").distinct()
        known = names.join(store.cache_metadata(self.read("prices")), "ticker")
        new = names.join(known, "ticker", "left_anti").select("ticker", F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
        ranges = store.missing_ranges(known, start, end).unionByName(new)
        return self.load("prices", fetch(ranges))

    def clear(self, table: str, tickers: list[str] | None = None) -> None:
        """Forget a table's rows, of some names or all: a new pointer without them; files stay until they are purged."""
        number, parts = self.pointer(table)
        if tickers is None:
            return self._point(table, number + 1, {})
        spec, batch = self.schemas[table], uuid.uuid4().hex
        part = F.year(spec.date).cast("string") if spec.date else F.lit("all")
        rows = self.read(table).filter(~F.col("ticker").isin(*tickers))
        left = [r[0] for r in rows.select(part.alias("p")).distinct().collect()]
        rows.withColumn(PART, part).write.partitionBy(PART).parquet(f"{self.root}/{table}/{BATCH}={batch}")
        self._point(table, number + 1, dict.fromkeys(left, batch))

    def purge(self, table: str) -> None:
        """Delete batch folders that the newest pointer does not name; not while others read older ones."""
        _, parts = self.pointer(table)
        fs, folder = self._fs(f"{self.root}/{table}")
        for entry in fs.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith(f"{BATCH}=") and name.removeprefix(f"{BATCH}=") not in parts.values() or name == "_drafts":
                fs.delete(entry.getPath(), True)
