"""Readers of files: bulk CSV by kind, ticker lists, vendor JSON, return series in JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import ContractError, normalize_columns


@dataclass(frozen=True)
class Kind:
    """How a bulk file becomes a standard table: new names, columns in millions, days until known, a row filter."""

    names: dict[str, str] = field(default_factory=dict)
    millions: tuple[str, ...] = ()
    known_after: tuple[str, int] | None = None
    keep: str | None = None


#: Vendor columns by kind of file.
KINDS = {
    "fundamentals": Kind(keep="dimension = 'ARQ'"),
    "prices": Kind({"closeadj": "close"}),
    "daily": Kind({"marketcap": "mcap"}, millions=("mcap", "ev")),
    "institutions": Kind({"date": "calendardate", "shrunits": "inst_shares", "shrholders": "inst_holders"}, known_after=("calendardate", 45)),
    "insiders": Kind({"transactionshares": "shares"}),
    "tickers": Kind({"isdelisted": "is_delisted"}),
    "actions": Kind(),
    "sp500": Kind(),
}


def standard(df: DataFrame, kind: str) -> DataFrame:
    """A vendor table in standard form; text that is no number becomes NULL, never an error."""
    k = KINDS[kind]
    if kind == "prices" and "closeadj" in df.columns:
        df = df.drop("close")
    df = normalize_columns(df, k.names)
    for c in k.millions:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast("double") * 1e6)
    if k.known_after:
        df = df.withColumn("datekey", F.date_add(F.to_date(k.known_after[0]), k.known_after[1]))
    return df.filter(k.keep) if k.keep and "dimension" in df.columns else df


def read_csv(spark: SparkSession, path: str, kind: str, most_bad: float = 0.01) -> DataFrame:
    """A bulk CSV file (gzip too) in standard form; filings known before their period go if few, else ContractError."""
    df = standard(spark.read.option("header", True).csv(path), kind)
    if kind == "fundamentals" and {"datekey", "reportperiod"} <= set(df.columns):
        bad = F.coalesce(F.to_date("datekey") < F.to_date("reportperiod"), F.lit(False))
        share = df.agg(F.avg(bad.cast("double"))).first()[0] or 0.0
        if share > most_bad:
            raise ContractError(f"{share:.1%} of filings are known before their period ends")
        df = df.filter(~bad)
    return df


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Vendor JSON: a list of records, or {columns: [...], data: [[...]]} with names of columns beside rows of values."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if set(df.columns) == {"columns", "data"}:
        names = df.select("columns").first()[0]
        rows = df.select(F.explode("data").alias("r"))
        return rows.select(*[F.col("r")[i].alias(c) for i, c in enumerate(names)])
    return df


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker: upper case, distinct, sorted; of a CSV file's ticker column or of words between commas and spaces."""
    lines = spark.read.text(path)
    first = lines.first()
    if first and "ticker" in [c.strip().lower() for c in first[0].split(",")]:
        df = spark.read.option("header", True).csv(path)
        words = df.select(F.col(next(c for c in df.columns if c.strip().lower() == "ticker")).alias("t"))
    else:
        words = lines.select(F.explode(F.split("value", r"[,\s]+")).alias("t"))
    out = words.select(F.upper(F.trim("t")).alias("ticker")).filter("ticker != ''").distinct().orderBy("ticker")
    if out.isEmpty():
        raise ValueError(f"{path} has no tickers")
    return out


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """date, r of a JSON object of unix seconds to returns, sorted."""
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("s", "r"))
    return df.select(F.timestamp_seconds(F.col("s").cast("long")).cast("date").alias("date"), "r").orderBy("date")


def wanted_only(prices: DataFrame, tickers: list[str]) -> DataFrame:
    """Rows of the tickers with a close; a ticker without any row is an error."""
    rows = prices.filter(F.col("ticker").isin(tickers) & F.col("close").isNotNull())
    missing = set(tickers) - {r.ticker for r in rows.select("ticker").distinct().collect()}
    if missing:
        raise ValueError(f"no prices for {sorted(missing)}")
    return rows


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """A report as CSV files with a header, in ascending or (`-name`) descending order over all files; an older report goes."""
    _in_order(rows, order).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json(rows: DataFrame, path: str, *order: str) -> None:
    """A report as JSON records, one a line, NULLs written out; order and older reports as in write_csv."""
    _in_order(rows, order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_returns(returns: DataFrame, path: str) -> None:
    """date, r as what read_returns reads: an object of unix seconds to returns in each year's folder."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.unix_seconds(F.col("date").cast("timestamp")).cast("string"), "r"))))
    years = returns.filter("r IS NOT NULL").groupBy(F.year("date").alias("year")).agg(F.to_json(pairs).alias("value"))
    years.write.mode("overwrite").partitionBy("year").text(path)


def _in_order(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return rows.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]) if order else rows
