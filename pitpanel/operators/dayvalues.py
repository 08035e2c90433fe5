"""Values of expressions over windows of days on a few days only, for a name or a block of names at once.

A window's moments are taken where they are asked for instead of on every day: a month's last days need a thirtieth of
them, and each is summed on its own, so no difference of long sums loses digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import TINY

#: Operators that need all days of a window.
ROLLED = {"ma", "std", "downside", "rsi", "beta"}
#: What can be given along a name's days.
NODES = ROLLED | {"field", "const", "add", "sub", "mul", "div", "neg", "abs", "lag", "accel", "mom", "change"}


class _Days:
    """Columns (names x days; the market's: days) with values of nodes (name, arguments, parameters), NaN for unknown."""

    def __init__(self, columns: dict[str, np.ndarray], names: int, days: int):
        self.columns, self.names, self.days, self.known = columns, names, days, {}

    def dense(self, node) -> np.ndarray:
        if node not in self.known:
            self.known[node] = self._dense(*node)
        return self.known[node]

    def _dense(self, name, args, params):
        if name == "field":
            return self.columns[params[0]]
        if name == "const":
            return np.float64(params[0])
        if name in ROLLED:
            return self.at((name, args, params), np.arange(self.days))
        return _value(name, params, *[lambda n, x=x: before(self.dense(x), n) if n else self.dense(x) for x in args])

    def at(self, node, days: np.ndarray) -> np.ndarray:
        """Values of a node on the days (places); windows in it are taken on the days it looks at alone."""
        name, args, params = node
        if name in ROLLED:
            return self._rolled(name, args, *params, days)
        if not _rolls(node):
            return self.dense(node) if name == "const" else self.dense(node)[..., days]
        return _value(name, params, *[lambda n, x=x: self._earlier(x, days, n) for x in args])

    def _earlier(self, node, days, n):
        if not n:
            return self.at(node, days)
        inside = (days >= n) & (days - n < self.days)
        out = np.full((self.names, len(days)), np.nan)
        out[:, inside] = self.at(node, days[inside] - n)
        return out

    def _rolled(self, name, args, n, days):
        x = self.dense(args[0])
        if name == "rsi":
            return np.stack([wilder(v, n)[days] for v in x])
        if name == "beta":
            return self._beta(x, n, days)
        if name == "downside":
            return moments(np.where(x < 0, x, np.nan), n, days, max(2, n // 4))[1]
        if name == "ma":
            return means(x, n, days, max(2, n // 2))[0]
        return moments(x, n, days, max(2, n // 2))[1]

    def _beta(self, x, n, days):
        r, m = windows(x, n, days), windows(self.columns["__m"], n, days)
        pair = ~np.isnan(r * m)
        count = pair.sum(axis=-1)
        r, m = centred(r, pair, count), centred(m, pair, count)
        cov = np.divide((r * m).sum(axis=-1), count - 1, out=np.full(count.shape, np.nan), where=count >= max(20, n // 2))
        return ratio(cov, self.columns[f"__s{n}"][..., days] ** 2)


def _rolls(node) -> bool:
    return node[0] in ROLLED or any(map(_rolls, node[1]))


def fields_of(nodes) -> set[str]:
    """The fields that nodes read."""
    return {f for name, args, params in nodes for f in ({params[0]} if name == "field" else fields_of(args))}


def _value(name, params, a, b=None):
    """A node's values; a, b: values of its arguments so many days before."""
    match name:
        case "add":
            return a(0) + b(0)
        case "sub":
            return a(0) - b(0)
        case "mul":
            return a(0) * b(0)
        case "div":
            return ratio(a(0), b(0))
        case "neg":
            return -a(0)
        case "abs":
            return np.abs(a(0))
        case "lag":
            return a(params[0])
        case "accel":
            return a(0) - a(params[0])
        case "mom":
            return ratio(a(params[1]), a(params[0])) - 1
        case "change":
            return ratio(a(0), a(params[0])) - 1
    raise ValueError(f"{name} along days")


def ratio(a, b):
    """a / b, NaN where b is within TINY of zero."""
    a, b = np.broadcast_arrays(a, b)
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=np.abs(b) > TINY)


def before(x: np.ndarray, n: int) -> np.ndarray:
    out, days = np.full(x.shape, np.nan), x.shape[-1]
    if n >= 0:
        out[..., n:] = x[..., : max(days - n, 0)]
    else:
        out[..., :n] = x[..., -n:]
    return out


def windows(x: np.ndarray, n: int, days: np.ndarray, outside: float = np.nan) -> np.ndarray:
    """A row of the last n values for each of the days (x's last axis), `outside` before the first."""
    padded = np.concatenate([np.full((*x.shape[:-1], n - 1), outside, x.dtype), x], axis=-1)
    return np.lib.stride_tricks.sliding_window_view(padded, n, axis=-1)[..., days, :]


def centred(x, known, count):
    """x less its mean over known values, 0 where unknown."""
    mean = np.where(known, x, 0.0).sum(axis=-1) / np.maximum(count, 1)
    return np.where(known, x - mean[..., None], 0.0)


def means(x: np.ndarray, n: int, days: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (NaN under `least` values) and number of the last n values on the days, and the windows with 0 for unknown."""
    known = np.cumsum(~np.isnan(x), axis=-1)
    count = known[..., days] - np.where(days >= n, known[..., np.maximum(days - n, 0)], 0)
    w = windows(np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf), n, days, 0.0)
    return np.where(count >= least, w.sum(axis=-1) / np.maximum(count, 1), np.nan), count, w


def moments(x: np.ndarray, n: int, days: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the last n values on the days; NaN under `least` values."""
    mean, count, w = means(x, n, days, least)
    w = np.where(windows(~np.isnan(x), n, days, False), w - mean[..., None], 0.0)
    squares = np.einsum("...i,...i->...", w, w)
    return mean, np.sqrt(np.divide(squares, count - 1, out=np.full(count.shape, np.nan), where=(count >= least) & (count > 1)))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """The index of timeseries.wilder_rsi on every day."""
    d = pd.Series(x).diff()
    smoothed = lambda v: v.ewm(alpha=1.0 / n, adjust=False, ignore_na=True).mean().to_numpy()
    gain, loss = smoothed(d.clip(lower=0)), smoothed((-d).clip(lower=0))
    known = (d.notna().cumsum() >= n).to_numpy() & (np.abs(loss) > TINY)
    return np.where(known, 100 - 100 / (1 + np.divide(gain, loss, out=np.zeros(len(d)), where=known)), np.nan)


def _schema(ticker: T.StructField, keep: list[T.StructField], nodes) -> T.StructType:
    return T.StructType([ticker, *keep, *[T.StructField(c, T.DoubleType()) for c in nodes]])


def _with_values(out: pa.Table, values: _Days, nodes: dict[str, tuple], mask: np.ndarray, places: np.ndarray) -> pa.Table:
    """out (the names' rows one after the other, one for each of the places) with a column for each of the nodes."""
    for name, (node, bits) in nodes.items():
        wanted, found = (mask & bits) != 0, np.full((values.names, len(places)), np.nan)
        found[:, wanted] = values.at(node, places[wanted])
        out = out.append_column(name, _doubles(found.ravel()))
    return out


def _doubles(v: np.ndarray) -> pa.Array:
    return pa.array(v, pa.float64(), mask=np.isnan(v))


def on_days(daily: DataFrame, days: DataFrame, nodes: dict[str, tuple], keep: list[str]) -> DataFrame:
    """ticker, the columns of `keep` and one for each of `nodes`, of daily's rows on the days (idx, mask) only.

    daily: ticker, idx, numbers; nodes: column -> (node, bits), the node being (name, arguments, parameters) of NODES
    and given on the days whose mask has one of the bits. Beta reads the columns __m and __s{n} of the market.
    """
    schema = _schema(daily.schema["ticker"], [daily.schema[c] for c in keep], nodes)
    numbers = [c for c in daily.columns if c not in ("ticker", "date")]

    def run(rows: pa.Table) -> pa.Table:
        idx, mask = rows.column("idx").to_numpy(), rows.column("__mask").to_numpy()
        first, asked = idx.min(), np.flatnonzero(mask)
        columns = {c: np.full((1, idx.max() - first + 1), np.nan) for c in numbers}
        for c, v in columns.items():
            v[0, idx - first] = rows.column(c).to_numpy()
        return _with_values(rows.take(pa.array(asked)).select(["ticker", *keep]), _Days(columns, 1, idx.max() - first + 1), nodes, mask[asked], idx[asked] - first)

    marked = daily.join(F.broadcast(days.select("idx", F.col("mask").alias("__mask"))), "idx", "left").fillna(0, ["__mask"])
    return marked.select("ticker", *dict.fromkeys([*keep, *numbers]), "__mask").groupBy("ticker").applyInArrow(run, schema)


def from_trades(trades: DataFrame, block: str, calendar: pd.DataFrame, fill: Callable[[dict, np.ndarray, np.ndarray], dict], nodes: dict[str, tuple], keep: list[str]) -> DataFrame:
    """on_days for names whose days follow from few rows: `fill` makes them, by name and day, inside the call that takes the windows.

    trades: ticker, idx (from 1 on), numbers and `block`, the same for few names (a call takes them together); calendar: a row a
    day in order with date, idx, mask, __trade (for fill) and the market's columns; keep: date, idx and columns that fill gives.
    """
    fields = [c for c in keep if c not in ("date", "idx")]
    schema = _schema(trades.schema["ticker"], [T.StructField("date", T.DateType()), T.StructField("idx", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in fields]], nodes)
    numbers = [c for c in trades.columns if c not in ("ticker", block)]
    trade, market = calendar["__trade"].to_numpy(float), {c: calendar[c].to_numpy(float) for c in calendar.columns if c not in ("date", "idx", "mask", "__trade")}
    asked = np.flatnonzero(calendar["mask"])
    mask, dates, places = calendar["mask"].to_numpy()[asked], calendar["date"].iloc[asked].to_numpy(), (asked + 1).astype(np.int32)

    def run(rows: pa.Table) -> pa.Table:
        names = rows.column("ticker").combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(names, pa.ChunkedArray):
            names = names.chunk(0)
        count = len(names.dictionary)
        columns = fill({c: rows.column(c).to_numpy() for c in numbers}, trade, names.indices.to_numpy())
        each = pa.array(np.repeat(np.arange(count), len(asked)))
        out = {"ticker": names.dictionary.take(each), "date": pa.array(np.tile(dates, count), pa.date32()), "idx": pa.array(np.tile(places, count)), **{c: _doubles(columns[c][:, asked].ravel()) for c in fields}}
        return _with_values(pa.table(out), _Days(columns | market, count, len(trade)), nodes, mask, asked)

    return trades.groupBy(block).applyInArrow(run, schema)
