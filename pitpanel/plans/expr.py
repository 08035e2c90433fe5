"""Factor expressions: a small tree that compiles to DataFrame plans.

An expression lives on the quarterly or the daily grid. Combining the two promotes the quarterly side: each day sees
the last filing known that day. All requested factors compile together: expressions are numbered by their text, so a
shared part is computed once, and windows with the same partitioning run in one sort.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..operators import crosssection as xs
from ..operators import dayvalues
from ..operators import timeseries as ts
from ..operators.asof import as_of_each

#: Stock fields: a sum over four quarters means nothing, so ttm leaves them as they are.
STOCKS = frozenset(
    "assets assetsc cashneq inventory receivables intangibles liabilities liabilitiesc debt debtc debtnc equity retearn invcap workingcapital sharesbas inst_shares inst_holders".split()
)


class GridError(TypeError):
    """An operator on the wrong grid."""


class MissingFieldError(KeyError):
    """A field that no table has."""


@dataclass(frozen=True, eq=False)
class Expr:
    """A node: name of the operator, arguments (nodes), parameters; make(columns) gives its column."""

    name: str
    args: tuple[Expr, ...] = ()
    params: tuple = ()
    make: Callable[..., Column] | None = field(default=None, repr=False)
    only: str | None = None

    def describe(self) -> str:
        if self.name in ("field", "const"):
            return str(self.params[0])
        inner = ", ".join([a.describe() for a in self.args] + [str(p) for p in self.params])
        return f"{self.name}({inner})"

    def _op(self, name: str, make, *args: Expr, params: tuple = (), only: str | None = None) -> Expr:
        return Expr(name, (self, *args), params, make, only)

    def _pair(self, other, name: str, fn, swap: bool = False) -> Expr:
        other = other if isinstance(other, Expr) else const(other)
        a, b = (other, self) if swap else (self, other)
        if a.name == b.name == "const":
            raise ValueError("an expression needs a field")
        return Expr(name, (a, b), (), fn)

    def __add__(self, o):
        return self._pair(o, "add", operator.add)

    def __radd__(self, o):
        return self._pair(o, "add", operator.add, True)

    def __sub__(self, o):
        return self._pair(o, "sub", operator.sub)

    def __rsub__(self, o):
        return self._pair(o, "sub", operator.sub, True)

    def __mul__(self, o):
        return self._pair(o, "mul", operator.mul)

    def __rmul__(self, o):
        return self._pair(o, "mul", operator.mul, True)

    def __truediv__(self, o):
        return self._pair(o, "div", safe_div)

    def __rtruediv__(self, o):
        return self._pair(o, "div", safe_div, True)

    def __neg__(self):
        return self._op("neg", operator.neg)

    def __abs__(self):
        return self._op("abs", F.abs)

    def lag(self, n):
        return self._op("lag", lambda c: ts.lag(c, n), params=(n,))

    def accel(self, n):
        return self._op("accel", lambda c: c - ts.lag(c, n), params=(n,))

    def ttm(self):
        if self.name == "field" and self.params[0] in STOCKS:
            return self
        return self._op("ttm", ts.ttm, only="q")

    def qoq(self):
        return self._op("qoq", lambda c: ts.growth(c, 1), only="q")

    def yoy(self):
        return self._op("yoy", lambda c: ts.growth(c, 4), only="q")

    def quarterly_std(self, n):
        return self._op("quarterly_std", lambda c: ts.rolling(c, n, "std", max(4, n // 2)), params=(n,), only="q")

    def quarterly_mean(self, n):
        return self._op("quarterly_mean", lambda c: ts.rolling(c, n, "mean", max(4, n // 2)), params=(n,), only="q")

    def ma(self, n):
        return self._op("ma", lambda c: ts.rolling(c, n), params=(n,), only="d")

    def std(self, n):
        return self._op("std", lambda c: ts.rolling(c, n, "std"), params=(n,), only="d")

    def downside(self, n):
        return self._op("downside", lambda c: ts.rolling(F.when(c < 0, c), n, "std", max(2, n // 4)), params=(n,), only="d")

    def mom(self, days, skip=0):
        return self._op("mom", lambda c: safe_div(ts.lag(c, skip) if skip else c, ts.lag(c, days)) - 1, params=(days, skip), only="d")

    def change(self, n=1):
        return self._op("change", lambda c: safe_div(c, ts.lag(c, n)) - 1, params=(n,), only="d")

    def rsi(self, n):
        return Expr("rsi", (self,), (n,), None, "d")

    def beta(self, n):
        return Expr("beta", (self,), (n,), None, "d")

    def holds(self, test: Callable[[Column], Column], label: str):
        """1 or 0 by a condition, NULL for NULL."""
        return self._op(label, lambda c: F.when(c.isNotNull(), test(c).cast("double")))

    def winsor(self, p):
        return Expr("winsor", (self,), (p,)) if p else self

    def zscore(self):
        return Expr("zscore", (self,))

    def rank(self):
        return Expr("rank", (self,))

    def neutral(self, group):
        return Expr("neutral", (self,), (group,))


def const(v) -> Expr:
    return Expr("const", (), (float(v),))


class _Fields:
    def __getattr__(self, name: str) -> Expr:
        return Expr("field", (), (name,))


fields = _Fields()


@dataclass
class Tables:
    """What fields are read from: quarterly (ticker, idx, date, datekey, fields), daily prices, descriptions, market returns.

    known: the column with the date from which a quarterly field is known, where that is not datekey. calendar: date, idx of
    all days; on: the daily rows of the days (date) given; windows: dayvalues.on_days by days (idx, mask, the market's columns),
    nodes and columns to keep; these where they come cheaper than from daily.
    """

    quarterly: DataFrame
    daily: DataFrame
    groups: DataFrame | None = None
    market: DataFrame | None = None
    known: dict[str, str] = field(default_factory=dict)
    calendar: DataFrame | None = None
    on: Callable[[DataFrame], DataFrame] | None = None
    windows: Callable[[DataFrame, dict, list[str]], DataFrame] | None = None

    def grid(self, e: Expr) -> str | None:
        """'q', 'd' or None (constants); raises where an operator is on the wrong grid, before any job runs."""
        if e.name == "const":
            return None
        if e.name == "field":
            if e.params[0] in self.quarterly.columns:
                return "q"
            if e.params[0] in self.daily.columns:
                return "d"
            raise MissingFieldError(e.params[0])
        grids = {g for a in e.args if (g := self.grid(a))}
        out = "d" if "d" in grids else "q"
        if e.only and out != e.only:
            raise GridError(f"{e.name} on the {'daily' if out == 'd' else 'quarterly'} grid: {e.describe()}")
        return out

    def sources(self, e: Expr) -> frozenset[str]:
        if e.name == "field":
            return frozenset([self.known.get(e.params[0], "datekey")])
        return frozenset().union(*(self.sources(a) for a in e.args))


#: Operators that are one window over rows or names; growths are arithmetic on a lag of so many quarters.
_WINDOWED = {"lag", "accel", "ttm", "quarterly_std", "quarterly_mean", "ma", "std", "downside", "mom", "change", "winsor", "zscore", "rank", "neutral"}
_GROWTHS = {"qoq": 1, "yoy": 4}


def _parts(e: Expr) -> tuple[Expr, ...]:
    return (*e.args, e.args[0].lag(_GROWTHS[e.name])) if e.name in _GROWTHS else e.args


class _Emitter:
    """Adds one column for each different node to a frame."""

    def __init__(self, frame: DataFrame, tables: Tables):
        self.frame, self.tables, self.names = frame, tables, {}

    def add_all(self, expressions) -> list[str]:
        """add for each, with all windows that need no other's value in one pass over the rows, then those that need these."""
        depths: dict[str, int] = {}
        passes: dict[int, dict[str, Expr]] = {}

        def depth(e: Expr) -> int:
            text = e.describe()
            if text in self.names:
                return 0
            if text not in depths:
                depths[text] = max(map(depth, _parts(e)), default=0) + (e.name in _WINDOWED)
                if e.name in _WINDOWED:
                    passes.setdefault(depths[text], {})[text] = e
            return depths[text]

        for e in expressions:
            depth(e)
        for k in sorted(passes):
            made = {}
            for text, e in passes[k].items():
                column = self._column(e)
                self.names[text] = f"__x{len(self.names)}"
                made[self.names[text]] = column
            self.frame = self.frame.withColumns(made)
        return [self.add(e) for e in expressions]

    def add(self, e: Expr) -> str:
        text = e.describe()
        if text in self.names:
            return self.names[text]
        if e.name == "field":
            self.names[text] = e.params[0]
            return e.params[0]
        column = self._column(e)
        name = self.names[text] = f"__x{len(self.names)}"
        self.frame = self.frame.withColumnRenamed(e.name, name) if column is None else self.frame.withColumn(name, column)
        return name

    def _column(self, e: Expr) -> Column | None:
        """The column of a node by those of its arguments; None where the frame has it now, by the node's name."""
        args = [F.lit(a.params[0]) if a.name == "const" else F.col(self.add(a)) for a in _parts(e)]
        if e.name in _GROWTHS:
            return safe_div(args[0] - args[1], F.abs(args[1]))
        if e.name == "winsor":
            return xs.winsor(self.add(e.args[0]), *e.params)
        if e.name == "zscore":
            return xs.zscore(self.add(e.args[0]))
        if e.name == "rank":
            return xs.rank(self.add(e.args[0]))
        if e.name == "neutral":
            return xs.neutral_groups(self.add(e.args[0]), e.params[0])
        if e.name == "rsi":
            self.frame = ts.wilder_rsi(self.frame, self.add(e.args[0]), *e.params)
            return None
        if e.name == "beta":
            self.frame = ts.beta(self.frame, self.tables.market, e.params[0], self.add(e.args[0]))
            return None
        return e.make(*args)


#: Operators that look from a row at rows some days before: how many days.
_STEPS = {"lag": lambda p: {p[0]}, "accel": lambda p: {0, p[0]}, "change": lambda p: {0, p[0]}, "mom": set}


class _Along:
    """What expressions need of the daily grid: rows so many days before a wanted one, and windows of days.

    windows: text -> node and the days before, of outermost expressions with windows over daily figures alone; dense: a window
    over filings, which needs all days.
    """

    def __init__(self, tables: Tables, wanted: dict[str, Expr]):
        self.tables, self.back, self.dense = tables, {0}, False
        self.windows: dict[str, tuple[Expr, set[int]]] = {}
        for e in wanted.values():
            self._walk(e, {0})

    def _walk(self, e: Expr, back: set[int]) -> None:
        if e.name == "const" or self.tables.grid(e) == "q":
            return
        self.back |= back
        if e.name in dayvalues.ROLLED or (self._daily(e) and any(n.name in dayvalues.ROLLED for n in _nodes([e]))):
            self.dense |= not self._daily(e)
            self.windows.setdefault(e.describe(), (e, set()))[1].update(back)
            return
        steps = _STEPS[e.name](e.params) if e.name in _STEPS else {0}
        for a in e.args:
            self._walk(a, {b + n for b in back for n in steps})

    def _daily(self, e: Expr) -> bool:
        """Whether the windows' helper can give it: no filings, no scores across names."""
        if e.name == "const":
            return True
        return self.tables.grid(e) == "d" and e.name in dayvalues.NODES and all(map(self._daily, e.args))


def _node(e: Expr) -> tuple:
    return e.name, tuple(map(_node, e.args)), e.params


def used(*expressions: Expr) -> set[str]:
    """The fields that expressions read."""
    return {n.params[0] for n in _nodes(expressions) if n.name == "field"}


def across(e: Expr, tables: Tables) -> bool:
    """Whether it compares names on the quarterly grid, where names without a filing may count too."""
    return any(n.name in ("winsor", "zscore", "rank", "neutral") and tables.grid(n) == "q" for n in _nodes([e]))


def _rows_on_days(tables: Tables, wanted: dict[str, Expr], along: _Along, days: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Daily rows on the days and so many days before as `along` says, with columns of its windows, and their names by text."""
    back = {n: 1 << k for k, n in enumerate(sorted(along.back))}
    earlier = days.select(F.explode(F.array(*[F.struct((F.col("idx") - n).alias("idx"), F.lit(bit).cast("long").alias("bit")) for n, bit in back.items()])).alias("d"))
    earlier = earlier.groupBy("d.idx").agg(F.bit_or("d.bit").alias("mask"))
    calendar = tables.daily.select("date", "idx").distinct() if tables.calendar is None else tables.calendar.select("date", "idx")
    asked = calendar.join(F.broadcast(earlier), "idx")
    if not along.windows:
        return tables.daily.join(F.broadcast(asked.select("date")), "date", "left_semi") if tables.on is None else tables.on(asked), {}
    read, outside = used(*wanted.values()), _outside(wanted.values(), along.windows)
    fields, kept = [c for c in tables.daily.columns if c in read], [c for c in tables.daily.columns if c in outside]
    spans = sorted({n.params[0] for n in _nodes([e for e, _ in along.windows.values()]) if n.name == "beta"})
    spread = ts.market_spread(tables.market, spans) if spans else None
    names = {text: f"__w{k}" for k, text in enumerate(along.windows)}
    nodes = {names[t]: (_node(e), sum(back[n] for n in offsets)) for t, (e, offsets) in along.windows.items()}
    if tables.windows is not None:
        marked = calendar.select("idx").join(F.broadcast(earlier), "idx", "left")
        return tables.windows(marked if spread is None else marked.join(F.broadcast(spread), "idx", "left"), nodes, ["date", "idx", *kept]), names
    daily = tables.daily.select("ticker", "date", "idx", *fields)
    if spread is not None:
        daily = daily.join(F.broadcast(spread), "idx", "left")
    return dayvalues.on_days(daily, asked, nodes, ["date", "idx", *kept]), names


def _outside(expressions, windows) -> set[str]:
    """The fields that expressions read other than in the windows."""
    return {f for e in expressions if e.describe() not in windows for f in ({e.params[0]} if e.name == "field" else _outside(e.args, windows))}


def _nodes(expressions) -> list[Expr]:
    return [n for e in expressions for n in (e, *_nodes(e.args))]


def compile_all(tables: Tables, wanted: dict[str, Expr], days: DataFrame | None = None) -> DataFrame:
    """ticker, date, idx and a column for each wanted expression, for the days (date, idx) given (all trading days if none).

    With days, only their rows and those that lags ask for meet filings; windows of days are taken on these days alone.
    """
    for e in wanted.values():
        tables.grid(e)  # errors come before any job
    promoted: dict[str, Expr] = {}

    def boundary(e: Expr) -> None:
        if e.name == "const":
            return
        if tables.grid(e) == "q":
            promoted[e.describe()] = e
        elif e.describe() not in windows:
            for a in e.args:
                boundary(a)

    along = _Along(tables, wanted)
    daily, windows = (tables.daily, {}) if days is None or along.dense else _rows_on_days(tables, wanted, along, days)
    for e in wanted.values():
        boundary(e)
    grouped = lambda rows: rows if tables.groups is None or all(n.name != "neutral" for n in _nodes(wanted.values())) else rows.join(tables.groups, "ticker", "left")
    q = _Emitter(grouped(tables.quarterly), tables)
    columns = dict(zip(promoted, q.add_all(promoted.values()), strict=True))
    daily = grouped(daily)
    names: dict[str, str] = dict(windows)
    by_source: dict[frozenset, list[str]] = {}
    for text, e in promoted.items():
        by_source.setdefault(tables.sources(e), []).append(text)
    if by_source:  # one column with the date from which all of its sources are known for each set of them
        known = {f"__known{k}": F.greatest(*map(F.col, sorted(sources))) if len(sources) > 1 else F.col(*sources) for k, sources in enumerate(by_source)}
        carry = {f"__known{k}": [f"__p{k}_{i}" for i in range(len(texts))] for k, texts in enumerate(by_source.values())}
        facts = {c: F.col(columns[t]) for at, texts in zip(carry.values(), by_source.values(), strict=True) for c, t in zip(at, texts, strict=True)}
        rows = q.frame.select("ticker", F.col("date").alias("__period"), *[v.alias(c) for c, v in (known | facts).items()])
        daily = as_of_each(daily, rows, "ticker", "date", ["__period"], carry)
        names |= {t: c for at, texts in zip(carry.values(), by_source.values(), strict=True) for c, t in zip(at, texts, strict=True)}
    d = _Emitter(daily, tables)
    d.names |= names
    out = dict(zip(wanted, d.add_all(wanted.values()), strict=True))
    rows = d.frame if days is None else d.frame.join(F.broadcast(days.select("date")), "date", "left_semi")
    return rows.select("ticker", "date", "idx", *[F.col(c).alias(k) for k, c in out.items()])
