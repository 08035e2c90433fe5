"""Factor expressions as SQL of another engine: what the compiled plans are checked against.

Each different node is one column; nodes of one depth share a SELECT over the one before. Windows count rows of the dense
grids, where the plans count ordinals; filings are promoted by ASOF joins, where the plans use windows.
"""

from __future__ import annotations

from .expr import Expr, Tables

_SIGNS = {"positive": "> 0", "rises": "> 0", "falls": "< 0", "no_issue": "<= 0"}
ORDER = "PARTITION BY ticker ORDER BY idx"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-9 THEN ({a}) / ({b}) END)"


def lag(a: str, n: int) -> str:
    return f"lag({a}, {n}) OVER ({ORDER})"


def rolling(fn: str, a: str, n: int, least: int) -> str:
    w = f"({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({a}) OVER {w} >= {least} THEN {fn}({a}) OVER {w} END"


def _rsi(a: str, n: int) -> list[str]:
    """Columns in steps: the change, its rank among known ones, and both smoothed sides as weighted prefix sums."""
    keep = 1 - 1 / n
    past = f"({ORDER} ROWS UNBOUNDED PRECEDING)"

    def smooth(side: str) -> str:
        x = f"greatest({side}{{0}}, 0)"
        weighted = f"CASE WHEN {{1}} = 1 THEN {x} ELSE {1 / n!r} * {x} * pow({keep!r}, 1 - {{1}}) END"
        return f"pow({keep!r}, {{1}} - 1) * sum({weighted}) OVER {past}"

    up, down = smooth(""), smooth("-")
    return [f"{a} - {lag(a, 1)}", f"count({{0}}) OVER {past}", up, down, f"CASE WHEN {{1}} >= {n} AND abs({{3}}) > 1e-9 THEN 100 - 100 / (1 + {{2}} / {{3}}) END"]


def _neutral(a: str, g: str) -> str:
    ok = f"CASE WHEN {g} IS NOT NULL THEN {a} END"
    groups = f"len(list_distinct(list(CASE WHEN {a} IS NOT NULL THEN {g} END) OVER (PARTITION BY date)))"
    return f"CASE WHEN {a} IS NOT NULL AND {g} IS NOT NULL AND count({ok}) OVER (PARTITION BY date) >= {groups} + 1 THEN {a} - avg({ok}) OVER (PARTITION BY date, {g}) END"


def _column(e: Expr, args: list[str]) -> str:
    a, b, p = args[0], args[-1], e.params
    of_date = "OVER (PARTITION BY date)"
    match e.name:
        case "add":
            return f"{a} + {b}"
        case "sub":
            return f"{a} - {b}"
        case "mul":
            return f"{a} * {b}"
        case "div":
            return div(a, b)
        case "neg":
            return f"-({a})"
        case "abs":
            return f"abs({a})"
        case "lag":
            return lag(a, p[0])
        case "accel":
            return f"{a} - {lag(a, p[0])}"
        case "ttm":
            return rolling("sum", a, 4, 4)
        case "qoq" | "yoy":
            before = lag(a, 1 if e.name == "qoq" else 4)
            return div(f"{a} - {before}", f"abs({before})")
        case "quarterly_std" | "quarterly_mean":
            return rolling("stddev_samp" if e.name == "quarterly_std" else "avg", a, p[0], max(4, p[0] // 2))
        case "ma" | "std":
            return rolling("avg" if e.name == "ma" else "stddev_samp", a, p[0], max(2, p[0] // 2))
        case "downside":
            return rolling("stddev_samp", f"CASE WHEN {a} < 0 THEN {a} END", p[0], max(2, p[0] // 4))
        case "mom":
            return div(lag(a, p[1]) if p[1] else a, lag(a, p[0])) + " - 1"
        case "change":
            return div(a, lag(a, p[0])) + " - 1"
        case "beta":
            n, least = p[0], max(20, p[0] // 2)
            w = f"({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            return div(f"CASE WHEN count({a} * mr) OVER {w} >= {least} THEN covar_samp({a}, mr) OVER {w} END", f"ms{n} * ms{n}")
        case "winsor":
            return f"CASE WHEN {a} IS NOT NULL THEN greatest(least({a}, quantile_cont({a}, {1 - p[0]!r}) {of_date}), quantile_cont({a}, {p[0]!r}) {of_date}) END"
        case "zscore":
            return div(f"{a} - avg({a}) {of_date}", f"stddev_pop({a}) {of_date}")
        case "neutral":
            return _neutral(a, p[0])
    return f"CASE WHEN {a} IS NOT NULL THEN CAST({a} {_SIGNS[e.name]} AS INT)::DOUBLE END"


class Grid:
    """The columns wanted on one grid: steps of SELECTs that each read the one before."""

    def __init__(self, name: str, names: dict[str, str] | None = None):
        self.name, self.names, self.steps, self.depth = name, dict(names or {}), [], {}

    def _put(self, depth: int, sql: str) -> str:
        while len(self.steps) < depth:
            self.steps.append({})
        column = f"{self.name}{sum(map(len, self.steps))}x"
        self.steps[depth - 1][column] = sql
        return column

    def add(self, e: Expr) -> tuple[str, int]:
        """Column and depth of a node."""
        if e.name == "const":
            return repr(e.params[0]), 0
        text = e.describe()
        if text in self.names:
            return self.names[text], self.depth.get(text, 0)
        if e.name == "field":
            return e.params[0], 0
        args = [self.add(a) for a in e.args]
        depth = 1 + max(d for _, d in args)
        if e.name == "rsi":
            parts: list[str] = []
            for k, sql in enumerate(_rsi(args[0][0], e.params[0])):
                depth = depth + (k > 0 and k != 3)
                parts.append(self._put(depth, sql.format(*parts) if k else sql))
            column = parts[-1]
        else:
            column = self._put(depth, _column(e, [a for a, _ in args]))
        self.names[text], self.depth[text] = column, depth
        return column, depth


    def sql(self) -> str:
        out, last = "", self.name
        for k, step in enumerate(self.steps):
            out += f",\n{self.name}_{k} AS (SELECT *, " + ", ".join(f"{sql} AS {c}" for c, sql in step.items()) + f" FROM {last})"
            last = f"{self.name}_{k}"
        self.last = last
        return out


def factor_sql(tables: str, layout: Tables, wanted: dict[str, Expr], value) -> str:
    """SQL giving ticker, date, factor, value for the wanted expressions.

    tables: WITH clauses that define q (quarterly) and d (daily, with mr and ms60, ms252 of the market); layout tells which
    grid a field is on (only its column names are used); value formats the value.
    """
    promoted: dict[str, Expr] = {}

    def boundary(e: Expr) -> None:
        if e.name != "const":
            if layout.grid(e) == "q":
                promoted[e.describe()] = e
            else:
                for a in e.args:
                    boundary(a)

    for e in wanted.values():
        boundary(e)
    q = Grid("q")
    columns = {text: q.add(e)[0] for text, e in promoted.items()}
    out = tables + q.sql()
    names, last = {}, "d"
    by_source: dict[frozenset, list[str]] = {}
    for text, e in promoted.items():
        by_source.setdefault(layout.sources(e), []).append(text)
    for k, (sources, texts) in enumerate(by_source.items()):
        known = f"greatest({', '.join(sorted(sources))})" if len(sources) > 1 else next(iter(sources))
        carry = {t: f"p{k}_{i}" for i, t in enumerate(texts)}
        out += f",\nk{k} AS (SELECT ticker AS kt, {known} AS known, " + ", ".join(f"{columns[t]} AS {c}" for t, c in carry.items()) + f" FROM {q.last} WHERE known IS NOT NULL)"
        out += f",\nj{k} AS (SELECT {last}.*, " + ", ".join(f"k{k}.{c}" for c in carry.values()) + f" FROM {last} ASOF LEFT JOIN k{k} ON {last}.ticker = k{k}.kt AND {last}.date >= k{k}.known)"
        names, last = names | carry, f"j{k}"
    d = Grid("d", names)
    found = {k: d.add(e)[0] for k, e in wanted.items()}
    d.name, steps = "d", d.sql().replace(" FROM d)", f" FROM {last})", 1)
    last = d.last if d.steps else last
    out += steps
    pairs = ", ".join(f"{{factor: '{k}', value: CAST({c} AS DOUBLE)}}" for k, c in found.items())
    return out + f",\nu AS (SELECT ticker, date, unnest([{pairs}]) AS f FROM {last})\nSELECT ticker, date, f.factor AS factor, {value('f.value')} AS value FROM u WHERE f.value IS NOT NULL"
