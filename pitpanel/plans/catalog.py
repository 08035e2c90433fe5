"""The registered factors: expression, category, direction and how each is made a score."""

from __future__ import annotations

from dataclasses import dataclass

from .expr import Expr
from .expr import fields as f


@dataclass(frozen=True)
class Factor:
    name: str
    expr: Expr
    category: str
    direction: int = 1
    invert: bool = False
    neutral: str | None = None
    winsor: float = 0.01
    requires: tuple[str, ...] = ("SF1",)

    def formula(self) -> str:
        return self.expr.describe()

    def scoring(self) -> Expr:
        """Inverted, winsorised, made neutral, turned so that more is better, in this order."""
        e = (1.0 / self.expr if self.invert else self.expr).winsor(self.winsor)
        e = e.neutral(self.neutral) if self.neutral else e
        return -e if self.direction < 0 else e


def difference(e: Expr, n: int = 4) -> Expr:
    return e - e.lag(n)


def average(e: Expr, n: int = 1) -> Expr:
    return (e + e.lag(n)) / 2


def sharpe(n: int) -> Expr:
    return returns.ma(n) / returns.std(n) * 252**0.5


def sortino(n: int) -> Expr:
    return returns.ma(n) / returns.downside(n) * 252**0.5


def f_score() -> Expr:
    """Nine signs of strength, one point each; one that is unknown makes the sum unknown."""
    roa, turnover = f.netinc / average(f.assets), f.revenue / average(f.assets)
    above = lambda e: e.holds(lambda c: c > 0, "positive")
    rises = lambda e: difference(e).holds(lambda c: c > 0, "rises")
    points = [
        above(roa), above(f.ncfo), rises(roa), above(f.ncfo - f.netinc), difference(f.debtnc / average(f.assets)).holds(lambda c: c < 0, "falls"),
        rises(f.assetsc / f.liabilitiesc), difference(f.sharesbas).holds(lambda c: c <= 0, "no_issue"), rises(f.gp / f.revenue), rises(turnover),
    ]
    out = points[0]
    for p in points[1:]:
        out = out + p
    return out


def altman_z() -> Expr:
    return 1.2 * (f.workingcapital / f.assets) + 1.4 * (f.retearn / f.assets) + 3.3 * (f.ebit / f.assets) + 0.6 * (f.mcap / f.liabilities) + 1.0 * (f.revenue / f.assets)


returns = f.close.change(1)
accrual = f.netinc - f.ncfo
enterprise = f.mcap + f.debt - f.cashneq
CATALOG: dict[str, Factor] = {}


def _add(category: str, name: str, expr: Expr, **more) -> None:
    if name in CATALOG:
        raise ValueError(f"{name} is registered already")
    CATALOG[name] = Factor(name, expr, category, **more)


# Names, fields and formulas of the factors are the catalog itself.
SEP, BOTH = ("SEP",), ("SF1", "SEP")
for _name, _e in {"NETINC": f.netinc, "REVENUE": f.revenue, "GP": f.gp, "OPINC": f.opinc, "NCFO": f.ncfo, "ACCRUAL": accrual}.items():
    _add("acceleration", f"{_name}_ACCEL_QOQ", _e.qoq().accel(1), winsor=0.02)
    _add("acceleration", f"{_name}_ACCEL_YOY", _e.yoy().accel(4), winsor=0.02)
for _s, _l, _k in ((3, 3, 10), (3, 12, 5), (10, 1, 5)):
    _add("acceleration", f"MA_ACCEL_{_s}_{_l}_{_k}", (f.close.ma(21 * _s) / f.close.ma(21 * _l)).accel(_k), winsor=0.02, requires=SEP)

_GROWTH = {
    "NETINC": f.netinc, "OPINC": f.opinc, "GP": f.gp, "REVENUE": f.revenue, "ASSETS": f.assets, "EQUITY": f.equity, "GP_A": f.gp / f.assets, "OPINC_DEBT": f.opinc / f.debt,
    "NCFO": f.ncfo, "RND": f.rnd, "CASH": f.cashneq, "DEBT": f.debt, "DIVYIELD": -f.ncfdiv / f.mcap,
}
for _name, _e in _GROWTH.items():
    for _how in ("qoq", "yoy"):
        _add("growth", f"{_name}_GROWTH_{_how.upper()}", getattr(_e, _how)(), neutral="sector", requires=BOTH if _name == "DIVYIELD" else ("SF1",))

_add("flow_proxy", "INST_HOLD_CHG", (f.inst_shares / f.sharesbas).qoq(), requires=("SF3", "SF1"))
_add("flow_proxy", "INST_HOLDER_CHG", f.inst_holders.qoq(), requires=("SF3",))
_add("flow_proxy", "INSIDER_NET_BUY", f.insider_net_shares.ttm() / f.sharesbas, requires=("SF2", "SF1"))
_add("flow_proxy", "SHORT_INT_CHG", -(f.short_interest / f.sharesbas).change(21), requires=("FMP", "SF1"))
_add("flow_proxy", "INST_SHORT_COMBO", (f.inst_shares / f.sharesbas).qoq().zscore() - (f.short_interest / f.sharesbas).change(21).zscore(), requires=("SF3", "FMP", "SF1"))

_mean_assets = average(f.assets, 4)
_QUALITY_UP = {
    "CBOP": (f.gp - difference(f.receivables) - difference(f.inventory) + difference(f.liabilitiesc)) / f.assets,
    "TAX_EBIT": f.taxexp.ttm() / f.ebit.ttm(), "CH_ASSET_TURNOVER": difference(f.revenue.ttm() / f.assets),
    "ROE": f.netinc / average(f.equity), "ROA": f.netinc / average(f.assets), "ROE_TTM": f.netinc.ttm() / average(f.equity), "ROA_TTM": f.netinc.ttm() / average(f.assets),
    "ROIC": (f.ebit - f.taxexp) / average(f.invcap), "GPIC": f.gp / average(f.invcap), "GP_E": f.gp / f.equity, "GP_A": f.gp / f.assets, "GP_A_TTM": f.gp.ttm() / f.assets,
    "ROCE": f.ebit / (f.assets - f.liabilitiesc), "ASSET_TURNOVER": f.revenue / average(f.assets), "ASSET_TURNOVER_TTM": f.revenue.ttm() / average(f.assets),
    "GPM": f.gp / f.revenue, "OPM": f.opinc / f.revenue, "NPM": f.netinc / f.revenue, "OPINC_DEBT": f.opinc / f.debt, "RETENTION": f.retearn / f.equity, "CURRENT_RATIO": f.assetsc / f.liabilitiesc,
}
_QUALITY_DOWN = {
    "ACCRUAL_CF": accrual / f.assets, "NOA": (f.assets - f.cashneq - (f.liabilities - f.debt)) / f.assets.lag(4), "NET_ISSUANCE": difference(f.sharesbas) / f.sharesbas.lag(4),
    "EXT_FINANCE": (f.ncfcommon + f.ncfdebt) / f.assets, "SGNA_GP": f.sgna.ttm() / f.gp.ttm(), "DEL_COA": difference(f.assetsc - f.cashneq) / _mean_assets,
    "DEL_FINL": difference(f.debtnc + f.debtc) / _mean_assets, "DEL_EQU": difference(f.equity) / _mean_assets,
    "CH_NNCOA": difference((f.assets - f.assetsc - (f.liabilities - f.debtc - f.debtnc)) / f.assets), "CH_NWC": difference((f.assetsc - f.cashneq - (f.liabilitiesc - f.debtc)) / f.assets),
    "COMPOSITE_DEBT_ISSUANCE": f.debt / f.debt.lag(20), "INV_GROWTH": difference(f.inventory) / _mean_assets, "CH_EQUITY": f.equity / f.equity.lag(4), "BOOK_LEVERAGE": f.assets / f.equity,
    "AC_A": accrual / average(f.assets), "AC_E": accrual / average(f.equity), "DEBT_RATIO": f.debt / f.equity, "EARNINGS_VOL": (f.netinc / f.assets).quarterly_std(20),
}
_QUALITY_SECTOR_UP = {
    "RIC": f.rnd / average(f.invcap), "GP_IT": f.gp / f.intangibles, "OP_IT": f.opinc / f.intangibles, "ROIT": f.netinc / f.intangibles, "IT_TURNOVER": f.revenue / f.intangibles,
    "RND_REVENUE": f.rnd / f.revenue, "RND_GP": f.rnd / f.gp, "RND_OPINC": f.rnd / f.opinc, "RND_NETINC": f.rnd / f.netinc,
}
_QUALITY_SECTOR_DOWN = {"CAPEX_INTENSITY": -f.capex / f.assets, "SBC_REVENUE": f.sbcomp.ttm() / f.revenue.ttm(), "GR_CAPX": (-f.capex).ttm() / (-f.capex).ttm().lag(8)}
for _group, _more in ((_QUALITY_UP, {}), (_QUALITY_DOWN, {"direction": -1}), (_QUALITY_SECTOR_UP, {"neutral": "sector"}), (_QUALITY_SECTOR_DOWN, {"direction": -1, "neutral": "sector"})):
    for _name, _e in _group.items():
        _add("quality", _name, _e, **_more)
for _name, _n in (("VOL_52W", 252), ("VOL_60D", 60)):
    _add("quality", _name, returns.std(_n) * 252**0.5, direction=-1, requires=SEP)
_add("quality", "F_SCORE", f_score(), winsor=0.0)
_add("quality", "ALTMAN_Z", altman_z(), requires=BOTH)

for _months, _n, _d in ((1, 21, -1), (3, 63, 1), (6, 126, 1), (12, 252, 1)):
    _add("price", f"MOM_{_months}M", f.close.mom(_n), direction=_d, requires=SEP)
_add("price", "MOM_12_1", f.close.mom(252, 21), requires=SEP)
_add("price", "CLOSE_UNADJ", f.closeunadj, requires=SEP)
for _name, _make in (("SHARPE", sharpe), ("SORTINO", sortino)):
    _add("price", _name, _make(252), requires=SEP)
    for _n in (20, 60, 120, 200):
        _add("price", f"{_name}_MOM_{_n}D", _make(_n).accel(_n), requires=SEP)
for _n in (9, 14, 25):
    _add("price", f"RSI_{_n}D", f.close.rsi(_n), direction=-1, requires=SEP)
for _name, _n in (("BETA", 252), ("BETA_60D", 60)):
    _add("price", _name, returns.beta(_n), direction=-1, requires=SEP)
    _add("price", f"ABS_{_name}", abs(returns.beta(_n)), direction=-1, requires=SEP)
_add("price", "TURNOVER", (f.volume * f.close).ma(20) / f.mcap, direction=-1, requires=SEP)

_add("value_ev", "EV", enterprise, direction=-1, requires=BOTH)
for _name, _e in {"NET": f.netinc, "SALES": f.revenue, "EBITDA": f.ebitda, "EBIT": f.ebit, "GP": f.gp, "RD": f.rnd, "CF": f.ncfo, "AC": accrual}.items():
    _add("value_ev", f"EV_{_name}", enterprise / _e, invert=True, neutral="sector" if _name == "RD" else None, requires=BOTH)

_add("value_price", "SIZE", f.mcap, direction=-1, requires=SEP)
_PRICE = {"PER": f.netinc, "PBR": f.equity, "PSR": f.revenue, "POR": f.opinc, "PCR": f.ncfo, "PFCR": f.fcf, "PGPR": f.gp, "PRR": f.rnd, "PAR": f.assets, "PACR": accrual, "PITR": f.intangibles}
for _name, _e in _PRICE.items():
    _add("value_price", _name, f.mcap / _e, invert=True, neutral="sector" if _name in ("PRR", "PITR") else None, requires=BOTH)
for _name in ("PER", "PSR", "POR", "PCR", "PGPR"):
    _add("value_price", f"{_name}_TTM", f.mcap / _PRICE[_name].ttm(), invert=True, requires=BOTH)
_add("value_price", "RND_MCAP", f.rnd.ttm() / f.mcap, neutral="sector", requires=BOTH)
_add("value_price", "ASSETS_TO_MARKET", f.assets / f.mcap, requires=BOTH)
_add("value_price", "NCAV", (f.assetsc - f.liabilities) / f.mcap, requires=BOTH)
_add("value_price", "DIV_YIELD", (-f.ncfdiv).ttm() / f.mcap, requires=BOTH)
_add("value_price", "SHAREHOLDER_YIELD", (-f.ncfdiv + -f.ncfcommon).ttm() / f.mcap, requires=BOTH)
_add("value_price", "PEG_TTM", f.mcap / f.netinc.ttm() / (f.epsdil.ttm().yoy() * 100.0), direction=-1, requires=BOTH)
_add("value_price", "PEG_FWD", f.mcap / f.netinc.ttm() / (f.eps_growth_fwd * 100.0), direction=-1, requires=("SF1", "SEP", "FMP"))


def available(have: set[str]) -> dict[str, Factor]:
    """The factors whose tables are there."""
    return {k: v for k, v in CATALOG.items() if set(v.requires) <= have}
