"""The 39 derived metrics, as a registry of name -> Column by level: each level only reads raw columns and earlier levels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantsieve.functions.numeric import clean, ratio

Metric = Callable[[], Column]
LEVELS: tuple[dict[str, Metric], ...] = ({}, {}, {})


def metric(level: int) -> Callable[[Metric], Metric]:
    def register(f: Metric) -> Metric:
        LEVELS[level - 1][f.__name__] = f
        return f

    return register


def change(name: str, now: str, before: str, level: int) -> None:
    LEVELS[level - 1][name] = lambda: ratio(F.col(now), F.col(before)) - 1


def gap(name: str, a: str, b: str, level: int) -> None:
    LEVELS[level - 1][name] = lambda: F.col(a) - F.col(b)


def quotient(name: str, a: str, b: str, level: int) -> None:
    LEVELS[level - 1][name] = lambda: ratio(F.col(a), F.col(b))


def days(name: str, balance: str, quarter: str) -> None:
    LEVELS[0][name] = lambda: ratio(F.col(balance), F.col(quarter)) * 90


change("ps_diff", "ps_ntm", "ps_3yr_avg", 1)
gap("fcf_yield_diff", "fcf_yield_3yr_avg", "fcf_yield", 1)
change("yoy_growth_ttm", "revenues_ttm", "revenues_ttm_t1", 1)
change("yoy_growth_ttm_t1", "revenues_ttm_t1", "revenues_ttm_t2", 1)
gap("growth_decel", "yoy_growth_ttm", "yoy_growth_ttm_t1", 2)
gap("growth_accel", "rev_cagr_f2y", "rev_cagr_p2y", 1)
gap("gm_diff", "ntm_gross_margin", "gross_margin_3yr_avg", 1)
gap("ebit_diff", "ntm_ebit_margin", "ebit_margin_3yr_avg", 1)


def _not_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


@metric(1)
def leverage_ratio_calc() -> Column:
    return _not_negative(ratio(F.col("net_debt"), F.col("adj_ebitda")))


@metric(1)
def debt_sales() -> Column:
    return _not_negative(ratio(F.col("net_debt"), F.col("revenues_ttm")))


@metric(1)
def enterprise_value_calc() -> Column:
    return F.col("market_cap") + F.col("net_debt")


quotient("debt_ev", "net_debt", "enterprise_value_calc", 2)


@metric(1)
def liquidity() -> Column:
    """Cash and undrawn credit; an unknown credit line counts as none."""
    return F.col("cash_balance") + F.coalesce(F.col("available_loc"), F.lit(0.0))


@metric(2)
def remaining_liquidity_years() -> Column:
    """Years until liquidity is spent; only for those that burn cash."""
    return F.when(F.col("fcf") < 0, ratio(F.col("liquidity"), -F.col("fcf")))


quotient("fcf_conversion", "fcf", "adj_ebitda", 1)


@metric(1)
def accrual_ratio() -> Column:
    return ratio(F.col("cfo") - F.col("net_income"), F.col("cfo"))


days("dsos", "avg_receivables", "revenues_t3m")
days("dsos_py", "avg_receivables_t1", "revenues_t3m_t1")
change("dso_pct_change", "dsos", "dsos_py", 2)
days("dios", "avg_inventory", "cogs_t3m")
days("dios_t1", "avg_inventory_py", "cogs_t3m_t1")
change("dio_pct_change", "dios", "dios_t1", 2)
days("dpos", "avg_payables", "cogs_t3m")
days("dpos_t1", "avg_payables_t1", "cogs_t3m_t1")
change("dpo_pct_change", "dpos", "dpos_t1", 2)
days("days_deferred_rev", "deferred_revenue", "revenues_t3m")
days("days_deferred_rev_t1", "deferred_revenue_t1", "revenues_t3m_t1")
change("deferred_rev_pct_change", "days_deferred_rev", "days_deferred_rev_t1", 2)
quotient("eps_adj_ratio", "adj_eps", "dil_eps_fy0", 1)


@metric(1)
def hold_sell_pct() -> Column:
    """Share of analysts who don't say buy."""
    other = F.col("hold_recs") + F.col("sell_recs")
    return ratio(other, F.col("buy_recs") + F.col("hold_recs") + F.col("sell_recs"))


quotient("dsri", "dsos", "dsos_py", 2)


@metric(1)
def gmi() -> Column:
    def margin(t: str) -> Column:
        return ratio(F.col(f"revenues_t3m{t}") - F.col(f"cogs_t3m{t}"), F.col(f"revenues_t3m{t}"))

    return ratio(margin("_t1"), margin(""))


@metric(1)
def aqi() -> Column:
    def soft_assets(t: str) -> Column:
        return 1 - ratio(F.col(f"current_assets{t}") + F.col(f"ppe{t}") + F.col(f"lt_investments{t}"), F.col(f"total_assets{t}"))

    return ratio(soft_assets(""), soft_assets("_t1"))


quotient("sgi", "revenues_t3m", "revenues_t3m_t1", 1)


@metric(1)
def depi() -> Column:
    before = ratio(F.col("depreciation_t1"), F.col("ppe_t1") + F.col("depreciation_t1"))
    return ratio(before, ratio(F.col("depreciation"), F.col("depreciation") + F.col("ppe")))


@metric(1)
def sgai() -> Column:
    return ratio(ratio(F.col("sga"), F.col("revenues_ttm")), ratio(F.col("sga_t1"), F.col("revenues_ttm_t1")))


quotient("lvgi", "debt_to_assets", "debt_to_assets_t1", 1)


@metric(1)
def tata() -> Column:
    return ratio(F.col("net_income") - F.col("cfo"), F.col("total_assets"))


# The M-Score's intercept and coefficients, in the order of the sum.
MSCORE_INTERCEPT = -4.84
MSCORE = (("dsri", 0.920), ("gmi", 0.528), ("aqi", 0.404), ("sgi", 0.892), ("depi", 0.115), ("sgai", -0.172), ("tata", 4.679), ("lvgi", -0.327))


@metric(3)
def mscore() -> Column:
    return reduce(add, [F.lit(c) * F.col(name) for name, c in MSCORE], F.lit(MSCORE_INTERCEPT))


METRICS = tuple(name for level in LEVELS for name in level)


def with_metrics(raw: DataFrame) -> DataFrame:
    """raw with all metrics: one projection per level."""
    for level in LEVELS:
        raw = raw.withColumns({name: clean(f()) for name, f in level.items()})
    return raw

