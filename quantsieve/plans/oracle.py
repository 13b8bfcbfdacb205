"""DuckDB SQL for the screening queries, written apart from the DataFrame code."""

from __future__ import annotations

from quantsieve.sources.schema import CATEGORIES, CATEGORY_OF, FACTOR_NAMES, FACTORS, HEADERS, LABEL_OF, METRIC_OF, default_config

MONEY = "CAST(l_extendedprice AS DECIMAL(18,2))"
TESTS = {"all": "TRUE", "R": "l_returnflag = 'R'", "A": "l_returnflag = 'A'", "N": "l_returnflag = 'N'", "O": "l_linestatus = 'O'", "F": "l_linestatus = 'F'", "kept": "l_returnflag <> 'R'"}
SPANS = {
    "2001-08-01": {"y0": ("2000-08-01", "2001-08-01"), "y1": ("1999-08-01", "2000-08-01"), "y2": ("1998-08-01", "1999-08-01"), "q0": ("2001-05-01", "2001-08-01"), "q1": ("2000-05-01", "2000-08-01")},
    "2001-02-01": {"y0": ("2000-02-01", "2001-02-01"), "y1": ("1999-02-01", "2000-02-01"), "y2": ("1998-02-01", "1999-02-01"), "q0": ("2000-11-01", "2001-02-01"), "q1": ("1999-11-01", "2000-02-01")},
    "2000-08-01": {"y0": ("1999-08-01", "2000-08-01"), "y1": ("1998-08-01", "1999-08-01"), "y2": ("1997-08-01", "1998-08-01"), "q0": ("2000-05-01", "2000-08-01"), "q1": ("1999-05-01", "1999-08-01")},
}
PANEL = ["2000-08-01", "2001-02-01", "2001-08-01"]


def q(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, CAST(0 AS DOUBLE)))"


def z(x: str) -> str:
    return f"coalesce({x}, CAST(0 AS DOUBLE))"


def accounts(day: str) -> str:
    out = []
    for w, (a, b) in SPANS[day].items():
        inside = f"l_shipdate >= TIMESTAMP '{a}' AND l_shipdate < TIMESTAMP '{b}'"
        for kind, test in TESTS.items():
            out.append(f"CAST(sum({MONEY}) FILTER ({inside} AND {test}) AS DOUBLE) AS {w}_{kind}")
            out.append(f"CAST(count(*) FILTER ({inside} AND {test}) AS DOUBLE) AS n_{w}_{kind}")
        for rate in ("tax", "discount"):
            out.append(f"CAST(sum({MONEY} * CAST(l_{rate} AS DECIMAL(18,2))) FILTER ({inside}) AS DOUBLE) AS {w}_{rate}")
        out.append(f"CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER ({inside}) AS DOUBLE) AS {w}_quantity")
    return f"SELECT l_partkey, {', '.join(out)} FROM lineitem GROUP BY l_partkey"


def raw(day: str = "2001-08-01") -> str:
    cfo = {y: f"({z(y + '_N')} - {z(y + '_R')})" for y in ("y0", "y1")}
    income = {y: f"({z(y + '_F')} - {z(y + '_O')})" for y in ("y0", "y1")}
    fcf = {y: f"({z(y + '_A')} - {z(y + '_R')})" for y in ("y0", "y1")}
    ebitda = f"({z('y0_N')} + {z('y0_A')} - {z('y0_R')})"
    cap = "(p_retailprice * p_size)"
    values = {
        "ticker": "'P' || p_partkey", "name": "p_name", "sector": "p_type", "industry": "p_brand", "market_cap": cap,
        "revenues_ttm": "y0_all", "revenues_ttm_t1": "y1_all", "revenues_ttm_t2": "y2_all", "revenues_t3m": "q0_all", "revenues_t3m_t1": "q1_all",
        "cogs_ttm": z("y0_kept"), "cogs_ttm_t1": z("y1_kept"), "cogs_t3m": z("q0_kept"), "cogs_t3m_t1": z("q1_kept"),
        "avg_receivables": "q0_O", "avg_receivables_t1": "q1_O", "avg_inventory": "q0_F", "avg_inventory_py": "q1_F", "avg_payables": "q0_A", "avg_payables_t1": "q1_A", "deferred_revenue": "q0_N", "deferred_revenue_t1": "q1_N",
        "cfo": cfo["y0"], "cfo_t1": cfo["y1"], "net_income": income["y0"], "net_income_t1": income["y1"], "fcf": fcf["y0"], "adj_ebitda": ebitda,
        "net_debt": f"{z('y0_O')} - {z('y0_F')}", "cash_balance": "y1_F", "available_loc": "CASE WHEN p_size > 25 THEN y1_R END",
        "current_assets": "y0_O", "current_assets_t1": "y1_O", "ppe": "y0_F", "ppe_t1": "y1_F",
        "lt_investments": f"{z('y0_R')} * CAST(0.25 AS DOUBLE)", "lt_investments_t1": f"{z('y1_R')} * CAST(0.25 AS DOUBLE)", "total_assets": "y0_all * CAST(2 AS DOUBLE)", "total_assets_t1": "y1_all * CAST(2 AS DOUBLE)",
        "depreciation": "y0_tax", "depreciation_t1": "y1_tax", "sga": "y0_discount", "sga_t1": "y1_discount", "debt_to_assets": q("y0_O", "y0_all"), "debt_to_assets_t1": q("y1_O", "y1_all"),
        "buy_recs": z("n_y0_N"), "hold_recs": z("n_y0_A"), "sell_recs": z("n_y0_R"),
        "ps_ntm": q(cap, "y0_all"), "ps_3yr_avg": q(f"{cap} * CAST(3 AS DOUBLE)", f"{z('y0_all')} + {z('y1_all')} + {z('y2_all')}"),
        "fcf_yield": q(fcf["y0"], cap), "fcf_yield_3yr_avg": q(fcf["y1"], cap), "ntm_gross_margin": q("y0_N", "y0_all"), "gross_margin_3yr_avg": q("y1_N", "y1_all"),
        "ntm_ebit_margin": q(f"y0_all - {z('y0_R')} - y0_discount", "y0_all"), "ebit_margin_3yr_avg": q(f"y1_all - {z('y1_R')} - y1_discount", "y1_all"),
        "rev_cagr_p2y": f"sqrt({q('y0_all', 'y2_all')}) - CAST(1 AS DOUBLE)", "rev_cagr_f2y": f"{q('y0_all', 'y1_all')} - CAST(1 AS DOUBLE)",
        "dilution_p3y": f"{q('n_y0_all', 'n_y1_all')} - CAST(1 AS DOUBLE)", "weighted_avg_maturity": q("y0_quantity", "n_y0_all"), "short_interest_pct": q("y0_discount", "y0_all"),
        "adj_eps": q(income["y0"], "CAST(p_size AS DOUBLE)"), "dil_eps_fy0": q(cfo["y0"], "CAST(p_size AS DOUBLE)"), "non_gaap_gaap_ebit": q(ebitda, cfo["y0"]),
    }
    columns = ", ".join(f"{values.get(n, 'CAST(NULL AS DOUBLE)')} AS {n}" for n in HEADERS.values())
    return f"SELECT p_partkey AS _row_id, {columns} FROM part LEFT JOIN ({accounts(day)}) ON p_partkey = l_partkey"


def d(a: str, b: str) -> str:
    return f"{a} / nullif({b}, CAST(0 AS DOUBLE))"


FIRST = {
    "ps_diff": d("ps_ntm", "ps_3yr_avg") + " - 1", "fcf_yield_diff": "fcf_yield_3yr_avg - fcf_yield",
    "yoy_growth_ttm": d("revenues_ttm", "revenues_ttm_t1") + " - 1", "yoy_growth_ttm_t1": d("revenues_ttm_t1", "revenues_ttm_t2") + " - 1", "growth_accel": "rev_cagr_f2y - rev_cagr_p2y",
    "gm_diff": "ntm_gross_margin - gross_margin_3yr_avg", "ebit_diff": "ntm_ebit_margin - ebit_margin_3yr_avg",
    "leverage_ratio_calc": f"CASE WHEN {d('net_debt', 'adj_ebitda')} >= 0 THEN {d('net_debt', 'adj_ebitda')} END", "debt_sales": f"CASE WHEN {d('net_debt', 'revenues_ttm')} >= 0 THEN {d('net_debt', 'revenues_ttm')} END",
    "enterprise_value_calc": "market_cap + net_debt", "liquidity": f"cash_balance + {z('available_loc')}", "fcf_conversion": d("fcf", "adj_ebitda"), "accrual_ratio": d("(cfo - net_income)", "cfo"),
    "dsos": d("avg_receivables", "revenues_t3m") + " * 90", "dsos_py": d("avg_receivables_t1", "revenues_t3m_t1") + " * 90", "dios": d("avg_inventory", "cogs_t3m") + " * 90", "dios_t1": d("avg_inventory_py", "cogs_t3m_t1") + " * 90",
    "dpos": d("avg_payables", "cogs_t3m") + " * 90", "dpos_t1": d("avg_payables_t1", "cogs_t3m_t1") + " * 90", "days_deferred_rev": d("deferred_revenue", "revenues_t3m") + " * 90", "days_deferred_rev_t1": d("deferred_revenue_t1", "revenues_t3m_t1") + " * 90",
    "eps_adj_ratio": d("adj_eps", "dil_eps_fy0"), "hold_sell_pct": d("(hold_recs + sell_recs)", "buy_recs + hold_recs + sell_recs"),
    "gmi": q(d("(revenues_t3m_t1 - cogs_t3m_t1)", "revenues_t3m_t1"), d("(revenues_t3m - cogs_t3m)", "revenues_t3m")),
    "aqi": q("1 - " + d("(current_assets + ppe + lt_investments)", "total_assets"), "1 - " + d("(current_assets_t1 + ppe_t1 + lt_investments_t1)", "total_assets_t1")),
    "sgi": d("revenues_t3m", "revenues_t3m_t1"), "depi": q(d("depreciation_t1", "ppe_t1 + depreciation_t1"), d("depreciation", "depreciation + ppe")), "sgai": q(d("sga", "revenues_ttm"), d("sga_t1", "revenues_ttm_t1")),
    "lvgi": d("debt_to_assets", "debt_to_assets_t1"), "tata": d("(net_income - cfo)", "total_assets"),
}
SECOND = {
    "growth_decel": "yoy_growth_ttm - yoy_growth_ttm_t1", "debt_ev": d("net_debt", "enterprise_value_calc"), "remaining_liquidity_years": f"CASE WHEN fcf < 0 THEN {d('liquidity', '-fcf')} END",
    "dso_pct_change": d("dsos", "dsos_py") + " - 1", "dio_pct_change": d("dios", "dios_t1") + " - 1", "dpo_pct_change": d("dpos", "dpos_t1") + " - 1", "deferred_rev_pct_change": d("days_deferred_rev", "days_deferred_rev_t1") + " - 1", "dsri": d("dsos", "dsos_py"),
}
_C = lambda x: f"CAST({x} AS DOUBLE)"
MSCORE = f"{_C(-4.84)} + {_C(0.92)} * dsri + {_C(0.528)} * gmi + {_C(0.404)} * aqi + {_C(0.892)} * sgi + {_C(0.115)} * depi + {_C(-0.172)} * sgai + {_C(4.679)} * tata + {_C(-0.327)} * lvgi"


def metrics(day: str = "2001-08-01") -> str:
    first = ", ".join(f"{e} AS {n}" for n, e in FIRST.items())
    second = ", ".join(f"{e} AS {n}" for n, e in SECOND.items())
    return f"SELECT *, {MSCORE} AS mscore FROM (SELECT *, {second} FROM (SELECT *, {first} FROM ({raw(day)})))"


def rank(metric: str, inverted: bool, default: float, keys: str = "") -> str:
    part = f"PARTITION BY {keys + ', ' if keys else ''}{metric} IS NULL"
    p = f"CASE WHEN count(*) OVER ({part}) = 1 THEN CAST(1 AS DOUBLE) ELSE (rank() OVER ({part} ORDER BY {metric}) - 1) / CAST(count(*) OVER ({part}) - 1 AS DOUBLE) END"
    return f"CASE WHEN {metric} IS NULL THEN {_C(default)} ELSE {'1 - ' if inverted else ''}({p}) END"


def overall(weights: dict[str, float] | None = None) -> str:
    weights = weights or default_config()["weights"]
    return " + ".join([_C(0.0), *[f"{_C(weights[f])} * {f}" for f in FACTOR_NAMES]])


def scored(day: str = "2001-08-01", keys: str = "") -> str:
    ranks = ", ".join(f"{rank(f[1], f[2], f[3], keys)} AS {f[0]}" for f in FACTORS)
    return f"SELECT *, {overall()} AS overall_score, coalesce(mscore > {_C(-2.22)}, FALSE) AS mscore_flag FROM (SELECT *, {ranks} FROM ({metrics(day)}))"


def panel(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT DATE '{day}' AS as_of, {columns} FROM ({scored(day)})" for day in PANEL)


def facts(source: str, keys: str) -> str:
    """category, factor_label, score and ordinals of each row of source."""
    return " UNION ALL ".join(
        f"SELECT {keys}, '{CATEGORY_OF[f]}' AS category, '{LABEL_OF[f]}' AS factor_label, {f} AS score, {CATEGORIES.index(CATEGORY_OF[f])} AS category_ordinal, {i} AS factor_ordinal FROM ({source})" for i, f in enumerate(FACTOR_NAMES)
    )


def reference(source: str) -> str:
    """The external table that parity queries compare with: scores moved on some keys, some keys gone, some of its own."""
    moved = ", ".join(f"{_C('NULL') if i == 23 else f'{f} + CASE WHEN _row_id % {100 if i % 3 != 1 else 10} = 0 THEN {_C(0.01)} ELSE {_C(0)} END'} AS {f}" for i, f in enumerate(FACTOR_NAMES))
    own = f"SELECT ' ' || ticker || chr(9) AS ref_ticker, {moved}, overall_score + CASE WHEN _row_id % 20 = 0 THEN {_C(0.02)} ELSE {_C(0)} END AS overall_score, mscore + CASE WHEN _row_id % 2 = 0 THEN {_C(0.0005)} ELSE {_C(0)} END AS mscore FROM ({source}) WHERE _row_id % 50 <> 7"
    return own + f" UNION ALL SELECT 'X' || ticker, {', '.join(FACTOR_NAMES)}, overall_score, mscore FROM ({source}) WHERE _row_id % 40 = 0 UNION ALL SELECT NULL, {', '.join(FACTOR_NAMES)}, overall_score, mscore FROM ({source}) WHERE _row_id % 500 = 1"


def parity(column: str, extra: str, base: str = "sc") -> str:
    """One row about the deviations of a column; needs the CTEs sc and ref."""
    dev = f"SELECT abs(s.{column} - r.{column}) AS dev FROM sc s JOIN ref r ON s.ticker = trim(r.ref_ticker, ' ' || chr(9)) WHERE abs(s.{column} - r.{column}) IS NOT NULL"
    return f"SELECT {extra} FROM ({dev})"
