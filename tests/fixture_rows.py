"""Companies that reach every guard of the metrics, and the metrics worked out from them (to nine places)."""

#: All is known, nothing is zero.
STEADY = {
    "ps_ntm": 3.2, "ps_3yr_avg": 2.5, "fcf_yield": 0.045, "fcf_yield_3yr_avg": 0.06,
    "revenues_ttm": 840.0, "revenues_ttm_t1": 700.0, "revenues_ttm_t2": 640.0, "rev_cagr_f2y": 0.13, "rev_cagr_p2y": 0.18,
    "ntm_gross_margin": 0.62, "gross_margin_3yr_avg": 0.58, "ntm_ebit_margin": 0.21, "ebit_margin_3yr_avg": 0.24,
    "net_debt": 320.0, "adj_ebitda": 160.0, "market_cap": 2880.0, "fcf": 96.0, "cash_balance": 75.0, "available_loc": 45.0,
    "cfo": 128.0, "net_income": 104.0, "revenues_t3m": 225.0, "revenues_t3m_t1": 180.0, "cogs_t3m": 90.0, "cogs_t3m_t1": 63.0,
    "avg_receivables": 65.0, "avg_receivables_t1": 48.0, "avg_inventory": 33.0, "avg_inventory_py": 28.0,
    "avg_payables": 26.0, "avg_payables_t1": 14.0, "deferred_revenue": 17.0, "deferred_revenue_t1": 16.0,
    "adj_eps": 2.7, "dil_eps_fy0": 1.8, "buy_recs": 7.0, "hold_recs": 9.0, "sell_recs": 4.0,
    "dilution_p3y": 0.035, "non_gaap_gaap_ebit": 1.2, "short_interest_pct": 0.07, "weighted_avg_maturity": 6.5,
    "current_assets": 410.0, "current_assets_t1": 360.0, "ppe": 270.0, "ppe_t1": 240.0, "lt_investments": 120.0, "lt_investments_t1": 90.0,
    "total_assets": 1600.0, "total_assets_t1": 1500.0, "depreciation": 30.0, "depreciation_t1": 24.0, "sga": 126.0, "sga_t1": 119.0,
    "debt_to_assets": 0.36, "debt_to_assets_t1": 0.32,
}
#: Burns cash, holds more of it than it owes, has no known credit line.
BURNING = STEADY | {"fcf": -60.0, "net_debt": -480.0, "cash_balance": 510.0, "available_loc": None, "cfo": -40.0, "net_income": -72.0, "adj_ebitda": -24.0, "rev_cagr_f2y": -0.04, "dil_eps_fy0": -0.9}
#: Everything that a metric divides by is zero, or adds up to zero.
IDLE = STEADY | dict.fromkeys(
    "ps_3yr_avg revenues_ttm revenues_ttm_t1 revenues_ttm_t2 adj_ebitda cfo revenues_t3m revenues_t3m_t1 cogs_t3m cogs_t3m_t1 dil_eps_fy0 buy_recs hold_recs sell_recs total_assets total_assets_t1 depreciation ppe debt_to_assets_t1 fcf".split(), 0.0
) | {"market_cap": -320.0}
#: Nothing is known of the year before, and no averages.
NEW = STEADY | {c: None for c in STEADY if c.endswith(("_t1", "_t2", "_3yr_avg", "_py"))}
#: The latest accounts are missing; the year before is known, the balances stand at zero.
LATE = STEADY | dict.fromkeys("revenues_ttm market_cap cash_balance net_income sell_recs total_assets sga ntm_ebit_margin adj_eps".split()) | dict.fromkeys("avg_receivables_t1 avg_inventory_py avg_payables_t1 deferred_revenue_t1 net_debt".split(), 0.0)
COMPANIES = [STEADY, BURNING, IDLE, NEW, LATE]

_ = None
GOLDEN = {
    "ps_diff": [0.28, 0.28, _, _, 0.28],
    "fcf_yield_diff": [0.015, 0.015, 0.015, _, 0.015],
    "yoy_growth_ttm": [0.2, 0.2, _, _, _],
    "yoy_growth_ttm_t1": [0.09375, 0.09375, _, _, 0.09375],
    "growth_accel": [-0.05, -0.22, -0.05, -0.05, -0.05],
    "gm_diff": [0.04, 0.04, 0.04, _, 0.04],
    "ebit_diff": [-0.03, -0.03, -0.03, _, _],
    "leverage_ratio_calc": [2, 20, _, 2, 0],
    "debt_sales": [0.380952381, _, _, 0.380952381, _],
    "enterprise_value_calc": [3200, 2400, 0, 3200, _],
    "liquidity": [120, 510, 120, 120, _],
    "fcf_conversion": [0.6, 2.5, _, 0.6, 0.6],
    "accrual_ratio": [0.1875, -0.8, _, 0.1875, _],
    "dsos": [26, 26, _, 26, 26],
    "dsos_py": [24, 24, _, _, 0],
    "dios": [33, 33, _, 33, 33],
    "dios_t1": [40, 40, _, _, 0],
    "dpos": [26, 26, _, 26, 26],
    "dpos_t1": [20, 20, _, _, 0],
    "days_deferred_rev": [6.8, 6.8, _, 6.8, 6.8],
    "days_deferred_rev_t1": [8, 8, _, _, 0],
    "eps_adj_ratio": [1.5, -3, _, 1.5, _],
    "hold_sell_pct": [0.65, 0.65, _, 0.65, _],
    "gmi": [1.083333333, 1.083333333, _, _, 1.083333333],
    "aqi": [0.925925926, 0.925925926, _, _, _],
    "sgi": [1.25, 1.25, _, _, 1.25],
    "depi": [0.909090909, 0.909090909, _, _, 0.909090909],
    "sgai": [0.882352941, 0.882352941, _, _, _],
    "lvgi": [1.125, 1.125, _, _, 1.125],
    "tata": [-0.015, -0.02, _, -0.015, _],
    "growth_decel": [0.10625, 0.10625, _, _, _],
    "debt_ev": [0.1, -0.2, _, 0.1, _],
    "remaining_liquidity_years": [_, 8.5, _, _, _],
    "dso_pct_change": [0.083333333, 0.083333333, _, _, _],
    "dio_pct_change": [-0.175, -0.175, _, _, _],
    "dpo_pct_change": [0.3, 0.3, _, _, _],
    "deferred_rev_pct_change": [-0.15, -0.15, _, _, _],
    "dsri": [1.083333333, 1.083333333, _, _, _],
    "mscore": [-2.267538511, -2.290933511, _, _, _],
}
