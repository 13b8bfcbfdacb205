"""Registries: upload headers, factors, categories, labels, weights."""

from __future__ import annotations

# Vendor header -> column, in upload order.
HEADERS = {
    "Ticker": "ticker",
    "Name": "name",
    "Sector": "sector",
    "Industry": "industry",
    "Market Cap ($M)": "market_cap",
    "Enterprise Value ($M)": "enterprise_value",
    "Short Interest %": "short_interest_pct",
    "P/S - NTM": "ps_ntm",
    "P/S 3 Yr. Avg.": "ps_3yr_avg",
    "FCF Yield": "fcf_yield",
    "NTM Gross Margin": "ntm_gross_margin",
    "Gross Margin (3Yr. Avg.)": "gross_margin_3yr_avg",
    "NTM EBIT Margin": "ntm_ebit_margin",
    "EBIT Margin (3yr. Avg.)": "ebit_margin_3yr_avg",
    "Revenue CAGR (P2Y)": "rev_cagr_p2y",
    "Revenue CAGR (F2Y)": "rev_cagr_f2y",
    "ROIC (%)": "roic",
    "ROIC (3yr. Avg.)": "roic_3yr_avg",
    "Buy Recs": "buy_recs",
    "Hold Recs": "hold_recs",
    "Sell Recs": "sell_recs",
    "Leverage Ratio": "leverage_ratio",
    "52 Week High (%)": "week_52_high_pct",
    "52 Week Low (%)": "week_52_low_pct",
    "FCF ($M)": "fcf",
    "Adj. EBITDA ($M)": "adj_ebitda",
    "30 Day Avg. Volume ($M)": "avg_volume_30d",
    "Adj. EPS (FY-2)": "adj_eps_fy2",
    "Adj. EPS (FY-1)": "adj_eps_fy1",
    "Adj. EPS": "adj_eps",
    "Dil. EPS  (FY-2)": "dil_eps_fy2",
    "Dil. EPS (FY-1)": "dil_eps_fy1",
    "Dil. EPS (FY0)": "dil_eps_fy0",
    "Non-GAAP/GAAP EBIT": "non_gaap_gaap_ebit",
    "Dil. Wtd. Avg. Shares (FY-3 to FY0)": "dilution_p3y",
    "Net Debt ($M)": "net_debt",
    "Weighted Avg. Maturity": "weighted_avg_maturity",
    "TTM Cash Burn": "ttm_cash_burn",
    "Cash Balance": "cash_balance",
    "Available LOC": "available_loc",
    "Revenues TTM": "revenues_ttm",
    "Revenues TTM (T-1)": "revenues_ttm_t1",
    "Revenues TTM (T-2)": "revenues_ttm_t2",
    "Revenues T3M": "revenues_t3m",
    "Revenues T3M (T-1)": "revenues_t3m_t1",
    "COGS TTM": "cogs_ttm",
    "COGS TTM (T-1)": "cogs_ttm_t1",
    "COGS T3M": "cogs_t3m",
    "COGS T3M (T-1)": "cogs_t3m_t1",
    "SG&A": "sga",
    "SG&A (T-1)": "sga_t1",
    "Depr.": "depreciation",
    "Depr. (T-1)": "depreciation_t1",
    "Net Income": "net_income",
    "Net Income (T-1)": "net_income_t1",
    "CFO": "cfo",
    "CFO (T-1)": "cfo_t1",
    "Avg. Rec.": "avg_receivables",
    "Avg. Rec. (T-1)": "avg_receivables_t1",
    "Avg. Inventory": "avg_inventory",
    "Avg. Inventory (PY)": "avg_inventory_py",
    "Current Assets": "current_assets",
    "Current Assets (T-1)": "current_assets_t1",
    "PP&E": "ppe",
    "PP&E (T-1)": "ppe_t1",
    "LT Inv.": "lt_investments",
    "LT Inv. (T-1)": "lt_investments_t1",
    "Avg. Payables": "avg_payables",
    "Avg. Payables (T-1)": "avg_payables_t1",
    "Deferred Rev.": "deferred_revenue",
    "Deferred Rev (T-1)": "deferred_revenue_t1",
    "Debt to Assets": "debt_to_assets",
    "Debt to Assets (T-1)": "debt_to_assets_t1",
    "Total Assets": "total_assets",
    "Total Assets (T-1)": "total_assets_t1",
    "DSOs (3yr. Avg.)": "dsos_3yr_avg",
    "DIOS (3yr. Avg.)": "dios_3yr_avg",
    "DPOS (3yr. Avg.)": "dpos_3yr_avg",
    "FCF Yield (3yr. Avg.)": "fcf_yield_3yr_avg",
    "1W Perf.": "perf_1w",
    "1M Perf.": "perf_1m",
}
IDENTITY = ("ticker", "name", "sector", "industry")
MISSING_MARKER = "#N/A N/A"
#: Columns where the marker means zero rather than unknown.
MARKER_IS_ZERO = ("available_loc",)

# Factor, ranked metric, whether high values score low, default for a missing value, weight, category, label.
FACTORS = (
    ("abs_ps_factor", "ps_diff", False, 0.5, 0.25, "Valuation", "Abs. P/S"),
    ("rel_ps_factor", "ps_ntm", False, 0.5, 0.25, "Valuation", "Rel. P/S"),
    ("abs_fcf_factor", "fcf_yield_diff", False, 0.5, 0.25, "Valuation", "Abs. FCF%"),
    ("rel_fcf_factor", "fcf_yield", True, 0.5, 0.25, "Valuation", "Rel. FCF%"),
    ("decel_factor", "growth_decel", True, 0.5, 0.5, "Growth", "Deceleration"),
    ("accel_factor", "growth_accel", False, 0.5, 0.5, "Growth", "Acceleration"),
    ("gm_factor", "gm_diff", False, 0.5, 0.5, "Profitability", "Gross Margin"),
    ("ebit_factor", "ebit_diff", False, 0.5, 0.5, "Profitability", "EBIT Margin"),
    ("debt_ebitda_factor", "leverage_ratio_calc", False, 0.0, 0.2, "Balance Sheet", "Debt/EBITDA"),
    ("debt_sales_factor", "debt_sales", False, 0.0, 0.2, "Balance Sheet", "Debt/Sales"),
    ("debt_ev_factor", "debt_ev", False, 0.5, 0.2, "Balance Sheet", "Debt/EV"),
    ("refi_risk_factor", "weighted_avg_maturity", True, 0.5, 0.2, "Balance Sheet", "Refi Risk"),
    ("liquidity_risk_factor", "remaining_liquidity_years", True, 0.0, 0.2, "Balance Sheet", "Liquidity Risk"),
    ("fcf_conv_factor", "fcf_conversion", True, 0.5, 0.142857, "Cash Flow", "FCF Conversion"),
    ("accrual_factor", "accrual_ratio", False, 0.5, 0.142857, "Cash Flow", "Accrual"),
    ("dso_factor", "dso_pct_change", False, 0.0, 0.142857, "Cash Flow", "DSO"),
    ("dio_factor", "dio_pct_change", False, 0.0, 0.142857, "Cash Flow", "DIO"),
    ("dpo_factor", "dpo_pct_change", True, 0.0, 0.142857, "Cash Flow", "DPO"),
    ("def_rev_factor", "deferred_rev_pct_change", True, 0.0, 0.142857, "Cash Flow", "Def. Revenue"),
    ("dilution_factor", "dilution_p3y", False, 0.5, 0.142857, "Cash Flow", "Dilution"),
    ("ebit_adj_factor", "non_gaap_gaap_ebit", False, 0.5, 0.5, "Non-GAAP", "EBIT Adj."),
    ("eps_adj_factor", "eps_adj_ratio", False, 0.5, 0.5, "Non-GAAP", "EPS Adj."),
    ("short_int_factor", "short_interest_pct", False, 0.5, 0.5, "Sentiment", "Short Interest"),
    ("ratings_factor", "hold_sell_pct", False, 0.5, 0.5, "Sentiment", "Ratings"),
)
FACTOR_NAMES = tuple(f[0] for f in FACTORS)
METRIC_OF = {f[0]: f[1] for f in FACTORS}
INVERTED = {f[0]: f[2] for f in FACTORS}
CATEGORIES = tuple(dict.fromkeys(f[5] for f in FACTORS))
CATEGORY_OF = {f[0]: f[5] for f in FACTORS}
LABEL_OF = {f[0]: f[6] for f in FACTORS}

#: The columns of the screening table, in order; absent ones are skipped.
DISPLAY = ("ticker", "name", "sector", "industry", "market_cap", "overall_score", "mscore_flag", *FACTOR_NAMES)


def default_config() -> dict:
    """The scoring settings: weights and defaults by factor, and the manipulation threshold."""
    return {"weights": {f[0]: f[4] for f in FACTORS}, "defaults": {f[0]: f[3] for f in FACTORS}, "mscore_threshold": -2.22}


def check_config(config: dict) -> dict:
    """config, or an error that names the factors without a weight or default."""
    for part in ("weights", "defaults"):
        if missing := [f for f in FACTOR_NAMES if f not in config[part]]:
            raise KeyError(f"no {part} for {len(missing)} factors: {', '.join(missing)}")
    return config
