"""A universe of companies made of the order tables: each part is a company, its order lines its accounts.

Amounts are decimals, summed as whole numbers, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantsieve.sources.schema import HEADERS, IDENTITY

AS_OF = "2001-08-01"
MONEY = "decimal(18,2)"


def _years_before(day: date, years: int) -> date:
    return day.replace(year=day.year - years)


def windows(as_of: str) -> dict[str, tuple[str, str]]:
    """Half-open date ranges: three years back from as_of, and its last quarter with the same one a year before."""
    end = date.fromisoformat(as_of)
    month = end.month - 3
    quarter = end.replace(month=month) if month > 0 else end.replace(year=end.year - 1, month=month + 12)
    spans = {f"y{k}": (_years_before(end, k + 1), _years_before(end, k)) for k in range(3)}
    spans |= {f"q{k}": (_years_before(quarter, k), _years_before(end, k)) for k in range(2)}
    return {k: (a.isoformat(), b.isoformat()) for k, (a, b) in spans.items()}


KINDS = {"all": None, "R": ("l_returnflag", "R"), "A": ("l_returnflag", "A"), "N": ("l_returnflag", "N"), "O": ("l_linestatus", "O"), "F": ("l_linestatus", "F")}


def last_places(x: Column, digits: int = 2) -> Column:
    """A double as a whole number of its last decimal place, rounded as a decimal; those that have no more places take no decimal arithmetic."""
    near = F.rint(x * 10.0**digits)
    exact = (near / 10.0**digits == x) & (F.abs(near) < 1e15)  # up to 15 digits, a double stands for one decimal
    return F.when(exact, near.cast("long")).otherwise((x.cast(MONEY) * 10**digits).cast("long"))


def accounts(lineitem: DataFrame, as_ofs: Sequence[str] = (AS_OF,)) -> DataFrame:
    """One row per part and as_of: the amounts <window>_<kind>, counts n_<window>_<kind>, and weighted sums, in one aggregation.

    Lines are shuffled once, as they are: a part's lines are scattered, and partial sums would be rows of all amounts for nearly every line.
    """
    spans = [windows(day) for day in as_ofs]
    names = list(spans[0])
    days = lineitem.sparkSession.createDataFrame([(day, *[d for w in names for d in s[w]]) for day, s in zip(as_ofs, spans)], "as_of string, " + ", ".join(f"{w}_{side} string" for w in names for side in ("from", "to")))
    days = days.select(F.col("as_of").cast("date").alias("as_of"), *[F.col(c).cast("timestamp") for c in days.columns[1:]], *[f(*[F.col(f"{w}_{side}") for w in names]).cast("timestamp").alias(f"_{side}") for f, side in ((F.least, "from"), (F.greatest, "to"))])
    first, last = min(a for s in spans for a, _ in s.values()), max(b for s in spans for _, b in s.values())
    seen = lineitem.where((F.col("l_shipdate") >= F.lit(first).cast("timestamp")) & (F.col("l_shipdate") < F.lit(last).cast("timestamp")))
    # Each amount is read once, as a whole number of its last decimal place.
    cents, rates = last_places(F.col("l_extendedprice")), ("tax", "discount")
    seen = seen.select("l_partkey", "l_shipdate", "l_returnflag", "l_linestatus", cents.alias("cents"), last_places(F.col("l_quantity")).alias("quantity"), *[last_places(F.col(f"l_{rate}")).alias(rate) for rate in rates])
    met = seen.join(F.broadcast(days), (F.col("l_shipdate") >= F.col("_from")) & (F.col("l_shipdate") < F.col("_to")))
    inside = {w: (F.col("l_shipdate") >= F.col(f"{w}_from")) & (F.col("l_shipdate") < F.col(f"{w}_to")) for w in names}
    lines = met.select("l_partkey", "as_of", "l_returnflag", "l_linestatus", "cents", "quantity", *[(F.col("cents") * F.col(rate)).alias(rate) for rate in rates], *[c.alias(f"_{w}") for w, c in inside.items()]).repartition("l_partkey", "as_of")
    total = lambda met, name, digits: F.sum(F.when(met, F.col(name))).cast("double") / 10.0**digits
    aggs = []
    for w in names:
        for kind, test in KINDS.items():
            met = F.col(f"_{w}") if test is None else F.col(f"_{w}") & (F.col(test[0]) == test[1])
            aggs.append(total(met, "cents", 2).alias(f"{w}_{kind}"))
            if w in ("y0", "y1"):
                aggs.append(F.count(F.when(met, 1)).cast("double").alias(f"n_{w}_{kind}"))
        aggs.append(total(F.col(f"_{w}") & (F.col("l_returnflag") != "R"), "cents", 2).alias(f"{w}_kept"))
        if w in ("y0", "y1"):
            aggs += [total(F.col(f"_{w}"), rate, 4).alias(f"{w}_{rate}") for rate in rates]
    aggs.append(total(F.col("_y0"), "quantity", 2).alias("y0_quantity"))
    return lines.groupBy("l_partkey", "as_of").agg(*aggs)


def companies(part: DataFrame, lineitem: DataFrame, as_ofs: Sequence[str] = (AS_OF,)) -> DataFrame:
    """The raw table: _row_id, identity and 77 numbers (null where the order tables say nothing), and as_of, for each part and snapshot."""
    each = part.withColumn("as_of", F.explode(F.array(*[F.lit(day).cast("date") for day in as_ofs])))
    df = each.join(accounts(lineitem, as_ofs).withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey", "as_of"], "left")
    c = F.col
    z = lambda x: F.coalesce(c(x), F.lit(0.0))
    div = lambda a, b: a / F.nullif(b, F.lit(0.0))
    df = df.withColumn("market_cap", c("p_retailprice") * c("p_size"))
    cfo = lambda y: z(f"{y}_N") - z(f"{y}_R")
    income = lambda y: z(f"{y}_F") - z(f"{y}_O")
    fcf = lambda y: z(f"{y}_A") - z(f"{y}_R")
    ebitda = z("y0_N") + z("y0_A") - z("y0_R")
    ebit = lambda y: div(c(f"{y}_all") - z(f"{y}_R") - c(f"{y}_discount"), c(f"{y}_all"))
    values: dict[str, Column] = {
        "ticker": F.concat(F.lit("P"), c("p_partkey").cast("string")),
        "name": c("p_name"),
        "sector": c("p_type"),
        "industry": c("p_brand"),
        "market_cap": c("market_cap"),
        "revenues_ttm": c("y0_all"),
        "revenues_ttm_t1": c("y1_all"),
        "revenues_ttm_t2": c("y2_all"),
        "revenues_t3m": c("q0_all"),
        "revenues_t3m_t1": c("q1_all"),
        "cogs_ttm": z("y0_kept"),
        "cogs_ttm_t1": z("y1_kept"),
        "cogs_t3m": z("q0_kept"),
        "cogs_t3m_t1": z("q1_kept"),
        "avg_receivables": c("q0_O"),
        "avg_receivables_t1": c("q1_O"),
        "avg_inventory": c("q0_F"),
        "avg_inventory_py": c("q1_F"),
        "avg_payables": c("q0_A"),
        "avg_payables_t1": c("q1_A"),
        "deferred_revenue": c("q0_N"),
        "deferred_revenue_t1": c("q1_N"),
        "cfo": cfo("y0"),
        "cfo_t1": cfo("y1"),
        "net_income": income("y0"),
        "net_income_t1": income("y1"),
        "fcf": fcf("y0"),
        "adj_ebitda": ebitda,
        "net_debt": z("y0_O") - z("y0_F"),
        "cash_balance": c("y1_F"),
        "available_loc": F.when(c("p_size") > 25, c("y1_R")),
        "current_assets": c("y0_O"),
        "current_assets_t1": c("y1_O"),
        "ppe": c("y0_F"),
        "ppe_t1": c("y1_F"),
        "lt_investments": z("y0_R") * 0.25,
        "lt_investments_t1": z("y1_R") * 0.25,
        "total_assets": c("y0_all") * 2.0,
        "total_assets_t1": c("y1_all") * 2.0,
        "depreciation": c("y0_tax"),
        "depreciation_t1": c("y1_tax"),
        "sga": c("y0_discount"),
        "sga_t1": c("y1_discount"),
        "debt_to_assets": div(c("y0_O"), c("y0_all")),
        "debt_to_assets_t1": div(c("y1_O"), c("y1_all")),
        "buy_recs": z("n_y0_N"),
        "hold_recs": z("n_y0_A"),
        "sell_recs": z("n_y0_R"),
        "ps_ntm": div(c("market_cap"), c("y0_all")),
        "ps_3yr_avg": div(c("market_cap") * 3.0, z("y0_all") + z("y1_all") + z("y2_all")),
        "fcf_yield": div(fcf("y0"), c("market_cap")),
        "fcf_yield_3yr_avg": div(fcf("y1"), c("market_cap")),
        "ntm_gross_margin": div(c("y0_N"), c("y0_all")),
        "gross_margin_3yr_avg": div(c("y1_N"), c("y1_all")),
        "ntm_ebit_margin": ebit("y0"),
        "ebit_margin_3yr_avg": ebit("y1"),
        "rev_cagr_p2y": F.sqrt(div(c("y0_all"), c("y2_all"))) - 1.0,
        "rev_cagr_f2y": div(c("y0_all"), c("y1_all")) - 1.0,
        "dilution_p3y": div(c("n_y0_all"), c("n_y1_all")) - 1.0,
        "weighted_avg_maturity": div(c("y0_quantity"), c("n_y0_all")),
        "short_interest_pct": div(c("y0_discount"), c("y0_all")),
        "adj_eps": div(income("y0"), c("p_size").cast("double")),
        "dil_eps_fy0": div(cfo("y0"), c("p_size").cast("double")),
        "non_gaap_gaap_ebit": div(ebitda, cfo("y0")),
    }
    empty = {n: F.lit(None).cast("double") for n in HEADERS.values() if n not in values}
    return df.select(c("p_partkey").alias("_row_id"), *[(values | empty)[n].cast("string" if n in IDENTITY else "double").alias(n) for n in HEADERS.values()], "as_of")


def read_companies(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    return read_panel(spark, sf_dir, [as_of]).drop("as_of")


def read_panel(spark: SparkSession, sf_dir: str, as_ofs: Sequence[str]) -> DataFrame:
    """The snapshots of several dates, with as_of; order lines are read and shuffled once for all."""
    return companies(spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet"), as_ofs)
