"""The screen: filters, facets, bounds, ordering, export, drill-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.sources.schema import CATEGORIES, CATEGORY_OF, DISPLAY, FACTOR_NAMES, LABEL_OF


def filtered(df: DataFrame, *, sectors: Sequence[str] = (), industries: Sequence[str] = (), market_cap: tuple[float, float] | None = None, score: tuple[float, float] | None = None) -> DataFrame:
    """Rows that meet every filter given; ranges are closed and drop missing values."""
    if sectors:
        df = df.where(F.col("sector").isin(list(sectors)))
    if industries:
        df = df.where(F.col("industry").isin(list(industries)))
    if market_cap:
        df = df.where(F.col("market_cap").between(*market_cap))
    if score:
        df = df.where(F.col("overall_score").between(*score))
    return df


def display(df: DataFrame) -> DataFrame:
    """The display columns that df has."""
    return df.select(*[c for c in DISPLAY if c in df.columns])


def _order(row_id: str) -> list[Column]:
    return [F.desc_nulls_last("overall_score"), F.asc("ticker"), F.asc(row_id)]


def ordered(df: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """Highest composite first, missing last; ticker and row id settle ties."""
    return df.orderBy(*_order(row_id))


def top(df: DataFrame, k: int, universe_keys: Sequence[str] = (), row_id: str = "_row_id") -> DataFrame:
    """The k first rows of the order, of the whole or of each universe."""
    if not universe_keys:
        return ordered(df, row_id).limit(k)
    w = Window.partitionBy(*universe_keys).orderBy(*_order(row_id))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def export_csv(df: DataFrame, path: str, row_id: str = "_row_id") -> None:
    """The display columns as CSV: part files, in order by name, hold the rows in screen order."""
    shown = [c for c in DISPLAY if c in df.columns]
    df.select(*dict.fromkeys([*shown, "overall_score", "ticker", row_id])).repartitionByRange(*_order(row_id)).sortWithinPartitions(*_order(row_id)).select(*shown).write.mode("overwrite").option("header", True).csv(path)


def bounds(df: DataFrame) -> DataFrame:
    """One row: the least and largest market cap and composite."""
    return df.agg(*[f(c).alias(f"{side}_{c}") for c in ("market_cap", "overall_score") for f, side in ((F.min, "min"), (F.max, "max"))])


def facet(df: DataFrame, column: str, sectors: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct values of a column, missing ones left out, within sectors if given."""
    return filtered(df, sectors=sectors).select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def lookup(df: DataFrame, ticker: str, row_id: str = "_row_id") -> DataFrame:
    """The first row of a ticker."""
    w = Window.partitionBy("ticker").orderBy(row_id)
    return df.where(F.col("ticker") == ticker).withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def card(df: DataFrame) -> DataFrame:
    return df.select("ticker", "name", "sector", "industry", "market_cap", "overall_score", "mscore", "mscore_flag")


def factor_facts(df: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(keys, category, factor_label, score, ordinals): 24 rows for each row of df, missing scores kept as null."""
    long = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in FACTOR_NAMES]).unpivot(list(keys), list(FACTOR_NAMES), "factor", "score")

    def named(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("factor")]

    return long.select(*keys, named(CATEGORY_OF).alias("category"), named(LABEL_OF).alias("factor_label"), "score", named({f: CATEGORIES.index(CATEGORY_OF[f]) for f in FACTOR_NAMES}).alias("category_ordinal"), named({f: i for i, f in enumerate(FACTOR_NAMES)}).alias("factor_ordinal"))


def chart_rows(df: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """The facts without missing scores: what a bar chart shows."""
    return factor_facts(df, keys).where("score is not null")


def report(df: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """The facts as text, with N/A for missing scores, and the row's market cap and M-Score as shown on its card."""
    shown = df.select(*keys, *FACTOR_NAMES, F.coalesce(F.concat(F.lit("$"), F.format_number("market_cap", 0)), F.lit("N/A")).alias("market_cap_text"), F.when(F.col("mscore").isNull(), "N/A").otherwise(F.format_string("%.2f", "mscore")).alias("mscore_text"))
    facts = factor_facts(shown, [*keys, "market_cap_text", "mscore_text"])
    return facts.withColumn("score_text", F.when(F.col("score").isNull(), "N/A").otherwise(F.format_string("%.3f", "score"))).drop("score")
