"""Operators over panels of snapshots (as_of x security)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.operators.positions import positions, tile
from quantsieve.sources.schema import FACTOR_NAMES


def score_trend(panel: DataFrame, window: int = 3, as_of: str = "as_of", key: str = "ticker") -> DataFrame:
    """key, as_of, overall_score, previous_score, score_change, and mean_score over the last ``window`` snapshots."""
    w = Window.partitionBy(key).orderBy(as_of)
    before, last = F.lag("overall_score").over(w), w.rowsBetween(1 - window, 0)
    return panel.select(key, as_of, "overall_score", before.alias("previous_score"), (F.col("overall_score") - before).alias("score_change"), (F.sum(F.col("overall_score").cast("decimal(28,12)")).over(last).cast("double") / F.count("overall_score").over(last)).alias("mean_score"))


def factor_trend(panel: DataFrame, factors: Sequence[str] = FACTOR_NAMES, as_of: str = "as_of", key: str = "ticker") -> DataFrame:
    """key, as_of, factor, score, change since the snapshot before."""
    w = Window.partitionBy(key).orderBy(as_of)
    changes = panel.select(key, as_of, *[F.struct(F.lit(f).alias("factor"), F.col(f).alias("score"), (F.col(f) - F.lag(f).over(w)).alias("change")).alias(f) for f in factors])
    return changes.select(key, as_of, F.explode(F.array(*factors)).alias("x")).select(key, as_of, "x.*")


def backtest(panel: DataFrame, value: str, tiles: int = 10, as_of: str = "as_of", key: str = "ticker") -> DataFrame:
    """as_of, decile (1: lowest composite), n, mean_return: the growth of ``value`` until the next snapshot."""
    after = F.lead(value).over(Window.partitionBy(key).orderBy(as_of))
    rows = panel.select(as_of, key, "overall_score", (after / F.nullif(F.col(value), F.lit(0.0)) - 1).alias("r")).where("r is not null")
    placed = positions(rows, ["overall_score", key], [as_of])
    return placed.withColumn("decile", tile(F.col("pos"), F.col("n"), tiles)).groupBy(as_of, "decile").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("r").cast("decimal(28,12)")).cast("double") / F.count(F.lit(1))).alias("mean_return"))


def dedupe_latest(df: DataFrame, key: str = "ticker", order: str = "_row_id") -> DataFrame:
    """The last row of each key (opt-in: uploads keep repeated tickers); rows without a key count as one."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_last", F.row_number().over(w)).where("_last = 1").drop("_last")
