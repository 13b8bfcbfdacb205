"""Comparison of a scored universe with an external reference table, within tolerances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantsieve.functions.numeric import trimmed
from quantsieve.sources.schema import FACTOR_NAMES

PASS_SHARE, TOLERANCE = 95.0, 0.001


def _keyed(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(trimmed(F.col(key)).alias("_key"), *[F.col(c).cast("double").alias(c) for c in columns])


def _deviations(computed: DataFrame, reference: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(factor, deviation) over the pairs of equal key where both values are known."""
    a, b = _keyed(computed, key, columns), _keyed(reference, key, columns)
    joined = a.join(b.select("_key", *[F.col(c).alias(f"_ref_{c}") for c in columns]), "_key")
    wide = joined.select(*[F.abs(F.col(c) - F.col(f"_ref_{c}")).alias(c) for c in columns])
    return wide.select(F.lit(0).alias("_"), "*").unpivot(["_"], list(columns), "factor", "deviation").where("deviation is not null and not isnan(deviation)").select("factor", "deviation")


def _share(tolerance: float) -> Column:
    return F.avg(F.when(F.col("deviation") <= tolerance, 100.0).otherwise(0.0))


def factor_parity(computed: DataFrame, reference: DataFrame, key: str = "ticker", factors: Sequence[str] = FACTOR_NAMES, tolerance: float = TOLERANCE) -> DataFrame:
    """factor, n_compared, pct_within, max_dev, mean_dev, status for every factor; the status looks at the unrounded share."""
    stats = _deviations(computed, reference, key, factors).groupBy("factor").agg(F.count(F.lit(1)).alias("n"), _share(tolerance).alias("share"), F.max("deviation").alias("top"), (F.sum(F.col("deviation").cast("decimal(38,18)")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("mean"))
    every = computed.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    status = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "NO DATA").when(F.col("share") >= PASS_SHARE, "PASS").otherwise("FAIL")
    return every.join(stats, "factor", "left").select("factor", F.coalesce("n", F.lit(0)).alias("n_compared"), F.bround("share", 2).alias("pct_within"), F.bround("top", 6).alias("max_dev"), F.bround("mean", 6).alias("mean_dev"), status.alias("status"))


def value_parity(computed: DataFrame, reference: DataFrame, column: str, tolerances: Sequence[float], key: str = "ticker") -> DataFrame:
    """One row: n_compared, pct_within_<tolerance>, max_dev, mean_dev of one column."""
    devs = _deviations(computed, reference, key, [column])
    return devs.agg(F.count(F.lit(1)).alias("n_compared"), *[F.bround(_share(t), 2).alias("pct_within_" + str(t).replace(".", "_")) for t in tolerances], F.bround(F.max("deviation"), 6).alias("max_dev"), F.bround((F.sum(F.col("deviation").cast("decimal(38,18)")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))), 6).alias("mean_dev"))


def coverage(computed: DataFrame, reference: DataFrame, key: str = "ticker") -> DataFrame:
    """One row: how many distinct keys are in both, only computed, only in the reference."""
    a = _keyed(computed, key, []).distinct().withColumn("_a", F.lit(1))
    b = _keyed(reference, key, []).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, "_key", "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"), F.count_if(F.col("_b").isNull()).alias("only_computed"), F.count_if(F.col("_a").isNull()).alias("only_reference"))


def summary(parity: DataFrame) -> DataFrame:
    """status, n_factors, factors (sorted, comma-joined)."""
    return parity.groupBy("status").agg(F.count(F.lit(1)).alias("n_factors"), F.array_join(F.array_sort(F.collect_list("factor")), ",").alias("factors"))
