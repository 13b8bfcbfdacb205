"""Factor scores, the weighted composite, the manipulation flag."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantsieve.operators.ranking import rank_factors
from quantsieve.sources.schema import CATEGORIES, CATEGORY_OF, FACTOR_NAMES, INVERTED, METRIC_OF, check_config, default_config


#: Most scenarios in one re-weighting.
MAX_SCENARIOS = 10_000


def factor_scores(df: DataFrame, config: dict | None = None, *, factors: Sequence[str] = FACTOR_NAMES, **options) -> DataFrame:
    """df with the scores of factors; options (row_id, universe_keys, keep, ...) are those of ``rank_factors``."""
    config = check_config(config or default_config())
    return rank_factors(df, {f: METRIC_OF[f] for f in factors}, INVERTED, config["defaults"], **options)


def composite(weights: dict[str, float] | dict[str, Column]) -> Column:
    """The weighted sum in registry order, which fixes its last bits."""
    return reduce(lambda s, f: s + (weights[f] if isinstance(weights[f], Column) else F.lit(float(weights[f]))) * F.col(f), FACTOR_NAMES, F.lit(0.0))


def mscore_flag(threshold: float = -2.22) -> Column:
    return F.coalesce(F.col("mscore") > F.lit(float(threshold)), F.lit(False))


def scored_universe(metrics: DataFrame, config: dict | None = None, *, keep: Sequence[str] | None = None, **options) -> DataFrame:
    """metrics (its columns of ``keep`` if given) with 24 factor scores, overall_score and mscore_flag."""
    config = check_config(config or default_config())
    scored = factor_scores(metrics, config, keep=None if keep is None else [*keep, "mscore"], **options)
    return finished(scored, config)


def finished(scores: DataFrame, config: dict) -> DataFrame:
    """scores with overall_score and mscore_flag."""
    return scores.withColumns({"overall_score": composite(config["weights"]), "mscore_flag": mscore_flag(config["mscore_threshold"])})


def reweight(scored: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The composite of each row under each scenario (scenario, and a weight column per factor); ranks are not computed again.

    Scenarios are weightings that a user lists; each of them meets each row, which is what the operator is for. They are
    sent to every executor, so more than MAX_SCENARIOS are an error: split them.
    """
    if (n := scenarios.limit(MAX_SCENARIOS + 1).count()) > MAX_SCENARIOS:
        raise ValueError(f"more than {MAX_SCENARIOS} scenarios ({n} seen)")
    sides = scenarios.select("scenario", *[F.col(f).alias(f"w_{f}") for f in FACTOR_NAMES])
    joined = scored.crossJoin(F.broadcast(sides))
    return joined.select("scenario", *[c for c in scored.columns if c not in FACTOR_NAMES and c != "overall_score"], composite({f: F.col(f"w_{f}") for f in FACTOR_NAMES}).alias("overall_score"))


def weight_check(spark: SparkSession, config: dict | None = None, tolerance: float = 0.001) -> DataFrame:
    """category, total_weight, ok: each category's weights must sum to 1."""
    weights = check_config(config or default_config())["weights"]
    rows = [(CATEGORIES.index(CATEGORY_OF[f]), CATEGORY_OF[f], f, float(weights[f])) for f in FACTOR_NAMES]
    df = spark.createDataFrame(rows, "ordinal int, category string, factor string, weight double")
    out = df.groupBy("ordinal", "category").agg(F.sum(F.col("weight").cast("decimal(18,9)")).cast("double").alias("total_weight"))
    return out.select("category", "total_weight", (F.abs(F.col("total_weight") - 1.0) <= tolerance).alias("ok"))
