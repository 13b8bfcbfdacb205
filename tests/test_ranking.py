from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quantsieve.operators import ranking, scoring
from quantsieve.sources.schema import CATEGORIES, FACTOR_NAMES, METRIC_OF, default_config


def scores(spark, values, inverted=False, default=0.5, strategy="window"):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "_row_id long, v double")
    out = ranking.rank_factors(df, {"s": "v"}, {"s": inverted}, {"s": default}, strategy=strategy)
    return [r["s"] for r in out.orderBy("_row_id").collect()]


@pytest.mark.parametrize("strategy", ["window", "buckets"])
def test_percentiles(spark, strategy):
    assert scores(spark, [1.0, 2, 3, 4, 5], strategy=strategy) == [0, 0.25, 0.5, 0.75, 1]
    assert scores(spark, [1.0, 2, 2, 3], strategy=strategy) == pytest.approx([0, 1 / 3, 1 / 3, 1])
    assert scores(spark, [5.0], strategy=strategy) == [1.0]
    assert scores(spark, [5.0], inverted=True, strategy=strategy) == [0.0]
    assert scores(spark, [1.0, 2, None, 4, 5], default=0.0, strategy=strategy) == pytest.approx([0, 1 / 3, 0, 2 / 3, 1])
    assert scores(spark, [1.0, 2, 3, 4, 5], inverted=True, strategy=strategy) == [1, 0.75, 0.5, 0.25, 0]
    assert scores(spark, [None, None, None], strategy=strategy) == [0.5] * 3
    assert scores(spark, [0.0, -0.0, 1.0], strategy=strategy) == [0, 0, 1]
    assert scores(spark, [float("-inf"), 0.0, float("inf")], strategy=strategy) == [0, 0.5, 1]


def test_strategies_agree(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("abc"), rng.choice([None, float(rng.randint(0, 9)), rng.gauss(0, 1)]), rng.gauss(0, 5)) for i in range(600)]
    df = spark.createDataFrame(data, "_row_id long, g string, x double, y double")
    for keys in ([], ["g"]):
        long = ranking.unpivot(df, ["_row_id", *keys], {"fx": "x", "fy": "y"})
        a = {(r["_row_id"], r["factor"]): r["p"] for r in ranking.rank_long(long, keys).collect()}
        b = {(r["_row_id"], r["factor"]): r["p"] for r in ranking.rank_long(long, keys, "buckets", 7).collect()}
        c = {(r["_row_id"], r["factor"]): r["p"] for r in ranking.rank_long(long.repartition(7, "v"), keys, "buckets").collect()}
        assert a == b == c


def test_ranking_has_no_single_partition(spark):
    df = spark.range(50).select(F.col("id").alias("_row_id"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    long = ranking.unpivot(df, ["_row_id"], {"fx": "x", "fy": "y"})
    for strategy in ("window", "buckets"):
        plan = ranking.rank_long(long, (), strategy)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Python" not in plan


def test_mscore_flag(spark):
    df = spark.createDataFrame([(-3.0,), (-2.22,), (-2.21,), (-1.0,), (None,)], "mscore double")
    assert [r[0] for r in df.select(scoring.mscore_flag()).collect()] == [False, False, True, True, False]


def test_weights(spark):
    assert len(FACTOR_NAMES) == 24
    assert [(r["category"], r["ok"]) for r in scoring.weight_check(spark).collect()].__len__() == len(CATEGORIES)
    assert all(r["ok"] for r in scoring.weight_check(spark).collect())
    broken = default_config()
    del broken["weights"]["dso_factor"]
    with pytest.raises(KeyError, match="dso_factor"):
        scoring.scored_universe(spark.range(1), broken)


def test_composite_range_and_reweight(spark):
    rng = random.Random(42)
    metrics = sorted(set(METRIC_OF.values()) | {"mscore"})
    df = spark.createDataFrame([(i, *[rng.gauss(0, 1) for _ in metrics]) for i in range(10)], "_row_id long, " + ", ".join(f"{m} double" for m in metrics))
    out = scoring.scored_universe(df)
    assert all(0 <= r["overall_score"] <= 7 and isinstance(r["mscore_flag"], bool) for r in out.collect())
    sides = spark.createDataFrame([("flat", *[1.0] * 24)], "scenario string, " + ", ".join(f"{f} double" for f in FACTOR_NAMES))
    flat = {r["_row_id"]: r["overall_score"] for r in scoring.reweight(out, sides).collect()}
    assert all(flat[r["_row_id"]] == pytest.approx(sum(r[f] for f in FACTOR_NAMES)) for r in out.collect())
