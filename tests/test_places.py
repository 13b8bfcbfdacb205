"""Places, tiles, routed ranks and exact quantiles against plain windows and sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantsieve.operators import quality, ranking
from quantsieve.operators.history import backtest
from quantsieve.operators.positions import positions, tile
from quantsieve.sources import tables
from quantsieve.sources.universe import last_places, read_panel


def made(spark, n=3000, seed=7):
    """One universe with over a third of all rows, small ones, a missing one; a value with a third of all rows; ties."""
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, 0.0, 0.0, 0.0, float(rng.randint(0, 20)), rng.gauss(0, 1)])
    rows = [(i, rng.choice(["hot", "hot", "a", "b", "c", None]), pick(), rng.gauss(0, 5)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "one", 5.0, None)], "_row_id long, g string, x double, y double")


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_positions_and_tiles(spark, keys):
    df = made(spark)
    w = Window.partitionBy(*keys).orderBy("x", "_row_id") if keys else Window.orderBy("x", "_row_id")
    for tiles in (1, 4, 10, 5000):
        got = positions(df, ["x", "_row_id"], keys).select("_row_id", "pos", tile(F.col("pos"), F.col("n"), tiles).alias("t"))
        want = df.select("_row_id", (F.row_number().over(w) - 1).alias("pos"), F.ntile(tiles).over(w).alias("t"))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert positions(df.limit(0), ["x"], keys).count() == 0
    with pytest.raises(ValueError, match="pos"):
        positions(df.withColumn("pos", F.lit(1)), ["x"])


def test_backtest_windows_over_no_snapshot(spark):
    """The plan's windows are over a key, or over a table of one row per partition and snapshot."""
    panel = made(spark).select((F.col("_row_id") % 600).alias("ticker"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("_row_id") / 600).cast("int")).alias("as_of"), F.coalesce("x", F.lit(0.0)).alias("overall_score"), F.abs("y").alias("v"))
    out = backtest(panel, "v", 10)
    after = F.lead("v").over(Window.partitionBy("ticker").orderBy("as_of"))
    rows = panel.select("as_of", "ticker", "overall_score", (after / F.nullif("v", F.lit(0.0)) - 1).alias("r")).where("r is not null")
    want = rows.withColumn("decile", F.ntile(10).over(Window.partitionBy("as_of").orderBy("overall_score", "ticker"))).groupBy("as_of", "decile").count()
    assert {(r[0], r["decile"], r["n"]) for r in out.collect()} == {tuple(r) for r in want.collect()}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_universes_are_routed_by_size(spark, keys, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 40)
    monkeypatch.setattr(ranking, "LEAST_RANGES", 4)
    df, columns = made(spark), {"fx": "x", "fy": "y"}
    want = ranking.rank_long(ranking.unpivot(df, ["_row_id", *keys], columns), keys, "window")
    want = {(r["_row_id"], r["factor"]): r["p"] for r in want.collect()}
    rows = tables.staged(df, "rows")
    for large in (0, 500, 10**6):
        got = ranking.rank_table(rows, columns, "_row_id", keys, large)
        assert {(r["_row_id"], r["factor"]): r["p"] for r in got.collect()} == want
    assert ranking.rank_table(tables.staged(df.limit(0), "none"), columns, "_row_id", keys, 0).count() == 0


def test_a_hot_universe_is_no_task(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 2000)
    df = spark.range(40_000).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.rand(3).alias("x"))
    rows = tables.staged(df, "rows")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = ranking.rank_table(rows, {"fx": "x"}, "_row_id", ["g"], 5000)
        most = ranked.where("g = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 26_667 / 2 and ranked.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_universe_is_made_once(spark):
    made_rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made_rows.add(b.num_rows)
            yield b

    df = made(spark).mapInArrow(seen, "_row_id long, g string, x double, y double")
    out = ranking.rank_factors(df, {"fx": "x", "fy": "y"}, {"fx": False, "fy": True}, {"fx": 0.5, "fy": 0.0}, keep=["g"])
    assert out.columns == ["_row_id", "g", "fx", "fy"] and len(out.collect()) == 3001
    assert made_rows.value == 3001


@pytest.mark.parametrize(("keys", "ranges"), [([], 3), ([], 64), (["g"], 8), (["g"], 1)])
def test_quantiles_are_exact(spark, keys, ranges):
    df, qs = made(spark), [0.0001, 0.25, 0.5, 0.75, 1.0]
    got = quality.quantiles(tables.staged(df, "rows"), ["x", "y"], qs, keys, ranges)
    got = {(r["g"] if keys else None, r["column_name"], r["q"]): r["value"] for r in got.collect()}
    groups = {}
    for r in df.collect():
        for c in "xy":
            if r[c] is not None:
                groups.setdefault((r["g"] if keys else None, c), []).append(r[c])
    assert got == {(*k, q): sorted(v)[math.ceil(q * len(v)) - 1] for k, v in groups.items() for q in qs}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_cut_points_are_made_once(spark, keys, monkeypatch):
    """Cut points come out a little different each time they are made: ranges are counted and read by the same ones."""
    plain = ranking.cut_points
    monkeypatch.setattr(ranking, "cut_points", lambda *a: plain(*a).withColumn("_r", F.expr("double(reflect('java.lang.Math', 'random'))")).withColumn("_cuts", F.transform("_cuts", lambda c: c + F.col("_r"))).drop("_r"))
    df, qs = made(spark), [0.1, 0.25, 0.5, 0.75, 0.9]
    got = quality.quantiles(tables.staged(df, "rows"), ["y"], qs, keys, 64)
    want = df.where("y is not null").groupBy(*keys).agg(F.sort_array(F.collect_list("y")).alias("ys")).collect()
    assert {(r["g"] if keys else None, r["q"], r["value"]) for r in got.collect()} == {(r["g"] if keys else None, q, r["ys"][math.ceil(q * len(r["ys"])) - 1]) for r in want for q in qs}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_a_panel_reads_its_order_lines_once(spark, sf_dir):
    assert scans(read_panel(spark, sf_dir, ["2000-08-01", "2001-02-01", "2001-08-01"])) == 2  # parts and lines


def test_ranges_of_snapshots_are_not_shuffled_again(spark):
    """Rows are shuffled to be ranked in their range, and not to be met with cut points or counts."""
    rows = tables.staged(made(spark), "rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be broadcast by themselves
    try:
        plan = ranking.rank_table(rows, {"fx": "x", "fy": "y"}, "_row_id", ["g"], 1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan


def test_last_places(spark):
    values = [0.07, 1.005, -2.675, 901.0, 104949.5, 1e14, 123456789012.34, 0.1 + 0.2, -0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(last_places(F.col("x"))).collect()] == [r[0] for r in df.select((F.col("x").cast("decimal(18,2)") * 100).cast("long")).collect()]


def test_quantiles_of_many_rows(spark):
    n = 3_000_000
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id") / 7).alias("y"))
    rows = tables.staged(df, "many")
    got = {(r["column_name"], r["q"]): r["value"] for r in quality.quantiles(rows, ["x", "y"], [0.25, 0.5]).collect()}
    low = sum(i / 7 < 1 for i in range(0, 8, 3))
    assert got == {("x", 0.25): n / 4 - 1, ("x", 0.5): n / 2 - 1, ("y", 0.25): 1.0, ("y", 0.5): 1.0} and low == 3


def test_what_a_write_sees(spark, tmp_path):
    df = spark.sql("select id, if(id % 4 = 0, null, id) as market_cap, if(id < 9, null, 'x') as t, cast(id as double) as overall_score from range(20)")
    seen = quality.save_profiled(df, str(tmp_path / "t"))
    assert tables.load(spark, str(tmp_path / "t")).count() == 20
    assert sorted(map(tuple, seen.null_rates(spark).collect())) == sorted(map(tuple, quality.null_rates(df).collect())) == [("market_cap", 0.25), ("t", 0.45)]
    assert tuple(seen.counts(spark).first()) == tuple(quality.counts(df).first()) == (20, 4)
    assert tuple(seen.bounds_table(spark).first()) == (1.0, 19.0, 0.0, 19.0)
    none = quality.save_profiled(df.limit(0), str(tmp_path / "u"))
    assert none.null_rates(spark).count() == 0 and tuple(none.bounds_table(spark).first()) == (None,) * 4
