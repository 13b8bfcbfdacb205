"""Exact inclusive percentile ranks over any universe.

The rank of v among n present values is (values below v) / (n - 1): equal values share the lowest rank, a
single value ranks 1, missing values stand outside. Inverted ranks are 1 - rank.

``rank_factors`` writes the columns it needs once, counts its universes on that table, and takes each by the plan that
its size asks for; both give the same numbers. "window" sorts each (universe, metric) group in one task: right for
universes of up to LARGE rows, however many. "buckets" deals larger ones out: cut points split a metric's values
into ranges, as many as the universe's size asks for, and each range is ranked on its own above the count of what lies below it. A
value common enough to fill a range is itself a cut point; its rows need no order and are dealt out by hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.sources.tables import small, staged

#: Rows of a universe beyond which it is dealt out by ranges.
LARGE = 1_000_000
#: Ranges of a metric's values: one for so many rows, within bounds (the cut points of all metrics are broadcast).
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 500_000, 64, 16_384
BUCKETS = 256
#: Tasks that the rows of one cut value are dealt to.
SALTS = 64
#: Most cut points, and counts of ranges, that are sent to every executor.
CUT_POINTS, COUNTS = 2_000_000, 200_000


def percent_rank_inc(below: Column, n: Column) -> Column:
    return F.when(n == 1, F.lit(1.0)).otherwise(below / (n - 1))


def unpivot(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """(keys, factor, v) for each factor -> column, missing values left out."""
    # One array to explode, not a projection for each factor, which Java compiles slowly where there are many.
    values = F.array(*[F.col(c).cast("double") for c in columns.values()])
    long = df.select(*keys, F.posexplode(values).alias("_place", "v")).where("v is not null and not isnan(v)")
    return long.select(*keys, F.get(F.array(*map(F.lit, columns)), F.col("_place")).alias("factor"), "v")


def _by_window(long: DataFrame, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group)
    return long.withColumn("p", percent_rank_inc(F.rank().over(w.orderBy("v")) - 1, F.count("v").over(w)))


def ranges_for(rows: int) -> int:
    return min(max(rows // RANGE_ROWS, LEAST_RANGES), MOST_RANGES)


def cut_points(long: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """group, _cuts: about the ``buckets``-quantiles of _v, in ascending order."""
    return long.groupBy(*group).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets)).alias("_cuts"))


def in_ranges(long: DataFrame, cuts: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """long (with _v) with its range _bucket, and whether _v is the cut point that begins it (_cut)."""
    kept = [c for c in long.columns if c != "_v"]
    if group == ["factor"]:
        cuts = F.broadcast(cuts)  # one row per metric
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    put = long.alias("a").join(cuts.alias("b"), same).select("a.*", "_cuts", F.lit(0).alias("_bucket"))
    # The number of cut points up to _v, bit by bit from the highest, in compiled code.
    for bit in reversed(range(buckets.bit_length())):
        reached = F.coalesce(F.get("_cuts", F.col("_bucket") + (2**bit - 1)) <= F.col("_v"), F.lit(False))
        put = put.select(*kept, "_v", "_cuts", (F.col("_bucket") + F.when(reached, 2**bit).otherwise(0)).alias("_bucket"))
    return put.select(*kept, "_v", "_bucket", F.coalesce(F.get("_cuts", F.col("_bucket") - 1) == F.col("_v"), F.lit(False)).alias("_cut"))


def bucketed(long: DataFrame, group: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """(long with _v, the range _bucket and whether _v is the cut point that begins it (_cut); a row for each _bucket and _cut with _n rows, _before and _all in the group).

    No group is ever one task. Cut points are approximate, which moves the borders of ranges and no result, but they differ each time
    they are made (sketches are merged in the order they arrive in): they are written, so that both tables have the same.
    """
    long = long.withColumn("_v", F.col("v") + F.lit(0.0))  # -0.0 is 0.0
    cuts = small(staged(cut_points(long, group, buckets), "cuts"), CUT_POINTS // buckets)
    put = in_ranges(long, cuts, group, buckets)
    # Rows at a cut point come before the others of its range.
    below = Window.partitionBy(*group).orderBy("_bucket", F.desc("_cut"))
    per = put.groupBy(*group, "_bucket", "_cut").agg(F.count(F.lit(1)).alias("_n"))
    per = per.select(*group, "_bucket", "_cut", "_n", (F.sum("_n").over(below) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("_all"))
    per = staged(per, "ranges")  # two rows per range
    return put, F.broadcast(per) if group == ["factor"] else small(per, COUNTS)


def _by_buckets(long: DataFrame, group: list[str], buckets: int) -> DataFrame:
    kept = long.columns
    put, per = bucketed(long, group, buckets)
    salt = F.when(F.col("_cut"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    inside = Window.partitionBy(*group, "_bucket", "_cut", "_salt").orderBy("_v")
    put = put.withColumn("_salt", salt).withColumn("_inside", F.rank().over(inside) - 1)
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    joined = put.alias("a").join(per.alias("b"), [*same, F.col("a._bucket") == F.col("b._bucket"), F.col("a._cut") == F.col("b._cut")])
    return joined.select(*[f"a.{c}" for c in kept], percent_rank_inc(F.col("_before") + F.col("_inside"), F.col("_all")).alias("p"))


def rank_long(long: DataFrame, universe_keys: Sequence[str] = (), strategy: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """long (.., factor, v) with p, the percentile rank of v in its universe and factor."""
    group = [*universe_keys, "factor"]
    strategy = strategy or ("window" if universe_keys else "buckets")
    if strategy == "window":
        return _by_window(long, group)
    if strategy == "buckets":
        return _by_buckets(long, group, buckets)
    raise ValueError(f"unknown strategy {strategy!r}")


def rank_table(rows: DataFrame, columns: dict[str, str], row_id: str, universe_keys: Sequence[str] = (), large: int | None = None) -> DataFrame:
    """(row_id, universe_keys, factor, v, p) over a written table, each universe by the plan that its size asks for."""
    large = LARGE if large is None else large
    ids, group = [row_id, *[k for k in universe_keys if k != row_id]], [*universe_keys, "factor"]
    if not universe_keys:
        n = rows.count()
        long = unpivot(rows, ids, columns)
        return _by_buckets(long, group, ranges_for(n)) if n > large else _by_window(long, group)
    sizes = staged(rows.groupBy(*universe_keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= large:
        return _by_window(unpivot(rows, ids, columns), group)
    hot = small(sizes.where(F.col("_n") > large).select(*[F.col(k).alias(f"_hot_{k}") for k in universe_keys]))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in universe_keys])
    dealt = _by_buckets(unpivot(rows.join(hot, same, "left_semi"), ids, columns), group, ranges_for(most))
    return dealt.unionByName(_by_window(unpivot(rows.join(hot, same, "left_anti"), ids, columns), group))


def rank_factors(df: DataFrame, columns: dict[str, str], inverted: dict[str, bool], defaults: dict[str, float], *, row_id: str = "_row_id", universe_keys: Sequence[str] = (), strategy: str | None = None, keep: Sequence[str] | None = None, large: int | None = None) -> DataFrame:
    """df with one score column per factor -> column of ``columns``.

    df is made once: its columns (those of ``keep`` if given, and what ranks need) are written, ranked in one pass for all
    factors, and joined by row id with the scores.
    """
    carried = list(dict.fromkeys([row_id, *universe_keys, *(df.columns if keep is None else keep)]))
    rows = staged(df.select(*dict.fromkeys([*carried, *columns.values()])), "ranked")
    if strategy:
        ranked = rank_long(unpivot(rows, [row_id, *[k for k in universe_keys if k != row_id]], columns), universe_keys, strategy)
    else:
        ranked = rank_table(rows, columns, row_id, universe_keys, large)
    return join_scores(rows, ranked, columns, inverted, defaults, row_id).select(*carried, *columns)


def join_scores(rows: DataFrame, ranked: DataFrame, columns: dict[str, str], inverted: dict[str, bool], defaults: dict[str, float], row_id: str = "_row_id") -> DataFrame:
    """rows with a score column per factor from ranked (row_id, factor, p)."""
    flip = F.col("factor").isin([f for f in columns if inverted[f]])
    scores = ranked.select(row_id, "factor", F.when(flip, 1 - F.col("p")).otherwise(F.col("p")).alias("p"))
    # Shuffled once as they are: partial results of scattered rows would be a row of all factors each.
    wide = scores.repartition(row_id).groupBy(row_id).agg(*[F.max(F.when(F.col("factor") == f, F.col("p"))).alias(f) for f in columns])
    joined = rows.join(wide, row_id, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f), F.lit(float(defaults[f]))).alias(f) for f in columns])
