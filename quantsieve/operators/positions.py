"""Places in an order, by universe, without any universe being one task.

Rows are range-partitioned and sorted by (universe, order) and written; a row's place is its number in its
partition plus what the universe has in earlier ones, which a table of one row per partition and universe says.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.sources.tables import small, staged


def positions(df: DataFrame, order: Sequence[str], universe_keys: Sequence[str] = ()) -> DataFrame:
    """df with pos (from 0, missing values first) in its universe by order, and n, the universe's size; rows equal in order are placed arbitrarily."""
    if clash := {"pos", "n", "_at", "_part"} & set(df.columns):
        raise ValueError(f"columns named like results: {', '.join(sorted(clash))}")
    keys = [*universe_keys, *order]
    spread = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    spread = spread.withColumn("_part", F.shiftright("_at", 33))
    runs = spread.groupBy(*universe_keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # A window over a universe holds one row for each partition that the universe reaches.
    whole = Window.partitionBy(*universe_keys)
    runs = runs.select(*universe_keys, "_part", "_first", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    same = [F.col("a._part") == F.col("b._part"), *(F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in universe_keys)]
    joined = spread.alias("a").join(small(staged(runs, "runs")).alias("b"), same)
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), F.col("b.n").alias("n"))


def tile(pos: Column, n: Column, tiles: int) -> Column:
    """The tile (from 1) of a place among n: as even as can be, larger ones first."""
    size, larger = F.floor(n / tiles), n % tiles
    head = larger * (size + 1)
    return (F.when(pos < head, F.floor(pos / (size + 1))).otherwise(larger + F.floor((pos - head) / F.greatest(size, F.lit(1)))) + 1).cast("int")
