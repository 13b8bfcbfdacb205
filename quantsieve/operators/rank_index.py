"""An order-statistics index of one universe, so that late rows re-rank only the value ranges they fall in.

A rank is the count of values below it over n - 1. A late row moves n and the counts below all larger values, but the order inside
a range of values stays as it is unless the row falls into it. So the index keeps, for each metric,

* cut points, set when the index is first built,
* slots: the rows of one range of one metric, with their rank inside it, each slot a partition of its own (rows at a
  cut point, which may be very common, are in a slot apart, where all rank alike),
* the count of each slot.

``add`` reads and ranks the slots that new rows fall in, and no others, and replaces their counts. Ranks are slot rank plus
the counts of slots before: a join with a small table, without any sort. The row ids of a batch that is added
again after a failure replace themselves. Slots grow as rows come; ``build`` sets new cut points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantsieve.operators.ranking import cut_points, in_ranges, percent_rank_inc, ranges_for, unpivot
from quantsieve.sources.tables import load, save, staged

_COUNTS = "slot int, factor string, _bucket int, _cut boolean, n long"


def _slots(spark: SparkSession, path: str, rows: DataFrame, columns: dict[str, str], row_id: str) -> DataFrame:
    """(row_id, factor, v, _bucket, _cut, slot) of rows by the index's cut points."""
    cuts = load(spark, f"{path}/cuts", empty=True)
    ranges = cuts.agg(F.max(F.size("_cuts"))).first()[0] or 0
    long = unpivot(rows, [row_id], columns).withColumn("_v", F.col("v") + F.lit(0.0))
    put = in_ranges(long, cuts, ["factor"], ranges + 1)
    number = F.create_map(*[F.lit(x) for i, f in enumerate(sorted(columns)) for x in (f, i)])[F.col("factor")]
    slot = (number * (ranges + 1) + F.col("_bucket")) * 2 + F.when(F.col("_cut"), 0).otherwise(1)
    return put.select(row_id, "factor", F.col("_v").alias("v"), "_bucket", "_cut", slot.cast("int").alias("slot"))


def _ranked(rows: DataFrame) -> DataFrame:
    inside = F.rank().over(Window.partitionBy("slot").orderBy("v")) - 1
    return rows.where("not _cut").withColumn("inside", inside).unionByName(rows.where("_cut").withColumn("inside", F.lit(0)))


def _count(spark: SparkSession, path: str, slots: Sequence[int]) -> DataFrame:
    """Counts of some slots as they are stored now: the footers and dictionaries of their files."""
    found = load(spark, f"{path}/slots", empty=True, only={f"slot={s}" for s in slots})
    return found.groupBy("slot", "factor", "_bucket", "_cut").agg(F.count(F.lit(1)).alias("n"))


def build(path: str, rows: DataFrame, columns: dict[str, str], row_id: str = "_row_id", ranges: int | None = None) -> None:
    """Index the metrics factor -> column of all rows, by cut points of their own."""
    spark = rows.sparkSession
    rows = staged(rows.select(row_id, *dict.fromkeys(columns.values())), "indexed")
    long = unpivot(rows, [row_id], columns).withColumn("_v", F.col("v") + F.lit(0.0))
    found = cut_points(long, ["factor"], ranges or ranges_for(rows.count()))
    every = spark.createDataFrame([(f,) for f in columns], "factor string")  # a metric may have no value yet
    save(every.join(found, "factor", "left").select("factor", F.coalesce("_cuts", F.array().cast("array<double>")).alias("_cuts")), f"{path}/cuts")
    save(_ranked(_slots(spark, path, rows, columns, row_id)), f"{path}/slots", "slot", replace=True)
    counts = load(spark, f"{path}/slots", empty=True).groupBy("slot", "factor", "_bucket", "_cut").agg(F.count(F.lit(1)).alias("n"))
    save(counts, f"{path}/counts")


def add(path: str, rows: DataFrame, columns: dict[str, str], row_id: str = "_row_id") -> list[int]:
    """Add rows to the index; the slots they fell in, which alone were read and written."""
    spark = rows.sparkSession
    new = staged(_slots(spark, path, rows, columns, row_id), "late")
    touched = sorted(r["slot"] for r in new.select("slot").distinct().collect())  # of the index's slots
    if not touched:
        return []
    merged = new
    old = load(spark, f"{path}/slots", only={f"slot={s}" for s in touched})
    if old is not None:
        merged = old.drop("inside").join(new.select(row_id, "slot"), [row_id, "slot"], "left_anti").unionByName(new)
    save(_ranked(merged), f"{path}/slots", "slot")
    kept = load(spark, f"{path}/counts", empty=True).where(~F.col("slot").isin(touched))
    save(staged(kept.unionByName(_count(spark, path, touched)), "counts"), f"{path}/counts")
    return touched


def ranks(spark: SparkSession, path: str, row_id: str = "_row_id") -> DataFrame:
    """(row_id, factor, v, p) of all rows of the index."""
    order = Window.partitionBy("factor").orderBy("_bucket", F.desc("_cut"))  # two rows per range
    counts = load(spark, f"{path}/counts", empty=True)
    before = counts.select("slot", (F.sum("n").over(order) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy("factor")).alias("_all"))
    found = load(spark, f"{path}/slots", empty=True).join(F.broadcast(before), "slot")
    return found.select(row_id, "factor", "v", percent_rank_inc(F.col("_before") + F.col("inside"), F.col("_all")).alias("p"))
