"""Connected components by alternating large-star and small-star steps.

Large-star: every node hands each larger neighbour to the smallest node of its neighbourhood. Small-star:
every node hands its smaller neighbours and itself to the smallest of them. Each step turns E links into at
most E, and together they end in one star per component. A step is a grouped minimum (combined before the
shuffle, so a hub costs one row per task) and a join on the node, in which every node's links are dealt to SALTS
parts by their other end and its minimum is sent to each; no node's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import table


#: Parts that the links of a node are dealt to.
SALTS = 16


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with m, the least neighbour of u."""
    salted = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    sent = least.withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    # Copies compress so well that their size would be taken for one to broadcast.
    return salted.join(sent.hint("merge"), ["u", "s"]).drop("s")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links that isn't its component's smallest; root is the smallest.

    Rounds go on until nothing moves. Each round is written to the shared folder, which cuts lineage.
    Links of a node to itself or to null say nothing. No links give an empty table.
    """
    now = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = table(now, "links")
    last = None
    for _ in range(max_rounds):
        now = table(_small_star(_large_star(now)).distinct(), "stars")
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
