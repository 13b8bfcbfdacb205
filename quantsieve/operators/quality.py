"""Reports on the data itself: null rates, counts, missing columns, outliers, changes between snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantsieve.operators.ranking import LARGE, bucketed, ranges_for, unpivot
from quantsieve.sources.tables import partitions, save, small, staged

NULL_LIMIT, SIZE_CHANGE_LIMIT = 0.10, 0.05


def null_rates(df: DataFrame, limit: float = NULL_LIMIT, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, null_rate of the columns with a rate above limit: one aggregate over all."""
    columns = list(columns or df.columns)
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.select(F.lit(0).alias("_"), "*").unpivot(["_"], columns, "column_name", "null_rate").where(F.col("null_rate") > limit).select("column_name", "null_rate")


def counts(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def missing_columns(df: DataFrame, required: Iterable[str], source: str) -> DataFrame:
    """source, missing_column for each required column that df lacks."""
    lacks = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([(source, c) for c in lacks], "source string, missing_column string")


def snapshot_report(df: DataFrame, fields: Sequence[str], as_of: str = "as_of", null_limit: float = NULL_LIMIT, size_limit: float = SIZE_CHANGE_LIMIT) -> DataFrame:
    """as_of, finding, subject, value: key fields with many nulls, and universes whose size moved, for each snapshot."""
    per = df.groupBy(as_of).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in fields])
    nulls = per.unpivot([as_of], list(fields), "subject", "value").where(F.col("value") > null_limit).select(as_of, F.lit("null_rate").alias("finding"), "subject", "value")
    before = F.lag("_n").over(Window.orderBy(as_of))  # one row per snapshot
    moved = per.withColumn("value", F.col("_n") / before - 1).where(F.abs("value") > size_limit)
    return nulls.union(moved.select(as_of, F.lit("size_change"), F.lit("universe"), "value"))


def quantiles(rows: DataFrame, columns: Sequence[str], qs: Sequence[float], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """keys, column_name, q, value: the exact quantiles of the columns of a written table, each the least value with a share of at least q up to it.

    By selection, in bounded memory: beyond LARGE rows, counts of value ranges tell the range that holds a quantile's rank, and only that range's
    rows are ordered. A value common enough to fill a range is known from the counts alone.
    """
    ids, group = list(keys) or ["_"], [*keys, "factor"]
    source = rows if keys else rows.withColumn("_", F.lit(0))
    long = unpivot(source, ids, {c: c for c in columns}).select(*keys, "factor", "v")
    n = rows.count()
    put, per = bucketed(long, group, ranges or (ranges_for(n) if n > LARGE else 1))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.ceil(F.lit(float(q)) * F.col("_all")).alias("rank")) for q in qs]))
    asked = per.select("*", wanted.alias("w")).where("_before < w.rank and w.rank <= _before + _n").select(*group, "_bucket", "_cut", "w.q", (F.col("w.rank") - F.col("_before")).alias("_place"))
    asked = staged(asked, "asked")  # a row for each quantile, column and key
    same = [F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`")) for g in [*group, "_bucket", "_cut"]]
    near = put.alias("a").join(small(asked).alias("b"), same).select(*[F.col(f"a.`{g}`") for g in group], F.col("a._v").alias("value"), F.col("b._cut").alias("_cut"), "q", "_place")
    cut = near.where("_cut").groupBy(*group, "q").agg(F.min("value").alias("value"))
    place = F.row_number().over(Window.partitionBy(*group, "q").orderBy("value"))
    inside = near.where("not _cut").withColumn("_at", place).where("_at = _place").select(*group, "q", "value")
    return cut.unionByName(inside).withColumnRenamed("factor", "column_name")


def outliers(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), reach: float = 3.0, ranges: int | None = None) -> DataFrame:
    """column_name, low, high, n_outliers: values beyond reach interquartile ranges from the quartiles, which are exact."""
    rows = staged(df.select(*keys, *columns), "measured")
    group = [*keys, "column_name"]
    q = staged(quantiles(rows, columns, [0.25, 0.75], keys, ranges), "quantiles").groupBy(*group).pivot("q", [0.25, 0.75]).agg(F.first("value")).toDF(*group, "_a", "_b")
    width = F.col("_b") - F.col("_a")
    fences = q.select(*group, (F.col("_a") - reach * width).alias("low"), (F.col("_b") + reach * width).alias("high"))
    ids = list(keys) or ["_"]
    long = unpivot(rows if keys else rows.withColumn("_", F.lit(0)), ids, {c: c for c in columns}).withColumnRenamed("factor", "column_name")
    outside = (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
    same = [F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`")) for g in group]
    met = long.alias("a").join(fences.alias("b"), same)
    return met.groupBy(*[F.col(f"a.`{g}`") for g in group], "low", "high").agg(F.count_if(outside).alias("n_outliers"))


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """finding, subject, before, after: columns added, lost or of another type since the snapshot before, and the column counts where those differ.

    It looks at the schemas alone and reads no rows.
    """
    old, new = dict(before.dtypes), dict(after.dtypes)
    rows = [("added" if c not in old else "lost" if c not in new else "type", c, old.get(c), new.get(c)) for c in dict.fromkeys([*old, *new]) if old.get(c) != new.get(c)]
    if len(old) != len(new):
        rows.append(("column_count", "universe", str(len(old)), str(len(new))))
    return after.sparkSession.createDataFrame(rows, "finding string, subject string, before string, after string")


def schema_history(spark: SparkSession, path: str) -> DataFrame:
    """snapshot, ordinal, column_name, type, n_rows of every column of the snapshots of a stage, from the footers of their Parquet files."""
    rows = []
    for part, folder in sorted(partitions(spark, path).items()):  # snapshots
        found = spark.read.parquet(folder)
        n = found.count()  # the footers say it
        rows += [(part.partition("=")[2], i, f.name, f.dataType.simpleString(), n) for i, f in enumerate(found.schema.fields)]
    return spark.createDataFrame(rows, "snapshot string, ordinal int, column_name string, type string, n_rows long")


def schema_findings(history: DataFrame) -> DataFrame:
    """snapshot, finding, subject, before, after, n_rows: columns added, lost or of another type since the snapshot before, and column counts where those differ."""
    per = history.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.first("n_rows").alias("n_rows"))
    order = Window.orderBy("snapshot")  # one row per snapshot
    steps = per.select("snapshot", "n", "n_rows", F.lag("snapshot").over(order).alias("earlier"), F.lag("n").over(order).alias("n_before")).where("earlier is not null")
    now = steps.join(history.select("snapshot", "column_name", F.col("type").alias("after")), "snapshot").select("snapshot", "column_name", "after")
    then = steps.join(history.select(F.col("snapshot").alias("earlier"), "column_name", F.col("type").alias("before")), "earlier").select("snapshot", "column_name", "before")
    both = now.join(then, ["snapshot", "column_name"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    finding = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "lost").otherwise("type")
    changed = both.join(per.select("snapshot", "n_rows"), "snapshot").select("snapshot", finding.alias("finding"), F.col("column_name").alias("subject"), "before", "after", "n_rows")
    sizes = steps.where("n <> n_before").select("snapshot", F.lit("column_count").alias("finding"), F.lit("universe").alias("subject"), F.col("n_before").cast("string").alias("before"), F.col("n").cast("string").alias("after"), "n_rows")
    return changed.unionByName(sizes)


@dataclass(frozen=True)
class Profile:
    """What a stage's write has seen of its rows: no further pass over them."""

    n_rows: int
    n_columns: int
    nulls: dict[str, int]
    bounds: dict[str, tuple]

    def null_rates(self, spark: SparkSession, limit: float = NULL_LIMIT) -> DataFrame:
        """column_name, null_rate of the columns with a rate above limit."""
        rates = [(c, n / self.n_rows) for c, n in self.nulls.items() if self.n_rows]
        return spark.createDataFrame([r for r in rates if r[1] > limit], "column_name string, null_rate double")

    def counts(self, spark: SparkSession) -> DataFrame:
        """One row: n_rows, n_columns."""
        return spark.createDataFrame([(self.n_rows, self.n_columns)], "n_rows long, n_columns int")

    def bounds_table(self, spark: SparkSession) -> DataFrame:
        """One row: the least and largest value of each bounded column."""
        names = [f"{side}_{c}" for c in self.bounds for side in ("min", "max")]
        return spark.createDataFrame([tuple(v for pair in self.bounds.values() for v in pair)], ", ".join(f"{n} double" for n in names))


def save_profiled(df: DataFrame, path: str, *, columns: Sequence[str] | None = None, bounded: Sequence[str] = ("market_cap", "overall_score"), partition_by: str | Sequence[str] | None = None) -> Profile:
    """Save a stage and observe, in the same pass, its row count, the nulls of columns, and the bounds of those of ``bounded`` that it has."""
    columns = list(columns or df.columns)
    bounded = [c for c in bounded if c in df.columns]
    watch = {"rows": F.count(F.lit(1))}
    watch |= {f"null_{i}": F.count_if(F.col(c).isNull()) for i, c in enumerate(columns)}
    watch |= {f"{f.__name__}_{c}": f(F.col(c).cast("double")) for c in bounded for f in (F.min, F.max)}
    seen = save(df, path, partition_by, observe=watch)
    return Profile(seen["rows"], len(df.columns), {c: seen[f"null_{i}"] for i, c in enumerate(columns)}, {c: (seen[f"min_{c}"], seen[f"max_{c}"]) for c in bounded})
