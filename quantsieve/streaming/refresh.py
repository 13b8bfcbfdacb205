"""Take up new files and re-score the snapshots they touch.

Ranks are relative to a whole universe, so a new row moves all scores of its snapshot: each micro-batch is
added to the raw table and the snapshots that it touches are scored again as wholes. Both tables are published
as wholes (``tables.save``), so readers never meet half a batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantsieve.functions.metrics import with_metrics
from quantsieve.operators import rank_index
from quantsieve.operators.ranking import join_scores
from quantsieve.operators.scoring import finished, scored_universe
from quantsieve.sources.schema import HEADERS, INVERTED, METRIC_OF, check_config, default_config
from quantsieve.sources.tables import load, manifest, save
from quantsieve.sources.uploads import sort_out

#: The date in an upload's path that says which snapshot it belongs to.
SNAPSHOT = r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"
#: Files in one micro-batch, at most.
FILES = 1000
_FINDING = "file string, finding string, subject string"


def rescore(spark: SparkSession, raw_path: str, scored_path: str, as_ofs: Sequence[date], config: dict | None = None) -> None:
    """Score the snapshots named in as_ofs and replace them, and no others, in the scored table; only their partitions of the raw table are read."""
    touched = load(spark, raw_path, empty=True).where(F.col("as_of").isin(list(as_ofs)))
    save(scored_universe(with_metrics(touched), config, universe_keys=["as_of"]), scored_path, "as_of")


def rescore_late(spark: SparkSession, raw_path: str, scored_path: str, index_path: str, batch_id: int, as_ofs: Sequence[date], config: dict | None = None) -> None:
    """As ``rescore``, with an index of ranks for each snapshot: only the value ranges that the batch's rows fall in are ranked again."""
    config, raw, scored = check_config(config or default_config()), load(spark, raw_path, empty=True), None
    for day in as_ofs:  # snapshots in one batch
        at, rows = f"{index_path}/{day}", with_metrics(raw.where(F.col("as_of") == F.lit(day)))
        if manifest(spark, f"{at}/counts") is None:
            rank_index.build(at, rows, METRIC_OF)
        else:
            rank_index.add(at, rows.where(F.col("batch") == batch_id), METRIC_OF)
        part = finished(join_scores(rows, rank_index.ranks(spark, at), METRIC_OF, INVERTED, config["defaults"]), config)
        scored = part if scored is None else scored.unionByName(part)
    save(scored, scored_path, "as_of")


def _take_up(rows: DataFrame, batch_id: int, raw_path: str, scored_path: str, config: dict | None, index_path: str | None = None) -> None:
    """Add a batch's rows; one that is run again after a failure replaces what it wrote before."""
    spark = rows.sparkSession
    save(rows.withColumn("batch", F.lit(batch_id)), raw_path, ("as_of", "batch"))
    days = [r["as_of"] for r in load(spark, raw_path, empty=True).where(F.col("batch") == batch_id).select("as_of").distinct().collect()]  # snapshots in one batch
    if days and index_path:
        rescore_late(spark, raw_path, scored_path, index_path, batch_id, days, config)
    elif days:
        rescore(spark, raw_path, scored_path, days, config)


def refresh(spark: SparkSession, incoming: str, schema: str, raw_path: str, scored_path: str, checkpoint: str, config: dict | None = None, index_path: str | None = None) -> StreamingQuery:
    """Take up all Parquet files that are new in ``incoming`` (rows with as_of and _row_id), then stop; with index_path by ``rescore_late``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(incoming)
    take = lambda batch, batch_id: _take_up(batch, batch_id, raw_path, scored_path, config, index_path)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_uploads(spark: SparkSession, incoming: str, raw_path: str, scored_path: str, quarantine_path: str, checkpoint: str, config: dict | None = None, *, headers: Mapping[str, str] = HEADERS, snapshot: str = SNAPSHOT, files: int = FILES, index_path: str | None = None) -> StreamingQuery:
    """Take up all CSV uploads that are new in ``incoming`` or its folders, then stop.

    An upload's snapshot is the date in its path. Files of a micro-batch are grouped by header and checked one by one:
    those that lack required columns, have no date, or are no CSV go to the quarantine table (file, finding, subject,
    batch) and stop neither the others nor the stream. Rows of the rest are cleaned, numbered and added to the raw table.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").collect())  # at most ``files``
        csv = [p for p in paths if p.lower().endswith(".csv")]
        found = [(p, "unsupported", "") for p in paths if p not in csv]
        dated = spark.createDataFrame([(p,) for p in csv], "path string").where(F.regexp_extract("path", snapshot, 1).try_cast("date").isNotNull())
        good = {r["path"] for r in dated.collect()}
        found += [(p, "no_date", "") for p in csv if p not in good]
        if good:
            rows, bad = sort_out(spark, [p for p in csv if p in good], headers)
            found += [(p, "missing_column", c) for p, lacks in bad.items() for c in lacks]
            if rows is not None:
                as_of = F.regexp_extract("_source_file", snapshot, 1).cast("date")
                numbered = rows.withColumns({"as_of": as_of, "_row_id": F.concat_ws("-", F.lit(batch_id), F.monotonically_increasing_id())})
                _take_up(numbered, batch_id, raw_path, scored_path, config, index_path)
        if found:
            save(spark.createDataFrame(found, _FINDING).withColumn("batch", F.lit(batch_id)), quarantine_path, "batch")

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(incoming)
    # Only the files' names are read here; their lines are read by the jobs of sort_out.
    return stream.select("path").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
