"""What the operators share: word and case rules, and tables that cut lineage."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantsieve.sources.shared import new_path

#: The white space that separates words, as a regex class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a lookup table that is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
#: The same for tables of one 8-byte column: about 16 MB with their hash table.
KEY_ROWS = 500_000


def with_code(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f(spark, ...), with this package on the path of Python workers on the same machine; a cluster ships it by --py-files."""

    @wraps(f)
    def run(spark: SparkSession, *args) -> DataFrame:
        root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))
        return f(spark, *args)

    return run


def table(df: DataFrame, label: str) -> DataFrame:
    """Write df in the shared folder and read it again: later steps neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, label))
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; df must be cheap to count (a table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """c with A-Z, and nothing else, in lower case."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of c: what stands between white space."""
    return F.array_remove(F.split(c, SPACE + "+"), F.lit(""))
