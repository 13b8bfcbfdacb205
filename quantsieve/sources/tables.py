"""Stage tables as Parquet, published as wholes, and intermediate tables.

A save writes a version of its own beside what is there: ``<path>/<partition>/_v=<version>``. Only then a small manifest, which
says for each partition which version counts and what columns it has, is replaced in one rename. So a reader sees a
table as it was or as it will be, and a save that fails changes nothing. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantsieve.sources.shared import hadoop, new_path

MANIFEST = "_manifest.json"
#: Most rows of a lookup table that is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as an intermediate table: what reads it neither makes it again nor depends on lost executors."""
    df.write.parquet(path := new_path(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; df must be cheap to count (a table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def manifest(spark: SparkSession, path: str) -> dict | None:
    """{"parts": partition folder -> version, "schemas": version -> schema as JSON}; None if nothing is published."""
    p, fs = hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    jvm = spark.sparkContext._jvm
    draft, fs = hadoop(spark, f"{path}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    target = hadoop(spark, f"{path}/{MANIFEST}")[0]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, over)


def save(df: DataFrame, path: str, partition_by: str | Sequence[str] | None = None, observe: Mapping[str, Column] | None = None, replace: bool = False) -> dict:
    """Replace a stage; with partition_by, only the partitions that df holds, unless ``replace``. The values of ``observe``, aggregates over df taken as it is written."""
    spark, version, values = df.sparkSession, uuid.uuid4().hex, {}
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by or ())
    schema = df.schema
    if observe:
        watch = Observation()
        df = df.observe(watch, *[c.alias(name) for name, c in observe.items()])
    if keys:
        df.withColumn("_v", F.lit(version)).write.mode("append").partitionBy(*keys, "_v").parquet(path)
    else:
        df.write.parquet(f"{path}/_v={version}")
    if observe:
        values = watch.get
    root, fs = hadoop(spark, path)
    top = fs.resolvePath(root).toString().rstrip("/")
    written = fs.globStatus(hadoop(spark, "/".join([top, *["*"] * len(keys), f"_v={version}"]))[0]) or []
    parts = {f.getPath().getParent().toString()[len(top) :].strip("/"): version for f in written}
    old = manifest(spark, path) if keys and not replace else None
    old = old if old and old["keys"] == keys else None  # another layout replaces the whole
    parts = (old or {"parts": {}})["parts"] | parts
    schemas = ((old or {"schemas": {}})["schemas"]) | {version: schema.json()}
    _publish(spark, path, {"keys": keys, "parts": parts, "schemas": {v: schemas[v] for v in dict.fromkeys([*parts.values(), version])}})
    return values


def load(spark: SparkSession, path: str, *, empty: bool = False, only: Collection[str] | None = None) -> DataFrame | None:
    """A stage's table; None where there is none or, unless ``empty``, where it has no rows.

    only: names of partitions (such as as_of=2001-08-01); others are neither listed nor read. Versions of different width are read as one: columns that a version lacks are null.
    """
    if (found := manifest(spark, path)) is None:
        return None
    fields: dict[str, T.StructField] = {}
    for text in found["schemas"].values():
        fields |= {f.name: f for f in T.StructType.fromJson(json.loads(text)).fields}
    reader = spark.read.option("basePath", path).schema(T.StructType([*fields.values(), T.StructField("_v", T.StringType())]))
    parts = {part: v for part, v in found["parts"].items() if only is None or part in only}
    if not parts:
        return spark.createDataFrame([], T.StructType(list(fields.values()))) if empty else None
    df = reader.parquet(*["/".join(filter(None, (path, part, f"_v={v}"))) for part, v in parts.items()]).drop("_v")
    return df if empty or not df.isEmpty() else None


def partitions(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each published partition, by its name (such as as_of=2001-08-01)."""
    found = manifest(spark, path) or {"parts": {}}
    return {part: "/".join(filter(None, (path, part, f"_v={v}"))) for part, v in found["parts"].items()}


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the versions that count no longer, once no reader needs them; how many."""
    found = manifest(spark, path)
    if found is None:
        return 0
    root, fs = hadoop(spark, path)
    top, gone = fs.resolvePath(root).toString().rstrip("/"), 0
    live = {"/".join(filter(None, (top, part, f"_v={v}"))) for part, v in found["parts"].items()}
    for f in fs.globStatus(hadoop(spark, "/".join([top, *["*"] * len(found["keys"]), "_v=*"]))[0]) or []:
        if f.getPath().toString() not in live:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone
