"""Upload files (CSV, all strings, vendor headers) into the typed raw table."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantsieve.functions.numeric import parse_number
from quantsieve.sources.schema import HEADERS, IDENTITY, MARKER_IS_ZERO, MISSING_MARKER
from quantsieve.sources.shared import hadoop
from quantsieve.sources.tables import load, save, small, staged


#: Columns whose numbers are parsed together.
PARSED = 20


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def list_uploads(spark: SparkSession, *folders: str) -> list[str]:
    """The CSV files of the folders, any case of extension, by name; an error names what can't be read, or that nothing is there."""
    names = []
    for folder in folders:
        path, fs = hadoop(spark, folder)
        names += [s.getPath().toString() for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
    if bad := [n for n in sorted(names) if not n.lower().endswith(".csv")]:
        raise ValueError(f"unsupported file type: {', '.join(bad)}")
    if not names:
        raise FileNotFoundError(f"no uploads in {', '.join(folders)}")
    return sorted(names)


def scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of one header as strings, with _source_file."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(list(paths))
    return df.withColumn("_source_file", F.input_file_name())


def _plain(path: str) -> str:
    """A path as Hadoop writes it, from a file's metadata, where it is an encoded URI."""
    return re.sub(r"^file:/+", "file:/", unquote(path))


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file (encoded URI), header (its first line), n_lines of every file that has a line, by one scan of text; no driver opens files."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = F.when(F.col("block") == 0, F.col("at"))  # lines of a block are read in order
    return lines.groupBy("file").agg(F.min_by("value", first).alias("header"), F.count(F.lit(1)).alias("n_lines"))


def by_header(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files by their header line. Spark aligns CSV columns by position, so only files of one header may be read together."""
    heads = {_plain(r["file"]): r["header"] for r in first_lines(spark, paths).select("file", "header").collect()}
    groups: dict[str, list[str]] = defaultdict(list)
    for name in paths:
        groups[(heads.get(_plain(name)) or "").lstrip("\ufeff").strip()].append(name)
    return dict(groups)


def columns_of(header: str) -> list[str]:
    return next(csv.reader([header]), [])


def missing(columns: Sequence[str], headers: Mapping[str, str] = HEADERS) -> list[str]:
    return [h for h in headers if h not in columns]


def missing_report(spark: SparkSession, paths: Sequence[str], headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """file, missing_column, n_lines (header included) for every required column that an upload lacks; files without any line lack all."""
    names = spark.createDataFrame([(_plain(p),) for p in paths], "file string")
    found = first_lines(spark, paths).withColumn("file", F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/"))
    heads = staged(names.join(found, "file", "left").select("file", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines")), "headers")
    kinds = [r["header"] for r in heads.select("header").distinct().collect()]  # layouts of uploads: a few
    lacks = [(h, m) for h in kinds for m in missing(columns_of(h.lstrip("\ufeff").strip()), headers)]
    return heads.join(small(spark.createDataFrame(lacks, "header string, missing_column string")), "header").select("file", "missing_column", "n_lines")


def check_columns(columns: Sequence[str], source: str, headers: Mapping[str, str] = HEADERS) -> None:
    if lacks := missing(columns, headers):
        raise KeyError(f"{source} lacks {len(lacks)} required columns: {', '.join(lacks)}")


def cleaned(df: DataFrame, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """Renamed and typed: identity columns stay text, all others, extra ones too, become doubles.

    Numbers are parsed in arrays of PARSED columns: parsing each in code of its own outgrows what Java compiles, and
    parsing all in one would parse columns that no one asks for.
    """
    out, numbers = {}, []
    for name in df.columns:
        target = headers.get(name, name)
        value = _col(name)
        if target != "_source_file":
            if target in MARKER_IS_ZERO:
                value = F.when(value == MISSING_MARKER, F.lit("0")).otherwise(value)
            value = F.nullif(value, F.lit(MISSING_MARKER))
        out[target] = value
        if target != "_source_file" and target not in IDENTITY:
            numbers.append(target)
    groups = [numbers[i : i + PARSED] for i in range(0, len(numbers), PARSED)]
    parsed = df.select(*[out[t].alias(t) for t in out if t not in numbers], *[F.transform(F.array(*[out[t] for t in g]), parse_number).alias(f"_numbers{k}") for k, g in enumerate(groups)])
    place = {t: F.get(f"_numbers{k}", F.lit(i)) for k, g in enumerate(groups) for i, t in enumerate(g)}
    return parsed.select(*[place[t].alias(t) if t in place else _col(t) for t in out])


def sort_out(spark: SparkSession, paths: Sequence[str], headers: Mapping[str, str] = HEADERS) -> tuple[DataFrame | None, dict[str, list[str]]]:
    """(all uploads that have the required columns, cleaned and united by column name; the columns that each other file lacks)."""
    united, bad = None, {}
    for header, files in by_header(spark, paths).items():
        if lacks := missing(columns_of(header), headers):
            bad |= dict.fromkeys(files, lacks)
            continue
        df = cleaned(scan(spark, files), headers)
        united = df if united is None else united.unionByName(df, allowMissingColumns=True)
    return united, bad


def ingest(spark: SparkSession, *folders: str, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """All uploads of the folders, checked file by file, cleaned, and united by column name; an error names every file that lacks columns."""
    united, bad = sort_out(spark, list_uploads(spark, *folders), headers)
    if bad:
        raise KeyError("; ".join(f"{name} lacks {len(lacks)} required columns: {', '.join(lacks)}" for name, lacks in bad.items()))
    return united


def ingest_to(spark: SparkSession, folder: str, path: str, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """Ingest into a stage table, with _row_id assigned once as it is written; the table read again."""
    save(ingest(spark, folder, headers=headers).withColumn("_row_id", F.monotonically_increasing_id()), path)
    return load(spark, path, empty=True)
