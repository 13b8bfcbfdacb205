r"""Line deduplication across documents.

Lines are exploded with a normalised key (white space stripped at both ends, A-Z lower-cased), keys are
hashed, and for each hash the distinct documents are counted. Lines of a key found in at least
``min_docs`` documents go from every document but the one with the largest id; the others are joined
again by position.

Defined results: a null or empty text is one empty line; rows that repeat a document id count as one
document and are treated alike; rows without an id count for nothing and stay as they are; an empty
table gives an empty table. All input columns are kept; columns this operator adds replace those of
the same name, and names that begin with ``_qs_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import ascii_lower, table


#: The white space that a key loses at both ends.
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    """128 bits that stand for the key."""
    return F.unhex(F.md5(key))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``text`` less its repeated lines, and n_lines (before), n_dropped, both long."""

    def long_key(line: Column) -> Column:
        return F.when(F.length(line) >= min_chars, F.when(F.length(line_key(line)) >= min_chars, key_hash(line_key(line))))

    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n")
    # Rows of one id are told apart by their texts: a place is one in a text.
    places = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_qs_id"), F.xxhash64(whole).alias("_qs_text"), F.posexplode(F.transform(lines, long_key)).alias("_qs_place", "_qs_key"))
    places = table(places.where("_qs_key is not null"), "line-places")
    # A table of its own, so that the join below has a shuffle on either side and a common line's rows can be split.
    common = places.select("_qs_id", "_qs_key").distinct().groupBy("_qs_key").agg(F.count(F.lit(1)).alias("_qs_n"), F.max("_qs_id").alias("_qs_keeper")).where(F.col("_qs_n") >= min_docs)
    common = table(common.select("_qs_key", "_qs_keeper"), "common-lines")
    goes = places.join(common, "_qs_key").where("_qs_id <> _qs_keeper").groupBy("_qs_id", "_qs_text").agg(F.collect_set("_qs_place").alias("_qs_goes"))
    joined = docs.withColumn("_qs_whole", whole).join(goes, (F.col(doc_id) == F.col("_qs_id")) & (F.xxhash64("_qs_whole") == F.col("_qs_text")), "left").withColumn("_qs_lines", F.split("_qs_whole", "\n"))
    n, dropped = F.size("_qs_lines"), F.coalesce(F.size("_qs_goes"), F.lit(0))
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_qs_goes"))  # by a hash set, in order
    kept = F.array_join(F.transform(stays, lambda i: F.get("_qs_lines", i)), "\n")
    added = {text: F.when(F.col("_qs_goes").isNull(), F.col("_qs_whole")).otherwise(kept), "n_lines": n.cast("long"), "n_dropped": dropped.cast("long")}
    return joined.select(*[added[c].alias(c) if c in added else F.col(c) for c in docs.columns], *[added[c].alias(c) for c in added if c not in docs.columns])
