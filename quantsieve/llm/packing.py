r"""Best-fit packing planned over a histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` ids; only their lengths matter to the
plan. ``plan_best_fit`` runs best-fit decreasing over (length, count) pairs, at most ``capacity`` of them
whatever the corpus holds, and plans slots: for a range of ranks within a length, the sequences and offsets
they go to. Pieces then take the slots by their rank within their length. Ranks are counted in salted parts
of a length, with the parts' sizes as offsets, so that a common length is no single task's work.

Defined results: a null or empty text is its end id alone; null ids and repeated rows are pieces like any
other (a repeated row takes a slot of its own); an empty table gives an empty table. Sequence ids run from 0.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.llm._shared import table
from quantsieve.llm.encoding import encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that are ranked together, about.
RANK_ROWS = 100_000


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, capacity: int = 4096, *, with_ids: bool = False, special_strings: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with_ids its ids (u32, little-endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, special_strings)
        for batch in batches:
            row = 0
            for ids, counts in enc.encode(batch.column("text")):
                ids, counts = with_end(ids, counts, end_id)
                pieces = np.maximum(-(-counts // capacity), 1)
                of = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[of] - start, capacity)
                lo = ((np.cumsum(counts) - counts)[of] + start) * 4
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                parts = [data[a:b] for a, b in zip(lo.tolist(), (lo + length * 4).tolist())]
                out = {"doc_id": batch.column("doc_id").take(pa.array(row + of)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(map(zlib.crc32, parts), pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(map(bytes, parts), pa.binary())} if with_ids else {}))
                row += len(counts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Slots: length, rank (first of a range), n (ranks), sequence (first), each (pieces of this length per sequence), offset (of a sequence's first).

    Best-fit decreasing: pieces go from long to short, each to the fullest sequence that still holds it. Equal
    sequences are kept as one (first id, count), so the work depends on the number of lengths alone.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # what is free in a sequence -> groups of such sequences
    levels: list[int] = []  # the keys of free, ascending
    slots, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not free[room]:
                bisect.insort(levels, room)
            free[room].append((first, n))

    for length in sorted((x for x in histogram if x), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(levels, length)
            if at < len(levels):
                room = levels[at]
                first, n = free[room].pop()
                if not free[room]:
                    levels.pop(at)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and 0 < left < each:
                slots.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room, first + full, n - full)
    return pd.DataFrame(slots, columns=["length", "rank", "n", "sequence", "each", "offset"]).astype("int64").sort_values(["length", "rank"], ignore_index=True)


def rank_in_length(pieces: DataFrame) -> DataFrame:
    """pieces with rank: 0, 1, ... within each length, without a task for a whole length."""
    per_length = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_qs_n"))
    most = per_length.agg(F.max("_qs_n")).first()[0] or 0
    salts = max(16, -(-most // RANK_ROWS))
    salted = pieces.withColumn("_qs_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_qs_salt").agg(F.count(F.lit(1)).alias("_qs_n"))
    before = Window.partitionBy("length").orderBy("_qs_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_qs_salt", F.coalesce(F.sum("_qs_n").over(before), F.lit(0)).alias("_qs_before"))
    placed = salted.withColumn("_qs_row", F.row_number().over(Window.partitionBy("length", "_qs_salt").orderBy("doc_id", "piece", "ids_crc32")))
    return placed.join(parts, ["length", "_qs_salt"]).withColumn("rank", F.col("_qs_before") + F.col("_qs_row") - 1).drop("_qs_salt", "_qs_row", "_qs_before")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (a table: it is read several times) with sequence_id and offset. Lengths lie from 1 to capacity."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must lie from 1 to {capacity}")
    slots = plan_best_fit(histogram, capacity)
    sent = pieces.sparkSession.sparkContext.broadcast({c: slots[c].to_numpy() for c in slots})  # at most a few rows for each of capacity lengths
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "rank")]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        key = s["length"] << 40 | s["rank"]
        for pdf in batches:
            at = np.searchsorted(key, pdf["length"].to_numpy() << 40 | pdf["rank"].to_numpy(), side="right") - 1
            k = pdf.pop("rank").to_numpy() - s["rank"][at]
            yield pdf.assign(sequence_id=s["sequence"][at] + k // s["each"][at], offset=s["offset"][at] + k % s["each"][at] * s["length"][at])

    ranked = rank_in_length(pieces.select(*names)).select(*names, "rank")
    types = dict(pieces.dtypes)
    return ranked.mapInPandas(take, ", ".join(f"`{c}` {types[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, capacity: int = 4096, *, with_ids: bool = False, special_strings: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of docs with the sequences and offsets they are packed at."""
    return pack(table(token_pieces(docs, tokenizer_path, end_id, capacity, with_ids=with_ids, special_strings=special_strings, doc_id=doc_id, text=text), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (u32, little-endian) of each sequence of a packing with ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("length"), ids.alias("ids"))
