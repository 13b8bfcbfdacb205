r"""Ranked lexical search: the highest-scoring documents of an index for each of a set of items, exactly.

**Index.** Every document is indexed by the task that reads it, without a shuffle: a task gathers documents into segments of at
most ``SEGMENT_DOCS`` documents and about ``SEGMENT_BYTES`` of text, and writes for each segment a head row (ids and lengths
of its documents) and one row per term (places of the documents that hold it, and how often). Counts that
scores need of the whole corpus are sums over these rows.

**Search.** Items are taken in blocks of bounded size. A block's terms are broadcast with their weights and meet the index rows
of those terms; only these are dealt, by segment. A segment answers all items of the block by a hybrid of term-at-a-time
and document-at-a-time:

1. The item's short lists are summed into accumulators, term by term. From then on they are one iterator with one bound,
   the largest sum.
2. The long lists keep a bound each. Iterators whose bounds together stay below the item's k-th best score so far can't bring in
   a document on their own; the others name the candidates, which are taken in document order, a chunk at a time. Long lists that
   bring in none are only probed at candidates that can still reach the k-th best, the largest bound first, so that their other
   postings are skipped. The k-th best score rises from chunk to chunk and from segment to segment of a task.

A task returns its k best for each item, and one ranking by item keeps the k best of all. Nothing is estimated: a
document is passed over only where its bound is below the k-th best score (not where it is equal, as ties go by id).

The score is the contract's integer BM25: see ``contribution`` and ``weights``.

Defined results: terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case; null and empty
texts have none and are found by no item; items without a term that a document holds have no result; every row of
items is an item of its own and every row of docs a document of its own, repeated ids included; a null document id comes
first among equal scores; other columns are left out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.llm._shared import table

#: Documents, and about bytes of text, of a segment; bytes that are split into terms together.
SEGMENT_DOCS, SEGMENT_BYTES, RUN_BYTES = 16_384, 16_000_000, 4_000_000
#: Items, and about pairs of item and term, in a block of items.
BLOCK_ITEMS, BLOCK_PAIRS = 500, 200_000
#: Lists of at most this share of a segment's documents are short. Candidates that are scored together.
SHORT_SHARE, CHUNK = 1 / 16, 512
INDEX = "segment long, term string, n_docs long, n_terms long, docs binary, counts binary"
NULL_ID = -(2**63)

_bytes = np.arange(256)
_UPPER = (_bytes >= 0x41) & (_bytes <= 0x5A)
_IN_TERM = (_bytes >= 0x80) | ((_bytes >= 0x30) & (_bytes <= 0x39)) | _UPPER | ((_bytes >= 0x61) & (_bytes <= 0x7A))


def split_terms(b: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """(terms, the text that each is in) of the texts that begin at starts in b, UTF-8."""
    inside = _IN_TERM[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = starts[starts < len(b)]
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    letters = b[inside]
    letters = np.where(_UPPER[letters], letters + 32, letters).astype(np.uint8)
    offsets = np.append(np.cumsum(inside)[at] - 1, len(letters)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters)), np.searchsorted(starts, at, side="right") - 1


def _runs(texts: pa.Array) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """(terms, text of each) run after run; a run ends with a text, or in a long one where no term is cut."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, stop = int(ends[0]), int(ends[-1])
    while at < stop:
        to = min(stop, at + RUN_BYTES)
        last = int(ends[np.searchsorted(ends, to, side="right") - 1])
        if to < stop and last > at:
            to = last
        elif to < stop:
            gaps = np.flatnonzero(~_IN_TERM[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                end = int(ends[np.searchsorted(ends, at, side="right")])
                gaps = np.flatnonzero(~_IN_TERM[data[to:end]])
                to = to + int(gaps[0]) if len(gaps) else end
        low = int(np.searchsorted(ends, at, side="right")) - 1
        high = int(np.searchsorted(ends, to, side="left"))
        terms, which = split_terms(data[at:to], np.maximum(ends[low:high] - at, 0))
        yield terms, which + low
        at = to


class _Segment:
    """Postings of documents until they are written."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.bytes = 0
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, terms: pa.StringArray, docs: np.ndarray) -> None:
        """Terms of one run, each in the document of that place in the segment."""
        if len(terms):
            coded = terms.dictionary_encode()
            n = int(docs.max()) + 1
            keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * n + docs, return_counts=True)
            self.parts.append((coded.dictionary, keys // n, keys % n, counts))

    def rows(self, name: int) -> pa.RecordBatch:
        n_docs = len(self.ids)
        words = pa.concat_arrays([p[0] for p in self.parts]) if self.parts else pa.array([], pa.string())
        coded = words.dictionary_encode()
        codes, at = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *(len(p[0]) for p in self.parts)])
        keys = np.concatenate([np.zeros(0, np.int64), *(codes[p[1] + lo] * n_docs + p[2] for p, lo in zip(self.parts, at))])
        counts = np.concatenate([np.zeros(0, np.int64), *(p[3] for p in self.parts)])
        keys, back = np.unique(keys, return_inverse=True)  # a long text may stand in several runs
        counts = np.bincount(back, counts, len(keys)).astype(np.int64)
        docs, terms = keys % n_docs, keys // n_docs
        bounds = np.searchsorted(terms, np.arange(len(coded.dictionary) + 1))
        lengths = np.bincount(docs, counts, n_docs).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(counts)))[bounds]

        def binary(head: np.ndarray, values: np.ndarray) -> pa.Array:
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(values.astype("<u4"))])
            return pa.concat_arrays([pa.array([head.tobytes()], pa.binary()), lists])

        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(bounds), name), pa.int64()),
                pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary]),
                pa.array(np.append(np.count_nonzero(lengths), np.diff(bounds)), pa.int64()),
                pa.array(np.append(counts.sum(), np.diff(sums)), pa.int64()),
                binary(np.array(self.ids, "<i8"), docs),
                binary(lengths.astype("<i8"), counts),
            ],
            ["segment", "term", "n_docs", "n_terms", "docs", "counts"],
        )


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows of docs, as a table: heads of segments (term is null), and postings."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, made = _Segment(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_string()).fill_null(""), 0
            sizes = np.diff(np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1])
            while at < len(ids):
                room = np.searchsorted(np.cumsum(sizes[at:]), SEGMENT_BYTES - segment.bytes, side="right")
                n = min(max(int(room), 0 if segment.ids else 1), SEGMENT_DOCS - len(segment.ids), len(ids) - at)
                for terms, which in _runs(texts.slice(at, n)):
                    segment.add(terms, which + len(segment.ids))
                segment.ids += ids[at : at + n]
                segment.bytes += int(sizes[at : at + n].sum())
                at += n
                if at < len(ids):  # the next document doesn't fit
                    yield segment.rows(made)
                    segment, made = _Segment(), made + 1
        if segment.ids:
            yield segment.rows(made)

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
    return table(rows.mapInArrow(index, INDEX), "index")


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, repeats) as a table; item numbers the rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, which in _runs(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(which)), batch.column("item_id").take(pa.array(which)), terms], ["item", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["item_id"]
    return table(rows.mapInArrow(split, f"item long, item_id {kind}, term string").groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("repeats")), "items")


def weights(n_docs: int, df: Column) -> Column:
    """A term's weight by the number of documents that hold it."""
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1))).cast("long")


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that stands tf times brings in, before its weight; m: the document's length factor."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Postings:
    """One term's list in a segment: places in ascending order, and what the term brings in there, for a weight of 1."""

    def __init__(self, places: np.ndarray, brings: np.ndarray) -> None:
        self.places, self.brings, self.most = places, brings, int(brings.max())


def search_segment(lists: list[tuple[Postings, int]], ids: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of ``top`` and the documents of lists, each with its weight in the item."""
    scores, found = top
    limit, floor = SHORT_SHARE * len(ids), 1
    each = [(p, w) for p, w in lists if len(p.places) > limit]
    # Term at a time: one iterator for all short lists.
    if short := [(p, w) for p, w in lists if len(p.places) <= limit]:
        places, back = np.unique(np.concatenate([p.places for p, _ in short]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, back, np.concatenate([p.brings * w for p, w in short]))
        each.append((Postings(places, sums), 1))
        if len(sums) >= k:  # so many documents reach the k-th largest sum at least
            floor = max(floor, int(np.partition(sums, -k)[-k]))
    each.sort(key=lambda x: x[0].most * x[1])
    bounds = np.cumsum([p.most * w for p, w in each])  # of an iterator and all lesser ones together
    after = -1
    while True:
        # Documents that only lesser iterators hold can't reach the k-th best score.
        least = max(floor, int(scores[-1])) if len(scores) == k else floor
        lesser = int(np.searchsorted(bounds, least, side="left"))
        ahead = [p.places[np.searchsorted(p.places, after, side="right") :][:CHUNK] for p, _ in each[lesser:]]
        chunk = np.unique(np.concatenate([np.zeros(0, np.int64), *ahead]))[:CHUNK]
        if not len(chunk):
            return scores, found
        after = int(chunk[-1])
        sums, alive = np.zeros(len(chunk), np.int64), np.arange(len(chunk))
        for i in range(len(each) - 1, -1, -1):
            if i < lesser:  # only candidates that can still get there
                alive = alive[sums[alive] + bounds[i] >= least]
                if not len(alive):
                    break
            (p, w), asked = each[i], chunk[alive]
            at = np.minimum(np.searchsorted(p.places, asked), len(p.places) - 1)
            hit = p.places[at] == asked
            sums[alive[hit]] += p.brings[at[hit]] * w
        alive = alive[sums[alive] >= least]
        if len(alive):
            scores, found = best(np.concatenate([scores, sums[alive]]), np.concatenate([found, ids[chunk[alive]]]), k)


def search(index: DataFrame, items: DataFrame, k: int, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by doc_id."""
    spark = index.sparkSession
    n_docs, n_terms = index.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = _item_terms(items, item_id, text)
    kind = dict(asked.dtypes)["item_id"]
    if not n_docs:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long").withColumnRenamed("item_id", item_id)
    heads, postings = index.where("term is null"), index.where("term is not null")
    df = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weighted = table(asked.join(df, "term").select("item", "item_id", "term", (F.col("repeats") * weights(n_docs, F.col("df"))).alias("w")).where("w > 0"), "weights")
    n_items, n_pairs = weighted.agg(F.count_distinct("item"), F.count(F.lit(1))).first()
    n_blocks = max(-(-n_items // BLOCK_ITEMS), -(-n_pairs // BLOCK_PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        names = ["segment", "docs", "counts", "asking", "ws"]
        for _, rows in groupby((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True)), key=lambda r: r[0]):
            _, docs, counts, *_ = next(rows)  # the head
            ids, lengths = np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i8")
            m = 100 - 25 + (25 * lengths * n_docs) // n_terms
            lists: dict[int, list[tuple[Postings, int]]] = {}
            for _, docs, counts, asking, ws in rows:
                places = np.frombuffer(docs, "<u4").astype(np.int64)
                postings_of = Postings(places, contribution(np.frombuffer(counts, "<u4").astype(np.int64), m[places]))
                for item, w in zip(asking, ws, strict=True):
                    lists.setdefault(item, []).append((postings_of, w))
            for item, found in lists.items():
                tops[item] = search_segment(found, ids, tops.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64))), k)
        for item, (scores, ids) in tops.items():
            yield pa.RecordBatch.from_pydict({"item": pa.array(np.full(len(ids), item)), "doc_id": pa.array(ids), "score": pa.array(scores)})

    found = None
    for i in range(n_blocks):
        block = weighted.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("item", "w"))).alias("x"))
        hits = postings.join(F.broadcast(block), "term").select("segment", "term", "docs", "counts", F.col("x.item").alias("asking"), F.col("x.w").alias("ws"))
        none = F.lit(None).cast("array<long>")
        dealt = hits.union(heads.select("segment", "term", "docs", "counts", none, none)).repartition("segment").sortWithinPartitions("segment", "term")
        part = dealt.mapInArrow(run, "item long, doc_id long, score long")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) if found is not None else spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    named = ranked.join(weighted.select("item", "item_id").distinct(), "item")
    return named.select(F.col("item_id").alias(item_id), "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
