r"""A Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, the rows of a group make a tree, the groups' roots make a last one. A tree's nodes are labelled by (last
leaf below, level), an order in which children come before their parent. Going forward, each node sends its digest to its
parent through a priority queue ordered by label; a node is made when the sweep has passed its last leaf. Going back, from the
last label to the first, each node sends its proof (the siblings on its way to the root) to its children: their own siblings,
then that suffix.

The queue is external: a sweep is cut into bands of ``LEVELS`` levels, messages between bands are rows of a table, and
Spark's shuffle and sort deliver them to blocks of ARITY ** LEVELS neighbours in label order, spilling where they must. Only
messages within a block are in a heap, at most a few per level. So no tree, of whatever size, is in one task, and the driver
sees one number: the length of the longest group.

Places in a group are those of ``operators.positions``: counted over range partitions, by (order, leaf).

Defined results: a null group is a group of its own, the first; within a group a null order key comes first and equal ones
go by leaf digest, so rows that are alike in all fields are interchangeable; null fields count as ``-``, empty texts as ``0:``;
other columns, however named, are left out; an empty table has no rows and no root.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import table
from quantsieve.operators.positions import positions

#: Children of a node at most, and levels that one sweep over a block goes through.
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
_NODES = "grp string, pos long, n long, digest binary"
_PROOFS = "grp string, block long, sib binary, shape binary, subroot binary, root binary"
_RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(c: Column) -> Column:
    """A field as it is hashed: its UTF-8 length, a colon, its text; a dash for null."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def join_digests(parts: Iterable[bytes]) -> bytes:
    """The digest of a run of nodes, whose digests enter as hexadecimal text."""
    return sha256(b"".join(parts).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def forward(leaves: Iterable[tuple[int, bytes]], n: int, levels: int) -> Iterator[tuple[int, int, list[tuple[int, bytes]], bytes]]:
    """Nodes (level, place, children as (place, digest), digest) over neighbouring leaves (place, digest) of a tree of n, in label order."""
    queue: list[tuple[int, int, int, bytes]] = []  # (last leaf and level of the parent; the sender's place and digest)

    def send(level: int, place: int, digest: bytes) -> None:
        if level < levels:
            last = min((place // ARITY + 1) * ARITY ** (level + 1), n) - 1
            heapq.heappush(queue, (last, level + 1, place, digest))

    def due(at: int) -> Iterator[tuple[int, int, list[tuple[int, bytes]], bytes]]:
        while queue and queue[0][0] < at:
            label, got = queue[0][:2], []
            while queue and queue[0][:2] == label:
                got.append(heapq.heappop(queue)[2:])
            digest = join_digests(d for _, d in got)
            send(label[1], got[0][0] // ARITY, digest)
            yield label[1], got[0][0] // ARITY, got, digest

    for place, digest in leaves:
        yield from due(place)
        send(0, place, digest)
    yield from due(n)


def _block(pos: str = "pos") -> Column:
    return F.expr(f"{pos} div {BLOCK}")


def fold_up(nodes: DataFrame) -> DataFrame:
    """The nodes LEVELS above: one for each block of ``nodes``. A tree of one node stays as it is."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (grp, block, n), rows in groupby(_rows(batches, "grp", "block", "n", "pos", "digest"), key=lambda r: r[:3]):
            leaves = [(r[3], r[4]) for r in rows]
            top = leaves[0][1]
            for *_, top in forward(leaves, n, min(LEVELS, height(n))):
                pass  # a block's last node is its top
            out.append((grp, block, -(-n // BLOCK), top))
            if len(out) >= 4096:
                yield _batch(out, _NODES)
                out = []
        if out:
            yield _batch(out, _NODES)

    dealt = nodes.select("grp", _block().alias("block"), "n", "pos", "digest").repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return dealt.mapInArrow(fold, _NODES)


_ARROW = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW.get(t)) for c, (_, t) in zip(zip(*rows), named, strict=True)], [c for c, _ in named])


def backward(leaves: list[tuple[int, bytes]], n: int, levels: int, sib: bytes, shape: bytes) -> Iterator[tuple[bytes, bytes]]:
    """For each leaf its siblings up to the root, leaf first, and the shape of its way: for each level its place in the run and the run's length.

    sib and shape are those of the node on top. Nodes are taken from the last label to the first.
    """
    suffix: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    for level, place, children, _ in reversed(list(forward(leaves, n, levels))):
        rest, way = suffix.pop((level, place), (sib, shape))
        for i, (child, _) in enumerate(children):
            own = b"".join(d for j, (_, d) in enumerate(children) if j != i)
            suffix[level - 1, child] = own + rest, bytes((i * 16 + len(children),)) + way
    for place, _ in leaves:
        yield suffix.get((0, place), (sib, shape))


def refold(digest: bytes, sib: bytes, shape: bytes) -> bytes:
    """The root that a leaf's digest leads to."""
    at = 0
    for x in shape:
        i, size = divmod(x, 16)
        mid, end = at + 32 * i, at + 32 * (size - 1)
        digest, at = join_digests((sib[at:mid], digest, sib[mid:end])), end
    return digest


def _delivered(nodes: DataFrame, proofs: DataFrame, kept: Sequence[str], emit, schema: str) -> DataFrame:
    """emit(leaf row, sib, shape, subroot, root) for each node; a block's proof comes first in its queue, at place -1."""
    kept_types = dict(nodes.dtypes)
    down = proofs.select("grp", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), *[F.lit(None).cast(kept_types[c]).alias(c) for c in kept], "sib", "shape", "subroot", "root")
    up = nodes.select("grp", _block().alias("block"), "pos", "n", "digest", *kept, *[F.lit(None).cast("binary").alias(c) for c in ("sib", "shape", "subroot", "root")])
    queue = up.union(down).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    names = queue.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in groupby(_rows(batches, *names), key=lambda r: r[:2]):
            *_, sib, shape, subroot, root = next(rows)
            got = list(rows)
            n = got[0][3]
            ways = backward([(r[2], r[4]) for r in got], n, min(LEVELS, height(n)), sib, shape)
            out += [emit(dict(zip(names, r, strict=True)), *way, subroot, root) for r, way in zip(got, ways, strict=True)]
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return queue.mapInArrow(run, schema)


def _bands(nodes: DataFrame) -> list[DataFrame]:
    """nodes and the nodes above them, band by band, up to one for each group."""
    out, longest = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        out.append(table(fold_up(out[-1].select("grp", "pos", "n", "digest")), "nodes"))
        longest = -(-longest // BLOCK)
    return out


def _downwards(bands: list[DataFrame], proofs: DataFrame) -> DataFrame:
    """The proofs of the first band's blocks, from those of the last band's nodes."""
    for nodes in reversed(bands[1:-1]):
        proofs = table(_delivered(nodes, proofs, [], lambda r, *proof: (r["grp"], r["pos"], *proof), _PROOFS), "proofs")
    return proofs


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), *, group: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    tampered: fields as they are found later; folded_root is computed from them and the proof, and verified says whether it is the root.
    """
    found = {f: (tampered or {}).get(f, F.col(f)) for f in fields}
    differs = reduce(Column.__or__, [~F.col(f).eqNullSafe(c) for f, c in found.items() if f in (tampered or {})], F.lit(False))
    group_key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(F.col(order).alias("_id"), group_key.alias("grp"), leaf([F.col(f) for f in fields]).alias("digest"), F.when(differs, leaf(list(found.values()))).alias("now"))
    trees = _bands(positions(table(rows, "leaves"), ["_id", "digest"], ["grp"]))
    # The groups' roots, in order of their groups, as the leaves of a last tree.
    roots = trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    tops = _bands(positions(roots, ["name"], ["grp"]))
    empty = F.lit(b"").alias("sib"), F.lit(b"").alias("shape")
    start = tops[-1].select("grp", F.lit(0).cast("long").alias("block"), *empty, F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    named = _delivered(tops[0], _downwards(tops, start), ["name"], lambda r, sib, shape, _, root: (r["name"], 0, sib, shape, r["digest"], root), _PROOFS)

    def result(r: dict, sib: bytes, shape: bytes, subroot: bytes, root: bytes) -> tuple:
        folded = refold(r["now"] or r["digest"], sib, shape)
        return r["_id"], r["digest"].hex(), subroot.hex(), root.hex(), sha256(sib.hex().encode()).hexdigest(), folded.hex(), folded == root

    return _delivered(trees[0], _downwards(trees, table(named, "subroots")), ["_id", "now"], result, f"_id {dict(rows.dtypes)['_id']}, {_RESULT}").withColumnRenamed("_id", order)
