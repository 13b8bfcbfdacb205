r"""MinHash near-duplicate detection.

1. ``sketches``: each text becomes the set of its k-word shingles (64-bit hashes), from which come a key of
   the whole set, many minima of universal hashes a*x+b, and their bands.
2. Rows with equal sets are one node, that of their smallest id. Nodes that share a band are candidates.
   Bands and rows are chosen so that a pair at the threshold shares none with a probability of 1e-6 at most.
3. Candidates are gathered into candidate groups by connected components; a group that is large is dealt
   into blocks by hash, and pairs of blocks go to tasks of bounded size. In a task, signatures are compared
   first, and what they can't rule out is confirmed on full sets. Tasks return a spanning forest of the
   links they find, never all pairs.
4. Connected components (alternating large-star and small-star) of the confirmed links are the answer.

Defined results: A-Z count as lower case; with fewer than k words the whole sequence is one shingle; a null
or empty text, or one without words, has an empty set and is linked with nothing; rows of a null id too,
and keep a null component. Rows that repeat an id share its node. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import table
from quantsieve.llm.components import components

#: Bounds of a block: shingles and documents. A task holds two blocks.
BLOCK_SHINGLES, BLOCK_DOCS = 200_000, 1_000
#: Minima in a signature, at most.
MAX_HASHES = 400
_CACHE_WORDS = 500_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_cache: dict[bytes, int] = {}


def plan_bands(threshold: float, miss: float = 1e-6, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands, within ``most`` minima, miss a pair at the threshold with at most that probability."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("threshold too low for so few minima")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(_cache) > _CACHE_WORDS:
        _cache.clear()
    out = []
    for w in found:
        h = _cache.get(w)
        if h is None:
            h = _cache[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    hashes = np.array(out, np.uint64)
    width = min(k, len(hashes))
    n = len(hashes) - width + 1
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc = _mix(acc * _STEP + hashes[j : j + n])
    return np.unique(acc)


def hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)).reshape(-1, 1), rng.integers(0, 1 << 32, n, np.uint32).reshape(-1, 1)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """Minimum of each hash a*x+b (mod 2**32) over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), step):
        np.minimum(best, (a * x[at : at + step] + b).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(bands, dtype=np.uint64)
    for part in sig[: bands * rows].reshape(bands, rows).T:
        acc = _mix(acc * _STEP + part)
    return acc.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and bands (array<long>) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = hash_family(bands * rows)
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": [band_keys(signature(s, a, b), bands, rows) if len(s) else [] for s in sets],
                }
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Those of the links that first join two parts of n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in links:
        ri, rj = root(int(i)), root(int(j))
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
            kept.append((int(i), int(j)))
    return kept


def confirmed_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, numerator: int, denominator: int, step: int = 4096) -> np.ndarray:
    """Index pairs (one of left, one of right, first below second where both are the same) with intersection * denominator >= numerator * union."""
    size = np.array([len(s) for s in sets], np.float64)
    codes, index, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = counts[index] > 1  # a shingle of one set only is in no intersection
    owner, index = owner[shared], (np.cumsum(counts > 1) - 1)[index[shared]]
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    row = np.zeros(len(sets), np.int64)
    is_left, is_right = np.isin(np.arange(len(sets)), left), np.isin(np.arange(len(sets)), right)
    for at in range(0, int(index[-1]) + 1 if len(index) else 0, step):
        lo, hi = np.searchsorted(index, (at, at + step))
        dense = np.zeros((len(sets), step), np.float32)
        dense[owner[lo:hi], index[lo:hi] - at] = 1
        inter += dense[left] @ dense[right].T
    union = size[left][:, None] + size[right][None, :] - inter
    i, j = np.nonzero(inter.astype(np.float64) * denominator >= numerator * union)
    pairs = np.stack([left[i], right[j]], 1)
    return pairs[pairs[:, 0] < pairs[:, 1]] if np.array_equal(left, right) else pairs


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, *, doc_id: str = "doc_id", text: str = "text", miss: float = 1e-6) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id; true for a null id).

    Links hold where 100 * intersection >= percent * union of two shingle sets.
    """
    bands, rows = plan_bands(percent / 100, miss)
    sk = table(sketches(docs, k, bands, rows, doc_id=doc_id, text=text), "sketches")
    some = sk.where("set_key is not null and doc_id is not null")
    # Copies: one node for each set, before anything is compared. Equal sets have equal bands.
    nodes = table(some.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    near = banded.join(shared, "band").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    candidates = components(near)
    links = confirm(docs, nodes, candidates, k, percent, doc_id=doc_id, text=text)
    roots = components(links)
    named = nodes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    out = sk.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component_id"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def confirm(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, k: int, percent: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (u, v), checked on full sets, that join all that belongs together within each candidate group."""
    grouped = candidates.union(candidates.select("root", "root").distinct()).toDF("node", "grp")
    members = nodes.select("node", "n").join(grouped, "node")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("int").alias("blocks"))
    placed = members.select("node", "grp").join(sizes, "grp").select("node", "grp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [shingle_set(t, k) for t in pdf.pop("text")]
            yield pdf.assign(shingles=[s.tobytes() for s in made])

    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).where("text is not null")
    held = texts.join(placed, "node").select("node", "grp", "blocks", "block", "text").mapInPandas(sets, "node long, grp long, blocks int, block int, shingles binary")
    pairs = held.select("node", "grp", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("node", "grp", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    bands, rows = plan_bands(percent / 100)
    slack = 6 * math.sqrt(percent / 100 * (1 - percent / 100) / (bands * rows))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        node, block = pdf["node"].to_numpy(), pdf["block"].to_numpy()
        made = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(left) and len(right) and len(made) > 2:
            a, b = hash_family(bands * rows)
            sig = np.stack([signature(s, a, b) for s in made])
            alike = np.zeros((len(left), len(right)), np.uint16)
            for col in range(sig.shape[1]):
                alike += sig[left, col][:, None] == sig[right, col][None, :]
            likely = alike >= (percent / 100 - slack) * sig.shape[1]
            if i == j:
                np.fill_diagonal(likely, False)
            left, right = left[likely.any(1)], right[likely.any(0)]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        used = np.union1d(left, right)
        found = confirmed_links([made[x] for x in used], np.searchsorted(used, left), np.searchsorted(used, right), percent, 100)
        forest = _forest(found, len(used))
        return pd.DataFrame({"u": [node[used[x]] for x, _ in forest], "v": [node[used[y]] for _, y in forest]}, dtype="int64")

    return pairs.groupBy("grp", "i", "j").applyInPandas(link, "u long, v long")
