from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quantsieve.llm import merkle
from tests.llm.conftest import ODD, SCHEMA


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root and, for each leaf, its runs from leaf to root as (left siblings, right siblings)."""
    ways = [[] for _ in leaves]
    nodes = [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k, (_, below) in enumerate(run):
                for i in below:
                    ways[i].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
            above.append((h(*(d for d, _ in run)), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], ways


def brute(rows) -> list[tuple]:
    """rows as (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        doc_id, text, lang, source, n_chars = r
        late = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        of = lambda t: h(*map(field, (doc_id, source, lang, n_chars, t)))
        groups.setdefault(source, []).append((doc_id, of(text), of(late)))
    out, subroots = [], {}
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subroots[s] = tree([r[1] for r in groups[s]])
    root, tops = tree([subroots[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for (doc_id, leaf, late), way in zip(groups[s], subroots[s][1], strict=True):
            digest = late
            for left, right in way + top:
                digest = h(*left, digest, *right)
            out.append((doc_id, leaf, subroots[s][0], root, h(*(d for left, right in way + top for d in left + right)), digest, digest == root))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    rows = merkle.manifest(df, tampered={"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows), key=str)


def _rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, t, None, None if i % 2 else "", None) for i, t in enumerate(ODD)] + [(None, "no\nid", "en", "a", 3), (None, None, None, None, None), (7, "again", "en", "a", 1), (7, "again", "en", "a", 1), (7, "a\ngain", "en", "a", 1), (-5, "é\n日", "fr", "É", 2)]
    return out + [(rng.randrange(10**6), f"text\n{rng.random()}", rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", "B", "c", "É", ""]), rng.randrange(100)) for _ in range(n)]


@pytest.mark.parametrize(("n", "levels"), [(0, 2), (400, 1), (400, 2), (1500, 6)])
def test_manifest(spark, n, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rows = _rows(n, levels)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_one_row_none_and_other_columns(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    one = [(4, "x\ny", "en", "s", 3)]
    df = spark.createDataFrame(one, SCHEMA).withColumns({"grp": F.lit(1), "pos": F.lit(2), "digest": F.lit("z"), "root": F.lit(0)})
    assert got(df) == brute(one)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82, 100])
def test_sweeps(n):
    """Forward in label order with a small queue; backward to proofs that lead to the root."""
    leaves = [(i, bytes([i]) * 32) for i in range(n)]
    nodes = list(merkle.forward(leaves, n, merkle.height(n)))
    labels = [(min((place + 1) * 3**level, n) - 1, level) for level, place, *_ in nodes]
    assert labels == sorted(set(labels))
    root = nodes[-1][3] if nodes else leaves[0][1]
    for (_, d), (sib, shape) in zip(leaves, merkle.backward(leaves, n, merkle.height(n), b"", b""), strict=True):
        assert merkle.refold(d, sib, shape) == root and len(shape) == merkle.height(n)
        assert n == 1 or merkle.refold(bytes(32), sib, shape) != root or d == bytes(32)
