from __future__ import annotations

import random
import re

import pytest

from quantsieve.llm import near_dedup
from quantsieve.llm.components import components
from tests.llm.conftest import ODD


def brute_groups(docs, k, percent):
    sets = {}
    for i, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, words, change):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, change)):
            own[rng.randrange(words)] = f"v{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(docs_of, monkeypatch, k, percent):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 20)  # so that groups are dealt into blocks
    rng = random.Random(k)
    texts = [*ODD, "A b C", "a B c", "a b", *family(rng, 60, 150, 8), *family(rng, 30, 60, 3), *family(rng, 10, 12, 1)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.similar_groups(docs_of(texts, bands=1, node="x"), k, percent).collect()}
    assert got == brute_groups(list(enumerate(texts)), k, percent)


def test_null_and_repeated_ids(docs_of):
    rows = near_dedup.similar_groups(docs_of(["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 4, 4, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("4", "4", True)] * 2 + [("None", "None", True)] * 2
    assert near_dedup.similar_groups(docs_of([])).count() == 0


def test_bands_miss_little():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, width = near_dedup.plan_bands(t)
        assert (1 - t**width) ** bands <= 1e-6 and bands * width <= near_dedup.MAX_HASHES


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7)]
    rng.shuffle(links)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
