from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantsieve.llm import lexical_search as ls
from tests.llm.conftest import LONG, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


VOCABULARY = [*(f"w{i}" for i in range(40)), "the", "THE", "É", "日本", "naïve", "x9"]


def _texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    usual = [w for i, w in enumerate(VOCABULARY) for _ in range(1 + 200 // (i + 1))]
    return [rng.choice(["", "-"]).join("".join((w, rng.choice([" ", ", ", "\n"]))) for w in rng.choices(usual, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "size", "chunk"), [(1, 16_384, 512), (2, 37, 5), (3, 200, 1)])
def test_search_is_exact(spark, docs_of, seed, size, chunk, monkeypatch):
    """Ties, repeated and missing ids, odd texts, small segments and chunks, against scores of all documents."""
    for name, value in {"SEGMENT_DOCS": size, "CHUNK": chunk, "BLOCK_ITEMS": 7, "SEGMENT_BYTES": 20_000 if seed > 1 else 10**7}.items():
        monkeypatch.setattr(ls, name, value)
    texts = [*ODD, *_texts(600, seed), *["w1 w2 copy"] * 30]
    ids = [*range(len(texts) - 12), *[None] * 2, *[3] * 10]
    asked = [*enumerate(_texts(20, seed + 50)), (100, None), (101, ""), (102, "nowhere"), (103, "W1 w1 COPY"), (103, "word5 word6 the"), (None, "w39 É")]
    index = ls.build_index(docs_of(texts, ids, term="x", segment=1).repartition(3))
    got = ls.search(index, spark.createDataFrame(asked, "item_id long, text string"), 9).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == brute(list(zip(ids, texts, strict=True)), asked, 9)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert ls.search(ls.build_index(docs_of([])), items, 3).collect() == []
    assert ls.search(ls.build_index(docs_of(["", None])), items, 3).collect() == []
    assert ls.search(ls.build_index(docs_of(["some text"])), items.limit(0), 3).collect() == []
    assert ls.search(ls.build_index(docs_of(["no match"])), items, 3).collect() == []


@pytest.mark.parametrize("run", [1, 5, 64, 10**6])
def test_terms_in_runs(run, monkeypatch):
    monkeypatch.setattr(ls, "RUN_BYTES", run)
    texts = [None, "", *_texts(50, run), "", "a" * 300, LONG[:3000], "日" * 50 + " b", None]
    got = [(int(i), t) for ts, which in ls._runs(pa.array(["cut off", *texts]).slice(1)) for t, i in zip(ts.to_pylist(), which, strict=True)]
    assert got == [(i, t) for i, x in enumerate(texts) for t in terms(x)]


def test_long_lists_are_skipped(monkeypatch):
    """A rare term names the candidates; the list of a common one is only probed at them."""
    n = 16_000
    rare = ls.Postings(np.arange(0, n, 400), np.full(n // 400, 900_000))
    common = ls.Postings(np.arange(n), np.full(n, 500_000))
    probes = []
    plain = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: probes.append(np.size(v)) or plain(a, v, **k))
    scores, ids = ls.search_segment([(rare, 7000), (common, 1)], np.arange(n), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 20)
    assert len(ids) == 20 and ids.tolist() == list(range(0, 8000, 400)) and set(scores.tolist()) == {900_000 * 7000 + 500_000}
    assert sum(probes) < 2 * n / 10
