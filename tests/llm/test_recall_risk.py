"""Recall on re-parameterised items, the risk's gradient against finite differences, and shrinkage of sparse sites."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantsieve.llm import decontaminate, site_quality, toxicity

PLAIN = "the a of in with each how many does need carry along every between after before when same steady total share farm river market basket wagon bottle garden fence ladder engine field ticket library blue small heavy old".split()
NAMES, OTHER_NAMES = "Lyon Paris Nora Oskar Ruth Tilda".split(), "Turin Milan Pavel Greta Yusuf Marek".split()
UNITS, OTHER_UNITS = "km minutes litres dollars".split(), "miles hours gallons euros".split()


def problem(rng, length):
    """(item, copy): a word problem, and itself with other numbers, names and units, each changed alike throughout."""
    numbers = [str(n) for n in rng.sample(range(2, 900), 6)]
    swap = dict(zip(NAMES, rng.sample(OTHER_NAMES, 6))) | dict(zip(UNITS, rng.sample(OTHER_UNITS, 4))) | {n: str(int(n) + 1000) for n in numbers}
    out = ["so"]
    while len(out) < length:
        out.append(rng.choice(rng.choice((NAMES, UNITS, numbers))) if rng.random() < 0.25 else rng.choice(PLAIN))
    return " ".join(out), " ".join(swap.get(w, w) for w in out)


def test_recall_on_other_numbers_names_and_units(spark, docs_of):
    """At least 0.9 at each length, of 50 items; clean texts of the same words are left alone."""
    rng = random.Random(9)
    lengths = (12, 20, 35, 60)
    pairs = {100 * k + n: problem(rng, length) for k, length in enumerate(lengths) for n in range(50)}
    filler = lambda: " ".join(rng.choice(PLAIN) for _ in range(60))
    texts = {i: f"{filler()} {copy} {filler()}" for i, (_, copy) in pairs.items()}
    clean = {1000 + i: problem(rng, 60)[0] for i in range(200)}
    bench = spark.createDataFrame([(i, item) for i, (item, _) in pairs.items()], "item_id long, text string")
    docs = docs_of([*texts.values(), *clean.values()], [*texts, *clean])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    for k, length in enumerate(lengths):
        caught = sum((100 * k + n, 100 * k + n) in got for n in range(50)) / 50
        assert caught >= 0.9, length
    assert not {d for d, _ in got} & set(clean)


@pytest.mark.parametrize("prior", [0.05, 0.4])
def test_training_steps_against_finite_differences(monkeypatch, prior):
    """Adam on numeric gradients of the stated objective, text by text, ends at the same weights."""
    monkeypatch.setattr(toxicity, "MIN_STEPS", 1)
    rng = random.Random(4)
    draw = lambda n, lo: [np.array(sorted(rng.sample(range(lo, lo + 9), 4)), np.int32) for _ in range(n)]
    pos, unl, decay, rate, epochs = draw(8, 0), draw(30, 3), 0.01, 0.3, 12
    model = toxicity.train(pos, unl, prior, epochs=epochs, batch=1000, rate=rate, decay=decay, min_count=1, min_z=0)
    used = sorted({int(s) for t in [*pos, *unl] for s in t})

    def minus(x, text):
        return np.log1p(np.exp(sum(x[used.index(int(s))] for s in text) + x[-1]))

    def negative(x):
        return np.mean([minus(x, t) for t in unl]) - prior * np.mean([minus(x, t) for t in pos])

    def objective(x, held_back):
        plus = np.mean([minus(x, t) - (sum(x[used.index(int(s))] for s in t) + x[-1]) for t in pos])
        return -negative(x) if held_back else prior * plus + negative(x)

    x = np.append(np.zeros(len(used)), np.log(prior / (1 - prior)))
    m1 = m2 = np.zeros(len(x))
    held = 0
    for epoch in range(epochs):
        back = negative(x) < 0
        held += back
        grad = np.array([(objective(x + e, back) - objective(x - e, back)) / 2e-6 for e in np.eye(len(x)) * 1e-6])
        grad[np.abs(grad) < 1e-8] = 0  # below what differences can tell; the bias starts where its gradient is 0
        grad[:-1] += decay * x[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        x = x - rate * (1 - epoch / epochs) * (m1 / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(m2 / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    assert 0 < held < epochs  # both sides of the estimator are met
    assert np.allclose(model.weights[used], x[:-1], atol=1e-3) and abs(model.bias - x[-1]) < 1e-3


def test_odd_rows_of_toxicity(spark, docs_of):
    """Null and repeated ids are scored, equal texts alike; a label given twice counts as toxic if any row says so."""
    docs = docs_of(["vile words", "vile words", "fine words", None, "", "vile words"] * 5, [None, 3, 4, 5, 6, 3] * 5, toxic=9, score=0.5, label="x")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 30 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["doc_id"] is None for r in rows) == 5 and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, None)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1


def test_sparse_sites_of_addresses_shrink(spark):
    """Thousands of hosts of one to three pages: their posteriors stay nearer to the mean than their own means, rich hosts keep theirs."""
    rng = random.Random(6)
    good, bad = "a calm and well told account of how the old mill was rebuilt by its owners over many years", "buy now !!! $$$ ### buy now !!! $$$ ### buy now !!! $$$ ### buy now"
    rows, i = [], 0
    for h in range(2_000):
        for _ in range(rng.randint(1, 3)):
            rows.append((i, f"https://www.small{h}.org/p{rng.randint(0, 2)}/x.html", good if rng.random() < 0.5 else bad, "en"))
            i += 1
    for h, text in (("rich", good), ("spam", bad)):
        for n in range(600):
            rows.append((i, f"http://{h}.com:8080/all/{n}", text, "en"))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string, lang string")
    labels = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("text") == good).cast("int").alias("quality"))
    out = site_quality.site_quality(docs, labels, *site_quality.url_levels(F.col("url"))).collect()
    assert len(out) == len(rows)
    own: dict[str, list[float]] = {}
    for r in out:
        own.setdefault(r["host"], []).append(r["doc_score"])
    mean = np.mean([r["doc_score"] for r in out])
    posterior = {r["host"]: r["host_score"] for r in out}
    assert len(posterior) == 2_002
    for host, scores in own.items():
        if host.startswith("small"):
            assert abs(posterior[host] - mean) <= abs(np.mean(scores) - mean) + 1e-9
    moved = {h: abs(posterior[h] - mean) / abs(np.mean(s) - mean) for h, s in own.items() if abs(np.mean(s) - mean) > 1e-6}
    by_size = [np.mean([moved[h] for h, s in own.items() if h in moved and len(s) == n]) for n in (1, 2, 3)]
    assert by_size[0] < by_size[1] < by_size[2] < min(moved["rich.com"], moved["spam.com"])
    assert posterior["rich.com"] > 0.8 > 0.2 > posterior["spam.com"]
