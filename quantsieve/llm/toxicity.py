r"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and beginnings of words is trained in numpy on confirmed toxic texts (positives) and on texts of
unknown label. With class prior p, the risk is p * R_P(+) + max(0, R_U(-) - p * R_P(-)): unlabelled texts stand in
for negatives, less what the positives among them add, and where that difference would fall below zero (which
is overfitting) its gradient is turned round. Scores are logistic, so a score estimates the probability.

Training takes a sample of at most ``max_train`` positives and as many unlabelled texts, drawn by a hash of the
id. Their slots are counted in Spark, and only those that get a weight go to the driver. All documents are scored, from whole texts.

Defined results: a null or empty text scores by the bias alone; an id labelled twice is toxic if any label says
so; without positives every score is the prior (0); rows without an id are scored but never trained on; an
empty table gives an empty table. Other columns are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import table

BITS = 18
PREFIXES = (5, 7)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Steps of training at least, whatever the number of texts.
MIN_STEPS = 400
#: A slot gets a weight if so many training texts hold it, and its shares differ by so many standard errors.
MIN_COUNT, MIN_Z = 3, 5.0
_CACHE_WORDS = 200_000
_cache: dict[str, tuple[int, ...]] = {}


def _slots_of(word: str) -> tuple[int, ...]:
    """Slots of a word: its own, and those of its beginnings, which stand for its inflected and compound forms."""
    parts = [word + "$", *(word[:n] for n in PREFIXES if n <= len(word))]
    return tuple(xxhash.xxh32_intdigest(p) & ((1 << BITS) - 1) for p in parts)


def word_slots(text: str | None) -> np.ndarray:
    """Sorted distinct slots (i32) of the words of a text, lower-cased."""
    if len(_cache) > _CACHE_WORDS:
        _cache.clear()
    out: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        slots = _cache.get(w)
        if slots is None:
            slots = _cache[w] = _slots_of(w)
        out.update(slots)
    return np.array(sorted(out), np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, slots: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[s].sum() for s in slots], np.float64) + self.bias

    def scores(self, slots: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(slots), -30, 30))) if slots else np.empty(0)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, epochs: int = 20, batch: int = 512, rate: float = 0.05, decay: float | None = None, min_count: int = MIN_COUNT, min_z: float = MIN_Z, seed: int = 11) -> Model:
    """Minimise the non-negative risk with logistic loss by Adam.

    decay, the weight of the squared weights, is 40 over the number of texts (0.01 at most) if not given.
    Only words get a weight whose share among the positives differs from that among the unlabelled by min_z
    standard errors, and that stand in at least min_count training texts: rare words would be learnt by heart.
    """
    n_slots = 1 << BITS
    if not positive:
        return Model(np.zeros(n_slots, np.float32), -30.0)
    prior = float(np.clip(prior, 1e-4, 0.5))
    counts = np.bincount(np.concatenate([*positive, *unlabelled]), minlength=n_slots)
    in_pos = np.bincount(np.concatenate(positive), minlength=n_slots)
    n_pos, n_all = len(positive), len(positive) + len(unlabelled)
    decay = min(0.01, 40 / n_all) if decay is None else decay
    pooled = counts / n_all
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_pos + 1 / max(1, len(unlabelled))))
    z = (in_pos / n_pos - (counts - in_pos) / max(1, len(unlabelled))) / error
    used = np.flatnonzero((counts >= min_count) & (np.abs(z) >= min_z))
    place = np.full(n_slots, -1, np.int64)
    place[used] = np.arange(len(used))
    texts = [p[p >= 0] for p in (place[s] for s in [*positive, *unlabelled])]
    size = np.array([len(t) for t in texts])
    flat, ends = (np.concatenate(texts) if size.sum() else np.empty(0, np.int64)), np.cumsum(size)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    m1, m2, step = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0
    n_batches = max(1, -(-n_all // batch))
    epochs = max(epochs, -(-MIN_STEPS // n_batches))
    for epoch in range(epochs):
        pos, unl = rng.permutation(n_pos), n_pos + rng.permutation(n_all - n_pos)
        for k in range(n_batches):
            p, u = pos[k::n_batches], unl[k::n_batches]
            if not len(p) or not len(u):
                continue
            rows = np.concatenate([p, u])
            at = np.concatenate([np.arange(ends[r] - size[r], ends[r]) for r in rows]) if len(rows) else rows
            cols, owner = flat[at], np.repeat(np.arange(len(rows)), size[rows])
            z = np.bincount(owner, weights=w[cols], minlength=len(rows)) + b
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            is_p = np.arange(len(rows)) < len(p)
            loss_minus = np.logaddexp(0, z)  # the loss of calling a text negative
            negative = loss_minus[~is_p].mean() - prior * loss_minus[is_p].mean()
            g_minus = np.where(is_p, -prior * s / len(p), s / len(u))
            if negative < 0:
                g = -g_minus
            else:
                g = g_minus + np.where(is_p, prior * (s - 1) / len(p), 0)
            grad = np.append(np.bincount(cols, weights=g[owner], minlength=len(used)) + decay * w, g.sum())
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            move = rate * (1 - epoch / epochs) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(n_slots, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text falls in the fold that is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Train on the rows that aren't held out. The prior is the share of toxic rows among their labels."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_qs_id")).agg(F.max(toxic).alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return train([], [], 0.0)
    n_docs = docs.count()
    positives = known.where("toxic = 1").select("_qs_id", F.lit(1).alias("positive"))
    drawn = lambda share, c: F.pmod(F.xxhash64(F.lit("toxicity"), F.col(c).cast("long")), F.lit(10**9)) < int(10**9 * min(1.0, share))
    rows = docs.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id), F.col(text))
    # The ids drawn number about max_train whatever the corpus holds, so they go to every executor and no text is shuffled.
    picked = F.broadcast(positives.where(drawn(max_train / n_toxic, "_qs_id")))
    p = rows.join(picked, F.col(doc_id) == F.col("_qs_id"))
    # Texts of unknown label include some that are toxic; that is what the prior is for.
    apart = F.broadcast(positives.where(drawn(max_train / max(1, n_docs), "_qs_id")))
    u = rows.where(drawn(max_train / max(1, n_docs), doc_id)).join(apart, F.col(doc_id) == F.col("_qs_id"), "left_anti").select("*", F.lit(0).alias("positive"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "positive": pdf["positive"], "slots": [word_slots(t) for t in pdf["text"]]})

    sample = table(p.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), "positive").union(u.select(F.col(doc_id).cast("long"), F.col(text), "positive")).mapInPandas(slots, "id long, positive int, slots array<int>"), "sample")
    # Slots are counted and chosen in Spark; of the texts, only the chosen ones go to the driver.
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = sample.select("positive", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("positive").alias("in_pos"), F.count(F.lit(1)).alias("n"))
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    used = np.sort(counts.where(_stands_out(F.col("in_pos"), F.col("n"), n_pos, n_unl)).select("slot").toPandas()["slot"].to_numpy(np.int32))  # 2**BITS at most
    sent = docs.sparkSession.sparkContext.broadcast(used)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(slots=[s[np.isin(s, sent.value, assume_unique=True)].astype(np.int32).tobytes() for s in pdf["slots"]])

    got = sample.mapInPandas(chosen, "id long, positive int, slots binary").toPandas().sort_values(["positive", "id", "slots"])
    side = lambda x: [np.frombuffer(s, np.int32) for s in got.loc[got["positive"] == x, "slots"]]
    return train(side(1), side(0), n_toxic / n)


def _stands_out(in_pos: Column, n: Column, n_pos: int, n_unl: int, min_count: int = MIN_COUNT, min_z: float = MIN_Z) -> Column:
    """The test of train() as an expression, a little wider than it, so that rounding loses nothing."""
    n_all = n_pos + n_unl
    pooled = n / F.lit(float(n_all or 1))
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / max(1, n_pos) + 1 / max(1, n_unl)))
    z = (in_pos / max(1, n_pos) - (n - in_pos) / max(1, n_unl)) / error
    return (n >= min_count) & (F.abs(z) >= min_z * 0.999)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**BITS weights, whatever the corpus holds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for pdf in batches:
            s = m.scores([word_slots(t) for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
