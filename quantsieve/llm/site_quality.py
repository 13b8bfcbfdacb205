r"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression on the counts and histograms of quality_rules, trained on labels)
gives each document a probability. By grouped aggregation its evidence is summed for hosts and for the paths of a
host. A host's quality is a Beta posterior around the global mean, a path's one around its host's; the prior's
strength at each level is estimated from how much the sites differ (method of moments), so sparse sites shrink
toward what stands above them. A document's score combines its own evidence with its path's posterior, from
which its own part is taken out.

Defined results: a null host or path is a site of its own; a null or empty text is a document without
features; without labels of both kinds the classifier gives 0.5 to all; ids labelled twice count as good if any
label says so; repeated rows count each; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import BROADCAST_ROWS, small, table
from quantsieve.llm.quality_rules import CHAR_CLASSES, quality_features

#: Bounds of a prior's strength, in documents.
STRENGTH = (1.0, 10_000.0)
#: Parts that a site's documents are dealt to where sites are too many to send to every task.
SALTS = 16


def url_levels(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address, lower-cased, without port and leading www."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    return host, F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]+/([^/?#]*)", 1)


def document_features(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with ``x``: an array of numbers that describe a text, all of bounded size."""
    f = quality_features(docs, text=text, lang=lang)
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    n, chars = F.col("n_words"), F.col("word_chars")
    classes = [share(F.get("_qs_chars", F.lit(i)), chars) for i in range(1, len(CHAR_CLASSES))]
    common = share(n - F.get("_qs_common", F.lit(0)), n)
    x = F.array(F.least(F.log1p(n.cast("double")), F.lit(10.0)), F.least(share(chars, n), F.lit(20.0)), share(F.col("n_repeat_words"), n), share(F.col("n_dup_lines"), n), common, *classes)
    return f.select(*[c for c in docs.columns if c in f.columns and c != "x"], x.alias("x"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) by Newton's method; zeros where labels are all alike."""
    if not len(y) or y.min() == y.max():
        k = x.shape[1] if x.ndim == 2 else 0
        return np.zeros(k), np.ones(k), np.zeros(k + 1)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), ridge * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def probability(x: Column, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """The classifier as an expression."""
    mean, scale, w = fitted
    z = F.lit(float(w[-1]))
    for i, (m, s, v) in enumerate(zip(mean, scale, w)):
        z = z + F.lit(float(v)) * F.greatest(F.least((F.get(x, F.lit(i)) - float(m)) / float(s), F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(-z))


def train_classifier(features: DataFrame, labels: DataFrame, max_train: int = 20_000, *, doc_id: str = "doc_id", quality: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on at most about max_train labelled documents, drawn by a hash of the id; only their features go to the driver."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_qs_id")).agg(F.max(quality).cast("double").alias("_qs_y"))
    share = min(1.0, max_train / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality"), "_qs_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = features.join(drawn, F.col(doc_id) == F.col("_qs_id")).select(doc_id, "x", "_qs_y").toPandas().sort_values([doc_id, "_qs_y"])
    if not len(rows):
        return fit_logistic(np.empty((0, 0)), np.empty(0))
    return fit_logistic(np.array(rows["x"].tolist(), np.float64).reshape(len(rows), -1), rows["_qs_y"].to_numpy(np.float64))


def _strength(sites: DataFrame, mean: Column) -> float:
    """The Beta prior's strength from the spread of site means about ``mean``, less what sampling alone would give."""
    n, m = F.col("n"), F.col("s") / F.col("n")
    noise = (F.col("ss") / n - m * m) / F.greatest(n - 1, F.lit(1.0))
    many = sites.where("n > 1")
    row = many.agg(F.sum(n * ((m - mean) ** 2 - noise)).alias("v"), F.sum(n).alias("n"), F.sum(n * mean * (1 - mean)).alias("b")).first()
    if not row["n"] or row["v"] is None or row["v"] <= 0:
        return STRENGTH[1]
    return float(np.clip(row["b"] / row["v"] - 1, *STRENGTH))


def _with_sites(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """scored with the row of its (host, path): few sites go to every task; else each is sent to SALTS parts of its documents, so that no site is one task's."""
    named = sites.withColumnsRenamed({"host": "_qs_host", "path": "_qs_path"})
    same = F.col("host").eqNullSafe(F.col("_qs_host")) & F.col("path").eqNullSafe(F.col("_qs_path"))
    if sites.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return scored.join(F.broadcast(named), same)
    dealt = scored.withColumn("_qs_part", F.pmod(F.xxhash64("doc_id", "p"), F.lit(SALTS)).cast("int"))
    sent = named.withColumn("_qs_to", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return dealt.join(sent.hint("merge"), same & (F.col("_qs_part") == F.col("_qs_to")))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, max_train: int = 20_000, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality") -> DataFrame:
    """doc_id, host, path, doc_score, host_score, path_score, quality_score, kept of every row."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    features = table(document_features(named).select("doc_id", "host", "path", "x"), "features")
    fitted = train_classifier(features, labels.select(F.col(doc_id).alias("doc_id"), quality), max_train, quality=quality)
    scored = features.select("doc_id", "host", "path", F.greatest(F.least(probability(F.col("x"), fitted), F.lit(0.999)), F.lit(0.001)).alias("p"))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")]
    paths = table(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = 0.5 if total is None else float(total)
    k_host = _strength(hosts, F.lit(mean))
    host_score = (F.col("s") + k_host * mean) / (F.col("n") + k_host)
    hosts = hosts.select(F.col("host").alias("_qs_host"), host_score.alias("host_score"))
    sites = table(paths.join(small(table(hosts, "hosts")), F.col("host").eqNullSafe(F.col("_qs_host"))).drop("_qs_host"), "sites")
    k_path = _strength(sites, F.col("host_score"))
    joined = _with_sites(scored, sites.select("host", "path", "n", "s", "host_score"))
    others = (F.col("s") - F.col("p") + k_path * F.col("host_score")) / (F.col("n") - 1 + k_path)
    logit = lambda p: F.log(p / (1 - p))
    z = logit(F.col("p")) + logit(F.greatest(F.least(F.col("path_score"), F.lit(0.999)), F.lit(0.001))) - float(np.log(mean / (1 - mean)))
    out = joined.select("doc_id", "host", "path", F.col("p").alias("doc_score"), "host_score", others.alias("path_score"), "p")
    return out.withColumn("quality_score", 1 / (1 + F.exp(-z))).drop("p").withColumn("kept", F.col("quality_score") >= threshold)
