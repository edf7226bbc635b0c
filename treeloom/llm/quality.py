"""Quality classifier: document evidence combined with host and path posteriors.

A logistic model on text-shape features gives each document a probability of being good.
It is fitted on at most ``sample`` labelled rows.  Per path, then per host, grouped sums of
those probabilities form beta posteriors: a host shrinks toward the global mean, a path
toward its host, each by a concentration estimated from the spread between groups (method
of moments), so a sparse site says little and a large one speaks for itself.  A document's
posterior odds are its classifier's evidence times the prior odds of its path.

Sums are taken per path and host together with partial aggregation, so a site that holds a
third of all rows costs one row per task.  The table of paths is broadcast only when its
counted size is within ``BROADCAST_PATHS``; beyond that documents are salted against it.

Defined cases: null text is empty; a null host or path is a site of its own; repeated rows
stay; an empty table gives no rows; without usable labels of both kinds the fixed starting
weights are used; columns that share a name with a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.kernel import SPACE, Words, map_texts
from treeloom.runtime import ship, spread

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 20_000
BROADCAST_PATHS = 200_000
SALT = 64
#: Documents whose posterior of being good falls below this are rejected.
THRESHOLD = 0.5

FEATURES = ("upper", "digit", "mark", "symbol", "pipe", "repeat", "unique", "word_size", "short", "long_words", "wide")
_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _c in "!?" else 5 if _c == "|" else 4 if _b < 128 and not _c.isalnum() and _c not in " \t\n\r\f\v.,;:'\"()-" else 6 if _b >= 128 else 0


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of each text; every value lies between 0 and 1 or so."""
    rows = len(offsets) - 1
    w = Words(buf, offsets, SPACE)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    counts = w.counts.astype(float)
    many = np.maximum(counts, 1)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(owner * 7 + _KIND[buf], minlength=rows * 7).reshape(rows, 7) if len(buf) else np.zeros((rows, 7))
    letters = w.end - w.start
    again = np.zeros(len(w.h), bool)
    again[1:] = (w.h[1:] == w.h[:-1]) & (w.row[1:] == w.row[:-1])
    per = lambda x: np.bincount(w.row, weights=x, minlength=rows) if len(w.h) else np.zeros(rows)
    order = np.lexsort((w.h, w.row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.h[order][1:] != w.h[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    distinct = np.bincount(w.row[order][fresh], minlength=rows) if len(order) else np.zeros(rows)
    ratio = lambda k: np.sqrt(kinds[:, k] / many)
    return np.stack(
        [
            np.sqrt(kinds[:, 1] / size),
            ratio(2) / 2,
            ratio(3) / 2,
            ratio(4) / 2,
            ratio(5),
            per(again) / many,
            # distinct words against what prose of this length shows
            distinct / many * np.log1p(many) / 4,
            per(np.minimum(letters, 40)) / many / 10,
            1 / (1 + counts / 8),
            per(letters > 30) / many,
            kinds[:, 6] / size,
        ],
        1,
    )


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -12, 12)


def _design(x: np.ndarray) -> np.ndarray:
    """Features with their squares: junk lies at either end of some."""
    return np.concatenate([x, x * x], 1)


#: Weights used where no labels exist: marks, symbols, pipes, capitals and repetition speak against a text.
_START = Classifier(np.zeros(22), np.ones(22), np.array([-6, -1, -6, -6, -6, -8, 0, 0, -1, -2, 0] + [0] * 11, float), 4.0, 0.85)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> Classifier:
    """Logistic regression by Newton steps on standardised features."""
    if len(set(y.tolist())) < 2:
        return _START
    d = _design(x)
    mean, scale = d.mean(0), d.std(0) + 1e-6
    z = np.concatenate([(d - mean) / scale, np.ones((len(d), 1))], 1)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]), float(y.mean()))


def evidence(documents: DataFrame, model: Classifier, text: str, keep: list[str]) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batch, buf, offsets):
        return {"doc_log_odds": sent.value.log_odds(_design(features(buf, offsets)))}

    return map_texts(documents, text, keep, [T.StructField("doc_log_odds", T.DoubleType())], work)


def sampled(labels: DataFrame, label: str, doc: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids, chosen by hash; repeated labels of an id become one (the greatest)."""
    rows = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("id")).agg(F.max(label).cast("double").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(sample)


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Classifier:
    chosen = F.broadcast(sampled(labels, label, doc, sample))  # at most ``sample`` rows
    rows = documents.select(F.col(doc).alias("id"), F.col(text).alias("t")).join(chosen, "id").select("id", "y", "t")
    fields = [T.StructField("x", T.ArrayType(T.DoubleType()))]

    def work(batch, buf, offsets):
        return {"x": list(features(buf, offsets))}

    got = map_texts(rows, "t", ["id", "y"], fields, work).toPandas()
    if not len(got):
        return _START
    got = got.sort_values("id").drop_duplicates("id")
    return fit(np.stack(got["x"].to_list()), got["y"].to_numpy())


def _concentration(groups: DataFrame, n: str, mean: str, centre) -> float:
    """Beta concentration by moments over groups: large where groups differ no more than chance."""
    m = F.col(mean)
    c = centre if isinstance(centre, F.Column) else F.lit(centre)
    row = groups.select(F.sum(F.col(n) * (m - c) * (m - c)), F.sum(F.lit(1.0)), F.sum(n), F.sum(F.col(n) * F.col(n)), F.sum(F.col(n) * c * (1 - c))).first()
    ss, k, total, squares, noise = (float(x or 0) for x in row)
    if k < 2 or total <= 0:
        return 1000.0
    within = noise / total
    spare = total - squares / total
    between = max((ss - (k - 1) * within) / max(spare, 1e-9), 1e-9)
    return float(np.clip(within / between - 1, 1.0, 1000.0))


def score(documents: DataFrame, model: Classifier, text: str = "text", host: str = "source", path: str = "lang", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with doc_score, host_posterior, path_posterior, score and accepted."""
    ship(documents.sparkSession)
    keep = list(documents.columns if keep is None else keep)
    made = ["doc_log_odds", "doc_score", "host_posterior", "path_posterior", "score", "accepted"]
    facts = documents.select(F.col(text).alias("__t"), F.col(host).cast("string").alias("__host"), F.col(path).cast("string").alias("__path"))
    p = 1 / (1 + F.exp(-F.col("doc_log_odds")))
    by_path = evidence(facts, model, "__t", ["__host", "__path"]).groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("good"))
    by_path = by_path.cache()
    by_host = by_path.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    total = by_host.agg(F.sum("hn"), F.sum("hgood")).first()
    mean = float(np.clip((total[1] or 0.0) / max(total[0] or 0.0, 1.0), 1e-3, 1 - 1e-3)) if total[0] else model.prior
    k_host = _concentration(by_host.withColumn("m", F.col("hgood") / F.col("hn")), "hn", "m", mean)
    by_host = by_host.withColumn("host_posterior", (F.col("hgood") + k_host * mean) / (F.col("hn") + k_host))
    same = F.col("p.__host").eqNullSafe(F.col("h.__host"))
    sites = by_path.alias("p").join(by_host.alias("h"), same).select("p.__host", "p.__path", "n", "good", "host_posterior")
    k_path = _concentration(sites.withColumn("m", F.col("good") / F.col("n")), "n", "m", F.col("host_posterior"))
    sites = sites.select("__host", "__path", "host_posterior", ((F.col("good") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior"))
    rows = documents.select(*(f"`{c}`" for c in dict.fromkeys([*(c for c in keep if c not in made), text])), F.col(host).cast("string").alias("__host"), F.col(path).cast("string").alias("__path"))
    found = evidence(rows, model, text, [*(c for c in keep if c not in made), "__host", "__path"])
    key = F.struct(F.coalesce("__host", F.lit("")), F.col("__host").isNull(), F.coalesce("__path", F.lit("")), F.col("__path").isNull())
    sites = sites.select(F.hash(key).alias("__k"), F.col("__host").alias("__h"), F.col("__path").alias("__p"), "host_posterior", "path_posterior")
    found = found.withColumn("__k", F.hash(key))
    on = (F.col("__k") == F.col("__k2")) & F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p"))
    sites = sites.withColumnRenamed("__k", "__k2")
    if by_path.count() <= BROADCAST_PATHS:
        out = found.join(F.broadcast(sites), on)
    else:
        salted = sites.withColumn("__s2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = found.withColumn("__s", F.pmod(F.xxhash64("doc_log_odds"), F.lit(SALT)).cast("int")).join(salted, on & (F.col("__s") == F.col("__s2")))
    prior = float(np.clip(model.prior, 1e-3, 1 - 1e-3))
    odds = F.col("doc_log_odds") - float(np.log(prior / (1 - prior))) + F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    return out.select(
        *(f"`{c}`" for c in keep if c not in made),
        p.alias("doc_score"),
        "host_posterior",
        "path_posterior",
        (1 / (1 + F.exp(-odds))).alias("score"),
        (odds >= float(np.log(threshold / (1 - threshold)))).alias("accepted"),
    )


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
