"""Toxicity: a counterfactually regularised classifier.

Features are words and word beginnings (4, 5 and 6 bytes) that a text holds, by hash.
Grouped counts over the labelled sample select those whose rate in toxic texts departs
significantly; a logistic model is fitted on them.  For every labelled text and every identity
term that it mentions, the text is written again with that term swapped for another of its
group, and the counterfactual text is featurised like the original; the loss adds the mean
squared change of log-odds between the two, so that a neutral mention of a group moves the
score as little as any other group's.  Bare terms of a group are held against each other once
beside that, as labelled texts need not mention them all.

Learning is bounded: at most ``SAMPLE`` labelled rows and ``SELECTED`` features; scoring reads
every text whole in one map without a shuffle.

Defined cases: null text is empty and scores as the bias; labels that are null are left out,
repeated labels of an id become one (the greatest), of repeated ids' texts the least in byte order
is learnt from; without labels of both kinds every score
is the share of toxic labels, or 0 without labels; repeated rows stay; an empty table gives
no rows; columns that share a name with a result are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.kernel import NOT_ALNUM, Words, distinct, flat_texts, lists, map_texts
from treeloom.runtime import ship, spread

SAMPLE = 12_000
SELECTED = 4_096
#: Standard deviations by which a feature's count in toxic texts must depart, and its least count.
DEPARTURE, LEAST = 6.0, 5
THRESHOLD = 0.7
#: Weight of the counterfactual penalty.
SWAP_PENALTY = 2.0

#: Identity terms, swapped only within a group.
IDENTITY_TERMS = [
    ["women", "men", "woman", "man", "girls", "boys", "trans", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh", "christen", "muslime", "juden", "chrétiens", "musulmans", "juifs", "cristianos", "musulmanes", "judíos"],
    ["black", "white", "asian", "latino", "arab", "african", "european", "schwarze", "weiße", "noirs", "blancs", "negros", "blancos"],
    ["gay", "straight", "lesbian", "bisexual", "queer", "schwule", "lesben", "homosexuels", "gais", "lesbianas"],
    ["immigrants", "refugees", "foreigners", "natives", "migranten", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"],
    ["disabled", "blind", "deaf", "elderly", "young", "poor", "rich", "behinderte", "handicapés", "discapacitados"],
]


def text_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each row as (flat, first)."""
    w = Words(buf, offsets, NOT_ALNUM)
    rows, hashes = [w.row], [w.h]
    for size in (4, 5, 6):
        at, h = w.prefixes(size)
        rows.append(w.row[at])
        hashes.append(h)
    return distinct(np.concatenate(rows), np.concatenate(hashes), len(offsets) - 1)


def word_features(word: str) -> np.ndarray:
    data = word.encode()
    return text_features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        if len(self.features):
            flat, first = text_features(buf, offsets)
            at = np.searchsorted(self.features, flat)
            at[at == len(self.features)] = 0
            hit = self.features[at] == flat
            row = np.repeat(np.arange(len(z)), np.diff(first))[hit]
            z += np.bincount(row, weights=self.weights[at[hit]], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _term(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)]), NOT_ALNUM).h[0])


def _swapped(buf: np.ndarray, w: Words, row: int, term: np.uint64, other: bytes) -> bytes:
    """The row's text with every mention of the term replaced."""
    lo, hi = w.first[row], w.first[row + 1]
    at = lo + np.flatnonzero(w.h[lo:hi] == term)
    cut = np.concatenate(([w.offsets[row]], w.end[at])), np.concatenate((w.start[at], [w.offsets[row + 1]]))
    return other.join(buf[x:y].tobytes() for x, y in zip(*cut))


def counterfactuals(buf: np.ndarray, offsets: np.ndarray, seed: int = 5) -> list[tuple[int, bytes]]:
    """(row, swapped text): for each identity term that a text mentions as a word, the whole text with that
    term replaced by another of its group, which a hash of the row's text chooses.  No mention is left out."""
    terms = {_term(t): (group, t) for group in IDENTITY_TERMS for t in group}
    w = Words(buf, offsets, NOT_ALNUM)
    at = np.flatnonzero(np.isin(w.h, np.fromiter(terms, np.uint64, len(terms))))
    found = sorted(set(zip(w.row[at].tolist(), w.h[at].tolist())))
    out = []
    for row, h in found:
        group, own = terms[h]
        others = [t for t in group if t != own]
        pick = zlib.crc32(buf[offsets[row] : offsets[row + 1]].tobytes(), seed) + h
        out.append((row, _swapped(buf, w, row, np.uint64(h), others[pick % len(others)].encode())))
    return out


def changes(features: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(row, places lost, places gained) of every counterfactual text, featurised like its original, one at a time."""
    rows, lost, gained = [], [], []
    held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
    for row, swapped in counterfactuals(buf, offsets):
        if held[0] != row:
            own = buf[offsets[row] : offsets[row + 1]]
            held = row, text_features(own, np.array([0, len(own)]))[0]
        other = text_features(np.frombuffer(swapped, np.uint8), np.array([0, len(swapped)]))[0]
        rows.append(row)
        lost.append(np.flatnonzero(np.isin(features, np.setdiff1d(held[1], other))))
        gained.append(np.flatnonzero(np.isin(features, np.setdiff1d(other, held[1]))))
    return np.array(rows, np.int64), lost, gained


def terms_apart(features: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Changes between the bare sentences "a" and "b" for each two terms of a group, which labelled texts may lack."""
    place = lambda word: np.flatnonzero(np.isin(features, word_features(word)))
    out = []
    for group in IDENTITY_TERMS:
        own = [place(t) for t in group]
        out += [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for i, a in enumerate(own) for b in own[i + 1 :]]
    return out


def fit(
    features: np.ndarray,
    rows: np.ndarray,
    cols: np.ndarray,
    y: np.ndarray,
    swapped: list[tuple[np.ndarray, np.ndarray]] = (),
    ridge: float = 1e-5,
    steps: int = 800,
    rate: float = 0.05,
    penalty: float = SWAP_PENALTY,
) -> Model:
    """Adam on the mean logistic loss, a ridge and the mean squared change of log-odds under the swaps.

    ``swapped`` holds (places lost, places gained) of the counterfactual texts; equal changes are added up once.
    """
    n, k = len(y), len(features)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    times: dict[tuple[bytes, bytes], list] = {}
    for lost, gained in [*swapped, *terms_apart(features)] if penalty else []:
        if len(lost) + len(gained):
            times.setdefault((lost.tobytes(), gained.tobytes()), [lost, gained, 0])[2] += 1
    pairs = list(times.values())
    pair = np.repeat(np.arange(len(pairs)), [len(a) + len(c) for a, c, _ in pairs])
    column = np.concatenate([x for a, c, _ in pairs for x in (a, c)]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([x for a, c, _ in pairs for x in (-np.ones(len(a)), np.ones(len(c)))]) if pairs else np.zeros(0)
    weight = np.array([m for _, _, m in pairs], float)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(cols, weights=d[rows], minlength=k) + ridge * w
        if len(pairs):
            change = weight * np.bincount(pair, weights=sign * w[column], minlength=len(pairs))
            g += 2 * penalty / weight.sum() * np.bincount(column, weights=sign * change[pair], minlength=k)
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(features, w, b)


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, penalty: float = SWAP_PENALTY) -> Model:
    """A model from at most ``sample`` labelled rows, chosen by hash of the id."""
    ship(documents.sparkSession)
    rows = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("id")).agg(F.max(label).cast("double").alias("y"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = documents.select(F.col(doc).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("t").alias("t"))  # at most ``sample`` rows
    spark = documents.sparkSession

    def counted(batch, buf, offsets):
        flat, first = text_features(buf, offsets)
        y = batch.column("y").to_numpy()
        ids, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        toxic = np.bincount(at, weights=np.repeat(y, np.diff(first)), minlength=len(ids))
        # the rows' own counts travel as feature 0
        return [np.append(ids, np.uint64(0)).view(np.int64), np.append(toxic, y.sum()), np.append(n, len(y)).astype(np.float64)]

    counts = flat_texts(texts, "t", "feature long, toxic double, n double", counted).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    counts = counts.cache()
    total = counts.where("feature = 0").first()
    if total is None or not 0 < total["toxic"] < total["n"]:
        share = float(total["toxic"] / total["n"]) if total else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    base = float(total["toxic"] / total["n"])
    departure = F.abs(F.col("toxic") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    best = counts.where("feature <> 0").withColumn("z", departure).where(F.col("z") >= DEPARTURE).orderBy(F.desc("z"), "feature").limit(SELECTED).select("feature").collect()
    named = np.concatenate([word_features(t) for group in IDENTITY_TERMS for t in group])
    features = np.unique(np.concatenate([np.array([r[0] for r in best], np.int64).view(np.uint64), named]))
    counts.unpersist()
    sent = spark.sparkContext.broadcast(features)

    def kept(batch, buf, offsets):
        flat, first = text_features(buf, offsets)
        at = np.searchsorted(sent.value, flat)
        at[at == len(sent.value)] = 0
        hit = sent.value[at] == flat
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))[hit]
        # a text's swaps: sizes of what each loses and gains, and the places themselves
        of, lost, gained = changes(sent.value, buf, offsets) if penalty else (np.zeros(0, np.int64), [], [])
        sizes = np.array([[len(a), len(b)] for a, b in zip(lost, gained)], np.int32).reshape(-1, 2)
        flat_places = np.concatenate([np.concatenate(p) for p in zip(lost, gained)]) if len(of) else np.zeros(0, np.int64)
        ends = np.arange(len(first))
        bound = np.searchsorted(of, ends)
        total = np.append(0, np.cumsum(sizes.sum(1)))
        return {
            "x": lists(at[hit].astype(np.int32), np.searchsorted(row, ends), pa.int32()),
            "swap_sizes": lists(sizes.ravel(), 2 * bound, pa.int32()),
            "swap_places": lists(flat_places.astype(np.int32), total[bound], pa.int32()),
        }

    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField(c, ints) for c in ("x", "swap_sizes", "swap_places")]
    got = map_texts(texts, "t", ["id", "y"], fields, kept).toPandas().sort_values("id")
    flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in got[c]]) if len(got) else np.zeros(0, np.int64)
    cut = np.split(flat("swap_places"), np.cumsum(flat("swap_sizes"))[:-1]) if len(flat("swap_sizes")) else []
    return fit(features, np.repeat(np.arange(len(got)), got["x"].map(len).to_numpy()), flat("x"), got["y"].to_numpy(), list(zip(cut[::2], cut[1::2])), penalty=penalty)


def score(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``score``, the probability that a text is toxic."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return map_texts(documents, text, list(documents.columns if keep is None else keep), [T.StructField("score", T.DoubleType())], lambda batch, buf, offsets: {"score": sent.value.score(buf, offsets)})


def remainder(doc: Column, n: int) -> Column:
    return F.crc32(doc.cast("string")) % n


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 3) != 1)
    found = score(docs, learn(docs, labels), keep=["doc_id"])
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
