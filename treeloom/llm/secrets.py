"""Secret scans: base patterns plus a character convolutional network over candidates.

Candidates are the base matches and every run of ``[A-Za-z0-9+/_=.-]`` of 16 or more
characters, whatever it is made of; of a run that overlaps base matches, each part outside
them that is as long.  The network reads 48 characters of a candidate with 24 before and 8
after them, every ``STRIDE`` characters up to the candidate's end, and the greatest score is the
candidate's.  It scores base matches as well.  The network: embedding, two convolution widths, max pooling,
one logistic unit, all in numpy.  It is trained on labelled findings that a seeded generator
writes (keys, tokens and connection strings against words, addresses, versions, paths,
dates and identifiers) and on findings of the documents themselves: base matches are secrets,
and runs that a rule knows for words, numbers or names joined by marks are not (``review``); at most
``REAL`` of each, the least by a hash of their window, are taken.  Scores are calibrated by Platt
scaling on findings held out from training, generated and real, and the threshold is the
highest that keeps ``recall`` of the held-out secrets.  Base matches always stay.

Defined cases: null text is empty; an empty text has no span; spans are code points, end
exclusive; repeated rows stay separate rows; columns that share a name with a result are
replaced.  Texts are searched whole, and a candidate of any length is one candidate.
"""

from __future__ import annotations

import random
import re
import string
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.kernel import LOWER, flat_texts, map_texts
from treeloom.runtime import spread

#: The base patterns of the contract.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = 16
#: Findings of either label that are taken from the documents.
REAL = 2000
#: A run made of words, of short numbers, or of digits alone.
PLAIN = re.compile(rb"(?:[0-9]+|(?:[A-Za-z]+|[0-9]{1,4})(?:[+/_=.-]+(?:[A-Za-z]+|[0-9]{1,4}))*[+/_=.-]*)")

BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Characters between two windows of a candidate, and windows scored at once.
STRIDE, AT_ONCE = 16, 8192
EMBED, FILTERS, SPANS = 12, 24, (3, 5)

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def _classes() -> np.ndarray:
    """Bytes to 40 character classes; 0 is padding.  Letters keep their identity without case, which has a class bit of its own."""
    out = np.full(256, 39, np.int64)
    for i, c in enumerate(string.ascii_lowercase):
        out[ord(c)] = 1 + i
    for c in string.ascii_uppercase:
        out[ord(c)] = 27
    for c in string.digits:
        out[ord(c)] = 28
    for i, c in enumerate(" =:\"'._-/+"):
        out[ord(c)] = 29 + i
    return out


CLASS = _classes()


def window(data: bytes, start: int, end: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    before = CLASS[np.frombuffer(data[max(0, start - BEFORE) : start], np.uint8)]
    inside = CLASS[np.frombuffer(data[start : min(end, start + INSIDE)], np.uint8)]
    after = CLASS[np.frombuffer(data[end : end + AFTER], np.uint8)]
    out[BEFORE - len(before) : BEFORE] = before
    out[BEFORE : BEFORE + len(inside)] = inside
    out[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = after
    return out


def starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin; the last one reaches its end."""
    last = max(start, end - INSIDE)
    return [*range(start, last, STRIDE), last]


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no span covers."""
    parts = []
    for a, b in sorted(spans):
        if a > start:
            parts.append((start, min(a, end)))
        start = max(start, b)
        if start >= end:
            return parts
    return [*parts, (start, end)]


class CharCNN:
    """Embedding -> convolutions -> ReLU -> max over positions -> logistic unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (40, EMBED)), "o": r.normal(0, 0.1, FILTERS * len(SPANS)), "c": np.zeros(1)}
        for k in SPANS:
            self.p[f"w{k}"] = r.normal(0, (k * EMBED) ** -0.5, (k * EMBED, FILTERS))
            self.p[f"b{k}"] = np.zeros(FILTERS)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["e"][x]
        e[x == 0] = 0
        parts, caches = [], []
        for k in SPANS:
            n = WIDTH - k + 1
            cols = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), n, k * EMBED)
            a = cols @ self.p[f"w{k}"] + self.p[f"b{k}"]
            at = a.argmax(1)
            top = np.take_along_axis(a, at[:, None], 1)[:, 0]
            parts.append(np.maximum(top, 0))
            caches.append((cols, at, top > 0))
        h = np.concatenate(parts, 1)
        return h, h @ self.p["o"] + self.p["c"][0], caches

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 1024])[1] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                b = order[i : i + 64]
                h, z, caches = self._forward(x[b])
                d = (1 / (1 + np.exp(-z)) - y[b]) / len(b)
                g = {"o": h.T @ d, "c": np.array([d.sum()]), "e": np.zeros_like(self.p["e"])}
                dh = d[:, None] * self.p["o"]
                for j, k in enumerate(SPANS):
                    cols, at, on = caches[j]
                    dt = dh[:, j * FILTERS : (j + 1) * FILTERS] * on
                    rows = np.arange(len(b))[:, None]
                    picked = cols[rows, at]  # batch, filter, k * embed
                    g[f"w{k}"] = np.einsum("bfd,bf->df", picked, dt)
                    g[f"b{k}"] = dt.sum(0)
                    de = (dt[:, :, None] * self.p[f"w{k}"].T).reshape(len(b), FILTERS, k, EMBED)
                    ids = x[b][rows[:, :, None], at[:, :, None] + np.arange(k)]
                    np.add.at(g["e"], ids.reshape(-1), de.reshape(-1, EMBED))
                step += 1
                for key in self.p:
                    m[key] = 0.9 * m[key] + 0.1 * g[key]
                    v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
                    self.p[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, precision: float) -> dict[str, float]:
        """Platt scaling by Newton steps, then the threshold; returns what was reached."""
        z = self.logits(x)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 0.5, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - t) * z).sum() + 5.0 * (a - 0.5), (p - t).sum()])
            hess = np.array([[(w * z * z).sum() + 5.0, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
        self.scale, self.shift = float(a), float(b)
        s = self.scores(x)
        sure = np.sort(s[y > 0])
        self.threshold = float(sure[int((1 - recall) * len(sure))])
        passed = s >= self.threshold
        reached = {"recall": float(passed[y > 0].mean()), "precision": float(y[passed].mean())}
        if reached["precision"] < precision:
            warnings.warn(f"the network passes much at recall {recall}: {reached}", stacklevel=2)
        return reached


def findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings: windows around generated secrets and around look-alikes."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: "".join(r.choice(["the", "er", "on", "ing", "sh", "que", "ción", "ver", "ung", "ti", "a", "re", "en", "ou", "st"]) for _ in range(r.randint(1, 4)))
    b64 = string.ascii_letters + string.digits + "+/"
    secrets = [
        lambda: pick("0123456789abcdef", r.choice([18, 24, 32, 40, 64])),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: r.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "pk_live_", "AIza", "hf_", "npm_"]) + pick(string.ascii_letters + string.digits, r.randint(20, 40)),
        lambda: "eyJ" + pick(b64, 20) + "." + pick(b64, 40) + "." + pick(b64, 30),
        lambda: pick(b64, r.choice([22, 32, 40, 44])) + r.choice(["", "=", "=="]),
        lambda: pick(string.ascii_letters + string.digits, r.randint(20, 44)),
    ]
    plain = [
        lambda: f"{word()}.{word()}{r.randint(1, 99)}-{word()}{r.randint(1950, 2030)}_{word()}",
        lambda: f"www.{word()}{r.randint(1, 99)}.{word()}.com/{word()}/{word()}-{word()}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}",
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{r.choice(['alpha', 'beta', 'release', 'candidate'])}.{r.randint(1, 9)}-{word()}",
        lambda: f"/{word()}/{word()}{r.randint(1, 99)}/{word()}/{word()}.{r.choice(['txt', 'html', 'py', 'jpg'])}",
        lambda: f"{word()}.{word()}{r.randint(1, 999)}.example.{r.choice(['com', 'org', 'net'])}",
        lambda: f"{word()}{word()}{word()}{r.randint(1, 9)}{word()}{word()}",
        lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{pick(string.digits, 20)}",
        lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}x{r.randint(10, 99)}",
        lambda: "=" * r.randint(3, 9) + f"{word()}{r.randint(1, 99)}" + "=" * r.randint(8, 20),
        lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 99)}_{word()}",
        lambda: "".join(word() for _ in range(6)),
        lambda: "".join(word() for _ in range(6)).upper(),
        lambda: pick(string.digits, r.randint(16, 20)),
        lambda: pick("abcdefgh", 3) + "".join(r.choice([word(), str(r.randint(0, 9))]) for _ in range(8)),
    ]
    lead = ["password=", "token = \"", "api_key: ", "secret='", "Authorization: Bearer ", "key=", "", "", "", "export TOKEN=", "id "]
    xs, ys = [], []
    for i in range(n):
        y = i % 2
        made = r.choice(secrets if y else plain)()
        while len(made) < CANDIDATE:
            made += r.choice([word(), str(r.randint(10, 99))]) if not y else pick("0123456789abcdef", 6)
        before = " ".join(word() for _ in range(4)) + " " + (r.choice(lead) if y or r.random() < 0.1 else r.choice(["", "", "see ", "at ", "https://", "<"]))
        after = r.choice([" ", "\" ", "' ", ", ", ". "]) + word()
        data = (before + made + after).encode()
        start = len(before.encode())
        xs.append(window(data, start, start + len(made.encode())))
        ys.append(y)
    return np.array(xs), np.array(ys, float)


def trained(recall: float = 0.98, precision: float = 0.98, examples: int = 6000, real: tuple[np.ndarray, np.ndarray] | None = None) -> CharCNN:
    """A network fitted on generated findings and half of the ``real`` ones, calibrated on others and the other half."""
    net = CharCNN()
    x, y = findings(examples, 1)
    held_x, held_y = findings(examples // 2, 2)
    if real is not None and len(real[0]):
        x, y = np.concatenate([x, real[0][::2]]), np.concatenate([y, real[1][::2]])
        held_x, held_y = np.concatenate([held_x, real[0][1::2]]), np.concatenate([held_y, real[1][1::2]])
    net.fit(x, y)
    net.reached = net.calibrate(held_x, held_y, recall, precision)
    return net


def review(run: bytes) -> bool:
    """Whether a run is known to be no secret: words, numbers, or names joined by marks."""
    return PLAIN.fullmatch(run) is not None and len(set(run)) > 1


def labelled(documents: DataFrame, text: str = "text", most: int = REAL) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of findings in the documents: at most ``most`` of either label, the least by hash.

    A secret's window is kept without its context as often as with it, so that the value itself counts.
    """

    def found(batch, buf, offsets):
        whole = buf.tobytes()
        rows: dict[bytes, int] = {}
        for a, b in zip(*_stretches(_RUN[buf], offsets, CANDIDATE)):
            a, b = int(a), int(b)
            if review(whole[a:b]):
                r = int(np.searchsorted(offsets, a, side="right")) - 1
                rows[window(whole[offsets[r] : offsets[r + 1]], a - int(offsets[r]), b - int(offsets[r])).astype(np.uint8).tobytes()] = 0
        for a, b in zip(*_stretches(_HEX[buf], offsets, LEAST["hex"])):
            a, b = int(a), int(b)
            r = int(np.searchsorted(offsets, a, side="right")) - 1
            full = window(whole[offsets[r] : offsets[r + 1]], a - int(offsets[r]), b - int(offsets[r]))
            rows[full.astype(np.uint8).tobytes()] = 1
            full[:BEFORE] = full[BEFORE + INSIDE :] = 0
            rows[full.astype(np.uint8).tobytes()] = 1
        return [pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.int32())]

    seen = flat_texts(documents.select(F.col(text).alias("t")), "t", "w binary, y int", found)
    least = lambda y: seen.where(F.col("y") == y).distinct().orderBy(F.xxhash64("w"), "w").limit(most).select("w").collect()  # noqa: E731  at most ``most`` windows
    secret, plain = least(1), least(0)
    x = [np.frombuffer(r[0], np.uint8).astype(np.int64) for r in [*secret, *plain]]
    # labels take turns, so that each half of them holds both
    y = np.array([1.0] * len(secret) + [0.0] * len(plain))
    order = np.argsort(np.concatenate([np.arange(len(secret)), np.arange(len(plain))]) // 2, kind="stable")
    return (np.array(x)[order], y[order]) if x else (np.zeros((0, WIDTH), np.int64), y)


_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_RUN = np.isin(np.arange(256), list((string.ascii_letters + string.digits + "+/_=.-").encode()))


def _stretches(on: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` bytes that do not cross rows."""
    if not len(on):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = on.copy()
    begin[1:] &= ~on[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(on)]
    begin[edges] = on[edges]
    stop = on.copy()
    stop[:-1] &= ~on[1:]
    inner = edges[edges > 0] - 1
    stop[inner] = on[inner]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= least
    return a[long], b[long]


def scan(net: CharCNN, buf: np.ndarray, offsets: np.ndarray) -> dict:
    rows = len(offsets) - 1
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in range(rows)]
    hex_a, hex_b = _stretches(_HEX[buf], offsets, LEAST["hex"])
    for r, a, b in zip(np.searchsorted(offsets, hex_a, side="right") - 1, hex_a, hex_b):
        found[r].append((int(a - offsets[r]), 2, int(b - offsets[r]), 1.0))
    run_a, run_b = _stretches(_RUN[buf], offsets, CANDIDATE)
    lowered = LOWER[buf].tobytes()
    whole = buf.tobytes()
    value: dict[tuple[int, int], int] = {}  # where the value of an assignment begins
    assign = any(h in lowered for h in HINTS)
    access = b"AKIA" in whole
    for r in range(rows if assign or access else 0):
        a, b = int(offsets[r]), int(offsets[r + 1])
        if assign and any(lowered.find(h, a, b) >= 0 for h in HINTS):
            for m in ASSIGN.finditer(whole[a:b]):
                if len(m[2]) >= LEAST["assign"]:
                    found[r].append((m.start(), 0, m.end(), 1.0))
                    value[r, m.start()] = m.start(2)
        if access and whole.find(b"AKIA", a, b) >= 0:
            found[r].extend((m.start(), 1, m.end(), 1.0) for m in ACCESS.finditer(whole[a:b]) if m.end() - m.start() >= LEAST["access"])
    # every candidate is asked: the base matches, and the runs without them
    asked = [(r, value.get((r, a), a) if k == 0 else a, b, i) for r in range(rows) for i, (a, k, b, _) in enumerate(found[r])]
    for r, a, b in zip((np.searchsorted(offsets, run_a, side="right") - 1).tolist(), run_a.tolist(), run_b.tolist()):
        x, y = a - int(offsets[r]), b - int(offsets[r])
        base = [(s, e) for s, _, e, _ in found[r] if s < y and x < e]
        for p, q in outside(x, y, base) if base else [(x, y)]:
            if q - p >= CANDIDATE:
                asked.append((r, p, q, -1))
    best = np.zeros(len(asked))
    held: list[tuple[int, np.ndarray]] = []

    def judge() -> None:
        if held:
            np.maximum.at(best, [i for i, _ in held], net.scores(np.array([w for _, w in held])))
            held.clear()

    texts = {r: whole[offsets[r] : offsets[r + 1]] for r in {r for r, *_ in asked}}
    for i, (r, x, y, _) in enumerate(asked):
        for at in starts(x, y):
            held.append((i, window(texts[r], at, min(y, at + INSIDE))))
            if len(held) >= AT_ONCE:
                judge()
    judge()
    for (r, x, y, i), s in zip(asked, best.tolist()):
        if i >= 0:
            found[r][i] = (*found[r][i][:3], s)
        elif s >= net.threshold:
            found[r].append((x, 3, y, s))
    spans = []
    for r in range(rows):
        own = sorted(found[r])
        if own:
            data = whole[offsets[r] : offsets[r + 1]]
            where, at, points = {}, 0, 0
            for mark in sorted({x for s in own for x in (s[0], s[2])}):
                points += len(data[at:mark].decode("utf-8", "replace"))
                at = mark
                where[mark] = points
            spans.append([{"kind": KINDS[k], "start": where[a], "end": where[b], "score": s} for a, k, b, s in own])
        else:
            spans.append([])
    return {"secrets": pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))}


def find_secrets(documents: DataFrame, text: str = "text", keep: list[str] | None = None, net: CharCNN | None = None) -> DataFrame:
    """``keep`` columns with ``secrets``: kind, start, end (code points) and score of each finding, by start."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(net or trained(real=labelled(documents, text)))
    return map_texts(documents, text, list(documents.columns if keep is None else keep), [T.StructField("secrets", T.ArrayType(SPAN))], lambda batch, buf, offsets: scan(sent.value, buf, offsets))


def mask(text: F.Column, secrets: F.Column) -> F.Column:
    """The text with each finding replaced by ``<secret>``; overlapping findings are one."""
    put = F.aggregate(
        secrets,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<secret>"))).alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return F.when(F.size(secrets) > 0, put).otherwise(text)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
