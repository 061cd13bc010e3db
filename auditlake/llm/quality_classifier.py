"""A quality classifier fitted by positive-unlabelled learning.

Fitting uses trusted positives (labelled 1, outside the held-out fold), unlabelled web text and an estimated
class prior: a first classifier of positives against unlabelled text orders the sample, the prior is the least
ratio of unlabelled to positive mass above a threshold (best-bin estimate), and the final logistic model
minimises the non-negative unbiased risk  pi R+(P) + max(0, R-(U) - pi R-(P)).  Negative labels are not used.

Both samples are bounded by SAMPLE_ROWS (documented parameter): the rows with the smallest hashes of their
ids, so a fit is repeatable.  Scoring reads every whole text where it lies; nothing is shuffled.

Defined results: null text is empty and gets the score of an empty text; without any positive nothing can be
learned and every score is 1, so nothing is rejected; repeated labels count as often as they occur; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches, read_table

SAMPLE_ROWS = 12_000
STEPS = 800
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

#: Byte classes whose share of a text is a feature.
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "?", ".", ",;:", "|", "#$%&*@^~+=_", "<>{}[]()/\\", "'\"`-", " ", "\t\n\r"]
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _chars in enumerate(_CLASSES):
    _TABLE[[ord(c) for c in _chars], _k] = 1
_TABLE[128:, -1] = 1
N_FEATURES = _TABLE.shape[1] + 9


def features(text: str) -> np.ndarray:
    """Shape of a text: shares of byte classes, repetition, word lengths; log-scaled where rates are small."""
    raw = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _TABLE / max(1, len(raw))
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    distinct = len(set(words))
    repeated = sum(map(eq, words, words[1:])) / max(1, n - 1)
    expected = n**0.75 if n else 1.0
    odd_ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / max(1, n)
    rest = [np.log1p(100 * repeated), np.log(max(1, distinct) / expected), np.log1p(100 * odd_ends), np.log1p(n), np.log1p(len(raw) / max(1, n)), np.log1p(max(map(len, words), default=0)), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(10 * sum(len(w) == 1 for w in words) / max(1, n))]
    return np.concatenate([np.log1p(200 * shares), rest])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: The model when there is no positive: it rejects nothing.
ACCEPT_ALL = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 40.0, 1.0)


def _descend(gradient, n: int) -> tuple[np.ndarray, float]:
    """Adam on n weights and a bias."""
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        g = gradient(theta[:-1], theta[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a threshold, with room for sampling error."""
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    slack = np.sqrt(np.log(2 / 0.1) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    q_p, q_u = above(p), above(u)
    best = int(np.argmin((q_u + slack) / np.maximum(q_p, 1e-9)))
    return float(np.clip(q_u[best] / max(q_p[best], 1e-9), 0.02, 0.98))


def fit_rows(p: np.ndarray, u: np.ndarray, decay: float = 1e-3) -> Model:
    """nnPU logistic regression of feature rows."""
    if not len(p):
        return ACCEPT_ALL
    if not len(u):
        u = p
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = np.clip((p - mean) / scale, -8, 8), np.clip((u - mean) / scale, -8, 8)

    def plain(w, b):  # positives against unlabelled, equal weight
        a, c = _sigmoid(p @ w + b) - 1, _sigmoid(u @ w + b)
        return np.append(p.T @ a / len(p) + u.T @ c / len(u) + decay * w, a.mean() + c.mean())

    w0, b0 = _descend(plain, p.shape[1])
    prior = estimate_prior(p @ w0 + b0, u @ w0 + b0)

    def risk(w, b):
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = np.append(u.T @ su / len(u) - prior * (p.T @ sp) / len(p), su.mean() - prior * sp.mean())
        if negative < 0:
            return -g_neg
        g_pos = np.append(p.T @ (sp - 1) / len(p), (sp - 1).mean())
        return prior * g_pos + g_neg + decay * np.append(w, 0)

    weights, bias = _descend(risk, p.shape[1])
    return Model(mean, scale, weights, bias, prior)


def fold(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _features_of(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts]).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows positives and as many unlabelled documents; held-out rows take no part."""
    ids = docs.select(F.col("doc_id").cast("long").alias("sample_id")).where(F.coalesce(fold(F.col("sample_id")) != HELD_OUT, F.lit(False)))
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("sample_id")).where(fold(F.col("sample_id")) != HELD_OUT)
    order = F.xxhash64("sample_id")
    chosen = trusted.orderBy(order, "sample_id").limit(sample_rows).withColumn("positive", F.lit(True))
    chosen = chosen.unionByName(ids.orderBy(order, "sample_id").limit(sample_rows).withColumn("positive", F.lit(False)))

    @F.arrow_udf("array<double>")
    def featurise(texts: pa.Array) -> pa.Array:
        x = _features_of(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))

    # Broadcast: at most 2 * sample_rows ids.
    found = docs.select(F.col("doc_id").cast("long").alias("sample_id"), "text").join(F.broadcast(chosen), "sample_id")
    with bounded_batches(docs.sparkSession):
        rows = found.select("positive", featurise(F.col("text")).alias("x")).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    positive = np.array(rows["positive"].to_pylist(), bool)
    x, positive = (a[np.lexsort((*x.T, positive))] for a in (x, positive))  # row order does not matter
    return fit_rows(x[positive], x[~positive])


def score_column(model: Model, text: F.Column) -> F.Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_features_of(texts)) if len(texts) else np.empty(0))

    return score(text)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
