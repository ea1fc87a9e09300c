"""Operator 3: a quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else is unlabelled web
text, whatever its label says. A small network is fitted by the non-negative
unbiased risk: with prior p, positive risk p R_P(+1) plus max(0, R_U(-1) - p
R_P(-1)). The prior is estimated from the two samples alone, as the least ratio of
unlabelled to positive mass above a score threshold, of a first fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import appended, release, text_chunks

#: Byte classes: lower, upper, digit, space, line end, sentence marks, inner marks, other ASCII, lead and tail bytes.
CLASSES = 10
SHAPE = 7
FEATURES = CLASSES * CLASSES + CLASSES + SHAPE


def _classes() -> np.ndarray:
    kind = np.full(256, 7, np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[32, 9]], kind[[10, 13, 11, 12]] = 3, 4
    kind[[ord(c) for c in ".?"]], kind[[ord(c) for c in ",;:'\"-()"]] = 5, 6
    kind[128:192], kind[192:] = 9, 8
    return kind


KIND = _classes()


def _duplicates(text: bytes) -> tuple[float, float, float]:
    """Shares of repeated lines, of repeated words and of words like the one before."""
    lines, words = text.split(b"\n"), text.split()
    n = max(len(words), 1)
    return 1 - len(set(lines)) / len(lines), 1 - max(len(set(words)), 1) / n, sum(map(eq, words, words[1:])) / n


def features(texts: list[bytes]) -> np.ndarray:
    """One row of shape features for each whole text (zeros for an empty one)."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    kind = KIND[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(n), size)
    one = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    same = owner[1:] == owner[:-1]
    code = ((owner[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:])[same]
    two = np.bincount(code, minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    dup = np.array([_duplicates(t) for t in texts], float).reshape(n, 3)
    total = np.maximum(size, 1)
    gaps = one[:, 3] + one[:, 4]
    shape = np.c_[
        np.log1p(size), dup, np.log1p(size / (gaps + 1)), np.log1p(size / (one[:, 4] + 1)),
        np.minimum(one[:, 1] / np.maximum(one[:, 0] + one[:, 1], 1), 1),
    ]
    shape[size == 0] = 0
    return np.c_[np.sqrt(one / total[:, None]), np.sqrt(two / total[:, None]), shape].astype(np.float32)


@dataclass(frozen=True)
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1
        return np.maximum(h, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float, hidden: int, steps: int, seed: int, decay: float) -> list[np.ndarray]:
    """Adam on the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    size = 512
    for t in range(1, steps + 1):
        xp, xu = p[rng.integers(len(p), size=size)], u[rng.integers(len(u), size=size)]
        x = np.r_[xp, xu]
        h = np.maximum(x @ w[0] + w[1], 0)
        z = h @ w[2] + w[3][0]
        zp, zu = z[:size], z[size:]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * _sigmoid(zp) / size, _sigmoid(zu) / size  # slopes of the two parts of the negative risk
        if negative >= 0:
            gz = np.r_[-prior * _sigmoid(-zp) / size - gp, gu]
        else:  # climb back out of a negative estimate
            gz = np.r_[gp, -gu]
        gh = np.outer(gz, w[2]) * (h > 0)
        grads = [x.T @ gh + decay * w[0], gh.sum(0), h.T @ gz + decay * w[2], np.array([gz.sum()])]
        rate = 3e-3 * (1 - 0.9 * t / steps)
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from both samples' scores.

    Positives make at least p times their own mass above any threshold, so the
    least ratio of masses bounds p from above; thresholds that leave less than
    half of the positives are too noisy to count.
    """
    cuts = np.quantile(np.r_[positive, unlabelled], np.linspace(0.005, 0.995, 199))
    ratios = [1.0]
    for c in cuts:
        if (mass := (positive >= c).mean()) >= 0.5:
            ratios.append((unlabelled >= c).mean() / mass)
    return float(np.clip(min(ratios), 0.05, 0.98))


def fit_network(p: np.ndarray, u: np.ndarray, hidden: int = 16, steps: int = 1500, seed: int = 7) -> Network:
    """Estimate the prior, each half of the samples scored by a fit to the other, then fit the network under it."""
    mean, scale = u.mean(0), u.std(0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    priors = []
    for k in (0, 1):
        if min(len(zp), len(zu)) < 4:
            break
        w = _fit(zp[k::2], zu[k::2], 0.5, hidden, steps // 2, seed, 1e-3)
        priors.append(estimate_prior(*(np.maximum(z[1 - k :: 2] @ w[0] + w[1], 0) @ w[2] for z in (zp, zu))))
    prior = float(np.mean(priors)) if priors else 0.5
    w = _fit(zp, zu, prior, hidden, steps, seed + 1, 1e-4)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def _text_bytes(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _featured(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in text_chunks(batch):
                x = features(_text_bytes(part))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return df.select("text").mapInArrow(run, "x binary")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def train(documents: DataFrame, labels: DataFrame, held_out: Column | None = None, bound: int = 12_000) -> Network:
    """Fit on at most about ``bound`` trusted positives and ``bound`` unlabelled texts.

    Both are drawn by a hash of doc_id from all rows. ``labels`` needs doc_id and
    quality; rows where ``held_out`` (a predicate on doc_id) is true teach no
    label. Without positives, or without documents, the network scores every text
    by the prior 0.5.
    """
    docs = documents.select("doc_id", "text")
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    known = labels.select("doc_id", "quality").where((F.col("quality") == 1) & ~out).select("doc_id").distinct()
    n_known, n_docs = known.count(), docs.count()
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000))
    share = lambda n: F.lit(1_000_000 * min(1.0, bound / max(n, 1)))
    trusted = docs.join(F.broadcast(known.where(draw < share(n_known))), "doc_id", "left_semi")
    web = docs.where(draw < share(n_docs))
    read = lambda df: np.array([np.frombuffer(r.x, np.float32) for r in _featured(df).collect()]).reshape(-1, FEATURES)
    p, u = read(trusted), read(web)
    if not len(p) or not len(u):
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)
    return fit_network(p.astype(float), u.astype(float))


def scored(documents: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """``documents`` with the score of every whole text, from 0 to 1, in one more column.

    Inputs of a score are the text's bytes alone. A null text counts as empty and
    gets the score of an empty one; repeated rows get equal scores; an empty table
    stays empty; a column of that name is overwritten, all others pass as they are.
    Narrow: no shuffle; the network (some 2000 numbers) travels with the tasks.
    """
    return appended(documents, [(column, pa.float64(), T.DoubleType())], lambda part: [network.scores(features(_text_bytes(part)))])


def quality_scores(documents: DataFrame, network: Network) -> DataFrame:
    """doc_id (null stays null) and score of every row; see :func:`scored`."""
    return scored(documents.select("doc_id", "text"), network).select("doc_id", "score")
