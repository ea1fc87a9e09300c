"""Operator 7: toxic spans and scores by a linear-chain conditional random field.

Two tags, clean and toxic. Tokens of training texts are labelled: toxic where the
text is labelled toxic and the word is far likelier in toxic texts than in others,
else clean. A word's feature is the word itself or one of its beginnings (inflected and
compound forms share these), whichever tells most. The weights of learnt features, the
toxic tag's bias and the tag transitions are fitted together by gradient ascent on the
conditional likelihood: observed minus expected counts, the latter from forward-backward
over all chains at once. Words without weights all share one factor, so a run of k of
them is one matrix power; the recursions visit only words with weights and stay exact.
Scoring runs the same recursions over the whole text. Marginals give the offending
offsets, and a logistic link over them, fitted on the same training texts, the
document's score.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_chunks, texts_of

WORD = re.compile(r"\w+")
#: Letters of the shortest and of the longest beginning that is a feature.
HEAD, LONGEST = 4, 8
#: What a feature must tell for its words to count as toxic in toxic texts.
TOXIC_EVIDENCE = 24.0


def parts(word: str) -> list[str]:
    """The feature names of a word: itself, and its beginnings with a star."""
    return [word, *(word[:k] + "*" for k in range(HEAD, min(LONGEST, len(word) - 1) + 1))]


def lowered(text: str) -> list[str]:
    """The lower-cased words of a text, one for each word of the text as it stands."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


@dataclass(frozen=True)
class Field:
    """A fitted field: feature weights by tag, bias, transitions, the document link, and how much each feature tells."""

    weights: dict[str, float]
    bias: float
    transition: np.ndarray
    link: np.ndarray
    evidence: dict[str, float] = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "_heads", {f[:HEAD] for f in self.weights})
        # Psi[a, b]: going from tag a to tag b at a word without a weight of its own.
        psi = np.exp(self.transition + np.array([0.0, self.bias]))
        values, vectors = np.linalg.eig(psi / psi.sum())
        object.__setattr__(self, "_psi", psi / psi.sum())
        object.__setattr__(self, "_eigen", (np.real(values), np.real(vectors), np.real(np.linalg.inv(vectors))))

    def _power(self, vector: np.ndarray, k: int, left: bool) -> np.ndarray:
        """vector times the plain factor to the k-th power (or the other way), scaled to sum 1."""
        if k > 0:
            values, v, inverse = self._eigen
            top = np.abs(values).max()
            m = (v * (values / top) ** k) @ inverse
            vector = np.maximum(vector @ m if left else m @ vector, 1e-300)
        return vector / vector.sum()

    def marginals(self, at: list[int], weight: list[float], n: int) -> np.ndarray:
        """P(toxic) at the positions ``at`` of a chain of n tokens, by forward-backward."""
        k = len(at)
        fore, back = np.empty((k, 2)), np.empty((k, 2))
        state, before = np.array([1.0, 0.0]), -1  # a clean tag stands before the text
        for i in range(k):
            state = self._power(state, at[i] - before - 1, True) @ self._psi * np.array([1.0, np.exp(weight[i])])
            state = state / state.sum()
            fore[i], before = state, at[i]
        state, after = np.ones(2), n
        for i in range(k - 1, -1, -1):
            state = self._power(state, after - at[i] - 1, False)
            back[i], after = state, at[i]
            state = self._psi @ (state * np.array([1.0, np.exp(weight[i])]))
            state = state / state.sum()
        p = fore * back
        return p[:, 1] / p.sum(1)

    def features(self, words: list[str]) -> tuple[list[int], list[str]]:
        """The places of words that have a feature with a weight, and the most telling one of each."""
        at, names, heads = [], [], self._heads
        for i, w in enumerate(words):
            if w[:HEAD] in heads:
                known = [p for p in parts(w) if p in self.weights]
                if known:
                    at.append(i)
                    names.append(max(known, key=lambda p: self.evidence.get(p, 0.0)))
        return at, names

    def link_inputs(self, marginals: np.ndarray, n: int) -> np.ndarray:
        """What the document link reads: a constant, the highest marginal, their damped sum and density in n words."""
        if not len(marginals):
            return np.array([1.0, 0.0, 0.0, 0.0])
        total = marginals.sum()
        return np.array([1.0, marginals.max(), np.log1p(total), np.log1p(200 * total / (n + 50))])

    def read(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and (start, end, marginal) of its toxic words."""
        words = lowered(text)
        at, names = self.features(words)
        m = self.marginals(at, [self.weights[f] for f in names], len(words)) if at else np.zeros(0)
        score = 1 / (1 + np.exp(-np.clip(self.link_inputs(m, len(words)) @ self.link, -30, 30)))
        spans = []
        if (m > 0.5).any():
            hot = {i: float(x) for i, x in zip(at, m, strict=True) if x > 0.5}
            spans = [(w.start(), w.end(), hot[i]) for i, w in enumerate(WORD.finditer(text)) if i in hot]
        return float(score), spans


def telling(texts: list[list[str]], toxic: list[bool], least: float) -> dict[str, float]:
    """Features that tell toxic texts from clean ones, and by how much.

    Their odds there are above e^1.5 times those in clean texts, and twice the log
    likelihood ratio against equal odds, which is the evidence, is above ``least``.
    """
    bad, good = Counter(), Counter()
    for words, t in zip(texts, toxic, strict=True):
        (bad if t else good).update({p for w in set(words) for p in parts(w)})
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    base, out = n1 / max(1, n1 + n0), {}
    for f, c in bad.items():
        if c < 3 or not n0:
            continue
        g, share = good[f], c / (c + good[f])
        ratio = 2 * (c * np.log(share / base) + (g * np.log((1 - share) / (1 - base)) if g else 0.0))
        if (c / n1) / ((g + 0.1) / n0) > np.exp(1.5) and ratio > least:
            out[f] = float(ratio)
    return out


def without_copies(texts: list[str], most: float = 0.3) -> list[int]:
    """Places of the texts that do not repeat others: under ``most`` of a sample of their 5-word runs came before."""
    seen, keep = set(), []
    for i, t in enumerate(texts):
        words = lowered(t)
        runs = {zlib.crc32(" ".join(words[j : j + 5]).encode()) for j in range(max(1, len(words) - 4))}
        runs = {r for r in runs if r % 8 == 0} or runs
        if len(runs & seen) <= most * len(runs):
            keep.append(i)
        seen |= runs
    return keep


class Chains:
    """Labelled chains as padded arrays, those with most weighted words first."""

    def __init__(self, chains: list[tuple[list[int], list[int], np.ndarray, int]]):
        """Each chain: places of its weighted words, their features' numbers, their tags, and its length in words."""
        chains = sorted(chains, key=lambda c: -len(c[0]))
        self.k = np.array([len(c[0]) for c in chains])
        shape = (len(chains), int(self.k.max(initial=0)))
        self.feature, self.gap, self.tag = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        self.tail, self.n = np.zeros(len(chains)), np.array([float(c[3]) for c in chains])
        self.seen = np.zeros((2, 2))  # observed transitions; words without weights are clean
        for c, (at, features, tags, n) in enumerate(chains):
            k, places = len(at), np.array([-1, *at])
            self.feature[c, :k], self.tag[c, :k], self.gap[c, :k] = features, tags, np.diff(places) - 1
            self.tail[c] = n - at[-1] - 1 if k else n
            gaps, last = np.r_[self.gap[c, :k], self.tail[c]], np.r_[0, tags].astype(int)
            np.add.at(self.seen, (last[gaps > 0], 0), 1)
            self.seen[0, 0] += np.maximum(gaps - 1, 0).sum()
            np.add.at(self.seen, (np.where(gaps[:-1] > 0, 0, last[:-1]), last[1:]), 1)
        self.active = [int((self.k > i).sum()) for i in range(shape[1])]

    def slopes(self, weights: np.ndarray, bias: float, transition: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """The conditional log likelihood and its slopes by weights, bias and transitions."""
        psi = np.exp(transition + np.array([0.0, bias]))
        values, v = map(np.real, np.linalg.eig(psi))
        inverse, top = np.real(np.linalg.inv(v)), np.abs(values).max()
        d = values / top
        extra = np.exp(weights)
        log_z, expected = self.n * 0.0, np.zeros((2, 2))
        power = lambda g: d[None, :] ** g[:, None]

        def within(f: np.ndarray, b: np.ndarray, g: np.ndarray) -> None:
            """Add the expected transitions of runs of g plain words between forward f and backward b."""
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(g[:, None] > 0, g[:, None] * d[None, :] ** np.maximum(g - 1, 0)[:, None], 0.0)
                cross = (d[0] ** g - d[1] ** g) / (d[0] - d[1])
            s = np.stack([np.stack([own[:, 0], cross], 1), np.stack([cross, own[:, 1]], 1)], 1)
            p, q = f @ v, b @ inverse.T
            total = (p * power(g) * q).sum(1)
            m = np.einsum("c,cp,cpq,cq->pq", (g > 0) / total, p, s, q)
            expected[:] += psi / top * (inverse.T @ m @ v.T)

        state = np.tile([1.0, 0.0], (len(self.k), 1))  # a clean tag stands before the text
        before, middle, fore = [], [], []
        for i, a in enumerate(self.active):
            before.append(state[:a].copy())
            mid = (state[:a] @ v * power(self.gap[:a, i])) @ inverse
            phi = np.c_[np.ones(a), extra[self.feature[:a, i]]]
            new = mid @ psi * phi
            scale = new.sum(1)
            log_z[:a] += np.log(scale) + self.gap[:a, i] * np.log(top)
            state[:a] = new / scale[:, None]
            middle.append(mid)
            fore.append(state[:a].copy())
        back = (power(self.tail) * inverse.sum(1)) @ v.T
        log_z += np.log((state * back).sum(1)) + self.tail * np.log(top)
        within(state, np.ones_like(state), self.tail)
        slope = np.zeros(len(weights))
        for i in range(len(self.active) - 1, -1, -1):
            a = self.active[i]
            phi = np.c_[np.ones(a), extra[self.feature[:a, i]]]
            after = back[:a] * phi
            p = fore[i] * back[:a]
            slope += np.bincount(self.feature[:a, i], self.tag[:a, i] - p[:, 1] / p.sum(1), len(weights))
            edge = middle[i][:, :, None] * psi * after[:, None, :]
            expected += (edge / edge.sum((1, 2))[:, None, None]).sum(0)
            come = after @ psi.T
            come /= come.sum(1)[:, None]
            within(before[i], come, self.gap[:a, i])
            back[:a] = (come @ inverse.T * power(self.gap[:a, i])) @ v.T
            back[:a] /= back[:a].sum(1)[:, None]
        on = self.feature >= 0
        score = weights[self.feature[on]] @ self.tag[on] + bias * self.seen[:, 1].sum() + (transition * self.seen).sum()
        d_pair = self.seen - expected
        return float(score - log_z.sum()), slope, float(d_pair[:, 1].sum()), d_pair


def fit_field(texts: list[str], toxic: list[bool], share: float | None = None, rounds: int = 40, rate: float = 2.0) -> Field:
    """Label tokens, then fit the field and the link.

    Features with evidence of a third of what a toxic label takes have weights; all
    other words share the plain factor. ``share`` is that of toxic texts among all
    labelled ones, if the given texts hold more of them; the link answers to it.
    """
    words = [lowered(t) for t in texts]
    if not any(toxic):
        return Field({}, 0.0, np.array([[2.0, -2.0], [0.0, 0.0]]), np.array([-5.0, 0.0, 0.0, 0.0]))
    # Features as usual in clean texts as in toxic ones carry no evidence and stay plain.
    evidence = telling(words, toxic, TOXIC_EVIDENCE / 3)
    chooser = Field(dict.fromkeys(evidence, 0.0), 0.0, np.zeros((2, 2)), np.zeros(4), evidence)
    found = [chooser.features(ws) for ws in words]
    names = sorted({f for _, fs in found for f in fs})
    number = {f: i for i, f in enumerate(names)}
    evidence = {f: evidence[f] for f in names}
    chains = Chains([
        (at, [number[f] for f in fs], np.array([float(t and evidence[f] > TOXIC_EVIDENCE) for f in fs]), len(ws))
        for ws, t, (at, fs) in zip(words, toxic, found, strict=True)
    ])
    # Ascent starts at the counted transitions (one added); each parameter has its own step length.
    counted = chains.seen + 1.0
    w, bias, transition = np.zeros(len(names)), 0.0, np.log(counted / counted.sum(1, keepdims=True))
    step, step_b, step_t = np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    best = (-np.inf, w, bias, transition)
    for _ in range(rounds):
        value, g, g_b, g_t = chains.slopes(w, bias, transition)
        value -= 0.025 * (w @ w + bias**2 + (transition**2).sum())
        if value > best[0]:
            best = (value, w, bias, transition)
        g, g_b, g_t = g - 0.05 * w, g_b - 0.05 * bias, g_t - 0.05 * transition
        step, step_b, step_t = step + g * g, step_b + g_b * g_b, step_t + g_t * g_t
        w = w + rate * g / step**0.5
        bias, transition = bias + 0.1 * rate * g_b / step_b**0.5, transition + 0.1 * rate * g_t / step_t**0.5
    _, w, bias, transition = best
    weights = dict(zip(names, w.tolist(), strict=True))
    field = Field(weights, bias, transition, np.zeros(4), evidence)
    rows = [
        field.link_inputs(field.marginals(at, [weights[f] for f in fs], len(ws)) if at else np.zeros(0), len(ws))
        for ws, (at, fs) in zip(words, found, strict=True)
    ]
    x, y = np.array(rows), np.array(toxic, float)
    share = y.mean() if share is None else share
    each = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) if 0 < y.mean() < 1 else np.ones(len(y))
    link = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(each @ (np.logaddexp(0, z) - y * z) + 0.05 * w @ w)

    for _ in range(40):  # Newton steps of a ridge-logistic fit, halved while they do harm
        p = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        grad = x.T @ (each * (y - p)) - 0.1 * link
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(link))
        move = np.linalg.solve(hess, grad)
        while loss(link + move) > loss(link) and np.abs(move).max() > 1e-6:
            move = move / 2
        link = link + move
    return Field(weights, bias, transition, link, evidence)


def train(documents: DataFrame, labels: DataFrame, held_out: Column | None = None, bound: int = 5000, longest: int = 16_384) -> Field:
    """Fit on at most about ``bound`` labelled texts of at most ``longest`` letters, half of them toxic if there are as many.

    Drawn by a hash of doc_id; so the driver receives a bounded number of bytes. ``labels`` needs doc_id and toxic; rows where
    ``held_out`` (a predicate on doc_id) is true teach nothing. Without toxic
    texts every score is near 0.
    """
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1_000_000))
    share = lambda t: 1_000_000 * min(1.0, bound / 2 / max(count.get(t, 0), 1))
    drawn = known.where(draw < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))
    # About ``bound`` narrow rows: sent to the documents instead of shuffling these.
    fit = documents.select("doc_id", "text").where(F.length("text").between(1, longest))
    # Repeated ids could multiply the rows; the limit holds whatever happens.
    rows = fit.join(F.broadcast(drawn), "doc_id").orderBy(draw, F.xxhash64("text")).limit(bound + bound // 5).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    # Copies would make every word of theirs look telling.
    rows = [rows[i] for i in without_copies([r.text for r in rows])]
    share = count.get(1, 0) / max(1, sum(count.values()))
    return fit_field([r.text for r in rows], [bool(r.toxic) for r in rows], share)


def toxicity(documents: DataFrame, field: Field) -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1), spans (start, end, marginal) of toxic words.

    Offsets count code points. Only the text is an input. A null text counts as
    empty and gets the score of a text without toxic words, and no spans; a null
    doc_id stays null; repeated rows get equal scores; an empty table gives none;
    other columns are left alone, whatever their names. Narrow: no shuffle; the
    field's weights, bounded by the training sample, travel with the tasks.
    """
    kind = dict(documents.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                read = [field.read(t) for t in texts_of(part)]
                spans = [[{"start": a, "end": b, "marginal": m} for a, b, m in s] for _, s in read]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s for s, _ in read], pa.float64()), pa.array(spans, span)],
                    ["doc_id", "score", "spans"],
                )

    schema = f"doc_id {kind}, score double, spans array<struct<start: long, end: long, marginal: double>>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)
