"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; all other text is unlabelled.
A small network over a text's form (words, lines, characters, repetition) minimises
the non-negative unbiased risk: prior * positive risk + max(0, unlabelled risk -
prior * risk of positives taken for negatives). No negative label is read anywhere.

The class prior is estimated from the same two: a classifier of positives against
unlabelled text ranks rows that it was not fitted on; above a high cut there are
almost only positives, so the share of unlabelled rows there over that of positives
is the prior. A bounded sample gives the prior and where training starts; the steps
after it take the risk of all unlabelled rows, as sums over Spark.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch, checkpointed, fold, map_batches, text_of

#: Labelled good rows that the network is fitted on, at most, and unlabelled ones that it starts with.
TRAIN_POSITIVE, START_UNLABELLED = 4_000, 6_000
#: Steps and rate of the training over all unlabelled rows that follows.
FULL_STEPS, FULL_RATE = 12, 0.004
#: The prior where there are no labels at all.
DEFAULT_PRIOR = 0.5

_KIND = np.zeros(256, np.int64)  # 0: other control bytes
_KIND[[9, 11, 12, 13, 32]] = 1
_KIND[10] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[97:123] = 5
_KIND[128:] = 6
for _i, _c in enumerate(b".,;:!?|'\"-_/\\()[]{}<>=+*&%$#@^~`"):
    _KIND[_c] = 7 + _i
_KINDS = int(_KIND.max()) + 1
_WEB = re.compile(rb"https?://|www\.|@")
FEATURES = _KINDS + 27


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text's form; all zero for an empty one."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND[codes], minlength=_KINDS) / len(raw)
    words = raw.split()
    n = len(words)
    out[:_KINDS] = np.sqrt(kinds)
    f = out[_KINDS:]
    f[0], f[1] = np.log1p(len(raw)), np.log1p(n)
    if not n:
        return out
    size = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    top = sorted(count.values(), reverse=True)
    f[2], f[3], f[4] = size.mean(), size.std(), np.log1p(size.max())
    f[5], f[6], f[7] = (size == 1).mean(), (size <= 3).mean(), (size >= 12).mean()
    f[8] = len(count) / n
    f[9] = np.log(len(count)) / np.log(n + 1) if n > 1 else 1.0
    f[10], f[11] = top[0] / n, sum(top[:5]) / n
    same = np.fromiter(map(bytes.__eq__, words[1:], words[:-1]), bool, n - 1)
    f[12] = same.mean() if n > 1 else 0.0
    edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    f[13] = np.log(np.diff(edges).max())
    pairs = len(set(zip(words, words[1:])))
    f[14] = pairs / max(1, n - 1)
    lines = [x for x in raw.split(b"\n") if x]
    k = max(1, len(lines))
    f[15], f[16] = np.log1p(len(lines)), np.log1p(len(raw) / k)
    f[17] = 1 - len(set(lines)) / k
    f[18] = sum(x.rstrip()[-1:] in b".!?" for x in lines) / k
    initial = np.fromiter((w[0] for w in words), np.uint8, n)
    final = np.fromiter((w[-1] for w in words), np.uint8, n)
    f[19] = ((initial >= 65) & (initial <= 90)).mean()
    f[20] = ((initial >= 48) & (initial <= 57)).mean()
    f[21] = np.isin(final, (46, 33, 63)).mean()
    f[22] = (final == 44).mean()
    f[23] = np.log1p(len(_WEB.findall(raw)) / n * 100)
    f[24] = np.isin(initial, (124, 35, 42, 45, 60, 123)).mean()
    f[25] = np.log1p(kinds[3] * 100)
    f[26] = 1.0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._z(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))

    def params(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, np.array([self.b2])]


def risks(params: list[np.ndarray], x: np.ndarray, positive: bool) -> tuple[float, list[np.ndarray]]:
    """Sums over rows of the logistic loss as the given class, and of its gradients."""
    h = np.tanh(x @ params[0] + params[1])
    z = np.clip(h @ params[2] + params[3][0], -40, 40)
    s = 1 / (1 + np.exp(-z))
    g = s - 1 if positive else s
    g_h = np.outer(g, params[2]) * (1 - h * h)
    return float(np.logaddexp(0, -z if positive else z).sum()), [x.T @ g_h, g_h.sum(0), h.T @ g, np.array([g.sum()])]


def risk_gradient(params: list[np.ndarray], x_p: np.ndarray, unlabelled: tuple[float, list[np.ndarray]], n_u: int, prior: float) -> list[np.ndarray]:
    """Gradients of the non-negative risk, from the unlabelled rows' sums.

    Where the estimated risk of negatives falls below zero, which only fitting
    noise can do, the step goes up that part's gradient instead.
    """
    share = prior / len(x_p)
    as_negative, g_np = risks(params, x_p, False)
    g_minus = [u / n_u - share * p for u, p in zip(unlabelled[1], g_np)]
    if unlabelled[0] / n_u - share * as_negative < 0:
        return [-g for g in g_minus]
    return [share * p + m for p, m in zip(risks(params, x_p, True)[1], g_minus)]


class Adam:
    def __init__(self, params: list[np.ndarray], decay: float):
        self.params, self.decay, self.step = params, decay, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def move(self, grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for k, (p, (m, v), g) in enumerate(zip(self.params, self.moments, grads)):
            d = g + self.decay * p if k in (0, 2) else g
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-9)


def _initial(mean: np.ndarray, scale: np.ndarray, hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    return Model(mean, scale, rng.normal(0, 0.2, (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), 0.0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, hidden: int = 24, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 3) -> Model:
    """Full-batch Adam on the non-negative risk with logistic loss, over a sample."""
    model = _initial(mean, scale, hidden, seed)
    if not len(positive) or not len(unlabelled):
        model.w2[:] = 0
        model.b2 = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return model
    x_p, x_u, params = model._z(positive), model._z(unlabelled), model.params()
    adam = Adam(params, decay)
    for step in range(1, steps + 1):
        adam.move(risk_gradient(params, x_p, risks(params, x_u, False), len(x_u), prior), rate * (1 - 0.9 * step / steps))
    model.b2 = float(params[3][0])
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, steps: int = 150, delta: float = 0.1) -> float:
    """The share of positives in ``unlabelled``, from positives and unlabelled rows alone.

    A network tells one half of the positives from one half of the unlabelled rows; the
    other halves are ranked by it. For each cut, unlabelled rows above it, as a share,
    over positives above it bounds the prior from above; the cut with the least upper
    confidence limit is taken, as where few rows are left the ratio means nothing.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return DEFAULT_PRIOR
    model = _initial(mean, scale, 24, 11)
    params = model.params()
    adam, halves = Adam(params, 1e-3), [model._z(x[0::2]) for x in (positive, unlabelled)]
    for step in range(1, steps + 1):
        g_p, g_u = risks(params, halves[0], True)[1], risks(params, halves[1], False)[1]
        adam.move([p / len(halves[0]) + u / len(halves[1]) for p, u in zip(g_p, g_u)], 0.02 * (1 - 0.9 * step / steps))
    model.b2 = float(params[3][0])
    p, u = np.sort(model.logits(positive[1::2])), np.sort(model.logits(unlabelled[1::2]))
    cuts = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    doubt = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
    best = np.argmin((above_u + doubt) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _vectors(column) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.float32).reshape(len(cells), FEATURES).astype(np.float64)


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and x, the features of the whole text as bytes, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype(np.float32).tobytes() for t in b.column(2).to_pylist()]
            yield batch(doc_id=b.column(0), held_out=b.column(1), x=pa.array(x, pa.binary()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), text_of().alias("text"))
    return checkpointed(map_batches(rows, run, "doc_id long, held_out boolean, x binary"))


def _summed(rows: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``sums`` of each block of features, added up over all ``rows``: a number of cells that the network sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = sums(_vectors(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield batch(i=pa.array(np.arange(len(total), dtype=np.int32)), s=pa.array(total))

    found = map_batches(rows.select("x"), run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()
    return found.column("s").to_numpy()


def train(rows: DataFrame, labels: DataFrame, positives: int = TRAIN_POSITIVE, start: int = START_UNLABELLED, full_steps: int = FULL_STEPS) -> Model:
    """The network, from the ``profile`` rows outside the held-out fold.

    Positives are the labelled good ids that hash lowest, ``positives`` at most. Scaling and
    the last ``full_steps`` steps take all rows outside the fold as unlabelled.
    """
    open_rows = checkpointed(rows.where(~F.col("held_out")).select("doc_id", "x"))
    known = F.col("doc_id").isNotNull() & (fold() != 2)
    seen = labels.where(F.col("quality").isin(0, 1) & known).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    trusted = seen.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(positives)
    x_p = open_rows.join(F.broadcast(trusted), "doc_id").orderBy("doc_id", "x").select("x").toArrow()
    x_s = open_rows.orderBy(F.xxhash64("doc_id", "x"), "doc_id").select("x").limit(start).toArrow()
    positive, sample = _vectors(x_p.column("x")), _vectors(x_s.column("x"))
    moments = _summed(open_rows, lambda x: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))
    if not len(moments):
        return fit(positive, sample, DEFAULT_PRIOR, np.zeros(FEATURES), np.ones(FEATURES))
    n, mean = int(moments[0]), moments[1 : 1 + FEATURES] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + FEATURES :] / n - mean**2, 0)) + 1e-3
    prior = estimate_prior(positive, sample, mean, scale) if len(positive) else DEFAULT_PRIOR
    model = fit(positive, sample, prior, mean, scale)
    if not len(positive):
        return model
    params, shapes = model.params(), [p.shape for p in model.params()]
    adam, x_p, cuts = Adam(params, 1e-3), model._z(positive), np.cumsum([0] + [p.size for p in params])
    for step in range(full_steps):
        frozen = [p.copy() for p in params]

        def sums(x: np.ndarray) -> np.ndarray:
            loss, grads = risks(frozen, model._z(x), False)
            return np.concatenate(([loss], *[g.ravel() for g in grads]))

        total = _summed(open_rows, sums)
        grads = [total[1 + a : 1 + b].reshape(shape) for a, b, shape in zip(cuts[:-1], cuts[1:], shapes)]
        adam.move(risk_gradient(params, x_p, (total[0], grads), n, prior), FULL_RATE * (1 - step / full_steps))
    model.b2 = float(params[3][0])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    The score is the probability that a text is good, from the whole text alone.
    Training sees at most TRAIN_POSITIVE labelled good rows, and all rows outside
    the held-out fold as unlabelled text. Null and empty texts are scored like any
    other, on features of zero; without labels every score is one prior; an id
    labelled twice counts as good only if all its labels do; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    rows = profile(docs)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(rows, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model.value)
        for b in batches:
            scores = net.scores(_vectors(b.column(2)))
            yield batch(doc_id=b.column(0), held_out=b.column(1), score=pa.array(scores, pa.float64()), predicted=pa.array((scores >= threshold).astype(np.int32)))

    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
