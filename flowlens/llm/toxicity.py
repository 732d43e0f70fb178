"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams (and of
the word itself), so a misspelling that was never seen shares most of them. The
vectors of some words in a row are averaged and go through a linear softmax; a
document's logit is the soft maximum over its stretches, as a few toxic words in a
long clean text are enough, in the mean over short and longer stretches. Embeddings and softmax are trained jointly in
numpy, on a bounded sample of labelled rows, in a Spark task; every document is then scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch, fold, map_batches, text_of
from flowlens.llm.shingles import mix64

#: All ASCII but digits and letters parts words.
_FOLD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Labelled rows that the model is fitted on, at most, of either class.
TRAIN_TOXIC, TRAIN_CLEAN = 1_000, 2_000
#: Words of the stretches, steps of the training and its weight decay, chosen among those that cross-validation on training rows put near each other.
SPANS, STEPS, DECAY = (1, 2, 4), 45, 1e-6
#: Words that a worker keeps.
CACHE_SIZE = 300_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def ngrams(words: list[bytes], buckets: int, sizes: range = range(3, 6)) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' n-grams, grouped by word, and the groups' starts."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    owner = np.repeat(np.arange(len(words)), lens)
    left = (starts + lens)[owner] - np.arange(len(codes))  # characters from here to the word's end
    mul, whole = np.uint64(0x100000001B3), np.zeros(len(words), np.uint64)
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(int(lens.max()), 1), mul))))
    np.add.at(whole, owner, codes * powers[left - 1])
    ids, of = [mix64(whole ^ np.uint64(0x5BD1E995))], [np.arange(len(words))]
    for n in sizes:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), np.uint64(n))
        for i in range(n):
            h = h * mul + codes[at + i]
        ids.append(mix64(h))
        of.append(owner[at])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return (np.concatenate(ids) % np.uint64(buckets)).astype(np.int32)[order], np.searchsorted(of_all[order], np.arange(len(words)))


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    softmax: np.ndarray  # dim x 2
    bias: float
    spans: tuple[int, ...]
    constant: bool = False  # nothing was learnt: every text has the bias as its logit

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to a stretch's logit, before it is averaged."""
        if not words:
            return np.empty(0, np.float32)
        ids, starts = ngrams(words, len(self.vectors))
        each = (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]))[ids]
        return np.add.reduceat(each, starts) / np.diff(np.append(starts, len(ids)))

    def text_logit(self, each: np.ndarray) -> float:
        if self.constant:
            return self.bias
        return self.bias + (sum(float(_pooled(_stretches(each, n))) for n in self.spans) / len(self.spans) if len(each) else EMPTY)


#: The pooled logit of a text without words: no evidence of anything toxic.
EMPTY = -6.0


def _stretches(each: np.ndarray, span: int) -> np.ndarray:
    """Means over every run of ``span`` words (over all, if there are fewer)."""
    n = min(span, len(each))
    total = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
    return (total[n:] - total[:-n]) / n


def _pooled(z: np.ndarray) -> float:
    top = z.max()
    return top + np.log(np.exp(z - top).sum())


def fit(texts: list[str], toxic: list[int], weight_clean: float = 1.0, buckets: int = 1 << 18, dim: int = 8, spans: tuple[int, ...] = SPANS, steps: int = STEPS, rate: float = 0.08, decay: float = DECAY, seed: int = 7) -> Model:
    """Joint training of n-gram vectors and softmax: full-batch Adam on the log loss.

    ``weight_clean`` weighs clean rows, to undo how the sample was drawn.
    """
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    rows = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
    model = Model(rng.normal(0, 0.05, (buckets, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)).astype(np.float32), 0.0, spans)
    kept = [i for i, r in enumerate(rows) if len(r)]
    if not known or not 0 < sum(toxic[i] for i in kept) < len(kept):
        model.constant = True  # nothing to tell apart
        rate = sum(toxic) / max(1, len(toxic))
        model.bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
        return model
    y = np.array([toxic[i] for i in kept], np.float64)
    w = np.where(y > 0, 1.0, weight_clean)
    rows = [rows[i] for i in kept]
    flat = np.concatenate(rows).astype(np.int32)
    lens = np.array([len(r) for r in rows])
    begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
    stretches = []  # of each span: the document, first word and width of each stretch, and where documents' stretches begin
    for span in spans:
        n_win = np.maximum(lens - span + 1, 1)
        win_doc = np.repeat(np.arange(len(rows), dtype=np.int32), n_win)
        win_begin = np.cumsum(n_win) - n_win
        first = np.arange(len(win_doc), dtype=np.int32)
        first += (begin - win_begin).astype(np.int32)[win_doc]
        stretches.append((win_doc, first, np.minimum(span, lens).astype(np.int32)[win_doc], win_begin))
    words, parts = list(known), []
    for at in range(0, len(words), 8192):  # n-grams of some words at a time: what they are made from is much larger
        ids, starts = ngrams(words[at : at + 8192], buckets)
        parts.append((ids, np.diff(np.append(starts, len(ids))).astype(np.int32)))
    ids, sizes = (np.concatenate(x) for x in zip(*parts))
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    by_bucket = np.argsort(ids, kind="stable").astype(np.int32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)[by_bucket]
    held = ids[by_bucket]
    used_at = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    used = held[used_at]  # the buckets that these texts use: no others are trained
    ids[by_bucket] = np.repeat(np.arange(len(used), dtype=np.int32), np.diff(np.append(used_at, len(ids))))
    del parts, by_bucket, held, words

    params = {"v": model.vectors[used], "s": model.softmax, "b": np.zeros(1)}
    moments = {k: (np.zeros_like(p, np.float64 if k == "b" else np.float32), np.zeros_like(p, np.float64 if k == "b" else np.float32)) for k, p in params.items()}
    params["b"][0] = -4.0
    for step in range(1, steps + 1):
        d = model.softmax[:, 1] - model.softmax[:, 0]
        each = np.add.reduceat((params["v"] @ d)[ids], starts) / sizes  # a mean of dot products is the mean vector's
        total = np.zeros(len(flat) + 1)
        np.cumsum(each[flat], dtype=np.float64, out=total[1:])
        logit, parts = np.full(len(rows), params["b"][0]), []
        for win_doc, first, width, win_begin in stretches:
            e = total[first + width]
            e -= total[first]
            e /= width
            top = np.maximum.reduceat(e, win_begin)
            e -= top[win_doc]
            np.exp(e, out=e)
            mass = np.add.reduceat(e, win_begin)
            logit += (top + np.log(mass)) / len(stretches)
            e /= mass[win_doc]
            e /= width * np.float32(len(stretches))
            parts.append(e.astype(np.float32))
        p = 1 / (1 + np.exp(-logit))
        g_doc = w * (p - y) / w.sum()
        edge = np.zeros(len(flat) + 1)
        for (win_doc, first, width, _), part in zip(stretches, parts):
            g_win = g_doc[win_doc]
            g_win *= part
            edge += np.bincount(first, g_win, len(flat) + 1)
            edge -= np.bincount(first + width, g_win, len(flat) + 1)
        del parts, part, g_win, total
        g_word = np.bincount(flat, np.cumsum(edge, out=edge)[:-1], len(known))
        g_bucket = np.add.reduceat((g_word / sizes).astype(np.float32)[owner], used_at)
        g_dir = g_bucket @ params["v"]
        grads = {"s": np.stack([-g_dir, g_dir], 1) + 1e-5 * model.softmax, "b": np.array([g_doc.sum()])}
        grads["v"] = g_bucket[:, None] * d[None, :] + np.float32(decay) * params["v"]
        for k, grad in grads.items():
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)).astype(params[k].dtype)
    model.vectors[used] = params["v"]
    model.bias = float(params["b"][0])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> tuple[DataFrame, float]:
    """Rows (doc_id, text, y) of a bounded sample, and the weight that undoes its class shares.

    Only labelled rows outside the held-out fold (crc32 of the id, modulo 4, is
    not 2) are seen; of each class the ``toxic`` or ``clean`` ones whose id hashes lowest.
    """
    seen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pick = None
    for y, most in ((1, toxic), (0, clean)):
        part = seen.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        pick = part if pick is None else pick.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    took = {y: min(n.get(y, 0), most) for y, most in ((1, toxic), (0, clean))}
    weight = (n.get(0, 0) / max(1, took[0])) / (n.get(1, 0) / max(1, took[1])) if n.get(1) and n.get(0) else 1.0
    return texts.join(F.broadcast(pick), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y")), weight  # at most toxic + clean labelled ids


class Scorer:
    """Scores texts in a worker, keeping what each word adds."""

    def __init__(self, model: Model, limit: int = CACHE_SIZE):
        self.model, self.limit = model, limit
        self.known: dict[bytes, float] = {}

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        for at in range(0, len(texts), 64):
            part = [words_of(t) for t in texts[at : at + 64]]
            new = list({w for ws in part for w in ws} - self.known.keys())
            if len(self.known) + len(new) > self.limit:
                self.known = {}
                new = list({w for ws in part for w in ws})
            for k in range(0, len(new), 8192):
                self.known.update(zip(new[k : k + 8192], self.model.word_logits(new[k : k + 8192]).tolist()))
            for ws in part:
                z = self.model.text_logit(np.fromiter(map(self.known.__getitem__, ws), np.float64, len(ws)))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
        return out


def train(docs: DataFrame, labels: DataFrame) -> bytes:
    """The pickled model, fitted by one task on the sampled rows: neither they nor the fit's arrays pass the driver."""
    rows, weight = training_rows(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        if found:
            _, texts, toxic = zip(*found)
            del found
            yield batch(model=pa.array([pickle.dumps(fit(list(texts), list(toxic), weight))], pa.binary()))

    found = map_batches(rows.repartition(1), run, "model binary").collect()
    return bytes(found[0].model) if found else pickle.dumps(fit([], [], weight))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    The model learns from at most TRAIN_TOXIC + TRAIN_CLEAN rows of ``labels``
    outside the held-out fold, and sees nothing of a document but its text. Null
    and empty texts get the low score of a text without evidence; without labels of
    both classes all scores are one base rate; an id labelled twice counts as toxic
    if any label says so; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(model.value))
        for b in batches:
            scores = scorer.scores(b.column(2).to_pylist())
            yield batch(doc_id=b.column(0), held_out=b.column(1), score=pa.array(scores, pa.float64()), predicted=pa.array([int(s >= threshold) for s in scores], pa.int32()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), text_of().alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold`` (see ``score_toxicity``)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(model.value))
        for b in batches:
            yield b.filter(pa.array([s < threshold for s in scorer.scores([t or "" for t in b.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
