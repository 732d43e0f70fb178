"""Language-model scoring with a causal self-attention model trained in numpy.

Texts are lower-cased words, each spelled in subword ids (a word's first id holds
its leading space), then one end. One layer of masked self-attention over subword
embeddings gives, at each place, the weights of ``parts`` mixture parts, each a
softmax over all ids; the next id's probability is the weighted mean. Long texts
are cut into windows that overlap: each id is scored once, in the window where it
has the most context, and windows go through the attention in batches.

A word's probability is its ids', given that a word begins, times that of a word
border after them. It is mixed with the word's share in the whole training corpus;
those counts cover every training text. The attention model starts from a bounded
sample and then learns from all windows of all training texts, in Spark tasks.
"""

from __future__ import annotations

import base64
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch, checkpointed, fold, text_of

#: Training texts that the start of the attention model is fitted on, at most; the rounds after it cover all.
START_DOCS = 1_200
#: Rounds that the one pass over all training texts is cut into, and the rate of their Adam steps.
ROUNDS, RATE = 2, 0.01
#: Words whose counts are broadcast (16 bytes each); the counts of others are joined.
TABLE_SIZE = 1_000_000
#: Words that a worker keeps, and their bytes; characters of the texts that it takes at once.
CACHE_SIZE, CACHE_BYTES, BATCH_CHARS = 500_000, 32 << 20, 400_000
#: Characters of the texts whose words are counted at once.
COUNT_CHARS = 8_000_000
#: Windows that go through the attention at once, so that their arrays stay in a core's cache.
CHUNK = 64
#: Attention scores and logits are held within this, so that no exponential overflows.
MOST_SCORE = 60
#: The attention model's share in a known word's probability.
SHARE = 0.5
WINDOW, STRIDE = 32, 26
#: Probability that the mixture parts leave for all ids alike.
REST = 1e-3
END_WORD = b"\n"  # no word has white space


_OTHER_SPACE = re.compile(r"[^\S ]")


class Spelling:
    """Subword ids of words, and of the end."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("lm", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.initial = np.zeros(self.size, bool)  # ids that only a word's start, or the end, can be
        self.initial[[i for b, i in ranks.items() if b.startswith(b" ")] + [self.end]] = True

    def ids(self, word: bytes) -> list[int]:
        ids = self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))
        # white space of other kinds inside a word could start a new id with a space: spell such a word in bytes
        return ids if self.initial[ids[0]] and not self.initial[ids[1:]].any() else [self.space, *[self.byte[b] for b in word]]

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if not _OTHER_SPACE.search(text):
            flat = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            first = np.flatnonzero(self.initial[flat])
            if len(first) == len(words):  # each word's first id, and no other, begins one
                return flat, np.diff(np.append(first, len(flat)))
        ids = [self.ids(w) for w in words]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    @property
    def space(self) -> int:
        return self.encoding.encode_single_token(b" ")

    @property
    def byte(self) -> dict[int, int]:
        return {b: self.encoding.encode_single_token(bytes([b])) for b in range(256)}


@lru_cache(maxsize=1)
def spelling_of(ranks_path: str) -> Spelling:
    """A worker reads the ids once, not in each of its tasks."""
    return Spelling(ranks_path)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (``words_of``), each text's followed by an empty one for its end; and how many each has."""
    kept = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    empty, space = pa.scalar("", texts.type), pa.scalar(" ", texts.type)
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(kept, empty), empty, pc.binary_join_element_wise(kept, space, empty)))
    return lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)


def _bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Words(dict):
    """Numbers of the words that a worker has met; ``starts`` and ``ids`` hold their spellings. The end, an empty word, is number 0."""

    def __init__(self, spelling: Spelling):
        super().__init__()
        self.spelling = spelling
        self.empty()

    def empty(self) -> None:
        self.clear()
        self[b""] = 0
        self.bytes, self.ids, self.starts = 0, np.full(8192, self.spelling.end, np.int32), np.zeros(1025, np.int64)
        self.starts[1] = 1

    def learn(self, first: int, words: list[bytes]) -> None:
        """Spells the words numbered from ``first`` on."""
        ids, lens = self.spelling.spell(words)
        used = int(self.starts[first])
        self.starts = _room(self.starts, first + len(words) + 1)
        self.ids = _room(self.ids, used + len(ids))
        self.starts[first + 1 : first + len(words) + 1] = used + np.cumsum(lens)
        self.ids[used : used + len(ids)] = ids
        self.bytes += sum(map(len, words))

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, texts end to end, each with its end; and where texts begin."""
        if len(self) > CACHE_SIZE or self.bytes > CACHE_BYTES:
            self.empty()
        flat, sizes = split(texts)
        flat = flat.dictionary_encode()
        words = _bytes(flat.dictionary)
        number = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            first, met = len(self), [words[i] for i in new.tolist()]
            number[new] = np.arange(first, first + len(met))
            self.update(zip(met, range(first, first + len(met))))
            self.learn(first, met)
        return number.take(flat.indices.to_numpy()), np.cumsum(sizes) - sizes

    def spelled(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, and where each word's begin."""
        sizes = self.starts[number + 1] - self.starts[number]
        at = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.starts[number] - at, sizes) + np.arange(int(sizes.sum()))], at


def _room(x: np.ndarray, need: int) -> np.ndarray:
    return x if len(x) >= need else np.concatenate((x, np.zeros(max(need - len(x), len(x)), x.dtype)))


def _taken(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about ``most`` characters (BATCH_CHARS); a longer text comes alone."""
    end, at, most = np.cumsum(pc.utf8_length(texts).to_numpy(), dtype=np.int64), 0, most or BATCH_CHARS
    while at < len(texts):
        done = end[at - 1] if at else 0
        stop = max(int(np.searchsorted(end, done + most, side="right")), at + 1)
        yield at, stop
        at = stop


@dataclass
class Model:
    """``rows``: query, key, value and own of each id, side by side; ``table``: ids x parts."""

    rows: np.ndarray
    place: np.ndarray  # bias of the distance back
    table: np.ndarray
    sums: np.ndarray  # by part: 1, and the share of word starts
    ranks_path: str


def _softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    return x / x.sum(axis, keepdims=True)


def _scatter(ids: np.ndarray, grad: np.ndarray, size: int, short: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, all below ``size``, and the sums of their rows."""
    order = np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")  # short keys sort by radix
    held = ids.take(order)
    at = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    held, n = held.take(at), np.diff(np.append(at, len(order)))
    sums, many = np.empty((len(at), grad.shape[1]), grad.dtype), np.flatnonzero(n > short)
    if len(many):  # the few ids with many rows
        size = n.take(many)
        stop = np.cumsum(size)
        rows = grad.take(order.take(np.repeat(at.take(many) - stop + size, size) + np.arange(stop[-1])), 0)
        one = np.ones(int(size.max()), grad.dtype)
        for i, b, e in zip(many.tolist(), (stop - size).tolist(), stop.tolist()):
            np.matmul(one[: e - b], rows[b:e], out=sums[i])
    some = np.flatnonzero(n <= short)
    some = some.take(np.argsort(-n.take(some), kind="stable"))  # those with more rows come first
    at, n = at.take(some), n.take(some)
    few = grad.take(order.take(at), 0)
    for j in range(1, short):
        k = int(np.count_nonzero(n > j))
        few[:k] += grad.take(order.take(at[:k] + j), 0)
    sums[some] = few
    return held, sums


_BACK = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0, WINDOW - 1)
_LOWER = np.tril(np.ones((WINDOW, WINDOW), bool))


def _seen(place: np.ndarray) -> np.ndarray:
    """The factor of a distance, zero for what comes later."""
    return np.exp(np.clip(place, -MOST_SCORE / 2, MOST_SCORE / 2))[_BACK] * _LOWER


def attend(rows: np.ndarray, seen: np.ndarray, parts: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Attention weights (windows x places x WINDOW), the parts' weights (windows x places x parts), not yet
    divided by their sum, for the places from ``first`` on; and query (scaled), key, value of ``rows``."""
    width = (rows.shape[-1] - 2 * parts) // 2
    q = rows[:, first:, :width] * np.float32(1 / np.sqrt(width))
    k, v, own = rows[..., width : 2 * width], rows[..., 2 * width : 2 * width + parts], rows[:, first:, 2 * width + parts :]
    a = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
    np.exp(np.clip(a, -MOST_SCORE / 2, MOST_SCORE / 2, out=a), out=a)
    a *= seen[first:]
    a /= np.matmul(a.reshape(-1, WINDOW), np.ones((WINDOW, 1), np.float32)).reshape(*a.shape[:2], 1)
    u = np.matmul(a, v)
    u += own
    np.exp(np.clip(u, -MOST_SCORE, MOST_SCORE, out=u), out=u)
    return a, u, (q, k, v)


def gradients(rows: np.ndarray, place: np.ndarray, t: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the mean log loss by ``rows`` and ``place``, and each part's share in each next id.

    ``rows`` holds, for windows x WINDOW ids, query, key, value and own side by side;
    ``t`` the parts' probabilities of the next ids; places not ``live`` count for nothing.
    """
    g_rows, resp, n = np.empty(rows.shape, np.float32), np.empty(t.shape, np.float32), t[..., 0].size if live is None else max(live.sum(), 1)
    g_place = _gradients(rows, _seen(place), t, live, g_rows, resp)
    g_rows *= _scales(rows.shape[-1], t.shape[-1], n)
    return g_rows, g_place / np.float32(n), resp


def _scales(wide: int, parts: int, n: int) -> np.ndarray:
    """What the columns that ``_gradients`` fills are multiplied by for a mean over ``n`` places."""
    width, scales = (wide - 2 * parts) // 2, np.full(wide, 1 / n, np.float32)
    scales[:width] /= np.float32(np.sqrt(width))
    return scales


def _gradients(rows: np.ndarray, seen: np.ndarray, t: np.ndarray, live: np.ndarray | None, g_rows: np.ndarray, resp: np.ndarray) -> np.ndarray:
    """Fills ``g_rows``, but for ``_scales``, and ``resp`` of ``gradients``; the gradient of the sum by each distance's bias."""
    parts, f4 = t.shape[-1], np.float32
    a, u, (q, k, v) = attend(rows, seen, parts)
    width, shape, one = q.shape[-1], (*t.shape[:2], 1), np.ones((parts, 1), f4)
    mixed = u * t
    mixed /= np.maximum(np.matmul(mixed.reshape(-1, parts), one), f4(1e-30)).reshape(shape)
    u /= np.matmul(u.reshape(-1, parts), one).reshape(shape)
    u -= mixed
    if live is not None:
        u *= live[..., None]
        mixed *= live[..., None]
    resp[...] = mixed
    g_s = np.matmul(u, np.ascontiguousarray(v.transpose(0, 2, 1)))
    g_s -= np.einsum("bij,bij->bi", g_s, a)[..., None]
    g_s *= a
    np.matmul(g_s, k, out=g_rows[..., :width])
    np.matmul(g_s.transpose(0, 2, 1), q, out=g_rows[..., width : 2 * width])
    np.matmul(a.transpose(0, 2, 1), u, out=g_rows[..., 2 * width : 2 * width + parts])
    g_rows[..., 2 * width + parts :] = u
    return np.bincount(_BACK[_LOWER], g_s.sum(0)[_LOWER], WINDOW).astype(f4)


class Adam:
    """Moments of one parameter array; rows that a step doesn't touch rest."""

    def __init__(self, x: np.ndarray):
        self.x, self.m1, self.m2, self.step = x, np.zeros_like(x), np.zeros_like(x), 0

    def move(self, at, g: np.ndarray, rate: float) -> None:
        f4 = np.float32
        self.step += 1
        rows = (lambda x: x.take(at, 0)) if isinstance(at, np.ndarray) else (lambda x: x[at])
        m1, m2 = rows(self.m1) * f4(0.9), rows(self.m2) * f4(0.98)
        m1 += f4(0.1) * g
        g = np.square(g)
        g *= f4(0.02)
        m2 += g
        self.m1[at], self.m2[at] = m1, m2
        m2 *= f4(1 / (1 - 0.98**self.step))
        np.sqrt(m2, out=m2)
        m2 += f4(1e-8)
        m1 *= f4(rate / (1 - 0.9**self.step))
        m1 /= m2
        self.x[at] = rows(self.x) - m1


@dataclass
class Start:
    """Where a round starts: ``rows`` (query, key, value, own of each id), ``place`` and the parts' ``table``."""

    rows: np.ndarray
    place: np.ndarray
    table: np.ndarray
    ranks_path: str


def train(sequences: list[np.ndarray], spelling: Spelling, ranks_path: str, parts: int = 24, width: int = 8, steps: int = 400, rows: int = 256, rate: float = 0.03, seed: int = 5) -> Start:
    """Adam on the log loss of the next id, over random windows of the sequences: where the rounds over all texts start.

    Parameters are the per-id tables of a one-layer attention model: query, key,
    value and residual rows of each subword id, a bias of each distance, and
    the mixture parts' logits.
    """
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate(([spelling.end], s)) for s in sequences]) if sequences else np.array([spelling.end] * 2)
    while len(flat) < WINDOW + 2:
        flat = np.concatenate((flat, flat))
    used, flat = np.unique(flat, return_inverse=True)  # ids that the sample has
    size = len(used)
    count = np.bincount(flat, minlength=size) + 0.05
    f4 = np.float32
    own = Adam(np.concatenate([rng.normal(0, sd, (size, n)) for sd, n in ((0.1, width), (0.1, width), (0.3, parts), (0.3, parts))], 1).astype(f4))
    place = Adam(np.zeros(WINDOW, f4))
    logits = Adam((np.log(count / count.sum())[:, None] + rng.normal(0, 0.3, (size, parts))).astype(f4))
    for step in range(1, steps + 1):
        begin = rng.integers(0, len(flat) - WINDOW, rows)
        x = flat[begin[:, None] + np.arange(WINDOW)]
        y = flat[begin[:, None] + np.arange(1, WINDOW + 1)]
        table = _softmax(logits.x, 0)
        g_rows, g_place, resp = gradients(own.x.take(x, 0), place.x, table.take(y, 0))
        n = f4(x.size)
        some, g = _scatter(y.ravel(), resp.reshape(-1, parts) / n, size)
        g_logits = table * (resp.reshape(-1, parts).sum(0) / n)
        g_logits[some] -= g
        g_logits += f4(1e-9) * (logits.x - logits.x.mean(1, keepdims=True))
        now = rate * min(1.0, 2.2 * (1 - step / (steps + 1)) + 0.05)
        logits.move(slice(None), g_logits, now)
        own.move(*_scatter(x.ravel(), g_rows.reshape(-1, g_rows.shape[-1]), size), now)
        place.move(slice(None), g_place, now)
    all_rows, table = np.zeros((spelling.size, own.x.shape[1]), f4), np.zeros((spelling.size, parts), f4)
    all_rows[used], table[used] = own.x, _softmax(logits.x, 0)
    return Start(all_rows, place.x, _with_rest(table), ranks_path)


def _with_rest(table: np.ndarray) -> np.ndarray:
    return ((1 - REST) * table + REST / len(table)).astype(np.float32)


def _round(start, rate: float, batch_rows: int = 256):
    """One task's part of a round: Adam over all windows of its texts, from the common start.

    Rows (id, n, sums): ``sums`` holds the id's change by this task times its ``n``
    uses as context, then the parts' shares in its uses as next id. Id -1 holds the
    change of ``place`` times the number of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Start = pickle.loads(start.value)
        spelling = spelling_of(s.ranks_path)
        own, place, parts = Adam(s.rows.copy()), Adam(s.place.copy()), s.table.shape[1]
        uses, shares = np.zeros(len(s.table), np.int64), np.zeros(s.table.shape)
        words, size, wide = Words(spelling), spelling.size, s.rows.shape[1]
        flat, need = np.array([spelling.end]), batch_rows * WINDOW

        def learn(ids: np.ndarray, n: int) -> None:
            """A step over the first ``n`` ids after the first; the rest is padding."""
            x, y = ids[:-1].reshape(-1, WINDOW), ids[1:].reshape(-1, WINDOW)
            live = None if n == x.size else (np.arange(x.size) < n).reshape(x.shape)
            # a row for each id: its gradient as context, and the parts' shares in it as next id
            both = np.empty((len(ids), wide + parts), np.float32)
            both[-1, :wide], both[0, wide:] = 0, 0
            g_rows, resp = both[:-1, :wide].reshape(*x.shape, wide), both[1:, wide:].reshape(*x.shape, parts)
            seen, g_place = _seen(place.x), 0
            for at in range(0, len(x), CHUNK):
                some = slice(at, at + CHUNK)
                g_place += _gradients(own.x.take(x[some], 0), seen, s.table.take(y[some], 0), None if live is None else live[some], g_rows[some], resp[some])
            held, sums = _scatter(ids, both, size)
            shares[held] += sums[:, wide:]
            if not (ids[:-1] == ids[-1]).any():  # the last id is no context in this step: its row rests
                keep = held != ids[-1]
                held, sums = held[keep], sums[keep]
            own.move(held, sums[:, :wide] * _scales(wide, parts, n), rate)
            place.move(slice(None), g_place / np.float32(n), rate)
            np.add(uses, np.bincount(x.ravel()[:n], minlength=len(uses)), out=uses)

        for b in batches:
            texts = b.column(0)
            for begin, stop in _taken(texts):
                ids, _ = words.spelled(words.numbers(texts[begin:stop])[0])
                flat, at = np.concatenate((flat, ids)), 0
                while at + need < len(flat):
                    learn(flat[at : at + need + 1], need)
                    at += need
                flat = flat[at:]
        n = len(flat) - 1
        if n:
            learn(np.append(flat, np.full(-n % WINDOW, spelling.end)), n)
        total = int(uses.sum())
        if not total:
            return
        ids = np.flatnonzero((uses > 0) | (shares.sum(1) > 0))
        sums = np.concatenate(((own.x[ids] - s.rows[ids]) * uses[ids, None], shares[ids]), 1).astype(np.float32)
        first = np.zeros((1, sums.shape[1]), np.float32)
        first[0, :WINDOW] = (place.x - s.place) * total
        yield from _packed(np.append(-1, ids), np.append(total, uses[ids]), np.concatenate((first, sums)))

    return run


def _packed(ids: np.ndarray, n: np.ndarray, sums: np.ndarray, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), most):
        part = np.ascontiguousarray(sums[at : at + most])
        cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(part.shape[1] * 4), len(part), [None, pa.py_buffer(part)])
        yield batch(id=pa.array(ids[at : at + most], pa.int64()), n=pa.array(n[at : at + most], pa.int64()), sums=cells.cast(pa.binary()))


def _unpacked(column) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.float32).reshape(len(cells), -1)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an id; a task holds the sums of its own ids."""
    at: dict[int, int] = {}
    n, sums = np.zeros(0, np.int64), None
    for b in batches:
        if not b.num_rows:
            continue
        got, cells = b.column(0).to_numpy(), _unpacked(b.column(2))
        where = np.fromiter((at.setdefault(i, len(at)) for i in got.tolist()), np.int64, len(got))
        more = len(at) - len(n)
        sums = np.zeros((0, cells.shape[1])) if sums is None else sums
        n, sums = np.append(n, np.zeros(more, np.int64)), np.concatenate((sums, np.zeros((more, cells.shape[1]))))
        np.add.at(n, where, b.column(1).to_numpy())
        np.add.at(sums, where, cells)
    if at:
        yield from _packed(np.fromiter(at, np.int64, len(at)), n, sums.astype(np.float32))


def improved(start: Start, texts: DataFrame, shares: np.ndarray, rate: float) -> Start:
    """``start`` after a round over all ``texts``; ``shares`` (ids x parts) gains what the parts had in them.

    An id's rows move by the tasks' changes, weighted by its uses in each; the table is
    the parts' shares in all texts of this round and those before.
    """
    spark = texts.sparkSession
    model = spark.sparkContext.broadcast(pickle.dumps(start))
    schema = "id long, n long, sums binary"
    found = texts.mapInArrow(_round(model, rate), schema).repartition(F.col("id")).mapInArrow(_added, schema).toArrow()  # a row an id
    if not found.num_rows:
        return start
    ids, n, sums = found.column("id").to_numpy(), found.column("n").to_numpy(), _unpacked(found.column("sums"))
    rows, wide = start.rows.copy(), start.rows.shape[1]
    some = ids >= 0
    rows[ids[some]] += sums[some, :wide] / np.maximum(n[some, None], 1)
    place = start.place + sums[~some][0, :WINDOW] / n[~some][0]
    shares[ids[some]] += sums[some, wide:]
    return Start(rows, place.astype(np.float32), _with_rest(shares / np.maximum(shares.sum(0), 1e-30)), start.ranks_path)


def finished(s: Start, spelling: Spelling) -> Model:
    sums = np.stack((np.ones(s.table.shape[1], np.float32), s.table[spelling.initial].sum(0)), 1)
    return Model(s.rows, s.place, s.table, sums, s.ranks_path)


def score_ids(model: Model, ids: np.ndarray, docs: np.ndarray, end: int, rows: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each id, and of a word border at its place.

    ``ids`` holds texts end to end, ``docs`` where each begins. A text's first id
    has the end id as its context. Windows of WINDOW ids overlap so that each id but
    a text's first ones is scored with at least WINDOW - STRIDE ids before it.
    """
    sizes = np.diff(np.append(docs, len(ids)))
    # contexts: each text is shifted by one place, the end id comes first
    context = np.empty(len(ids), np.int64)
    context[1:] = ids[:-1]
    context[docs] = end
    more = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    first, stop = np.repeat(docs, more + 1), np.repeat(docs + sizes, more + 1)
    number = np.arange(len(first)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    begin = np.maximum(np.minimum(first + number * STRIDE, stop - WINDOW), first)  # the last one is full
    covered = np.where(number == 0, first, np.concatenate(([0], np.minimum(begin + WINDOW, stop)[:-1])))
    seen, parts = _seen(model.place), model.table.shape[1]
    prob, border = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
    # a text's later windows score nothing in their first places, which are context alone
    for windows, skip in ((np.flatnonzero(number == 0), 0), (np.flatnonzero(number > 0), WINDOW - STRIDE)):
        for at in range(0, len(windows), rows):
            some = windows[at : at + rows]
            x = context.take(begin[some, None] + np.arange(WINDOW), mode="clip")
            place = begin[some, None] + np.arange(skip, WINDOW)
            _, u, _ = attend(model.rows.take(x, 0), seen, parts, skip)
            u = u.reshape(-1, parts)
            live = np.flatnonzero(((place >= covered[some, None]) & (place < stop[some, None])).ravel())
            where = place.ravel()[live]
            mass = np.matmul(u, model.sums)  # of all parts, and of those that begin a word
            mass[:, 1] /= mass[:, 0]
            next_id = np.einsum("ij,ij->i", u, model.table.take(ids.take(place.ravel(), mode="clip"), 0))
            next_id /= mass[:, 0]
            prob[where], border[where] = next_id[live], mass[live, 1]
    return np.log(np.maximum(prob, 1e-30)), np.log(np.clip(border, 1e-30, 1.0))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of a partition's words, in parts of bounded size; each text ends with the end."""
    parts: list[pa.Table] = []

    def out() -> pa.RecordBatch:
        found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        parts.clear()
        return batch(hash=pa.array(_hashes(_bytes(found.column("word").combine_chunks())).view(np.int64), pa.int64()), n=found.column("n_sum").combine_chunks())

    for b in batches:
        for begin, stop in _taken(b.column(0), COUNT_CHARS):
            words, n = split(b.column(0)[begin:stop])[0].value_counts().flatten()
            parts.append(pa.table({"word": words.cast(pa.binary()), "n": n}))
            if sum(map(len, parts)) > 2 * CACHE_SIZE:
                yield out()
    if parts:
        yield out()


@dataclass
class Tables:
    """The frequent words' counts, by sorted hash; the corpus's size and distinct words."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    complete: bool  # no word is outside

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Counts, -1 for a word that isn't here."""
        if not len(self.hashes):
            return np.full(len(hashes), 0 if self.complete else -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0 if self.complete else -1)


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words; an empty one is the end."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    found[found == xxhash.xxh64_intdigest(b"")] = xxhash.xxh64_intdigest(END_WORD)
    return found


class Scorer(Words):
    """Scores texts in a worker; keeps each known word's count and spelling."""

    def __init__(self, model: Model, tables: Tables, share: float = SHARE):
        self.model, self.tables, self.share = model, tables, share
        super().__init__(spelling_of(model.ranks_path))

    def empty(self) -> None:
        super().empty()
        self.hashes, self.counts = np.full(1024, _hashes([b""])[0], np.uint64), np.zeros(1024, np.int64)
        self.counts[:1] = self.tables.find(self.hashes[:1])

    def learn(self, first: int, words: list[bytes]) -> None:
        super().learn(first, words)
        stop = first + len(words)
        self.hashes, self.counts = _room(self.hashes, stop), _room(self.counts, stop)
        self.hashes[first:stop] = _hashes(words)
        self.counts[first:stop] = self.tables.find(self.hashes[first:stop])

    def score(self, texts: pa.Array):
        """Per text: tokens, known tokens, base and model log10 sums over the words that the table decides;
        and (text, word hash, log probability by the model) of the others."""
        number, begin = self.numbers(texts)
        ids, at = self.spelled(number)
        prob, border = score_ids(self.model, ids, at[begin], self.spelling.end)
        word = np.add.reduceat(prob, at).astype(np.float64) - border[at]
        after = np.append(border[at[1:]], 0.0)  # what comes after a word begins a word
        last = np.append(begin[1:], len(number)) - 1  # nothing comes after the end
        after[last] = 0.0
        word += after
        count = self.counts[number]
        t = self.tables
        here = count >= 0
        base = np.log10((np.maximum(count, 0) + 1) / (t.total + t.distinct + 1))
        mixed = mix(word, count, t.total, t.distinct, self.share)
        sums = lambda x: np.add.reduceat(np.where(here, x, 0), begin)
        text = np.repeat(np.arange(len(texts)), np.append(begin[1:], len(number)) - begin)
        rest = np.flatnonzero(~here)
        return np.append(begin[1:], len(number)) - begin, sums(count > 0), sums(base), sums(mixed), (text[rest], self.hashes[number[rest]], word[rest])


def mix(word: np.ndarray, count: np.ndarray, total: int, distinct: int, share: float) -> np.ndarray:
    """log10 of share * model + (1 - share) * the add-one share in the corpus, which is the base's for unseen words too."""
    by_count = np.log(np.maximum(count, 0) + 1.0) - np.log(total + distinct + 1.0) + np.log(1 - share)
    return np.logaddexp(word + np.log(share), by_count) / np.log(10)


def _score(model, tables, share: float):
    """Rows (doc, hash, n_tokens, n_known, base, score, word): sums of a document, or one word that a join must look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(model.value), tables.value, share)
        for b in batches:
            keys, ids, held, texts = b.column(0), b.column(1), b.column(2), b.column(3)
            for at, stop in _taken(texts):
                n, known, base, mixed, (text, hashes, word) = scorer.score(texts[at:stop])
                k, none = stop - at, len(text)
                pad = lambda x, kind, n=none: pa.concat_arrays([pa.array(x, kind), pa.nulls(n, kind)])
                key, doc, out = keys[at:stop], ids[at:stop], held[at:stop]
                take = pa.array(text, pa.int64())
                yield batch(
                    row=pa.concat_arrays([key, key.take(take)]),
                    doc_id=pa.concat_arrays([doc, doc.take(take)]),
                    held_out=pa.concat_arrays([out, out.take(take)]),
                    n_tokens=pad(n, pa.int64()),
                    n_known=pad(known, pa.int64()),
                    base_score=pad(base, pa.float64()),
                    score=pad(mixed, pa.float64()),
                    hash=pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(hashes.view(np.int64), pa.int64())]),
                    word=pa.concat_arrays([pa.nulls(k, pa.float64()), pa.array(word, pa.float64())]),
                )

    return run


def fit(docs: DataFrame, ranks_path: str, folds: int = 7, out: int = 2) -> Model:
    """The attention model: a start from the START_DOCS training texts whose ids hash lowest, then one pass over all of them.

    The pass has ROUNDS rounds, each over the texts of other ids: tasks take Adam steps
    over all windows of their texts, and their changes are averaged by id.
    """
    rows = docs.where(fold("doc_id", folds) != out).select("doc_id", text_of().alias("text"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(START_DOCS)
    sample = rows.join(F.broadcast(picked.distinct()), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(START_DOCS).collect()
    spelling = spelling_of(ranks_path)
    words = Words(spelling)
    sequences = [words.spelled(words.numbers(pa.array([r.text], pa.string()))[0])[0] for r in sample]
    now = train(sequences, spelling, ranks_path)
    shares = np.zeros(now.table.shape)
    for k in range(ROUNDS):
        now = improved(now, rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text"), shares, RATE / (k + 1))
    return finished(now, spelling)


def frequent(counts: DataFrame, most: int) -> int:
    """The least n such that at most ``most`` rows of ``counts`` have n or more, by a histogram in two steps.

    Below 1,024 each n has a cell, above there are eight to an octave, so that the driver
    gets some thousand rows at most; a cell that would go beyond ``most`` stays out whole.
    """
    octave = F.floor(F.log2("n") * 8)
    cell = F.when(F.col("n") < 1024, F.col("n")).otherwise(octave + 1024)
    rows = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()
    held, least = 0, (1 << 63) - 1
    for r in sorted(rows, key=lambda r: -r.least):
        held += r.rows
        if held > most:
            break
        least = r.least
    return least


def score_texts(docs: DataFrame, folds: int = 7, out: int = 2, share: float = SHARE, table_size: int = TABLE_SIZE, ranks_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32(doc_id) modulo ``folds`` is ``out`` are held out: neither counts
    nor model see them. ``base_score`` is the add-one unigram log10 probability of
    the text's words and end, ``score`` the model's. Word counts cover all training
    texts whole: those of the most frequent words, ``table_size`` at most, are
    broadcast, the others' are joined, so no count is dropped. Words are told apart
    by a hash of 64 bits.

    A null or empty text is one end token. Rows with a null id count as training
    rows and are scored. Repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    training = rows.where(fold("doc_id", folds) != out)
    counts = checkpointed(training.select("text").mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    size = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    least = frequent(counts, table_size)
    top = counts.where(F.col("n") >= least).toArrow()  # at most table_size pairs of numbers
    hashes, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hashes)
    tables = Tables(hashes[order], n[order], size.n or 0, size.v, size.v == len(n))
    model = spark.sparkContext.broadcast(pickle.dumps(fit(rows, ranks_path, folds, out)))
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", (fold("doc_id", folds) == out).alias("held_out"), "text")
    scored = keyed.mapInArrow(
        _score(model, spark.sparkContext.broadcast(tables), share), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, hash long, word double"
    )
    total, distinct = tables.total, tables.distinct
    if not tables.complete:
        scored = checkpointed(scored)
        rest = scored.where("hash is not null").select("row", "hash", "word").join(counts.where(F.col("n") < least), "hash", "left").withColumn("c", F.coalesce("n", F.lit(0)))
        by_count = F.log((F.col("c") + 1) / float(total + distinct + 1) * float(1 - share))
        by_model = F.col("word") + float(np.log(share))
        logs = F.greatest(by_model, by_count) + F.log1p(F.exp(-F.abs(by_model - by_count)))
        added = rest.groupBy("row").agg(
            F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum(F.log10((F.col("c") + 1) / float(total + distinct + 1))).alias("b"), F.sum(logs / float(np.log(10))).alias("s")
        )
        scored = scored.where("hash is null").join(added, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("b", F.lit(0.0)), "score": F.col("score") + F.coalesce("s", F.lit(0.0))})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
