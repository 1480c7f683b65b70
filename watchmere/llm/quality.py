"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes run over every byte of a document.  A filter
over one-hot bytes is a table per position, so a convolution is ``WIDTH`` table
look-ups and additions.  Filter outputs are max-pooled over overlapping chunks
of ``2 * HALF`` bytes (every half chunk begins one) that cover the whole
document; the document's mean and maximum over its chunks go through a small
dense layer to one probability.

Learning (Adam, log loss) uses ``labelled.PER_CLASS`` documents of each class at
most; learning and scoring both cover every chunk of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, labelled

WIDTH, FILTERS, HALF, HIDDEN = 4, 16, 128, 16
STEPS, BATCH, RATE = 240, 64, 0.01
PIECE = 1 << 15
#: Chunks that learning convolves at a time, which bounds its memory.
TRAIN_PIECE = 1024


@dataclass
class Net:
    tables: np.ndarray  # WIDTH, 256, FILTERS
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def params(self):
        return [self.tables, self.w1, self.b1, self.w2, self.b2]


def fresh(seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return Net(f(WIDTH, 256, FILTERS, scale=0.3), f(2 * FILTERS, HIDDEN, scale=0.25), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.25), np.zeros(1, np.float32))


def _head(net: Net, pooled: np.ndarray):
    hidden = np.maximum(pooled @ net.w1 + net.b1, 0)
    return hidden, 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2[0]).astype(np.float64)))


def _adam(net: Net, grads, state, rate: float) -> None:
    state["t"] += 1
    for k, (p, g) in enumerate(zip(net.params(), grads)):
        m, v = state.setdefault(k, (np.zeros_like(p), np.zeros_like(p)))
        m[...] = 0.9 * m + 0.1 * g
        v[...] = 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-7)


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks of texts (with the bytes that filters see beyond them), how many places of each are in its text, and its text's number."""
    size = 2 * HALF
    chunks, valid, owner = [], [], []
    for i, text in enumerate(texts):
        n = max(1, -(-len(text) // HALF) - 1)
        padded = np.zeros(max((n + 1) * HALF, len(text)) + WIDTH - 1, np.uint8)
        padded[: len(text)] = np.frombuffer(text, np.uint8)
        chunks.append(np.lib.stride_tricks.sliding_window_view(padded, size + WIDTH - 1)[: n * HALF : HALF])
        valid.append(np.clip(max(len(text), 1) - np.arange(n) * HALF, 1, size))
        owner += [i] * n
    return np.concatenate(chunks), np.concatenate(valid), np.array(owner)


def strongest(net: Net, chunks: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter is strongest in each chunk, and how strong; places beyond the text don't count."""
    size = 2 * HALF
    conv = net.tables[0][chunks[:, :size]]
    for j in range(1, WIDTH):
        conv += net.tables[j][chunks[:, j : j + size]]
    short = np.flatnonzero(valid < size)
    conv[short] = np.where(np.arange(size)[None, :, None] < valid[short, None, None], conv[short], -np.inf)
    at = conv.argmax(axis=1)
    return at, np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0, :]


def train(rows: list[tuple[bytes, int]], seed: int = 5) -> Net | None:
    """A trained net, or None if the rows don't hold both classes."""
    y = np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    chunks, valid, owner = chunked([text for text, _ in rows])
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    net, state, rng = fresh(seed), {"t": 0}, np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    epochs = -(-STEPS // -(-len(rows) // BATCH))  # about as many steps whatever the number of documents
    for epoch in range(epochs):
        rate = RATE * (0.15 if epoch >= epochs * 0.8 else 0.5 if epoch >= epochs // 2 else 1)
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            take = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            begin = np.searchsorted(own, np.arange(len(docs)))
            x = chunks[take]
            at, raw = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
            for c in range(0, len(x), TRAIN_PIECE):
                piece = slice(c, c + TRAIN_PIECE)
                at[piece], raw[piece] = strongest(net, x[piece], valid[take[piece]])
            act = np.maximum(raw, 0)
            counts = np.bincount(own, minlength=len(docs)).astype(np.float32)
            mean = np.add.reduceat(act, begin, axis=0) / counts[:, None]
            top = np.maximum.reduceat(act, begin, axis=0)
            pooled = np.concatenate([mean, top], axis=1)
            hidden, p = _head(net, pooled)
            d = ((p - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            dh = np.outer(d, net.w2) * (hidden > 0)
            dp = dh @ net.w1.T
            dact = dp[own, :FILTERS] / counts[own, None] + dp[own, FILTERS:] * (act == top[own])
            draw = dact * (raw > 0)
            dt = np.zeros_like(net.tables)
            chunk, filt = np.nonzero(draw)
            where = at[chunk, filt]
            for j in range(WIDTH):
                np.add.at(dt[j], (x[chunk, where + j], filt), draw[chunk, filt])
            grads = [dt + 1e-5 * net.tables, pooled.T @ dh + 1e-4 * net.w1, dh.sum(axis=0), hidden.T @ d + 1e-4 * net.w2, np.array([d.sum()], np.float32)]
            _adam(net, grads, state, rate)
    return net


def score_block(net: Net, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Probability of each document of a block."""
    docs = len(offs) - 1
    # every document is followed by zero bytes, so that no filter sees two
    length = np.maximum(np.diff(offs), 1)
    room = length + WIDTH
    begin = np.concatenate([[0], np.cumsum(room)])
    x = np.zeros(begin[-1] + WIDTH, np.uint8)
    x[np.arange(len(buf)) + np.repeat(begin[:-1] - offs[:-1], np.diff(offs))] = buf
    halves = -(-length // HALF)
    first = np.concatenate([[0], np.cumsum(halves)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], halves)
    lo = np.repeat(begin[:-1], halves) + k * HALF
    hi = np.minimum(lo + HALF, np.repeat(begin[:-1] + length, halves))
    pooled = np.empty((len(lo), FILTERS), np.float32)
    step = max(1, PIECE // HALF)
    for i in range(0, len(lo), step):
        a, b = lo[i], hi[min(i + step, len(lo)) - 1]
        conv = net.tables[0].take(x[a:b], axis=0)
        for j in range(1, WIDTH):
            conv += net.tables[j].take(x[a + j : b + j], axis=0)
        edges = np.empty(2 * len(lo[i : i + step]), np.int64)
        edges[::2], edges[1::2] = lo[i : i + step] - a, hi[i : i + step] - a
        pooled[i : i + step] = np.maximum.reduceat(conv, edges[:-1], axis=0)[::2]
    act = np.maximum(pooled, 0)
    chunk = act.copy()  # a chunk is a half and the next one of the same document
    inner = np.ones(len(act), bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    chunk[at] = np.maximum(act[at], act[at + 1])
    # the last half begins no chunk of its own unless it is the only one
    lone = first[:-1][halves == 1]
    use = inner
    use[lone] = True
    chunk = chunk[use]
    owner = np.repeat(np.arange(docs), np.maximum(halves - 1, 1))
    start = np.searchsorted(owner, np.arange(docs))
    mean = np.add.reduceat(chunk, start, axis=0, dtype=np.float64) / np.maximum(halves - 1, 1)[:, None]
    top = np.maximum.reduceat(chunk, start, axis=0)
    return _head(net, np.concatenate([mean.astype(np.float32), top], axis=1))[1]


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs.

    Null and empty texts are scored as one zero byte; without a net every score is
    0.5.  Rows are judged one by one: repeated rows give repeated results, a null
    doc_id is passed through, other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id")
            for b in kernel.blocks(batch.column("text")):
                p = score_block(net, b.buf, b.offs) if net else np.full(b.hi - b.lo, 0.5)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(b.lo, b.hi - b.lo), "score": pa.array(np.round(p, 5))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """Learn ``labels.quality`` outside the held-out bucket and score every row: doc_id, held_out, score, predicted."""
    net = train(labelled.sample(docs, labels, "quality", per_class))
    return score(docs, net).select("doc_id", (kernel.crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """The rows of docs with a score of at least threshold, all columns, in one pass over the texts.

    Whole rows go through the Arrow function, so they need not be joined by an id:
    repeated rows and null ids keep their own verdicts, other columns stay.  Null and
    empty texts are judged as one zero byte; without labels of both classes all rows
    stay; an empty table gives an empty one.
    """
    net = train(labelled.sample(docs, labels, "quality", per_class))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in kernel.blocks(batch.column("text")):
                p = np.round(score_block(net, b.buf, b.offs), 5) if net else np.full(b.hi - b.lo, 0.5)
                yield batch.slice(b.lo, b.hi - b.lo).filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
