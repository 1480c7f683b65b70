"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A document's words (runs of letters, digits and bytes beyond ASCII, ASCII letters
lower-cased) are read in windows of ``STEPS`` words, a new one every ``STRIDE``;
the last window ends with the document, so all words are covered.  A word's
input is a learned vector of the word itself plus the scaled sum of learned
vectors of its byte 3-grams and 5-grams, word ends marked (words and grams that
too few labelled documents hold have a zero vector).
Two GRUs read the window in both directions, attention over their states pools
it, and a logistic layer scores it.  A document's score is a calibrated logistic
function of its highest window.

Labels are per document, so learning alternates: take the windows of each
document that score highest now (at first: by the words' log odds), then train
the network on them by back-propagation through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, labelled

STEPS, STRIDE, HID, EMB = 16, 8, 8, 12
VOCAB, LEAST_DOCS, GRAMS, GRAM_BITS = 4096, 4, 8192, 20
ROUNDS, BATCH, RATE = 5, 128, 0.012
GROUP = 4096
GRAM_DOCS = 128

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_F = np.float32


@dataclass
class Text:
    """Words of some documents: unique ones with their gram codes (two a byte), and every word's unique index."""

    hashes: np.ndarray
    tri: np.ndarray
    tri_first: np.ndarray
    ids: np.ndarray
    first: np.ndarray


def read(buf: np.ndarray, offs: np.ndarray) -> Text:
    low = kernel.lower_ascii(buf)
    words = kernel.split_words(low, offs, _WORD)
    hashes, at, ids = np.unique(kernel.word_hashes(low, words), return_index=True, return_inverse=True)
    start, end = words.start[at], words.end[at]
    n = end - start
    first = np.concatenate([[0], np.cumsum(n)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], n)  # position in the word
    marked = np.zeros(first[-1] + 2 * len(n) + 4, np.uint64)  # 2, the word's bytes, 3
    place = np.arange(first[-1]) + np.repeat(2 * np.arange(len(n)), n)
    marked[place + 1] = low[inside + np.repeat(start, n)]
    ends = np.cumsum(n + 2)
    marked[ends - n - 2], marked[ends - 1] = 2, 3
    code = np.zeros(first[-1], np.uint64)
    codes = []
    for k in range(5):
        code = code * np.uint64(256) + marked[place + k]
        if k in (2, 4):
            mixed = kernel.mix(code + np.uint64(k << 60)) >> np.uint64(64 - GRAM_BITS)
            codes.append(np.where(inside + k <= np.repeat(n, n) + 1, mixed, 0).astype(np.int32))
    return Text(hashes, np.stack(codes, axis=1).reshape(-1), 2 * first, ids.reshape(-1), words.first)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every window, and where each document's windows begin (one at least)."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - STEPS) // STRIDE) + 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    nn = np.repeat(n, count)
    offset = np.minimum(k * STRIDE, np.maximum(nn - STEPS, 0))
    return np.repeat(first[:-1], count) + offset, np.minimum(nn, STEPS), begin


class Net:
    def __init__(self, vocab: np.ndarray, grams: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(_F)
        self.vocab = vocab  # sorted hashes
        self.gram_row = np.full(1 << GRAM_BITS, len(grams), np.int16)
        self.gram_row[grams] = np.arange(len(grams))
        self.p = {
            "word": f(len(vocab) + 1, EMB, scale=0.05), "tri": f(len(grams) + 1, EMB, scale=0.05),
            "wx0": f(EMB, 3 * HID, scale=0.4), "wx1": f(EMB, 3 * HID, scale=0.4), "wh0": f(HID, 3 * HID, scale=0.3), "wh1": f(HID, 3 * HID, scale=0.3),
            "b0": np.zeros(3 * HID, _F), "b1": np.zeros(3 * HID, _F), "att": f(2 * HID, scale=0.3), "out": f(2 * HID, scale=0.5), "bias": np.full(1, -1.0, _F),
        }
        self.scale, self.shift = 1.0, 0.0

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the word table for each hash; the last row is for all others and stays zero."""
        at = np.searchsorted(self.vocab, hashes)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == hashes, at, len(self.vocab)) if len(self.vocab) else np.zeros(len(hashes), np.int64)

    def inputs(self, row: np.ndarray, tri: np.ndarray, tri_first: np.ndarray) -> np.ndarray:
        n = np.diff(tri_first)
        if not len(n):
            return np.zeros((0, EMB), _F)
        return self.p["word"][row] + np.add.reduceat(self.p["tri"].take(self.gram_row[tri], axis=0), tri_first[:-1], axis=0) / np.sqrt(n[:, None]).astype(_F)

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        """Input parts of the gates of each unique word in both directions; a last row leaves the state as it is."""
        out = []
        for d in "01":
            g = np.zeros((len(x) + 1, 3 * HID), _F)
            g[:-1] = x @ self.p["wx" + d] + self.p["b" + d]
            g[-1, HID : 2 * HID] = 30
            out.append(g)
        return out

    def states(self, gates: list[np.ndarray], ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (both directions side by side) at every step of windows of unique-word indexes."""
        n = len(ids)
        h = np.empty((STEPS, n, 2 * HID), _F)
        for d in (0, 1):
            s, wh = np.zeros((n, HID), _F), self.p[f"wh{d}"]
            for t in range(STEPS) if d == 0 else range(STEPS - 1, -1, -1):
                gx = gates[d].take(ids[:, t], axis=0)
                gh = s @ wh
                rz = gx[:, : 2 * HID] + gh[:, : 2 * HID]
                np.negative(rz, out=rz)
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                r, z = rz[:, :HID], rz[:, HID:]
                c = np.tanh(gx[:, 2 * HID :] + r * gh[:, 2 * HID :])
                new = c + z * (s - c)
                if keep is not None:
                    keep.append((d, t, s, r, z, c, gh[:, 2 * HID :]))
                s = new
                h[t, :, d * HID : (d + 1) * HID] = s
        return h

    def pool(self, h: np.ndarray, pad: np.ndarray):
        e = h @ self.p["att"]
        e[pad.T] = -1e9
        e -= e.max(axis=0)
        a = np.exp(e)
        a /= a.sum(axis=0)
        c = np.einsum("tn,tnk->nk", a, h)
        return a, c, c @ self.p["out"] + self.p["bias"][0]

    def window_logits(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each window, and where each document's windows begin."""
        gates = self.project(self.inputs(self.lookup(text.hashes), text.tri, text.tri_first))
        at, length, begin = windows(text.first)
        ids = np.append(text.ids, len(text.hashes))
        out = np.empty(len(at), _F)
        for lo in range(0, len(at), GROUP):
            pad = np.arange(STEPS) >= length[lo : lo + GROUP, None]
            w = np.where(pad, len(text.ids), at[lo : lo + GROUP, None] + np.arange(STEPS))
            out[lo : lo + GROUP] = self.pool(self.states(gates, ids[w]), pad)[2]
        return out, begin

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        logits, begin = self.window_logits(read(buf, offs))
        top = np.maximum.reduceat(logits, begin[:-1]).astype(np.float64)
        return 1 / (1 + np.exp(-(self.scale * top + self.shift)))

    def gradient(self, text: Text, rows: np.ndarray, w_at: np.ndarray, w_len: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted log loss over some windows."""
        pad = np.arange(STEPS) >= w_len[:, None]
        w = np.where(pad, len(text.ids), w_at[:, None] + np.arange(STEPS))
        used, ids = np.unique(np.append(text.ids, -1)[w], return_inverse=True)
        ids = ids.reshape(w.shape)
        if used[0] == -1:  # padding becomes the row after the last
            ids, used = np.where(ids == 0, len(used) - 1, ids - 1), used[1:]
        n = text.tri_first[used + 1] - text.tri_first[used]
        first = np.concatenate([[0], np.cumsum(n)])
        tri = text.tri[np.arange(first[-1]) + np.repeat(text.tri_first[used] - first[:-1], n)]
        x = self.inputs(rows[used], tri, first)
        gates, saved = self.project(x), []
        h = self.states(gates, ids, saved)
        a, c, logit = self.pool(h, pad)
        p = 1 / (1 + np.exp(-logit))
        d = ((p - y) * weight / len(y)).astype(_F)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = c.T @ d, np.array([d.sum()], _F)
        dc = d[:, None] * self.p["out"]
        da = np.einsum("nk,tnk->tn", dc, h)
        de = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tn,tnk->k", de, h)
        dh = a[:, :, None] * dc + de[:, :, None] * self.p["att"]
        dgates = [np.zeros_like(v) for v in gates]
        carry = [np.zeros((len(y), HID), _F), np.zeros((len(y), HID), _F)]
        for way, t, s, r, z, cand, ghn in reversed(saved):
            dn = dh[t, :, way * HID : (way + 1) * HID] + carry[way]
            dan = dn * (1 - z) * (1 - cand**2)
            daz = dn * (s - cand) * z * (1 - z)
            dar = dan * ghn * r * (1 - r)
            dgh = np.concatenate([dar, daz, dan * r], axis=1)
            np.add.at(dgates[way], ids[:, t], np.concatenate([dar, daz, dan], axis=1))
            g[f"wh{way}"] += s.T @ dgh
            carry[way] = dn * z + dgh @ self.p[f"wh{way}"].T
        dx = np.zeros_like(x)
        for way in (0, 1):
            dg = dgates[way][:-1]
            g[f"wx{way}"], g[f"b{way}"] = x.T @ dg, dg.sum(axis=0)
            dx += dg @ self.p[f"wx{way}"].T
        np.add.at(g["word"], rows[used], dx)
        g["word"][-1] = 0
        np.add.at(g["tri"], self.gram_row[tri], np.repeat(dx / np.sqrt(n[:, None]).astype(_F), n, axis=0))
        g["tri"][-1] = 0
        return g


def train(rows: list[tuple[bytes, int]], seed: int = 3) -> Net | None:
    """A trained and calibrated net, or None if the rows don't hold both classes."""
    y = np.array([label for _, label in rows], _F)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    text = read(np.frombuffer(b"".join(t for t, _ in rows), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]))
    doc = np.repeat(np.arange(len(rows)), np.diff(text.first))
    pairs = np.unique(text.ids * len(rows) + doc)
    word, of = pairs // len(rows), pairs % len(rows)

    def log_odds(n, pos):
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((n - pos + 0.5) / (len(y) - y.sum() + 1))
        return (odds * (1 - np.exp(-n / 6))).astype(_F)

    n, pos = np.bincount(word, minlength=len(text.hashes)), np.bincount(word, weights=y[of], minlength=len(text.hashes))
    odds = log_odds(n, pos)
    common = np.flatnonzero(n >= LEAST_DOCS)
    common = common[np.lexsort((-n[common], -np.abs(odds[common])))[:VOCAB]]
    # the same for grams: documents that hold each
    # counted over GRAM_DOCS documents at a time, which bounds the driver's memory
    order = np.argsort(of, kind="stable")
    word, of = word[order], of[order]
    gn, gram_pos = np.zeros(1 << GRAM_BITS, np.int64), np.zeros(1 << GRAM_BITS)
    edges = np.searchsorted(of, np.arange(0, len(rows) + GRAM_DOCS, GRAM_DOCS))
    for lo, hi in zip(edges[:-1], edges[1:]):
        per = np.diff(text.tri_first)[word[lo:hi]]
        begin = np.concatenate([[0], np.cumsum(per)])
        held = text.tri[np.arange(begin[-1]) + np.repeat(text.tri_first[word[lo:hi]] - begin[:-1], per)].astype(np.int64)
        held = np.unique(held * len(rows) + np.repeat(of[lo:hi], per))
        gram, holder = held // len(rows), held % len(rows)
        gn += np.bincount(gram, minlength=1 << GRAM_BITS)
        gram_pos += np.bincount(gram, weights=y[holder], minlength=1 << GRAM_BITS)
    gram_odds = log_odds(gn, gram_pos)
    gram_odds[gn < LEAST_DOCS] = gram_odds[0] = 0
    grams = np.flatnonzero(gn >= LEAST_DOCS)
    grams = grams[grams > 0]
    grams = np.sort(grams[np.argsort(-np.abs(gram_odds[grams]), kind="stable")[:GRAMS]])
    net = Net(np.sort(text.hashes[common]), grams, seed)
    row = net.lookup(text.hashes)
    net.p["word"][row[common], 0] = odds[common] * 0.3
    net.p["word"][-1] = 0
    net.p["tri"][:-1, 1] = gram_odds[grams] * 0.3
    net.p["tri"][-1] = 0
    at, length, begin = windows(text.first)
    merit = np.where(row < len(net.vocab), np.maximum(odds, 0), 0)
    if len(merit):
        merit = merit + np.maximum.reduceat(np.maximum(gram_odds, 0)[text.tri], text.tri_first[:-1])
    total = np.concatenate([[0], np.cumsum(merit[text.ids])])
    rank = total[at + length] - total[at]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(_F)
    state, step = {}, 0
    for part in range(ROUNDS):
        take = []
        for i in range(len(rows)):
            mine = np.arange(begin[i], begin[i + 1])
            best = mine[np.argsort(-rank[mine], kind="stable")[: 1 if y[i] else 2]]
            take.append(best)
            if not y[i]:
                take.append(rng.choice(mine, 1))
        take = np.concatenate(take)
        owner = np.searchsorted(begin, take, side="right") - 1
        order = rng.permutation(len(take))
        rate = RATE * (0.3 if part == ROUNDS - 1 else 1)
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            g = net.gradient(text, row, at[take[pick]], length[take[pick]], y[owner[pick]], weight[owner[pick]])
            step += 1
            for k, v in net.p.items():
                m, s = state.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
                gk = g[k] + 2e-4 * v if k not in ("bias",) else g[k]
                m += 0.1 * (gk - m)
                s += 0.002 * (gk * gk - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.998**step)) + 1e-7)
        rank = net.window_logits(text)[0]
    top = np.maximum.reduceat(rank, begin[:-1]).astype(np.float64)
    for _ in range(300):  # logistic calibration of the highest window, at equal weight of the classes
        p = 1 / (1 + np.exp(-(net.scale * top + net.shift)))
        err = (p - y) * weight
        net.scale = max(net.scale - 0.5 * float((err * top).mean()), 0.05)
        net.shift -= 0.5 * float(err.mean())
    return net


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs.

    Null, empty and wordless texts get the score of an empty window; without a net
    every score is 0.  Rows are judged one by one: repeated rows give repeated
    results, a null doc_id is passed through, other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id")
            for b in kernel.blocks(batch.column("text")):
                p = net.score(b.buf, b.offs) if net else np.zeros(b.hi - b.lo)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(b.lo, b.hi - b.lo), "score": pa.array(np.round(p, 5))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """Learn ``labels.toxic`` outside the held-out bucket and score every row: doc_id, held_out, score, predicted."""
    net = train(labelled.sample(docs, labels, "toxic", per_class))
    return score(docs, net).select("doc_id", (kernel.crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
