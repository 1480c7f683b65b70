"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark items (runs of ASCII letters and digits and
bytes beyond ASCII, ASCII letters lower-cased); other words of a document have no
weight.  Documents are read in passages of ``PASSAGE`` words, a new one every
``STRIDE``.  Term weights are inverse document frequencies counted over all
documents.  A randomised SVD of the TF-IDF matrix of the items and all passages
of all documents (its products with a random matrix are summed by the executors,
one pass over the documents each) gives ``RANK`` latent directions.  Items and
passages, as often as they occur, weigh the same in it as a whole.  The sums are
of whole numbers, so they are the same however rows are dealt.  Every passage of every
document is projected and compared by cosine with every item, one of more than
``WHOLE`` words in segments of ``PASSAGE`` words; pairs of at least ``COSINE``
(and ``PRESENT``) are checked on the words themselves.  Around each such passage
as many words as the item has and ``MARGIN`` more are read on both sides, passages
of one item that meet in this are joined, and the longest common subsequence is
taken of the item and each window of its own length (``PASSAGE`` at least) with
``MARGIN`` words around it, and the same of the item's answer (its last
sentence), which lets paraphrases count.

What the cosine can't see (copies of short items, of items of common words, or
between words that weigh more) is found by pieces: every item is cut into
sequences of a few words, and a document that holds enough of an item's pieces
is checked where they are, in the same way.  So a verbatim copy is always checked.

Items of fewer than ``LEAST_WORDS`` words count only where all their words follow
one another as in the item, without cosine; an item without a word is found nowhere.

Items are the query set.  They are taken in blocks of ``ITEM_BLOCK`` in the order
of their ids, so what is broadcast and held by a worker is bounded; each block is
four passes over the documents: one counts, two fit, one compares.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .work import Work

PASSAGE, STRIDE, MARGIN = 48, 16, 16
#: Items of more words are compared with passages in segments, a new one every PASSAGE / 2 words.
WHOLE = PASSAGE + MARGIN
RANK, COSINE = 128, 0.45
#: Sums over all passages are of multiples of 1 / UNIT: exact, so their order doesn't matter.
UNIT = 1 << 24
#: Bytes of text that a pass takes at a time, and rows that a sum takes: few enough to stay in a processor's cache.
BLOCK_BYTES, ROWS = 1 << 18, 512
#: Groups that are summed at a time, and rows of a group that are added to those of others; the rows beyond are summed by themselves.
GROUPS, FEW = 8192, 16
#: A candidate's projection on its item is at least this share of the item itself: a single rare word is no candidate.
PRESENT = 0.3
#: Terms of more than this share of the documents (and of more than STOP_LEAST documents) have no weight.
STOP, STOP_LEAST = 0.05, 50
ITEM_BLOCK = 4000
#: A pair is a hit if the item's LCS share is SURE, or if of its weighted words it is LIKELY, with an answer share of ANSWER.
SURE, LIKELY, ANSWER = 0.75, 0.5, 0.5
LEAST_WORDS = 5
#: Words of a piece, for items of LONG_ITEM words or more and for shorter ones; the share of its pieces (one at least) that makes a candidate.
PIECE, SHORT_PIECE, LONG_ITEM, PIECES = 5, 3, 15, 0.25

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[kernel.Words, np.ndarray]:
    words = kernel.split_words(buf, offs, _WORD)
    return words, kernel.word_hashes(buf, words, lower=True)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[1]


class Terms:
    """The items' vocabulary: word hash to term number."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits, self.slots = np.zeros(1 << 20, bool), np.zeros(1 << 20, np.int32)
        slot = self._slot(self.hashes)
        self.bits[slot], self.slots[slot] = True, np.arange(len(slot))

    def __reduce__(self):  # the tables are made again where they are used
        return Terms, (self.hashes,)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << 20) - 1)).view(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are terms, and their term numbers."""
        slot = self._slot(h)
        at = np.flatnonzero(self.bits[slot])
        h, k = h[at], self.slots[slot[at]].astype(np.int64)
        ok = self.hashes[k] == h
        left = np.flatnonzero(~ok)  # no terms, or terms that share their slot
        more = np.searchsorted(self.hashes, h[left])
        more[more == len(self.hashes)] = 0
        k[left], ok[left] = more, self.hashes[more] == h[left]
        return at[ok], k[ok]


class Pieces:
    """The items' sequences of a few words: where they are in documents."""

    def __init__(self, numbers: list[np.ndarray]):
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.need = np.ones(len(numbers), np.int64)
        for i, x in enumerate(numbers):
            k = PIECE if len(x) >= LONG_ITEM else SHORT_PIECE if len(x) >= LEAST_WORDS else len(x)
            at = np.array([*range(0, len(x) - k, k), len(x) - k])
            h = np.unique(self._grams(x).between(at, at + k))
            self.need[i] = max(1, int(PIECES * len(h)))
            found.setdefault(k, []).append((h, np.full(len(h), i)))
        self.tables = {}
        for k, parts in found.items():
            h, item = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(h, kind="stable")
            keys, begin = np.unique(h[order], return_index=True)
            bits = np.zeros(1 << 22, bool)
            bits[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.tables[k] = keys, np.append(begin, len(h)), item[order], bits

    @staticmethod
    def _grams(term: np.ndarray) -> kernel.Grams:
        return kernel.Grams(kernel.mix(term.astype(np.uint64) + np.uint64(1)))

    def find(self, at: np.ndarray, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and first word of the pieces of the pairs that hold enough of them."""
        out = [np.zeros((4, 0), np.int64)]
        grams = self._grams(term)
        for k, (keys, begin, item, bits) in self.tables.items():
            if len(at) < k:
                continue
            i = np.flatnonzero((at[k - 1 :] - at[: len(at) - k + 1] == k - 1) & (doc[k - 1 :] == doc[: len(at) - k + 1]))
            h = grams.between(i, i + k)
            some = bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
            i, h = i[some], h[some]
            u = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            i, u = i[keys[u] == h], u[keys[u] == h]
            times = begin[u + 1] - begin[u]
            n = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            i, place = np.repeat(i, times), np.repeat(begin[u], times) + n
            out.append(np.array([doc[i], item[place], place, at[i]]))
            pairs, which = np.unique(doc[i] * len(self.need) + item[place], return_inverse=True)
            held = np.unique(which * len(item) + place) // len(item)
            out[-1] = out[-1][:, np.bincount(held, minlength=len(pairs))[which] >= self.need[item[place]]]
        d, i, _, w = np.concatenate(out, axis=1)
        return d, i, w


def _docs_of(at: np.ndarray, words: kernel.Words) -> np.ndarray:
    """The document of each of some words, which ascend."""
    return np.repeat(np.arange(len(words.first) - 1), np.diff(np.searchsorted(at, words.first)))


def _blocks_of(words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each run of STRIDE words, and where each document's runs begin (one at least)."""
    n = np.maximum(1, -(-np.diff(words.first) // STRIDE))
    begin = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(words.first[:-1], n) + (np.arange(begin[-1]) - np.repeat(begin[:-1], n)) * STRIDE, begin


def _passages_of(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First run of each passage, the end of its document's runs, and where each document's passages begin (one at least)."""
    count = np.maximum(1, np.diff(begin) - PASSAGE // STRIDE + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    return np.arange(first[-1]) - np.repeat(first[:-1] - begin[:-1], count), np.repeat(begin[1:], count), first


@dataclass
class Model:
    terms: Terms
    pieces: Pieces
    weight: np.ndarray  # idf of each term, 0 for stop words
    table: np.ndarray  # idf * latent direction
    segments: np.ndarray  # unit vectors of the items' segments
    norms: np.ndarray  # their lengths
    owner: np.ndarray  # the item of each segment
    ids: list[int]
    masks: list[dict[int, int]]
    length: list[int]
    answer: list[int]  # words of the answer

    def lcs(self, item: int, terms: list[int]) -> tuple[float, float] | None:
        """Shares of the item and of its answer in the longest common subsequence with some terms, None if that is no hit."""
        known, n, tail = self.masks[item], self.length[item], self.answer[item]

        def common(size: int, shift: int, heavy: bool) -> int:  # bit-parallel
            full = (1 << size) - 1
            v = full
            for t in terms:
                if not heavy or self.weight[t]:
                    u = v & (known.get(t, 0) >> shift)
                    if u:
                        v = ((v + u) | (v - u)) & full
            return size - v.bit_count()

        heavy = max(1, sum(m.bit_count() for t, m in known.items() if self.weight[t]))
        least = min(SURE * n, LIKELY * heavy)
        present = 0
        for t in set(terms):
            present |= known.get(t, 0)
        # neither subsequence is longer than the words present, nor that of the weighted words than that of all
        if present.bit_count() < least or (all_words := common(n, 0, False)) < least:
            return None
        answer = common(tail, n - tail, False) / tail
        if all_words >= SURE * n or answer >= ANSWER and common(n, 0, True) >= LIKELY * heavy:
            return all_words / n, answer
        return None

    def check(self, item: int, places: list[int], lo: int, hi: int, at: np.ndarray, term: np.ndarray) -> tuple[float, float] | None:
        """The surest shares of the item in the words lo..hi-1 of a document, around candidate passages that begin at places."""
        n = self.length[item]
        size, best, done = max(PASSAGE, n) + 2 * MARGIN, None, lo - MARGIN
        for place in sorted(places):
            # windows begin MARGIN before every STRIDE-th word; those of the passage before are not read again
            begin = max(done, lo - MARGIN + max(0, place - n - lo) // STRIDE * STRIDE)
            end = min(place + PASSAGE + n + MARGIN, hi)
            while True:
                s, e = np.searchsorted(at, (max(begin, lo), min(begin + size, hi)))
                shares = self.lcs(item, term[s:e].tolist())
                if shares and (best is None or shares > best):
                    best = shares
                begin += STRIDE
                if begin + size - STRIDE >= end:
                    break
            done = begin
        return best

    def find(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float | None, float, float]]:
        """(document, item id, cosine, LCS share, answer share) of the hits in a block: the greatest cosine and the surest shares of each pair."""
        words, h = _words(buf, offs)
        at, term = self.terms.find(h)
        starts, begin = _blocks_of(words)
        doc_of = _docs_of(at, words)
        sums = np.zeros((len(starts), self.table.shape[1]), np.float32)
        heavy = np.flatnonzero(self.weight[term] > 0)
        _add_rows(sums, begin[doc_of[heavy]] + (at[heavy] - words.first[doc_of[heavy]]) // STRIDE, self.table, term[heavy], np.ones(len(heavy), np.int64))
        span = PASSAGE // STRIDE
        p, last, first = _passages_of(begin)
        count = np.diff(first)
        cosine: dict[tuple[int, int], float] = {}
        places: dict[tuple[int, int], set[int]] = {}
        for lo in range(0, len(p), 8192):
            own, end = p[lo : lo + 8192], last[lo : lo + 8192]
            v = sums[own].copy()
            for j in range(1, span):
                more = own + j < end
                v[more] += sums[own[more] + j]
            norm = np.sqrt((v**2).sum(axis=1))
            some = np.flatnonzero(norm > PRESENT * self.norms.min(initial=np.inf))
            for seg in range(0, len(self.segments), ITEM_BLOCK):
                dot = v[some] @ self.segments[seg : seg + ITEM_BLOCK].T
                good = (dot >= COSINE * norm[some, None]) & (dot >= PRESENT * self.norms[seg : seg + ITEM_BLOCK])
                for k, j in zip(*np.nonzero(good)):
                    i = some[k]
                    key = int(np.searchsorted(first, lo + i, "right") - 1), int(self.owner[seg + j])
                    cosine[key] = max(cosine.get(key, -1.0), float(dot[k, j] / norm[i]))
                    places.setdefault(key, set()).add(int(starts[own[i]]))
        whole: set[tuple[int, int]] = set()
        for doc, item, word in zip(*(c.tolist() for c in self.pieces.find(at, term, doc_of))):
            if self.length[item] < LEAST_WORDS:
                whole.add((doc, item))
                continue
            run = int(begin[doc]) + min((word - int(words.first[doc])) // STRIDE, int(count[doc]) - 1)
            if int(starts[run]) in places.get((doc, item), ()):
                continue
            places.setdefault((doc, item), set()).add(int(starts[run]))
            v = sums[run : min(run + span, int(begin[doc + 1]))].sum(axis=0)
            dot = float((self.segments[self.owner == item] @ v).max() / max(float(np.sqrt((v**2).sum())), 1e-9))
            cosine[doc, item] = max(cosine.get((doc, item), -1.0), dot)
        out: list[tuple] = [(doc, self.ids[item], None, 1.0, 1.0) for doc, item in whole]
        for (doc, item), at_words in sorted(places.items()):
            shares = self.check(item, list(at_words), int(words.first[doc]), int(words.first[doc + 1]), at, term)
            if shares:
                out.append((doc, self.ids[item], round(cosine[doc, item], 4), round(shares[0], 4), round(shares[1], 4)))
        return sorted(out, key=lambda row: row[:2])


def _answer_words(text: str) -> int:
    """Words of the last sentence, or of the last third where there is but one."""
    parts = [n for n in (len(_hashes(s)) for s in re.split(r"[.!?]+(?:\s+|$)", text)) if n]
    n = sum(parts)
    return parts[-1] if len(parts) > 1 else max(1, -(-n // 3))


def _counts(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """Document frequency of each term over all documents, and their number."""
    size = len(terms.hashes)

    def run(batches):
        import pyarrow as pa

        df, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for b in kernel.blocks(batch.column("text"), BLOCK_BYTES):
                words, h = _words(b.buf, b.offs)
                at, term = terms.find(h)
                df += np.bincount(np.unique(_docs_of(at, words) * size + term) % size, minlength=size)
                total += b.hi - b.lo
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([*k.tolist(), -1], pa.int64()), "n": pa.array([*df[k].tolist(), total], pa.int64())})

    out = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in out.collect()}  # a row a term
    return np.array([counts.get(i, 0) for i in range(size)], np.float64), int(counts.get(-1, 0))


def _add_rows(out: np.ndarray, group: np.ndarray, table: np.ndarray, row: np.ndarray, count: np.ndarray) -> None:
    """Add count * table[row] to out[group], where groups ascend."""

    def rows(at: np.ndarray) -> np.ndarray:
        v = table.take(row[at], axis=0)
        many = np.flatnonzero(count[at] != 1)
        v[many] *= count[at[many], None].astype(v.dtype)
        return v

    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for lo in range(0, len(edges) - 1, GROUPS):
        edge = edges[lo : lo + GROUPS + 1]
        begin, size = edge[:-1], np.diff(edge)
        total = rows(begin)
        for j in range(1, FEW):  # most groups are small: their first rows, their second ones and so on
            more = np.flatnonzero(size > j)
            if not len(more):
                break
            total[more] += rows(begin[more] + j)
        for i in np.flatnonzero(size > FEW).tolist():
            for at in range(begin[i] + FEW, edge[i + 1], ROWS):
                total[i] += rows(np.arange(at, min(at + ROWS, edge[i + 1]))).sum(axis=0)
        out[group[begin]] += total.astype(out.dtype, copy=False)


def _squares(run: np.ndarray, term: np.ndarray, a: np.ndarray, size: int, begin: np.ndarray) -> np.ndarray:
    """Squared length of each passage's TF-IDF row, from what the terms of each run (ascending) weigh there."""
    first, last, _ = _passages_of(begin)
    key, span = run * size + term, PASSAGE // STRIDE
    out = np.zeros(len(first))
    for d in range(span):  # products of runs d apart
        k = np.minimum(np.searchsorted(key, key + d * size), len(key) - 1)
        same = np.flatnonzero(key[k] == key + d * size)
        dot = np.bincount(run[same], a[same] * a[k[same]] * (2 if d else 1), minlength=begin[-1])
        for j in range(span - d):
            more = first + j + d < last
            out[more] += dot[first[more] + j]
    return out


def _add_gram(total: np.ndarray, buf: np.ndarray, offs: np.ndarray, terms: Terms, weight: np.ndarray, table: np.ndarray) -> int:
    """Add UNIT times the product of a block's Gram matrix with a term table to total, but for the weight of total's terms; the number of passages.

    A passage's row is its terms' counts times their weights, at length 1; table
    has the weights, none of them 0, in it already.  Passages without a term count nothing.
    """
    words, h = _words(buf, offs)
    at, term = terms.find(h)
    if not len(at):
        return 0
    _, begin = _blocks_of(words)
    size, span = len(weight), PASSAGE // STRIDE
    doc = _docs_of(at, words)
    key, count = np.unique((begin[doc] + (at - words.first[doc]) // STRIDE) * size + term, return_counts=True)
    run, term = key // size, key % size
    square = _squares(run, term, count * weight[term], size, begin)
    first, _, which = _passages_of(begin)
    # rows of 0 behind each document, so that passages are sums of rows that follow one another
    gap = np.arange(len(begin) - 1) * (span - 1)
    row = run + np.repeat(gap, np.diff(begin))[run]
    rows = begin[-1] + (len(begin) - 1) * (span - 1)
    scale = np.zeros(rows)
    some = np.flatnonzero(square > 0)
    scale[(first + np.repeat(gap, np.diff(which)))[some]] = UNIT / square[some]
    sums = np.zeros((rows + span - 1, table.shape[1]), np.float32)
    _add_rows(sums, row, table, term, count)
    back = np.zeros((rows + span - 1, table.shape[1]))
    for lo in range(0, rows, ROWS):
        hi = min(lo + ROWS, rows)
        v = sums[lo:hi].copy()
        for j in range(1, span):
            v += sums[lo + j : hi + j]
        v = v * scale[lo:hi, None]
        np.rint(v, out=v)
        for j in range(span):
            back[lo + j : hi + j] += v
    order = np.argsort(term, kind="stable")
    _add_rows(total, term[order], back, row[order], count[order])
    return len(some)


def _gram(docs: DataFrame, terms: Terms, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Product of a term table with the mean Gram matrix of all passages: terms x columns, summed by the executors."""
    heavy, everything = np.flatnonzero(weight > 0), q.shape
    terms, weight, q = Terms(terms.hashes[heavy]), weight[heavy], q[heavy]  # in the same order
    size, wide = q.shape
    table = (weight[:, None] * q).astype(np.float32)
    schema = "term long, v array<long>"

    def rows(total):
        import pyarrow as pa

        used = np.flatnonzero(total.any(axis=1))
        for lo in range(0, len(used), 4096):
            k = used[lo : lo + 4096]
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * wide, pa.int32()), pa.array(total[k].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(k), v], names=["term", "v"])

    def products(batches):
        total = np.zeros((size + 1, wide), np.int64)  # the last row has the number of passages
        for batch in batches:
            for b in kernel.blocks(batch.column("text"), BLOCK_BYTES):
                total[size, 0] += _add_gram(total, b.buf, b.offs, terms, weight, table)
        yield from rows(total)

    def added(batches):
        total = np.zeros((size + 1, wide), np.int64)
        for batch in batches:
            np.add.at(total, batch.column("term").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, wide))
        yield from rows(total)

    # a partial sum a task is as large as the model: few tasks, however many parts the documents have
    tasks = docs.select("text").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    found = tasks.mapInArrow(products, schema).repartition("term").mapInArrow(added, schema).toArrow()
    out = np.zeros((size + 1, wide))
    if found.num_rows:
        out[found.column("term").to_numpy()] = found.column("v").combine_chunks().flatten().to_numpy().reshape(-1, wide)
    result = np.zeros(everything)
    result[heavy] = out[:size] * weight[:, None] / (UNIT * max(out[size, 0], 1))
    return result


def _item_gram(parts: list[np.ndarray], weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same of the items' segments, as term lists."""
    out = np.zeros(q.shape)
    for part in parts:
        k, c = np.unique(part, return_counts=True)
        a = c * weight[k]
        a /= max(np.sqrt((a**2).sum()), 1e-9)
        out[k] += a[:, None] * (a @ q[k])
    return out / max(len(parts), 1)


def _svd(docs: DataFrame, terms: Terms, parts: list[np.ndarray], weight: np.ndarray, rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of all passages of docs and the items' segments (parts): terms x rank.

    Subspace iteration from a random start; a round is one pass over the documents.
    """
    size, rank = len(weight), min(rank, len(weight))
    wide = min(size, rank + 8)

    def gram(q: np.ndarray) -> np.ndarray:
        return _gram(docs, terms, weight, q) + _item_gram(parts, weight, q)

    q = np.linalg.qr(np.random.default_rng(9).standard_normal((size, wide)))[0]
    for _ in range(rounds - 1):
        q = np.linalg.qr(gram(q))[0]
    value, vector = np.linalg.eigh(q.T @ gram(q))
    return (q @ vector[:, ::-1][:, :rank]).astype(np.float32)


def _segments(n: int) -> list[tuple[int, int]]:
    """Stretches in which an item of n words is compared with passages."""
    if n <= WHOLE:
        return [(0, n)]
    return [(a, a + PASSAGE) for a in [*range(0, n - PASSAGE, PASSAGE // 2), n - PASSAGE]]


def fit(docs: DataFrame, items: list[tuple[int, str]]) -> Model | None:
    """Model of a block of items (id, text); those without a word are left out."""
    kept = [(i, t, h) for i, t, h in ((i, t, _hashes(t or "")) for i, t in items) if len(h)]
    if not kept:
        return None
    terms = Terms(np.concatenate([h for _, _, h in kept]))
    df, n = _counts(docs, terms)
    weight = np.where(df > max(STOP * n, STOP_LEAST), 0.0, np.log((n + 1) / (df + 1)) + 0.05)
    numbers = [terms.find(h)[1] for _, _, h in kept]
    parts = [(i, x[a:b]) for i, x in enumerate(numbers) if len(x) >= LEAST_WORDS for a, b in _segments(len(x))]
    basis = _svd(docs, terms, [x for _, x in parts], weight)
    table = (weight[:, None] * basis).astype(np.float32)
    vectors = np.array([table[x].sum(axis=0) for _, x in parts]).reshape(-1, table.shape[1])
    norms = np.sqrt((vectors**2).sum(axis=1))
    vectors /= np.maximum(norms, 1e-9)[:, None]
    masks = []
    for x in numbers:
        m: dict[int, int] = {}
        for j, t in enumerate(x.tolist()):
            m[t] = m.get(t, 0) | 1 << j
        masks.append(m)
    return Model(
        terms, Pieces(numbers), weight, table, vectors.astype(np.float32), norms.astype(np.float32), np.array([i for i, _ in parts]), [i for i, _, _ in kept],
        masks, [len(x) for x in numbers], [min(_answer_words(t), len(x)) for (_, t, _), x in zip(kept, numbers)],
    )


def _models(docs: DataFrame, benchmark: DataFrame):
    """A model for each block of items, in the order of ids; rows of null id or text are no items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))
    after = None
    while True:
        left = items if after is None else items.filter(F.col("item_id") > after)
        block = [(r["item_id"], r["text"]) for r in left.orderBy("item_id").limit(ITEM_BLOCK).collect()]
        if block:
            model = fit(docs.select(F.col("text").cast("string").alias("text")), block)
            if model:
                yield model
        if len(block) < ITEM_BLOCK:
            return
        after = block[-1][0]


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, lcs, answer.

    Null, empty and clean texts have no rows.  Repeated documents give repeated
    rows, a null doc_id is passed through; an item id that is repeated counts once,
    with the smallest text; other columns are ignored.  No items, no rows.
    Items of fewer than LEAST_WORDS words are found as whole word sequences only,
    with a null cosine; those without a word have no rows.
    """
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for model in _models(docs, benchmark):

        def run(batches, model=model):
            import pyarrow as pa

            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            for batch in batches:
                ids = batch.column("doc_id")
                for b in kernel.blocks(batch.column("text"), BLOCK_BYTES):
                    rows = [(ids[b.lo + d].as_py(), *x) for d, *x in model.find(b.buf, b.offs)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns; rows are judged one by one, as by scan().

    Items of fewer than LEAST_WORDS words count too, as whole word sequences: a
    one-word item removes every document with that word.
    """
    for model in _models(docs, benchmark):

        def run(batches, model=model):
            import pyarrow as pa

            for batch in batches:
                for b in kernel.blocks(batch.column("text"), BLOCK_BYTES):
                    keep = np.ones(b.hi - b.lo, bool)
                    keep[[d for d, *_ in model.find(b.buf, b.offs)]] = False
                    yield batch.slice(b.lo, b.hi - b.lo).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
