"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every window of ``WINDOW`` words that also starts earlier (in a document of
smaller id, or earlier in the same one) is a duplicate, and each word that a
duplicate window covers is removed.

Reference blocks.  A window's anchor is its ``GRAM``-word sequence of smallest
hash (leftmost at ties), so equal windows have equal anchors at equal places.
Consecutive windows of one anchor are a block: about one block in seven words,
cut by content alone.  A row per block (anchor hash, hash of all its words,
document, place) is the index of the reference; it is sorted globally by those four
columns, so that a block stands next to the earlier ones of the same words.  Each
block that repeats another one learns two sources: the first of its kind (in the
task's range) and the one just before it.

Greedy factors.  A document is parsed from left to right: at a block with sources
the one is taken that goes on longest over the following blocks at the same
distance, and the stretch is one factor (document, place, length, source document,
source place).  Only factors of a whole window or more are made.  Longest is meant among the
sources that a block knows; a source in between may go on longer.

Factor boundaries.  A factor's ends fall inside blocks whose words differ while
their anchors agree.  The windows of such blocks (of each distinct block's first
occurrence; its repetitions are factors anyway) are hashed one by one (128 bits)
and sorted likewise; those that repeat an earlier window are one-window blocks of
the parse and lengthen the factors beside them, or are factors of their own.

Nothing is grouped by a key that can be hot: both sorts are range partitioned by
all their columns, so a block that a third of the corpus shares is spread over
tasks.  A block at the edge of a task's range counts as a boundary block, which
is always right, only dearer.  Anchor and word hashes together are 128 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .work import LOWEST, Work, one_per_id, sort_globally

WINDOW, GRAM = 20, 6
_U = np.uint64


def sliding_argmin(keys: np.ndarray, span: int) -> np.ndarray:
    """Index of the smallest of each ``span`` consecutive keys, leftmost at ties of their upper 36 bits."""
    low = _U((1 << 28) - 1)
    m = (keys & ~low) | np.arange(len(keys)).astype(_U)
    have = 1
    while have * 2 <= span:
        wider = m.copy()
        np.minimum(m[:-have], m[have:], out=wider[: len(m) - have])
        m, have = wider, have * 2
    if have < span:
        wider = m.copy()
        np.minimum(m[: have - span], m[span - have :], out=wider[: len(m) + have - span])
        m = wider
    return (m & low).astype(np.int64)


def block_rows(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Blocks of the documents of a buffer: anchor hash, words hash, document, first window's word, number of windows."""
    words = kernel.split_words(buf, offs)
    h = kernel.word_hashes(buf, words)
    at, _ = kernel.gram_starts(words.first, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams = kernel.Grams(h)
    g = np.zeros(len(h), _U)
    i = np.arange(len(h) - gram + 1)
    g[: len(i)] = grams.between(i, i + gram)
    anchor = sliding_argmin(g, window - gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at))
    start, end = at[lo], at[hi - 1] + window
    doc = np.searchsorted(words.first, start, "right") - 1
    return g[anchor[lo]].view(np.int64), grams.between(start, end).view(np.int64), doc, start - words.first[doc], hi - lo


def _index(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """a, u, doc, place (first word) and n (number of windows) of every block."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for b in kernel.blocks(batch.column("text")):
                a, u, doc, start, n = block_rows(b.buf, b.offs, window, gram)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "u": pa.array(u), "doc": pa.array(ids[b.lo + doc].astype(np.int64)), "place": pa.array(start), "n": pa.array(n.astype(np.int32))})

    return docs.mapInArrow(run, "a long, u long, doc long, place long, n int")


#: A piece of the parse: n windows from a place; its two sources, the first of its kind and the one before (null: a boundary block).
_PIECE = "doc long, place long, n int, first_doc long, first_place long, last_doc long, last_place long"


class _Run:
    """Walks rows sorted by a key of two columns, then doc and place: which repeat the key of the row before, and their sources."""

    def __init__(self):
        self.last = None  # key, key, doc, place, first doc, first place of the last row

    def step(self, k1, k2, doc, place):
        """same key as the row before; the same row as the one before; the first doc and place of the key; the row before's."""
        n, head = len(doc), self.last is None
        before = [np.concatenate([[x[0] if head else self.last[i]], x[:-1]]) for i, x in enumerate((k1, k2, doc, place))]
        same = (k1 == before[0]) & (k2 == before[1])
        again = same & (doc == before[2]) & (place == before[3])
        if head:
            same[0] = again[0] = False
        at = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        carried = (doc[0], place[0]) if head else self.last[4:]
        first = [np.where(at >= 0, x[np.maximum(at, 0)], c) for x, c in zip((doc, place), carried)]
        self.last = (k1[-1], k2[-1], doc[-1], place[-1], first[0][-1], first[1][-1])
        return same, again, first, before[2:]


def _pieces(doc, place, n, sources=None):
    import pyarrow as pa

    size = len(doc)
    four = [pa.nulls(size, pa.int64())] * 4 if sources is None else [pa.array(x, pa.int64()) for x in sources]
    return [pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32()), *four]


def _parse(index: DataFrame) -> DataFrame:
    """_PIECE rows: blocks that repeat another (with sources) and boundary blocks (without)."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in _PIECE.split(", ")]
        walk, held = _Run(), None  # held: the last distinct block (doc, place, n, boundary); another may follow at its anchor
        anchor = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, u, doc, place, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            head = walk.last is None
            same_anchor = np.concatenate([[not head and a[0] == anchor], a[1:] == a[:-1]])
            same, again, first, before = walk.step(a, u, doc, place)
            anchor = a[-1]
            take = np.flatnonzero(same & ~again)
            yield pa.RecordBatch.from_arrays(_pieces(doc[take], place[take], n[take], [first[0][take], first[1][take], before[0][take], before[1][take]]), names=names)
            distinct = np.flatnonzero(~same)
            if not len(distinct):
                continue
            # a distinct block is a boundary block if a neighbour among the distinct ones has its anchor
            mixed = same_anchor[distinct].copy()
            mixed[:-1] |= same_anchor[distinct[1:]]
            docs, places, counts = [], [], []
            if held is not None and (held[3] or same_anchor[distinct[0]]):
                docs.append([held[0]]), places.append([held[1]]), counts.append([held[2]])
            if head:
                mixed[0] = True
            done = distinct[:-1][mixed[:-1]]
            docs.append(doc[done]), places.append(place[done]), counts.append(n[done])
            end = distinct[-1]
            held = (doc[end], place[end], n[end], bool(mixed[-1]))
            yield pa.RecordBatch.from_arrays(_pieces(*(np.concatenate(x) for x in (docs, places, counts))), names=names)
        if held is not None:  # another may follow in the next task's range
            yield pa.RecordBatch.from_arrays(_pieces([held[0]], [held[1]], [held[2]]), names=names)

    return sort_globally(index, "a", "u", "doc", "place").mapInArrow(run, _PIECE)


def _boundary_windows(joined: DataFrame, window: int) -> DataFrame:
    """w1, w2 (128-bit hash), doc, word of every window of the listed blocks; joined: doc, text, blocks (place, n)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            listed = batch.column("blocks")
            for b in kernel.blocks(batch.column("text")):
                words = kernel.split_words(b.buf, b.offs)
                part = listed.slice(b.lo, b.hi - b.lo)
                value = part.flatten()
                place, n = (value.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                doc = np.repeat(np.arange(b.hi - b.lo), part.value_lengths().to_numpy(zero_copy_only=False))
                doc, word = np.repeat(doc, n), np.repeat(place, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = words.first[doc] + word
                w = [kernel.Grams(kernel.word_hashes(b.buf, words, s), s).between(at, at + window).view(np.int64) for s in (0, 1)]
                yield pa.RecordBatch.from_pydict({"w1": pa.array(w[0]), "w2": pa.array(w[1]), "doc": pa.array(ids[b.lo + doc].astype(np.int64)), "word": pa.array(word.astype(np.int64))})

    return joined.select("doc", "text", "blocks").mapInArrow(run, "w1 long, w2 long, doc long, word long")


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """_PIECE rows of one window each: all windows but the first of their words; plus the edges of the tasks' ranges.

    kind is 0, or 1 and 2 for the first and last row of a task's range, with the hash
    and the task's number.
    """

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in _PIECE.split(", ")] + ["kind", "w1", "w2", "task"]
        walk = _Run()

        def edge(kind, w1, w2, doc, place, task):
            columns = _pieces([doc], [place], [1])
            return pa.RecordBatch.from_arrays([*columns, pa.array([kind], pa.int32()), pa.array([w1], pa.int64()), pa.array([w2], pa.int64()), pa.array([task], pa.int32())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            w1, w2, doc, word, task = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if walk.last is None:
                yield edge(1, w1[0], w2[0], doc[0], word[0], task[0])
            same, again, first, before = walk.step(w1, w2, doc, word)
            take = np.flatnonzero(same & ~again)
            columns = _pieces(doc[take], word[take], np.ones(len(take), np.int32), [first[0][take], first[1][take], before[0][take], before[1][take]])
            blank = pa.nulls(len(take), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(take), np.int32)), blank, blank, pa.nulls(len(take), pa.int32())], names=names)
        if walk.last is not None:
            yield edge(2, *walk.last[:4], task[-1])

    return sort_globally(windows, "w1", "w2", "doc", "word").withColumn("task", F.spark_partition_id()).mapInArrow(run, _PIECE + ", kind int, w1 long, w2 long, task int")


def _parsed(docs: DataFrame, window: int, gram: int, work: Work) -> DataFrame:
    """docs (from one_per_id) with ``pieces``: each document's repeating blocks and windows with their sources, in order, or null."""
    index = work.save(_index(docs.select("doc", "text"), window, gram), "index")  # the sort reads its input twice
    blocks = work.save(_parse(index), "blocks")
    work.drop("index")
    work.release()
    boundary = blocks.filter("first_doc IS NULL").groupBy("doc").agg(F.collect_list(F.struct("place", "n")).alias("blocks"))
    windows = work.save(_boundary_windows(docs.select("doc", "text").join(boundary, "doc"), window), "windows")
    work.release()
    repeated = work.save(_repeated_windows(windows), "repeated")
    work.drop("windows")
    work.release()
    # a task's first window may repeat the last of the task before: two rows a task, settled here
    edges = sorted(repeated.filter("kind > 0").collect(), key=lambda r: (r["task"], r["kind"]))
    late = []
    for before, r in zip(edges, edges[1:]):
        if r["kind"] == 1 and (before["w1"], before["w2"]) == (r["w1"], r["w2"]) and (before["doc"], before["place"]) != (r["doc"], r["place"]):
            late.append((r["doc"], r["place"], 1, before["doc"], before["place"], before["doc"], before["place"]))
    columns = [c.split()[0] for c in _PIECE.split(", ")]
    found = blocks.filter("first_doc IS NOT NULL").unionAll(repeated.filter("kind = 0").select(*columns))
    if late:
        found = found.unionAll(docs.sparkSession.createDataFrame(late, _PIECE))
    pieces = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*columns[1:]))).alias("pieces"))
    return docs.join(pieces, "doc", "left")


def parse(pieces, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (place, length in words, source document, source place) of a document's pieces (an Arrow struct array in order)."""
    place, n, d1, p1, d2, p2 = (pieces.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(6))
    out, i = [], 0
    while i < len(place):
        best = (-1, 0, 0, 0)
        for d, p in {(d1[i], p1[i] - place[i]), (d2[i], p2[i] - place[i])}:
            j, end = i, place[i] + n[i]
            while j + 1 < len(place) and place[j + 1] <= end and ((d1[j + 1], p1[j + 1] - place[j + 1]) == (d, p) or (d2[j + 1], p2[j + 1] - place[j + 1]) == (d, p)):
                j += 1
                end = max(end, place[j] + n[j])
            best = max(best, (end, d, p, j))
        end, d, p, j = best
        out.append((place[i], end - place[i] + window - 1, d, place[i] + p))
        i = j + 1
    return out


def _remove(joined: DataFrame, window: int, text_out: bool) -> DataFrame:
    """n_words, n_removed and kept_sha256 (or the kept text) of each document, without the words of its factors."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            texts, pieces = batch.column("text"), batch.column("pieces")
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b"").split()
                removed, left = 0, words
                if pieces[i].is_valid:
                    cover = np.zeros(len(words), bool)
                    for place, length, _, _ in parse(pieces[i].values, window):
                        cover[place : place + length] = True
                    removed = int(cover.sum())
                    left = [w for w, gone in zip(words, cover.tolist()) if not gone]
                n_words.append(len(words)), n_removed.append(removed)
                kept.append(b" ".join(left) if text_out else hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary() if text_out else pa.string()).cast(pa.string())})

    return joined.select("doc_id", "text", "pieces").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, place, length, source_id, source_place: the factors of every document, in words; each equals its source word for word.

    Rows as dedup() treats them; rows that repeat an id are parsed once.
    """
    found = _parsed(one_per_id(docs, work := Work(docs.sparkSession)), window, gram, work).filter("pieces IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(batch.column("doc")[i].as_py(), *f) for i in range(batch.num_rows) for f in parse(batch.column("pieces")[i].values, window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2, 3, 4)], names=["doc", "place", "length", "source", "source_place"])

    known = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return found.select("doc", "pieces").mapInArrow(run, "doc long, place long, length long, source long, source_place long").select(known("doc").alias("doc_id"), "place", "length", known("source").alias("source_id"), "source_place")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words (column ``kept``; the words themselves with text_out).

    A null text has no words.  A null id counts as the smallest one.  Rows that
    repeat an id are one document, with the smallest of their texts, and each of
    them gets its result.  Documents of fewer words than the window lose none.
    Other columns are ignored; an empty table gives an empty one.
    """
    work = Work(docs.sparkSession)
    joined = _parsed(one_per_id(docs, work), window, gram, work)
    return _remove(joined.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))), window, text_out)


#: DuckDB SQL of the op9 query over documents.
SQL = """
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, CAST(unnest(range(1, len(w) - 18)) AS BIGINT) AS s, w FROM split WHERE len(w) >= 20
), keyed AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS k FROM win
), dup AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM dup
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id
)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(len(s.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
