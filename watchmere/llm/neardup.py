"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

A document's set is its distinct ``WORDS``-word shingles (ASCII letters
lower-cased).  Documents with equal sets form one class and only its smallest id
goes on.  The sketch has ``COORDS`` coordinates filled in rounds: in round i
every shingle is hashed into one bin with a value that grows with i, and each bin
keeps its smallest; the rounds from ``COORDS`` on aim at one bin each, so after
twice as many every bin is filled, and most sets need a handful of rounds.

Bands of ``ROWS`` coordinates give bucket keys.  At a similarity of 0.75 a pair
misses all ``COORDS / ROWS`` bands once in 2,500; every candidate is verified on
the full sets.

In a bucket every member is first checked against the smallest, and the links found
give components.  Buckets whose members are then in several components are looked
at again, whole: members outside a bucket's largest component meet all others in a
grid of blocks.  A block carries its documents' texts, so links are confirmed
where the rows meet and no row is made per pair; sizes and sketches rule out
hopeless pairs (an estimate four deviations too low) before sets are compared, and
pairs that the block has linked already are passed over.

Classes and buckets are found by global sorts, range partitioned by all columns,
so a class or bucket that a third of all rows share is spread over tasks; its
pieces are stitched together by one row a task.  Components are computed by
alternating large and small stars on tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .work import LOWEST, Work, one_per_id, sort_globally, spare_name

WORDS, PERCENT = 5, 75
COORDS, ROWS = 240, 6
ESTIMATE = 0.64
PARTNERS = 64
BLOCK, MOST_BLOCK, BLOCKS = 256, 1024, 64
FEW_IDS = 4_000_000
DOCS = 4096

_U = np.uint64


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (52 bits) of at most DOCS documents, sorted in each, and where each document's begin."""
    low = kernel.lower_ascii(buf)
    words = kernel.split_words(low, offs)
    grams = kernel.Grams(kernel.word_hashes(low, words))
    n = np.diff(words.first)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) + np.repeat(words.first[:-1] - begin[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    h = grams.between(at, at + np.repeat(np.minimum(n, WORDS), count)) >> _U(12)
    both = np.sort(doc.astype(_U) << _U(52) | h)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    doc = (both >> _U(52)).astype(np.int64)
    return both & _U((1 << 52) - 1), np.searchsorted(doc, np.arange(len(n) + 1))


def sketch(sets: np.ndarray, first: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketches: documents x coords; rows of empty sets are left at the largest value."""
    docs = len(first) - 1
    out = np.full(docs * coords, np.iinfo(np.uint64).max, _U)
    todo = np.flatnonzero(np.diff(first) > 0)
    for i in range(2 * coords):
        if not len(todo):
            break
        n = first[todo + 1] - first[todo]
        begin = np.concatenate([[0], np.cumsum(n)])
        x = sets[np.arange(begin[-1]) + np.repeat(first[todo] - begin[:-1], n)]
        with np.errstate(over="ignore"):
            v = kernel.mix(x + _U(i + 1) * _U(0x9E3779B97F4A7C15))
        value = _U(i) << _U(54) | v >> _U(10)
        if i < coords:
            bins = ((v & _U(0xFFFFFF)) * _U(coords) >> _U(24)).astype(np.int64)
            np.minimum.at(out, np.repeat(todo * coords, n) + bins, value)
        else:
            place = todo * coords + i - coords
            out[place] = np.minimum(out[place], np.minimum.reduceat(value, begin[:-1]))
        todo = todo[(out.reshape(docs, coords)[todo] == np.iinfo(np.uint64).max).any(axis=1)]
    return out.reshape(docs, coords)


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    docs, coords = sketches.shape
    part = sketches.reshape(docs, coords // rows, rows)
    key = np.arange(coords // rows).astype(_U)[None, :] + _U(1)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = kernel.mix(key * _U(0xD1342543DE82EF95) + part[:, :, k])
    return key.view(np.int64)


def _parts(b: kernel.Block):
    for lo in range(0, b.hi - b.lo, DOCS):
        hi = min(lo + DOCS, b.hi - b.lo)
        yield b.lo + lo, b.buf[b.offs[lo] : b.offs[hi]], b.offs[lo : hi + 1] - b.offs[lo]


def _sketches(docs: DataFrame) -> DataFrame:
    """s1, s2 (digest of the set), doc, n and bands of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc")
            for b in kernel.blocks(batch.column("text")):
                for lo, buf, offs in _parts(b):
                    sets, first = shingles(buf, offs)
                    n = np.diff(first)
                    with np.errstate(over="ignore"):
                        sums = [np.concatenate([[_U(0)], np.cumsum(kernel.mix(sets + _U(c)), dtype=_U)]) for c in (1 << 60, 1 << 61)]
                        s1, s2 = ((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in sums)
                    keys = band_keys(sketch(sets, first)).reshape(-1)
                    some = n > 0
                    offsets = np.concatenate([[0], np.cumsum(np.where(some, COORDS // ROWS, 0))]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({
                        "s1": pa.array(s1), "s2": pa.array(s2), "doc": ids.slice(lo, len(n)), "n": pa.array(n.astype(np.int64)),
                        "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[np.repeat(some, COORDS // ROWS)])),
                    })

    return docs.mapInArrow(run, "s1 long, s2 long, doc long, n long, bands array<long>")


def _described(docs: DataFrame) -> DataFrame:
    """doc, n, bands, sk (a byte a coordinate) and text of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("doc"), batch.column("text")
            for b in kernel.blocks(texts):
                for lo, buf, offs in _parts(b):
                    sets, first = shingles(buf, offs)
                    sk, n = sketch(sets, first), np.diff(first)
                    yield pa.RecordBatch.from_pydict({
                        "doc": ids.slice(lo, len(n)), "n": pa.array(n.astype(np.int64)), "bands": pa.array(list(band_keys(sk)), pa.list_(pa.int64())),
                        "sk": pa.array([x.tobytes() for x in (kernel.mix(sk) & _U(255)).astype(np.uint8)], pa.binary()), "text": texts.slice(lo, len(n)),
                    })

    return docs.select("doc", "text").mapInArrow(run, "doc long, n long, bands array<long>, sk binary, text string")


def _classes(sketches: DataFrame) -> DataFrame:
    """doc, n, rep (smallest id of the class within the task), bands of reps only, and before.

    The first row of a task also carries its set's digest in s1, s2 with before = 0,
    and one more row (doc null) the last with before = 1.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("bands", pa.list_(pa.int64())), ("task", pa.int32()), ("edge", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s1, s2, doc, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            new = np.ones(len(doc), bool)
            new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (n[1:] != n[:-1])
            at_start = last is None
            if last is not None:
                new[0] = (last[0], last[1], last[3]) != (s1[0], s2[0], n[0])
            alone = n == 0  # empty sets are linked with nothing
            head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            rep = np.where(head >= 0, doc[np.maximum(head, 0)], last[2] if last else 0)
            rep = np.where(alone, doc, rep)
            last = (s1[-1], s2[-1], rep[-1], n[-1], int(batch.column("task")[0].as_py()))
            mask = pa.array(~(new & ~alone))
            edge = np.full(len(doc), -1, np.int32)
            if at_start:
                edge[0] = 0
            import pyarrow.compute as pc

            bands = pc.if_else(mask, pa.scalar(None, batch.schema.field("bands").type), batch.column("bands"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n), pa.array(rep), bands.cast(pa.list_(pa.int64())), batch.column("task"), pa.array(edge), pa.array(s1), pa.array(s2)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"n": int(last[3]), "rep": int(last[2]), "task": last[4], "edge": 1, "s1": int(last[0]), "s2": int(last[1])}], schema=schema)

    ordered = sort_globally(sketches, "s1", "s2", "n", "doc").select("s1", "s2", "doc", "n", "bands", F.spark_partition_id().alias("task"))
    return ordered.mapInArrow(run, "doc long, n long, rep long, bands array<long>, task int, edge int, s1 long, s2 long")


def _stars(keys: DataFrame) -> DataFrame:
    """key, x, c: every bucket member but the smallest in the task, with that one; edges of tasks' ranges as in _classes."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("c", pa.int64()), ("task", pa.int32()), ("edge", pa.int32())])
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            task = int(batch.column("task")[0].as_py())
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            if last is None:
                yield pa.RecordBatch.from_pylist([{"key": int(key[0]), "x": int(rep[0]), "c": int(rep[0]), "task": task, "edge": 0}], schema=schema)
            else:
                new[0] = last[0] != key[0]
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            c = np.where(head >= 0, rep[np.maximum(head, 0)], last[1] if last else 0)
            last = (key[-1], c[-1], task)
            take = np.flatnonzero(c != rep)
            yield pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(rep[take]), pa.array(c[take]), pa.nulls(len(take), pa.int32()), pa.nulls(len(take), pa.int32())], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"key": int(last[0]), "x": int(last[1]), "c": int(last[1]), "task": last[2], "edge": 1}], schema=schema)

    ordered = sort_globally(keys, "key", "rep").select("key", "rep", F.spark_partition_id().alias("task"))
    return ordered.mapInArrow(run, "key long, x long, c long, task int, edge int")


def _stitch(edges: list, same) -> list[tuple]:
    """(edge row of a task's first run, true head) for runs that go on from the task before; edges: two rows a task."""
    out, head = [], None
    before = None
    for r in sorted(edges, key=lambda r: (r["task"], r["edge"])):
        if r["edge"] == 0:
            going_on = before is not None and same(before, r)
            head = (head if head is not None else before["head"]) if going_on else None
            if going_on:
                out.append((r, head))
            first = r
        else:
            # the last run is the first one of the task if nothing else came between
            mine = r["head"]
            if head is not None and same(first, r) and mine == first["head"]:
                before = {**r, "head": head}
            else:
                before, head = r, None
    return out


def _verify(pairs: DataFrame, texts: DataFrame, work: Work) -> DataFrame:
    """The pairs (x, c) whose full sets have PERCENT of their union in common.

    A centre's partners are dealt into groups of about PARTNERS; its text meets each
    group's, first in sort order, and a task holds one centre's set at a time.
    """
    groups = work.save(pairs.groupBy("c").agg(F.ceil(F.count("*") / PARTNERS).alias("groups")).filter("groups > 1"), "groups")
    spread = pairs.join(groups, "c", "left").select("x", "c", F.pmod(F.xxhash64("x"), F.coalesce("groups", F.lit(1))).alias("g"))
    roles = spread.select(F.col("x").alias("doc"), "c", "g", F.lit(1).alias("role")).unionAll(spread.select(F.col("c").alias("doc"), "c", "g", F.lit(0).alias("role")).distinct())
    rows = roles.join(texts, "doc").repartition("c", "g").sortWithinPartitions("c", "g", "role")

    def run(batches):
        import pyarrow as pa

        centre, mine = None, None
        for batch in batches:
            c, g, role, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("c", "g", "role", "doc"))
            xs, cs = [], []
            for b in kernel.blocks(batch.column("text")):
                for lo, buf, offs in _parts(b):
                    sets, first = shingles(buf, offs)
                    for i in range(len(first) - 1):
                        k, own = lo + i, sets[first[i] : first[i + 1]]
                        if role[k] == 0:
                            centre, mine = (c[k], g[k]), own.copy()
                        elif centre == (c[k], g[k]) and linked(mine, own):
                            xs.append(doc[k]), cs.append(c[k])
            yield pa.RecordBatch.from_pydict({"x": pa.array(xs, pa.int64()), "c": pa.array(cs, pa.int64())})

    return rows.select("c", "g", "role", "doc", "text").mapInArrow(run, "x long, c long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have PERCENT of their union in common."""
    if not len(a) or not len(b):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """node, label (smallest node that it is linked with) of every node of the edges x, c that isn't the smallest: alternating stars."""
    table = f"{name}-edges"
    e = work.save(edges.select(F.greatest("x", "c").alias("hi"), F.least("x", "c").alias("lo")).filter("hi <> lo").distinct(), table)
    while True:
        # done when every node points to one other and none that is pointed to points on
        heads = e.groupBy("hi").agg(F.min("lo").alias("a"), F.max("lo").alias("b"))
        if not heads.join(e.select(F.col("lo").alias("hi"), F.lit(True).alias("on")).distinct(), "hi", "left").filter("on OR a <> b").limit(1).count():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = work.save(both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), f"{name}-large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        e = work.save(small.distinct(), table, replace=True)
        work.drop(f"{name}-large")


def _unsettled(stars: DataFrame, labels: DataFrame, work: Work) -> DataFrame:
    """key, x, label, asks, rows, columns: members of the buckets whose members have several labels.

    asks: it is outside the bucket's largest part.  rows and columns are the blocks that
    all members and the asking ones are dealt into.
    """
    members = stars.select("key", "x").unionAll(stars.select("key", F.col("c").alias("x")).distinct())
    parts = work.save(members.join(labels.withColumnRenamed("node", "x"), "x", "left").select("key", "x", F.coalesce("label", "x").alias("label")), "parts")
    groups = parts.groupBy("key", "label").agg(F.count("*").alias("n"))
    shape = groups.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most")).filter("parts > 1")
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.col("all") / BLOCKS))
    shape = shape.select("key", "top", F.ceil(F.col("all") / block).alias("rows"), F.ceil((F.col("all") - F.col("most")) / block).alias("columns"))
    found = work.save(parts.join(shape, "key").select("key", "x", "label", (F.col("label") != F.col("top")).alias("asks"), "rows", "columns"), "unsettled")
    work.drop("parts")
    return found


class _Cell:
    """The asking documents of one block of a bucket, and what the block has linked so far."""

    def __init__(self):
        self.rows, self.ready, self.parent = [], False, {}

    def add(self, *row):
        self.rows.append(row)

    def root(self, label: int) -> int:
        while label in self.parent:
            label = self.parent[label]
        return label

    def meet(self, key: int, x: int, label: int, n: int, sk: np.ndarray, bands: np.ndarray, own: np.ndarray, asks: bool) -> list[tuple[int, int]]:
        """Labels that links of document x with the block's tie together."""
        if not self.rows:
            return []
        if not self.ready:
            self.x, self.label, self.n, self.sk, self.bands = (np.array([r[k] for r in self.rows]) for k in range(5))
            self.roots, self.ready = self.label.copy(), True
        mine = self.root(label)
        ok = (self.roots != mine) & (np.minimum(self.n, n) * 100 >= np.maximum(self.n, n) * PERCENT)
        if asks:
            ok &= self.x < x  # both ask: once is enough
        at = np.flatnonzero(ok)
        at = at[(self.sk[at] == sk).sum(axis=1) >= ESTIMATE * COORDS]
        if not len(at):
            return []
        shared = self.bands[at] == bands  # a pair that shares several buckets is compared in the first
        at = at[self.bands[at, shared.argmax(axis=1)] == key]
        out = []
        for j in at.tolist():
            if self.roots[j] != mine and linked(self.rows[j][5], own):
                out.append((int(self.label[j]), label))
                old, new = max(mine, int(self.roots[j])), min(mine, int(self.roots[j]))
                self.parent[old] = mine = new
                self.roots[self.roots == old] = new
        return out


def _grid(some: DataFrame, described: DataFrame) -> DataFrame:
    """x, c: pairs of labels that links inside the buckets tie together; every pair of members of different parts is judged."""

    def cells(role: int, across: str, along: str) -> DataFrame:
        chosen = some.filter("asks") if role == 0 else some
        mine, other = F.pmod(F.xxhash64("x"), F.col(across)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(along) - 1))
        return chosen.select("key", F.col("x").alias("doc"), "label", "asks", F.lit(role).alias("role"), mine.alias("column" if role == 0 else "row"), other.alias("row" if role == 0 else "column"))

    rows = cells(0, "columns", "rows").unionByName(cells(1, "rows", "columns")).join(described, "doc")
    rows = rows.repartition("key", "row", "column").sortWithinPartitions("key", "row", "column", "role")

    def run(batches):
        import pyarrow as pa

        at, cell = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_pylist() for n in ("key", "row", "column", "role", "doc", "label", "asks", "n")}
            sk = [np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column("sk")]
            bands = batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDS // ROWS)
            found = []
            for b in kernel.blocks(batch.column("text")):
                for lo, buf, offs in _parts(b):
                    sets, first = shingles(buf, offs)
                    for i, own in zip(range(lo, lo + len(first) - 1), (sets[s:e] for s, e in zip(first[:-1], first[1:]))):
                        here = (col["key"][i], col["row"][i], col["column"][i])
                        if here != at:
                            at, cell = here, _Cell()
                        if col["role"][i] == 0:
                            cell.add(col["doc"][i], col["label"][i], col["n"][i], sk[i].copy(), bands[i].copy(), own.copy())
                        else:
                            found += cell.meet(here[0], col["doc"][i], col["label"][i], col["n"][i], sk[i], bands[i], own, col["asks"][i])
            yield pa.RecordBatch.from_pydict({"x": pa.array([a for a, _ in found], pa.int64()), "c": pa.array([b for _, b in found], pa.int64())})

    return rows.mapInArrow(run, "x long, c long")


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (its id is that).

    Null and wordless texts have empty sets and are linked with nothing.  A null id
    counts as the smallest one, and a component with it has a null component_id.
    Rows that repeat an id are one document, with the smallest of their texts, and
    each of them gets its result.  Other columns are ignored; an empty table gives
    an empty one.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession)
    docs = one_per_id(docs, work)
    sketches = work.save(_sketches(docs.select("doc", "text")), "sketches")
    classes = work.save(_classes(sketches), "classes")
    work.drop("sketches")
    work.release()
    edges = [{**r.asDict(), "head": r["rep"]} for r in classes.filter("edge >= 0").select("task", "edge", "rep", "n", "s1", "s2").collect()]  # two rows a task
    stitched = [(r["rep"], head) for r, head in _stitch(edges, lambda p, q: (p["s1"], p["s2"], p["n"]) == (q["s1"], q["s2"], q["n"])) if r["n"]]
    classes = classes.filter("doc IS NOT NULL")
    reps = classes.filter("bands IS NOT NULL")
    stars = work.save(_stars(reps.select(F.explode("bands").alias("key"), F.col("doc").alias("rep"))), "stars")
    work.release()
    edges = [{**r.asDict(), "head": r["c"]} for r in stars.filter("edge IS NOT NULL").collect()]  # two rows a task
    joints = [(r["key"], r["x"], head) for r, head in _stitch(edges, lambda p, q: p["key"] == q["key"]) if r["x"] != head]
    stars = stars.filter("edge IS NULL").select("key", "x", "c")
    if joints:
        stars = stars.unionAll(spark.createDataFrame(joints, "key long, x long, c long"))
    stars = stars.select("key", F.greatest("x", "c").alias("x"), F.least("x", "c").alias("c"))
    pairs = work.save(stars.select("x", "c").distinct(), "pairs")
    inside = work.save(pairs.select(F.col("x").alias("doc")).unionAll(pairs.select(F.col("c").alias("doc"))).distinct(), "inside")
    few = inside.count() <= FEW_IDS  # then no text is shuffled for this; beyond, both sides are
    texts = work.save(docs.select("doc", "text").join(F.broadcast(inside) if few else inside, "doc"), "texts")
    work.drop("inside")
    work.release()
    links = _verify(pairs, texts, work)
    if stitched:
        links = links.unionAll(spark.createDataFrame(stitched, "x long, c long"))
    labels = components(links, work, "first")
    work.drop("pairs", "groups")
    some = _unsettled(stars, labels, work)
    if some.limit(1).count():
        described = work.save(_described(texts.join(some.select(F.col("x").alias("doc")).distinct(), "doc")), "described")
        more = components(_grid(some, described), work, "second")
        # nodes of more are labels (or documents that had none), never nodes of labels
        joined = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("whole")), "label", "left")
        labels = work.save(joined.select("node", F.coalesce("whole", "label").alias("label")).unionAll(more), "labels")
        work.drop("described", "first-edges", "second-edges")
    work.drop("texts", "stars", "unsettled")
    work.release()
    if stitched:
        reps_of = F.coalesce("whole", "rep")
        classes = classes.join(F.broadcast(spark.createDataFrame(stitched, "rep long, whole long").distinct()), "rep", "left")  # a row a task at most
    else:
        reps_of = F.col("rep")
    out = classes.select("doc", "n", reps_of.alias("node")).join(labels, "node", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component"))
    if docs.filter("times > 1").limit(1).count():
        out = out.join(docs.select("doc", "times"), "doc").select("doc", "n_shingles", "component", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    known = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select(known("doc").alias("doc_id"), "n_shingles", known("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs of each group's smallest id, all columns; of rows that repeat an id one stays.

    That is the one of smallest text (a null one as empty), at ties of smallest hash of
    all columns.  Wordless texts stay; a null id is an id like others; an empty table
    gives an empty one.
    """
    mark = spare_name(docs.columns, "doc")
    chosen = group(docs).filter("kept").select(F.coalesce("doc_id", F.lit(LOWEST)).alias(mark)).distinct()
    out = docs.withColumn(mark, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))).join(chosen, mark, "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        out = out.groupBy(mark).agg(F.min_by(F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))).alias("r")).select("r.*")
    return out.select(*docs.columns)


#: DuckDB SQL of the op4 query over documents.
SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0)
  )
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y WHERE 100 * c >= 75 * (sx.n + sy.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.y FROM reach r JOIN link l ON l.x = r.b
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id JOIN comp c ON c.a = d.doc_id
"""
