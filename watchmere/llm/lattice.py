"""Embedding near-dedup by lattice hashing: E8 cells of random projections, probes of neighbouring cells, cosine.

A vector's unit form goes through ``TABLES`` random Gaussian projections onto
``8 * BLOCKS`` dimensions; each run of eight is decoded to its nearest point of the
lattice E8 at ``SCALE``, and the points together are the vector's cell in that table.
Every vector is stored under its cell and looks into ``PROBES`` cells: its own and
those whose points lie next nearest (a point's neighbours are the 240 shortest
vectors of E8 away).  Two vectors meet if either looks into the other's cell in any
table.  Every pair that meets is verified by its cosine in double precision.

Groups of copies don't cost their square.  Equal vectors are one class with a
weight.  Vectors whose cosine with a common centre is at least ``BALL`` are a ball:
their cosines are at least ``COSINE`` by the triangle inequality of angles, so its
members are linked by their number alone and only pairs of different balls are
verified.  Centres are the smallest ids of cells.  The rest of a large cell is dealt
into blocks, so no task holds a cell; a pair counts in the first table, and there
in the first direction, that it meets in, so blocks add up numbers and no pair is
written.

Recall is that of the search, measured in the tests against all pairs; what is found
is exact, and every row is indexed.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .neardup import components
from .work import LOWEST, Work

COSINE = 0.9
BALL = 0.975  # cos(2 * acos(0.975)) = 0.90125
TABLES, BLOCKS, PROBES, SCALE = 8, 2, 6, 2.0
BLOCK = 1024
PAIRS, MATRIX = 1 << 16, 1 << 12
SALTS = 32

_U = np.uint64


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for signs in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = signs
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(np.sign(s)) > 0]
    return np.array(found)


SHORTEST = _shortest()


def nearest(x: np.ndarray) -> np.ndarray:
    """The point of E8 nearest to each row of x: the better of the nearest integer and half-integer points of even sum."""

    def even(y: np.ndarray) -> np.ndarray:
        whole = np.rint(y)
        off = y - whole
        odd = np.flatnonzero(whole.sum(axis=1) % 2)
        worst = np.abs(off[odd]).argmax(axis=1)
        whole[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return whole

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their magnitude."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _key(points: np.ndarray, table: int, dims: int) -> np.ndarray:
    """64-bit keys of cells: points (in halves) of all blocks, with the table and the number of dimensions."""
    key = np.full(points.shape[:-1], (table + 1) * 1_000_003 + dims, dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(points.shape[-1]):
            key = kernel.mix(key * _U(0xD1342543DE82EF95) + points[..., k].astype(np.int64).view(_U))
    return key.view(np.int64)


def cells(units: np.ndarray) -> np.ndarray:
    """rows x TABLES x PROBES: keys of the cells that each unit vector looks into; the first is its own."""
    n, dims = units.shape
    out = np.empty((n, TABLES, PROBES), np.int64)
    each = 8 * BLOCKS
    normal = np.random.default_rng([7, dims]).standard_normal((dims, TABLES * each))
    near = units @ normal / SCALE
    for t in range(TABLES):
        x = near[:, t * each : (t + 1) * each].reshape(n * BLOCKS, 8)
        own = nearest(x)
        far = 2 - 2 * (x - own) @ SHORTEST.T  # squared distance beyond that of the own point
        best = np.argpartition(far, PROBES - 2, axis=1)[:, : PROBES - 1]
        cost = np.take_along_axis(far, best, axis=1)
        order = np.lexsort((best, cost), axis=1)  # ties by number
        best, cost = np.take_along_axis(best, order, axis=1), np.take_along_axis(cost, order, axis=1)
        steps = np.concatenate([np.zeros((n * BLOCKS, 1, 8)), SHORTEST[best]], axis=1).reshape(n, BLOCKS, PROBES, 8)
        cost = np.concatenate([np.zeros((n * BLOCKS, 1)), cost], axis=1).reshape(n, BLOCKS, PROBES)
        total = cost[:, 0]
        choice = np.arange(PROBES)[None, :].repeat(n, axis=0)[:, :, None]
        for b in range(1, BLOCKS):  # the PROBES cheapest choices of one point a block
            every = (total[:, :, None] + cost[:, b, None, :]).reshape(n, -1)
            take = np.argsort(every, axis=1, kind="stable")[:, :PROBES]
            total = np.take_along_axis(every, take, axis=1)
            choice = np.concatenate([np.take_along_axis(choice, (take // PROBES)[:, :, None], axis=1), (take % PROBES)[:, :, None]], axis=2)
        own = own.reshape(n, BLOCKS, 8)
        points = np.concatenate([own[:, b, None, :] + np.take_along_axis(steps[:, b], choice[:, :, b, None], axis=1) for b in range(BLOCKS)], axis=2)
        out[:, t] = _key(np.rint(2 * points), t, dims)
    return out


def _arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls and where each list begins."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64), offsets - offsets[0]


def _units(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a list column by number of dimensions."""
    values, offsets = _arrays(column)
    size = np.diff(offsets)
    return [(at, unit(values[offsets[at][:, None] + np.arange(d)])) for d in np.unique(size) for at in [np.flatnonzero(size == d)]]


def _usable(e: str):
    """Whether a vector has a direction: components, none null or non-finite, one at least not zero."""
    return F.expr(f"{e} IS NOT NULL AND size({e}) > 0 AND forall({e}, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists({e}, x -> x <> 0)")


def _described(classes: DataFrame) -> DataFrame:
    """rep, weight, e, cells (TABLES * PROBES keys) and seen (their low 32 bits) of every class."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.empty((n, TABLES * PROBES), np.int64)
            for at, units in _units(batch.column("e")):
                for lo in range(0, len(at), 4096):
                    keys[at[lo : lo + 4096]] = cells(units[lo : lo + 4096]).reshape(-1, TABLES * PROBES)
            at = pa.array(np.arange(n + 1, dtype=np.int32) * (TABLES * PROBES))
            lists = [pa.ListArray.from_arrays(at, pa.array(k.reshape(-1))) for k in (keys, keys.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "weight", "e")), *lists], names=["rep", "weight", "e", "cells", "seen"])

    return classes.mapInArrow(run, T.StructType([classes.schema["rep"], classes.schema["weight"], classes.schema["e"], T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("seen", T.ArrayType(T.IntegerType()))]))


def _near(pairs: DataFrame) -> DataFrame:
    """x, c of the rows x, c, a, b whose vectors a and b have a cosine of BALL or more."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ok = np.zeros(batch.num_rows, bool)
            (a, at), (b, bt) = _arrays(batch.column("a")), _arrays(batch.column("b"))
            size = np.diff(at)
            for d in np.unique(size):
                rows = np.flatnonzero((size == d) & (np.diff(bt) == d))
                span = np.arange(d)
                ok[rows] = (unit(a[at[rows][:, None] + span]) * unit(b[bt[rows][:, None] + span])).sum(axis=1) >= BALL
            yield batch.select(["x", "c"]).filter(pa.array(ok))

    return pairs.select("x", "c", "a", "b").mapInArrow(run, "x long, c long")


def _balls(described: DataFrame, work: Work) -> DataFrame:
    """rep, label: the smallest centre near each class that has one; centres are the smallest ids of cells."""
    own = described.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.element_at("cells", t * PROBES + 1))).alias("key"))
    heads = own.groupBy("key").agg(F.min("rep").alias("c"), F.count("*").alias("n")).filter("n > 1").select("key", "c")
    stars = work.save(own.join(heads, "key").filter("rep <> c").select(F.col("rep").alias("x"), "c").distinct(), "stars")
    left, right = described.select(F.col("rep").alias("x"), F.col("e").alias("a")), described.select(F.col("rep").alias("c"), F.col("e").alias("b"))
    centres = right.join(stars.select("c").distinct(), "c", "left_semi")
    return work.save(_near(stars.join(left, "x").join(centres, "c")).groupBy("x").agg(F.min("c").alias("label")).withColumnRenamed("x", "rep"), "balls")


def _placed(described: DataFrame, work: Work) -> DataFrame:
    """key, grid, row, col, role, rep: cells' members dealt into blocks; role 0 is stored there, 1 looks there.

    Cells of up to BLOCK entries are one block.  In larger ones all pairs but those within
    the cell's largest ball meet: grid 0 has those outside it looking at all, grid 1 those
    in it looking at those outside.
    """
    entry = F.transform("cells", lambda k, i: F.struct(k.alias("key"), F.lit(1).alias("role")))
    stored = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.struct(F.element_at("cells", t * PROBES + 1).alias("key"), F.lit(0).alias("role")))
    entries = described.select("rep", "label", F.explode(F.concat(entry, stored)).alias("m")).select("rep", "label", "m.key", "m.role")
    shape = entries.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    shape = work.save(shape.filter("n0 > 0 AND n1 > 0 AND lo <> hi").select("key", "n0", "n1"), "shape")
    large = entries.join(shape.filter(F.col("n0") + F.col("n1") > BLOCK).select("key"), "key")
    by_ball = large.groupBy("key", "label").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1"))
    top = by_ball.groupBy("key").agg(F.max_by(F.struct("label", "n0", "n1"), F.struct(F.col("n0") + F.col("n1"), "label")).alias("top"))
    top = work.save(top.select("key", F.col("top.label").alias("ball"), F.col("top.n0").alias("b0"), F.col("top.n1").alias("b1")), "top")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1))
    shape = shape.join(top, "key", "left").select(
        "key", "ball", blocks(F.col("n1") - F.col("b1")).alias("rows0"), blocks(F.col("n0")).alias("cols0"), blocks(F.col("b1")).alias("rows1"), blocks(F.col("n0") - F.col("b0")).alias("cols1")
    )
    at = entries.join(shape, "key")
    inside, deal = F.col("label") == F.col("ball"), lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    spot = lambda grid, row, col: F.struct(F.lit(grid).alias("grid"), row.cast("long").alias("row"), col.cast("long").alias("col"))
    over = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    looks = F.when(inside, F.transform(over("cols1"), lambda c: spot(1, deal("rows1"), c))).otherwise(F.transform(over("cols0"), lambda c: spot(0, deal("rows0"), c)))
    held = F.transform(over("rows0"), lambda r: spot(0, r, deal("cols0")))
    held = F.when(inside, held).otherwise(F.concat(held, F.transform(over("rows1"), lambda r: spot(1, r, deal("cols1")))))
    spots = F.when(F.col("ball").isNull(), F.array(spot(0, F.lit(0), F.lit(0)))).when(F.col("role") == 1, looks).otherwise(held)
    return at.select("key", "role", "rep", F.explode(spots).alias("s")).select("key", "s.grid", "s.row", "s.col", "role", "rep")


class _Met:
    """Consecutive blocks' rows, and the links of the pairs that meet in them."""

    def __init__(self, rep, label, weight, units, seen, role, block):
        self.rep, self.label, self.weight, self.units, self.seen, self.role = rep, label, weight, units, seen, role
        self.table = None
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        self.lo, self.hi = edge[:-1], edge[1:]

    def pairs(self):
        """(looking rows, stored rows) whose cosine is COSINE or more, a few at a time; rows are sorted by block and role."""
        ones = np.concatenate([[0], np.cumsum(self.role)])
        looking = ones[self.hi] - ones[self.lo]
        stored = self.hi - self.lo - looking
        size = looking * stored
        big = size > MATRIX
        for s, m, e in zip(self.lo[big], (self.lo + stored)[big], self.hi[big]):
            for k in range(m, e, BLOCK):
                near = self.units[k : min(e, k + BLOCK)] @ self.units[s:m].T >= COSINE
                q, i = np.nonzero(near & (self.label[k : min(e, k + BLOCK), None] != self.label[s:m]))
                yield q + k, i + s
        some = np.flatnonzero(~big & (size > 0))
        begin = np.concatenate([[0], np.cumsum(size[some])])
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + PAIRS, side="right")) - 1)
            chosen = some[lo:hi]
            which = np.repeat(chosen, size[chosen])
            k = np.arange(begin[hi] - begin[lo]) - np.repeat(begin[lo:hi] - begin[lo], size[chosen])
            q, i = self.lo[which] + stored[which] + k // stored[which], self.lo[which] + k % stored[which]
            apart = self.label[q] != self.label[i]
            q, i = q[apart], i[apart]
            near = np.einsum("ij,ij->i", self.units[q], self.units[i]) >= COSINE
            yield q[near], i[near]
            lo = hi

    def links(self, key: np.ndarray):
        """Row pairs of different balls that meet here first."""
        out = [np.zeros((2, 0), np.int64)]
        for q, i in ((q[k : k + PAIRS], i[k : k + PAIRS]) for q, i in self.pairs() for k in range(0, len(q), PAIRS)):
            a, b = self.seen[q], self.seen[i]  # pairs x TABLES x PROBES
            forth, back = (a == b[:, :, :1]).any(axis=2), (b == a[:, :, :1]).any(axis=2)
            here = (a == key[q].astype(np.int32)[:, None, None]).any(axis=2) & forth
            first = (forth | back).argmax(axis=1)
            at = np.arange(len(q))
            # in the first table that they meet in, the larger id looks if both do
            mine = here[at, first] & (~back[at, first] | (self.rep[q] > self.rep[i]))
            out.append(np.stack([q[mine], i[mine]]))
        return np.concatenate(out, axis=1)


def _met(rows: DataFrame) -> DataFrame:
    """x, links (weight of the classes linked with it in a block; null for an edge), c (a label linked with label x; null for links)."""

    def work_on(t, names):
        import pyarrow as pa

        col = {n: t.column(names.index(n)) for n in names}
        number = {n: col[n].to_numpy(zero_copy_only=False) for n in ("key", "grid", "row", "col", "role", "rep", "label", "weight")}
        values, offsets = _arrays(col["e"])
        seen = col["seen"].values.to_numpy(zero_copy_only=False)[col["seen"].offsets[0].as_py() : col["seen"].offsets[-1].as_py()].reshape(-1, TABLES, PROBES)
        block = np.zeros(len(seen), np.int64)
        for n in ("key", "grid", "row", "col"):
            block[1:] |= number[n][1:] != number[n][:-1]
        dims = np.diff(offsets)
        widest = int(dims.max())
        units = np.zeros((len(dims), widest))
        for d in np.unique(dims):  # a cell's vectors have equal numbers of dimensions
            at = np.flatnonzero(dims == d)
            units[at, :d] = unit(values[offsets[at][:, None] + np.arange(d)])
        met = _Met(number["rep"], number["label"], number["weight"], units, seen, number["role"].astype(np.int64), np.cumsum(block))
        q, i = met.links(number["key"])
        if not len(q):
            return None
        reps, at = np.unique(np.concatenate([met.rep[q], met.rep[i]]), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate([met.weight[i], met.weight[q]]).astype(np.float64)).astype(np.int64)
        # a spanning forest of the labels that these links tie together
        labels, at = np.unique(np.concatenate([met.label[q], met.label[i]]), return_inverse=True)
        a, b = at[: len(q)], at[len(q) :]
        least = np.arange(len(labels))
        while True:
            low = np.minimum(least[a], least[b])
            new = least.copy()
            np.minimum.at(new, a, low), np.minimum.at(new, b, low)
            if (new == least).all():
                break
            least = new
        tied = np.flatnonzero(least != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([reps, labels[tied]])), pa.concat_arrays([pa.array(links), pa.nulls(len(tied), pa.int64())]), pa.concat_arrays([pa.nulls(len(reps), pa.int64()), pa.array(labels[least[tied]])]),
        ], names=["x", "links", "c"])

    def run(batches):
        import pyarrow as pa

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            t = batch if kept is None else pa.concat_batches([kept, batch])
            # rows of the last block wait for what follows
            same = np.ones(t.num_rows, bool)
            for n in ("key", "grid", "row", "col"):
                v = t.column(n).to_numpy(zero_copy_only=False)
                same &= v == v[-1]
            cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = t.slice(cut)
            if cut:
                found = work_on(t.slice(0, cut), names)
                if found is not None:
                    yield found
        if kept is not None:
            found = work_on(kept, kept.schema.names)
            if found is not None:
                yield found

    return rows.mapInArrow(run, "x long, links long, c long")


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """vec, rep of every usable vector; classes of many members are met by salted copies of their one row."""
    repeated = classes.filter("weight > 1")
    if not repeated.limit(1).count():
        return rows.select("vec", F.col("vec").alias("rep"))
    copies = repeated.select("e", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec"), F.lit(SALTS)))
    return salted.join(copies, ["e", "salt"], "left").select("vec", F.coalesce("rep", "vec").alias("rep"))


def group(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links (other vectors of cosine COSINE or more found), component_id (smallest id reachable), kept (its id is that).

    Vectors that are null, empty, zero or hold null or non-finite components are linked
    with nothing, nor are vectors of different numbers of dimensions with one another.
    A null id counts as the smallest one, and a component with it has a null
    component_id.  Rows that repeat an id are one vector, the smallest of theirs (nulls
    last), and each of them gets its result.  Ties don't arise: links are symmetric and
    ids decide.  Other columns are ignored; an empty table gives an empty one.
    """
    work = Work(vectors.sparkSession)
    kind = "double" if "double" in vectors.schema["embedding"].dataType.simpleString() else "float"
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LOWEST)).alias("vec"), F.col("embedding").cast(f"array<{kind}>").alias("e"))
    if rows.groupBy("vec").count().filter("count > 1").limit(1).count():
        rows = work.save(rows.groupBy("vec").agg(F.min("e").alias("e"), F.count("*").alias("times")), "once")
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    usable = rows.filter(_usable("e")).select("vec", "e")
    classes = work.save(usable.groupBy("e").agg(F.min("vec").alias("rep"), F.count("*").alias("weight")), "classes")
    described = work.save(_described(classes), "cells")
    balls = _balls(described, work)
    described = work.save(described.join(balls, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"), "weight", "e", "cells", "seen"), "described")
    work.drop("cells", "stars")
    work.release()
    what = described.drop("cells")
    rows_met = _placed(described, work).join(what, "rep").repartition("key", "grid", "row", "col").sortWithinPartitions("key", "grid", "row", "col", "role", "rep")
    met = work.save(_met(rows_met.select("key", "grid", "row", "col", "role", "rep", "label", "weight", "e", "seen")), "met")
    work.drop("shape", "top")
    work.release()
    edges = met.filter("c IS NOT NULL").select("x", "c").unionAll(balls.select(F.col("rep").alias("x"), F.col("label").alias("c")))
    labels = components(edges, work, "links")
    links = met.filter("links IS NOT NULL").groupBy("x").agg(F.sum("links").alias("links")).withColumnRenamed("x", "rep")
    inside = described.groupBy("label").agg(F.sum("weight").alias("all"))
    found = described.select("rep", "label", "weight").join(inside, "label").join(links, "rep", "left").join(labels.withColumnRenamed("label", "whole").withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("rep", (F.col("all") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("whole", "rep").alias("component"))
    out = rows.select("vec", "times").join(_members(usable, classes), "vec", "left").join(found, "rep", "left")
    out = out.select("vec", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component"), "times")
    out = out.select("vec", "n_links", "component", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))) if "once" in work.tables else out
    known = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select(known("vec").alias("vec_id"), "n_links", known("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"))


def keep_one(vectors: DataFrame) -> DataFrame:
    """The rows of vectors whose id is the smallest of its component; null ids and repeated ids as in group."""
    kept = group(vectors).filter("kept").select(F.coalesce("vec_id", F.lit(LOWEST)).alias("__kept")).distinct()
    return vectors.join(kept, F.coalesce(F.col("vec_id").cast("long"), F.lit(LOWEST)) == F.col("__kept"), "left_semi")


#: DuckDB SQL of the op11 query over embeddings: all pairs.
SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.y FROM reach r JOIN link l ON l.x = r.b
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v LEFT JOIN n ON n.x = v.vec_id JOIN comp c ON c.a = v.vec_id
"""
