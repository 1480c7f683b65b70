"""k-means with Elkan's bounds over whole-number vectors.

A vector keeps, beside its cluster, an upper bound of the distance to its centroid and a
lower bound of that to every centroid, in a table that each round reads and writes
anew.  After centroids move, bounds give way by as much; a centroid is passed over if
its lower bound, or half its distance from the vector's own, is above the upper bound.
Bounds are rounded outwards and a centroid is passed over only if it is strictly
farther, so ties go to the smaller number as if all distances were taken.  All
distances that decide are whole numbers.

A task adds up its vectors by cluster; only these sums are shuffled.  Centroids are
the one thing that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Larger components count as this, so that the sum of DIMS squared differences fits 63 bits.
LARGEST = 1 << 26

_UP, _DOWN = 1 + 2.0**-40, 1 - 2.0**-40


def whole(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and x: vectors of dims components, none null or non-finite, each as floor(scale * component)."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    rows = rows.filter((F.size("e") == dims) & F.forall("e", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    return rows.select("vec_id", F.transform("e", lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * float(scale))))).alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    at = column.offsets
    return column.values.to_numpy(zero_copy_only=False)[at[0].as_py() : at[-1].as_py()].reshape(-1, width)


def square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


def root(square: np.ndarray, way: float) -> np.ndarray:
    """Square root of whole numbers, rounded outwards: way _UP or _DOWN."""
    return np.sqrt(square.astype(np.float64)) * way


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its new bounds, and how many distances were taken.

    cluster, upper and lower must hold for these centroids: upper not below the distance to
    the cluster's centroid, lower not above that to any.
    """
    k = len(centroids)
    cluster, upper, lower, taken = cluster.copy(), upper.copy(), lower.copy(), 0
    half = root(np.array([square(centroids, c) for c in centroids]), _DOWN) / 2
    others = half + np.where(np.eye(k, dtype=bool), np.inf, 0)
    open_ = np.flatnonzero(~(others.min(axis=1)[cluster] > upper))
    if not len(open_):
        return cluster, upper, lower, taken
    best = np.full(len(x), -1, np.int64)  # exact where taken
    for j in range(k):
        at = open_[(cluster[open_] != j) & ~(lower[open_, j] > upper[open_]) & ~(half[cluster[open_], j] > upper[open_])]
        if not len(at):
            continue
        new = at[best[at] < 0]
        if len(new):
            best[new] = square(x[new], centroids[cluster[new]])
            upper[new] = root(best[new], _UP)
            lower[new, cluster[new]] = root(best[new], _DOWN)
            taken += len(new)
            at = at[~(lower[at, j] > upper[at]) & ~(half[cluster[at], j] > upper[at])]
        d = square(x[at], centroids[j])
        taken += len(at)
        lower[at, j] = root(d, _DOWN)
        nearer = (d < best[at]) | (d == best[at]) & (j < cluster[at])
        at, d = at[nearer], d[nearer]
        cluster[at], best[at], upper[at] = j, d, root(d, _UP)
    return cluster, upper, lower, taken


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, dims: int) -> DataFrame:
    """state with clusters and bounds of these centroids; moved: how far each went, at least (None: nothing is known yet)."""
    k = len(centroids)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), dims)
            if moved is None:
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                upper = (batch.column("upper").to_numpy() + moved[cluster]) * _UP
                lower = np.maximum(_matrix(batch.column("lower"), k) - moved, 0) * _DOWN
            cluster, upper, lower, taken = assign(x, centroids, cluster, upper, lower)
            counts = np.zeros(n, np.int64)
            counts[0] = taken
            at = pa.array(np.arange(n + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.ListArray.from_arrays(at, pa.array(lower.reshape(-1))), pa.array(counts)], names=["vec_id", "x", "cluster", "upper", "lower", "taken"])

    return state.mapInArrow(run, "vec_id long, x array<long>, cluster int, upper double, lower array<double>, taken long")


def _sums(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of each cluster's vectors: a row a cluster and batch is shuffled, one a component and cluster comes to the driver."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cluster, x = batch.column("cluster").to_numpy(), _matrix(batch.column("x"), dims)
            for c in np.unique(cluster):
                mine = x[cluster == c]
                total = mine.sum(axis=0)
                yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.full(dims + 1, c, np.int32)), "i": pa.array(np.arange(-1, dims, dtype=np.int32)), "v": pa.array(np.concatenate([[len(mine)], total]))})

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, i int, v long")
    out: dict[int, tuple[int, list[int]]] = {}
    rows = parts.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    for c in {r["cluster"] for r in rows}:
        mine = {r["i"]: int(r["v"]) for r in rows if r["cluster"] == c}
        out[c] = (mine[-1], [mine[i] for i in range(dims)])
    return out


def fit(vectors: DataFrame, work: Work, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> tuple[DataFrame | None, np.ndarray]:
    """(vec_id, x, cluster, upper, lower, taken) after the last assignment, and the centroids; (None, none) of no vectors."""
    state = vectors
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select("x", by_hash.alias("h")).orderBy("h", "x").limit(clusters).collect()  # clusters rows
    centroids, moved = np.array([r["x"] for r in first], np.int64).reshape(-1, dims), None
    if not len(first):
        return None, centroids
    for r in range(rounds + 1):
        state = work.save(_round(state, centroids, moved, dims), "state", replace=True)
        if r == rounds:
            break
        new = centroids.copy()
        for c, (n, total) in _sums(state, dims).items():
            new[c] = [t // n for t in total]
        moved, centroids = root(square(new, centroids), _UP), new
    return state, centroids


def cluster(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of DIMS finite components.

    Vectors with another number of components, or with null or non-finite ones, have no row;
    components beyond LARGEST / SCALE count as that.  Null ids hash as an empty text and
    repeated ones are vectors each; of equal hashes the smaller vector comes first.  With
    fewer vectors than CLUSTERS each is a centroid; ties go to the smaller number.  Sums that
    a long can't hold are null.  Other columns are ignored; an empty table gives an empty one.
    """
    spark, work = vectors.sparkSession, Work(vectors.sparkSession)
    state, centroids = fit(work.save(whole(vectors), "whole"), work)
    if state is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    work.drop("whole")
    centres = F.split(F.lit(";".join(",".join(map(str, c)) for c in centroids.tolist())), ";")
    centre = F.split(F.element_at(centres, F.col("cluster") + 1), ",").cast("array<long>")
    exact = F.aggregate(F.zip_with("x", centre, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    rows = state.select("vec_id", "cluster", exact.alias("distance"))
    total = {r["cluster"]: int(r["v"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")).collect()}  # CLUSTERS rows
    fits = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(c, fits(v), fits(sum(total.values())), digest[c]) for c, v in total.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """All distances of every round, as SQL."""
    steps = [f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT {CLUSTERS})
)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, x, min(struct_pack(d := d, cluster := cluster)) AS best FROM (
    SELECT v.vec_id, v.x, c.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{r} c
  ) GROUP BY vec_id, x
)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS x FROM (
      SELECT cluster, i, (s - ((s % n) + n) % n) // n AS floor_mean FROM (
        SELECT best.cluster AS cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {DIMS + 1}) t(i) GROUP BY ALL
      )
    ) GROUP BY cluster
  ) m ON m.cluster = c.cluster
)""")
    last = f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.cluster = best.cluster
"""
    return ", ".join(steps) + last


#: DuckDB SQL of the op12 query over embeddings.
SQL = _sql()
