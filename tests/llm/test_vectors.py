"""Embedding near-dedup, clustering and importance resampling against plain versions, and odd inputs."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from watchmere.llm import cluster, importance, lattice
from watchmere.llm.work import Work

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, key string"


def _rows(spark, vectors):
    """Vectors with extra columns of names that the operators use."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "k") for i, v in vectors], SCHEMA).repartition(5)


def _links(vectors):
    """vec_id -> ids linked with it, of all pairs."""
    known = {}
    for i, v in vectors:
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, np.float32).astype(np.float64)
            known[i] = x / np.abs(x).max()
    out = {i: set() for i, _ in vectors}
    for i, a in known.items():
        for j, b in known.items():
            if i < j and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.9:
                out[i].add(j), out[j].add(i)
    return out


def _component(links):
    out = {}
    for i in sorted(links, key=lambda k: -math.inf if k is None else k):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = i
                todo += links[j]
    return out


def _near(rng, x, cos):
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(axis=-1, keepdims=True) * x
    return cos * x + math.sqrt(1 - cos * cos) * lattice.unit(np.atleast_2d(r)).reshape(x.shape)


@pytest.fixture(scope="module")
def vectors():
    """A group of 150 near copies (some further out), equal and scaled copies, small groups, other dimensions and unusable vectors."""
    rng = np.random.default_rng(4)
    base = lattice.unit(rng.normal(size=(40, 64)))
    found = [_near(rng, base[0], 0.99 if k % 3 else 0.985) for k in range(150)]
    found += [base[1]] * 60 + [base[1] * 1e30, base[1] * 1e-30, _near(rng, base[1], 0.96)]
    found += [_near(rng, base[k], 0.98) for k in range(2, 20) for _ in range(3)]
    found += list(base[20:]) + [base[20][:32], base[20][:32] * 2, [1.0], [2.0], [-1.0]]
    found += [None, [], [0.0] * 64, [math.nan] * 64, [math.inf] + [1.0] * 63, [None] + [1.0] * 63]
    order = rng.permutation(len(found))
    return [(int(i), found[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [1024, 16])
def test_links_and_components(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    links = _links(vectors)
    parts = _component(links)
    out = {r["vec_id"]: r for r in lattice.group(_rows(spark, vectors)).collect()}
    assert len(out) == len(vectors)
    assert {i: r["n_links"] for i, r in out.items()} == {i: len(v) for i, v in links.items()}
    assert {i: r["component_id"] for i, r in out.items()} == parts
    assert all(r["kept"] == (i == parts[i]) for i, r in out.items())


def test_recall_of_pairs_near_the_limit(spark):
    """Planted pairs of a cosine of 0.900 to 0.905 among others: at least 0.9 found, nothing else linked."""
    rng = np.random.default_rng(9)
    a = lattice.unit(rng.normal(size=(1500, 64)))
    b = np.array([_near(rng, x, c) for x, c in zip(a, rng.uniform(0.9, 0.905, len(a)))])
    rows = [(2 * i + k, v) for i in range(len(a)) for k, v in ((0, a[i]), (1, b[i]))]
    links = _links(rows)
    assert sum(map(len, links.values())) > 2900
    out = lattice.group(_rows(spark, rows)).collect()
    assert all(r["n_links"] in (0, 1) and r["component_id"] in (r["vec_id"], r["vec_id"] - 1) for r in out)
    assert all(links[r["vec_id"]] for r in out if r["n_links"])
    assert sum(r["n_links"] for r in out) >= 0.9 * sum(map(len, links.values()))


def test_cells_are_nearest_points():
    """The decoded point is in E8 and no nearer one is among its neighbours; looked-up cells are distinct."""
    x = np.random.default_rng(2).normal(size=(500, 8)) * 3
    p = lattice.nearest(x)
    twice = np.rint(2 * p).astype(int)
    assert (np.abs(2 * p - twice) < 1e-9).all() and ((twice % 2 == twice[:, :1] % 2).all()) and (p.sum(axis=1) % 2 == 0).all()
    own = ((x - p) ** 2).sum(axis=1)
    for v in np.concatenate([lattice.SHORTEST, 2 * np.eye(8), -2 * np.eye(8)]):
        assert (own <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()
    keys = lattice.cells(lattice.unit(np.random.default_rng(3).normal(size=(50, 64))))
    assert all(len(set(k)) == lattice.PROBES for row in keys for k in row)


def test_repeated_and_null_ids_and_empty_tables(spark):
    v = [1.0] + [0.0] * 63
    rows = [(1, v), (1, v), (2, v), (None, v), (None, v), (3, None), (3, [-x for x in v])]
    out = sorted((tuple(r) for r in lattice.group(_rows(spark, rows)).collect()), key=str)
    assert out == sorted([(1, 2, None, False)] * 2 + [(2, 2, None, False)] + [(None, 2, None, True)] * 2 + [(3, 0, 3, True)] * 2, key=str)
    kept = lattice.keep_one(_rows(spark, rows))
    assert kept.columns == ["vec_id", "embedding", "label", "rep", "key"] and sorted(str(r["vec_id"]) for r in kept.collect()) == ["3", "3", "None", "None"]
    empty = _rows(spark, rows).limit(0)
    assert lattice.group(empty).collect() == [] and cluster.cluster(empty).collect() == []


def _kmeans(rows):
    """Plain rounds over all distances, in Python's whole numbers."""
    x = {i: [math.floor(64 * float(np.float32(c))) for c in v] for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)}
    order = sorted(x, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [x[i] for i in order[:16]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(3):
        of = {i: nearest(v)[1] for i, v in x.items()}
        for k in range(len(centroids)):
            mine = [x[i] for i in x if of[i] == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    best = {i: nearest(v) for i, v in x.items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = {k: sum(d for d, j in best.values() if j == k) for k in range(len(centroids))}
    return sorted((i, k, d, total[k], sum(total.values()), digest[k]) for i, (d, k) in best.items())


@pytest.mark.parametrize("n", [5, 400])
def test_clusters_as_by_all_distances(spark, n):
    """Few values, so that distances tie and vectors repeat; unusable vectors have no row; so few that each is a centroid."""
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(-1, 2, 64) / 64.0 if i % 3 else rng.normal(size=64)) for i in range(n)]
    rows += [(i + n, v) for i, v in rows[: n // 2]]
    odd = [(5000, None), (5001, []), (5002, [1.0] * 63), (5003, [math.nan] * 64), (5004, [None] * 64), (5005, [math.inf] * 64)]
    assert sorted(tuple(r) for r in cluster.cluster(_rows(spark, rows + odd)).collect()) == _kmeans(rows + odd)


def test_bounds_skip_distances_and_change_nothing(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 64))
    rows = [(i, centres[i % 16] + 0.1 * rng.normal(size=64)) for i in range(2000)]
    state, centroids = cluster.fit(cluster.whole(_rows(spark, rows)), Work(spark))
    got = state.collect()
    assert sum(r["taken"] for r in got) < 0.5 * 16 * len(got)
    for r in got:
        d = ((np.array(r["x"]) - centroids) ** 2).sum(axis=1)
        assert d.argmin() == r["cluster"] and r["upper"] >= math.sqrt(d[r["cluster"]]) and (np.array(r["lower"]) <= np.sqrt(d)).all()


def test_huge_components_and_repeated_ids(spark):
    rows = [(1, [3e38] * 64), (1, [-3e38] * 64), (None, [0.5] * 64), (2, [0.25] * 64)]
    out = cluster.cluster(_rows(spark, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1", "1", "2", "None"] and all(r["distance"] == 0 == r["inertia"] for r in out)


def _resample(docs, target):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(importance.UPPER, importance.LOWER))) if w]
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    counts = []
    for texts in ([t for _, t in docs], target):
        mine = [0] * 10_000
        for t in texts:
            for w in split(t):
                mine[bucket(w)] += 1
        counts.append(mine)
    s, t = counts
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + 10_000.0) / ((s[b] + 1.0) * (sum(t) + 10_000.0)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        w = split(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in w)
        rows.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(may[: len(may) * 10 // 100])}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=str)


def test_resample_as_by_a_plain_version(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"Wörd{i}" for i in range(300)] + ["x9", "ÄÖ", "日本", "é"]
    text = lambda k: " ".join(rng.choice(vocabulary, k)) + rng.choice(["", ".", "--\t"])
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "..."), (303, "word " * 30_000), (304, "A\x00B_c7`d"), (None, docs[3][1]), (5, docs[5][1]), (6, docs[9][1])]
    target = [text(40) for _ in range(10)] + [None, ""]
    table = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, source string, buckets int, rank int").repartition(7)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in importance.resample(table, items).collect()), key=str)
    assert got == _resample(docs, target)
    drawn = importance.draw(table, items)
    assert drawn.columns == table.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in got if r[4] and r[0] is not None}
    assert importance.resample(table.limit(0), items).collect() == []
    assert all(r["rank"] is None or r["rank"] > 0 for r in importance.resample(table, items.limit(0)).collect())


def test_features_of_longer_runs(spark):
    (row,) = importance.featured(spark.createDataFrame([("a b c",)], "text string"), grams=2).collect()
    assert row["buckets"] == [zlib.crc32(w.encode()) % 10_000 for w in ("a", "b", "c", "a b", "b c")]
    assert importance.featured(spark.createDataFrame([("a",)], "text string"), grams=2).collect()[0]["buckets"] == [zlib.crc32(b"a") % 10_000]
