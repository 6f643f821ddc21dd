"""Queries of all pairs keep no pairs: results as from brute force or SQL, and what they store or shuffle stays small."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from strandlake.operators import matrices as M
from strandlake.operators import neighbours as N
from strandlake.operators import networks as W
from strandlake.operators import signatures as S
from strandlake.operators import surfaces as U

TENTH = "/root/testdata/sf0.1"


@pytest.fixture
def kept(spark):
    """Bytes that a query adds to the shared folder."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    def run(f):
        before = size()
        out = f()
        return out, size() - before

    return run


def vectors(n: int, seed: int = 5) -> list[tuple]:
    """Rows (k, v, cluster) with copies of vectors and a null one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2]
    return [(k, [float(c) for c in v], 1 + k % 3) for k, v in enumerate(x)] + [(n, None, 1)]


VECTORS = "k long, v array<float>, cluster int"


def test_medoids_of_vectors(spark):
    rows = vectors(60)
    got = {r.cluster: r.medoid for r in M.vector_medoids(spark.createDataFrame(rows, VECTORS), "k", "v", "cluster").collect()}
    for c in (1, 2, 3):
        own = [(k, np.array(v)) for k, v, at in rows if at == c and v is not None]
        sums = {k: round(sum(float(np.sqrt(((v - w) ** 2).sum())) for _, w in own), 9) for k, v in own}
        assert got[c] == min(sums, key=lambda k: (sums[k], k))


def test_cluster_medoids_keeps_no_distances(spark, kept):
    found, size = kept(lambda: entry.queries()["cluster_medoids"](spark, TENTH).collect())
    assert len(found) == 10 and size < 4_000_000


def test_statistics_of_vectors(spark):
    rows = vectors(60)
    found = {r.cluster: r for r in M.vector_cluster_statistics(spark.createDataFrame(rows, VECTORS), "k", "v", "cluster").collect()}
    for c in (1, 2, 3):
        own = {k: v for k, v, at in rows if at == c}
        mid = np.array(own[found[c].medoid])
        d = [float(np.sqrt(((np.array(v) - mid) ** 2).sum())) for v in own.values() if v is not None]
        assert found[c].n == len(own) and np.allclose([found[c]["mean"], found[c].stddev, found[c]["median"], found[c].p95, found[c]["max"]], [np.mean(d), np.std(d), np.median(d), np.quantile(d, 0.95), max(d)])


def test_cluster_statistics_keeps_no_distances(spark, kept):
    found, size = kept(lambda: entry.queries()["cluster_statistics"](spark, TENTH).collect())
    assert len(found) == 10 and size < 4_000_000


def apart(n: int) -> list[tuple]:
    """Rows (k, v) around three places, with copies, a few far out and one null."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, size=(n, 3)) for c in (0, 6, 12)] + [rng.uniform(-40, 40, size=(n // 4, 3))]).astype(np.float32)
    x[-3:] = x[:3]
    return [(int(k), [float(c) for c in v]) for k, v in zip(rng.permutation(len(x)), x)]


@pytest.mark.parametrize("eps, least", [(None, None), (0.8, 5), (0.55, 8)])
def test_density_clusters_of_vectors(spark, monkeypatch, eps, least):
    from strandlake.operators import blocks as B
    from strandlake.operators import ensembles as E

    whole = B.vectors_in_blocks
    monkeypatch.setattr(B, "vectors_in_blocks", lambda *a, **k: whole(*a, **(k | {"block": 40})))  # many pairs of blocks
    monkeypatch.setattr(M, "FEW", 50)  # several histograms
    rows = spark.createDataFrame(apart(60), "k long, v array<float>")
    d = E._block_rows(rows, "k", "v", lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=1)), "value")
    want = {r.k: r.cluster for r in M.dbscan(d, rows, "k", eps, least).collect()}
    null = spark.createDataFrame([(1000, None), (1001, [float("nan")] * 3)], "k long, v array<float>")
    got = {r.k: r.cluster for r in M.vector_dbscan(rows.unionByName(null), "k", "v", eps, least if least else max(2, rows.count() // 20)).collect()}
    assert (got.pop(1000), got.pop(1001)) == (-1, -1) and got == want
    assert eps is None or {-1, 1, 2, 3} <= set(got.values())


def test_density_clusters_keeps_no_distances(spark, kept):
    found, size = kept(lambda: entry.queries()["density_clusters"](spark, TENTH).collect())
    assert len(found) == 2000 and size < 6_000_000


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_hierarchy_of_vectors(spark, method):
    rows = apart(40)
    keys, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    x = x[np.argsort(keys)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    groups, heights = [[k] for k in range(len(x))], []
    join = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, a, b = min((join(d[np.ix_(groups[a], groups[b])]), a, b) for a in range(len(groups)) for b in range(a))
        heights.append(h)
        groups[b] += groups.pop(a)
    merges = M.linkage(d, method)
    assert np.allclose([m[2] for m in merges], heights) and merges[-1][3] == len(x)
    want = M.cut(merges, len(x)).tolist()
    null = spark.createDataFrame([(1000, None)], "k long, v array<double>")
    vectors_ = spark.createDataFrame(rows, "k long, v array<double>").unionByName(null)
    got = {r.node: r.cluster for r in M.vector_hierarchy(vectors_, "k", "v", method).collect()}
    assert got.pop(1000) is None and [got[k] for k in range(len(x))] == want


def test_hierarchical_clusters_of_6000_vectors(spark, tmp_path):
    """As many as a task that holds the matrix several times, and searches it whole for each merge, has no room or time for."""
    table = spark.read.parquet(f"{TENTH}/embeddings.parquet").selectExpr("explode(array(0, 1, 2)) AS c", "vec_id", "embedding", "label")
    table.selectExpr("vec_id + 10000 * c AS vec_id", "transform(embedding, (x, k) -> float(x + c * 0.01 * ((vec_id + k) % 7))) AS embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert entry.queries()["hierarchical_clusters"](spark, str(tmp_path)).where("cluster > 0").count() == 6000


def modes_of(spark, seed: int, n: int, axes: int, nodes, share: float):
    """Mode rows of which only a share is there."""
    rng = np.random.default_rng(seed)
    rows = [(m, 1.0, 1.0, k, a, float(rng.normal())) for m in range(n) for k in nodes for a in range(axes) if rng.random() < share]
    return spark.createDataFrame(rows, "mode int, eigval double, variance double, node int, axis int, v double"), {(m, k, a): v for m, _, _, k, a, v in rows}


def norms(cells):
    return {m: np.sqrt(sum(v * v for (n, *_), v in cells.items() if n == m)) for m in {c[0] for c in cells}}


def dots(a, b):
    """Sums of products over shared places, and the nodes shared, of all pairs that share one."""
    out = {}
    for (m, *p), u in a.items():
        for (n, *q), w in b.items():
            if p == q:
                x, on = out.get((m, n), (0.0, set()))
                out[m, n] = (x + u * w, on | {p[0]})
    return out


SHAPES = pytest.mark.parametrize("axes, share", [(1, 1.0), (3, 1.0), (1, 0.4), (3, 0.2)])


@SHAPES
def test_cumulative_overlaps(spark, axes, share):
    (a, x), (b, y) = modes_of(spark, 1, 5, axes, range(4), share), modes_of(spark, 2, 6, axes, range(1, 6) if share < 1 else range(4), share)
    sx, sy, want, total = norms(x), norms(y), {}, {}
    for (m, n), (d, _) in sorted(dots(x, y).items()):
        total[m] = total.get(m, 0.0) + (d / sx[m] / sy[n]) ** 2
        want[m, n] = np.sqrt(total[m])
    for found in (W.cumulative_overlaps(a, b), W.cumulative_overlap(W.overlaps(a, b))):
        assert {(r.mode_a, r.mode_b): pytest.approx(r.cumulative) for r in found.collect()} == want
    equal = {(r.mode_a, r.mode_b): r.overlap for r in W.overlaps(a, b, True).collect()}
    assert equal == {(m, n): pytest.approx(d / sx[m] / sy[n]) for (m, n), (d, _) in dots(x, y).items() if m == n}


def test_overlaps_join_no_places(spark):
    """Pairs of modes are not joined place by place."""
    df = entry.queries()["cumulative_overlaps"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


@SHAPES
def test_projections(spark, axes, share):
    (c, x), (m, y) = modes_of(spark, 3, 5, axes, range(4), share), modes_of(spark, 4, 6, axes, range(1, 6) if share < 1 else range(4), share)
    confs = c.selectExpr("mode AS conf", "node", "axis", "v + 2 * node + axis AS value")
    mean = spark.createDataFrame([(k, a, 2.0 * k + a) for k in range(6) for a in range(axes)], "node int, axis int, value double")
    want = {k: pytest.approx(d / np.sqrt(len(on))) for k, (d, on) in dots(x, y).items()}
    assert {(r.conf, r.mode): r.projection for r in W.projections(confs, mean, m, "conf").collect()} == want
    assert {(r.conf, r.mode): r.projection for r in W.projections(confs, mean, m, "conf", False).collect()} == {k: pytest.approx(d) for k, (d, _) in dots(x, y).items()}


def test_projections_join_no_places(spark):
    df = entry.queries()["mode_projections"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


@SHAPES
def test_response_profile(spark, axes, share):
    (r, x), (t, y) = modes_of(spark, 5, 12, axes, range(4), share), modes_of(spark, 6, 6, axes, range(1, 6) if share < 1 else range(4), share)
    sx, sy, best = norms(x), norms(y), {}
    for (m, n), (d, _) in dots(x, y).items():
        best[m] = max(best.get(m, 0.0), abs(d / sx[m] / sy[n]))
    want = {p: pytest.approx(np.mean([o for m, o in best.items() if m % 3 == p])) for p in {m % 3 for m in best}}
    found = S.response_profile(r.selectExpr("mode % 3 AS perturbed", "mode AS force", "node", "axis", "v"), t, "mean")
    assert {r.perturbed: r.value for r in found.collect()} == want


def test_response_profile_joins_no_places(spark):
    df = entry.queries()["response_profile"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_surface_areas_of_copies_and_several_radii(spark):
    rng = np.random.default_rng(9)
    x, r = rng.uniform(-4, 9, size=(60, 3)).round(2), rng.choice([1.0, 1.5, 2.2], size=60)
    x[40:], r[40:50] = x[:20], r[:10]  # equal balls, and others around one place
    rows = [(k, *map(float, p), float(s)) for k, (p, s) in enumerate(zip(x, r))] + [(60, None, 0.0, 0.0, 1.5)]
    found = U.accessible_surface(spark.createDataFrame(rows, "atom_index int, x double, y double, z double, radius double"))
    k = np.arange(96)
    z, turn = 1 - (2 * k + 1) / 96, np.pi * (3 - np.sqrt(5)) * k
    sphere = np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], axis=1)
    want = {60: 4 * np.pi * 2.9**2}
    for i in range(60):
        gaps = np.sqrt(((x[i] + (r[i] + 1.4) * sphere)[:, None] - x[None]) ** 2 @ np.ones(3))
        inside = gaps < (r + 1.4)[None] - 1e-9
        inside[:, i] = False
        want[i] = 4 * np.pi * (r[i] + 1.4) ** 2 * (1 - inside.any(axis=1).mean())
    assert {a.atom_index: a.area for a in found.collect()} == {i: pytest.approx(a) for i, a in want.items()}


def test_surface_areas_make_no_rows_of_points(spark):
    plan = entry.queries()["surface_areas"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_distance_pairs(spark, keys):
    rng = np.random.default_rng(2)
    rows = [(f"a{k}", "one" if k < 30 else "two", *map(float, rng.uniform(0, 9, 3))) for k in range(40)] + [(None, "one", 0.0, 0.0, 0.0)]
    df = N.distance_pairs(spark.createDataFrame(rows, "k string, g string, x double, y double, z double"), "k", keys)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "_p" in plan  # pairs of blocks, in one large group too
    want = {(a[0], b[0]): pytest.approx(np.sqrt(sum((u - v) ** 2 for u, v in zip(a[2:], b[2:])))) for a in rows for b in rows if a[0] and b[0] and a[0] < b[0] and (not keys or a[1] == b[1])}
    got = [(r.i, r.j, r.distance) for r in df.collect()]
    assert len(got) == len(want) and {(i, j): d for i, j, d in got} == want


def test_near_tiles_are_as_the_distances():
    from strandlake.operators import blocks as B

    rng = np.random.default_rng(1)
    x = {"key": np.arange(300), "v": rng.integers(0, 4, size=(300, 5)) * 0.1 + 100.0}  # many equal distances
    d = B.distances(x["v"], x["v"])
    for eps in (0.0, *np.unique(d)[[1, 5, 9]], np.nextafter(np.unique(d)[5], 0)):
        assert np.array_equal(np.concatenate([near for _, near in B.near_tiles(x, x, eps)]), d <= eps)


def test_density_clusters_hold_equal_vectors_once(spark, monkeypatch):
    from strandlake.operators import blocks as B
    from strandlake.operators import ensembles as E

    whole, seen = B.vectors_in_blocks, []
    monkeypatch.setattr(B, "vectors_in_blocks", lambda rows, *a, **k: (seen.append(rows.count()), whole(rows, *a, **(k | {"block": 20})))[1])
    monkeypatch.setattr(M, "FEW", 50)
    each = apart(12)
    rows = spark.createDataFrame([(k * 5 + c, v) for k, v in each for c in range(1 + k % 5)], "k long, v array<float>")
    d = E._block_rows(rows, "k", "v", lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=1)), "value")
    for eps, least in ((None, None), (0.9, 12), (0.0, 3)):
        seen.clear()
        got = {r.k: r.cluster for r in M.vector_dbscan(rows, "k", "v", eps, least).collect()}
        assert got == {r.k: r.cluster for r in M.dbscan(d, rows, "k", eps, least).collect()}
        assert set(seen) == {len({tuple(v) for _, v in each})}
