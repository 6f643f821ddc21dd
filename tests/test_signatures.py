"""Ensembles of structures and models against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import ensembles as E
from strandlake.operators import networks as W
from strandlake.operators import signatures as S
from strandlake.plans.iteration import stored

RNG = np.random.default_rng(11)
BASE = RNG.uniform(0, 12, (14, 3))
CONFS = [BASE + RNG.normal(0, 0.4, BASE.shape) for _ in range(3)]


@pytest.fixture(scope="module")
def confs(spark):
    return spark.createDataFrame([(c, a, *map(float, xyz)) for c, conf in enumerate(CONFS) for a, xyz in enumerate(conf)], "conf int, atom int, x double, y double, z double")


def keep(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node int")


def gnm(x):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    k = -(d <= 10.0).astype(float)
    np.fill_diagonal(k, 0)
    return k - np.diag(k.sum(axis=1))


def anm(x):
    n = len(x)
    h = np.zeros((3 * n, 3 * n))
    for i in range(n):
        for j in range(n):
            d = x[j] - x[i]
            r2 = d @ d
            if i != j and r2 <= 225:
                block = np.outer(d, d) / r2
                h[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] -= block
                h[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] += block
    return h


def values(modes):
    rows = modes.select("conf", "mode", "eigval").distinct().collect()
    return {c: [r.eigval for r in sorted(rows, key=lambda r: r.mode) if r.conf == c] for c in {r.conf for r in rows}}


@pytest.mark.parametrize("model", ["gnm", "anm"])
@pytest.mark.parametrize("trim", ["trim", "slice", "reduce"])
def test_ensemble_modes(spark, confs, model, trim):
    kept = [0, 2, 3, 5, 6, 8, 9, 11]
    found = values(S.ensemble_modes(confs, model=model, keep=keep(spark, kept), trim=trim, n_modes=4))
    for c, x in enumerate(CONFS):
        build, axes = (gnm, 1) if model == "gnm" else (anm, 3)
        s = np.concatenate([np.arange(axes) + axes * k for k in kept])
        m = build(x[kept]) if trim == "trim" else build(x)
        if trim == "reduce":
            e = np.setdiff1d(np.arange(len(m)), s)
            m = m[np.ix_(s, s)] - m[np.ix_(s, e)] @ np.linalg.solve(m[np.ix_(e, e)], m[np.ix_(e, s)])
        w = np.linalg.eigvalsh(m)
        assert np.allclose(found[c], w[w > 1e-6][:4], atol=1e-6)


def test_bad_arguments(confs):
    with pytest.raises(ValueError):
        S.ensemble_modes(confs, trim="cut")
    with pytest.raises(ValueError):
        S.ensemble_modes(confs, model="xyz")
    with pytest.raises(ValueError):
        S.response_profile(confs, confs, "median")


def test_matching_restores_order_and_sign(spark, confs):
    first = S.ensemble_modes(confs.where("conf = 0"), n_modes=4)
    swapped = first.withColumns({"conf": F.lit(1), "mode": F.element_at(F.array(*[F.lit(k) for k in (1, 0, 3, 2)]), F.col("mode") + 1), "v": -F.col("v")})
    both = stored(first.unionByName(swapped), "both")
    back = S.matched_modes(both, "conf", 0)
    a = {(r.mode, r.node): r.v for r in first.collect()}
    assert all(abs(a[r.mode, r.node] - r.v) < 1e-9 for r in back.where("conf = 1").collect())
    turned = S.matched_modes(both.withColumn("eigval", F.when(F.col("conf") == 1, 10.0 + F.col("mode")).otherwise(F.col("eigval"))), "conf", 0)
    assert sorted((r.mode, r.eigval) for r in turned.where("conf = 1").select("mode", "eigval").distinct().collect()) == [(0, 11.0), (1, 10.0), (2, 13.0), (3, 12.0)]
    again = S.reweighted(turned, "conf").where("conf = 1").select("mode", "eigval").distinct().collect()
    assert sorted((r.mode, r.eigval) for r in again) == [(0, 10.0), (1, 11.0), (2, 12.0), (3, 13.0)]
    mean = {(r.mode, r.node): (r.v, r.eigval) for r in S.signature_modes(back, "conf").collect()}
    assert all(abs(mean[k][0] - v) < 1e-9 for k, v in a.items())
    one = S.signature_overlaps(back, "conf").collect()
    assert len(one) == 4 * 4 and all(abs(r.overlap - 1) < 1e-9 for r in one)
    full = S.signature_overlaps(back, "conf", False, first.drop("conf")).collect()
    assert len(full) == 2 * 16 and all(abs(r.overlap - (r.mode_a == r.mode_b)) < 1e-9 and r.b is None for r in full)


def test_masks_and_given_modes(spark, confs):
    kept = keep(spark, [1, 2, 4, 7])
    k = W.kirchhoff(confs.where("conf = 0"), "atom")
    part = S.masked(k, kept)
    assert {r.i for r in part.collect()} | {r.j for r in part.collect()} <= {1, 2, 4, 7}
    m = stored(W.modes(part, n_modes=2, zeros=True), "masked")
    whole = S.unmasked(m, keep(spark, range(14)))
    assert whole.count() == 2 * 14 and whole.where("node not in (1, 2, 4, 7) and v <> 0").count() == 0
    assert whole.where("v <> 0").count() == m.where("v <> 0").count()
    given = S.modes_from_vectors(spark.createDataFrame([(4.0, [0.0, 1.0]), (2.0, [1.0, 0.0])], "eigval double, vector array<double>"))
    more = S.with_eigenpair(given, 8.0, [0.6, 0.8])
    assert sorted((r.mode, r.eigval, r.node, r.v) for r in more.collect()) == [(0, 2.0, 0, 1.0), (0, 2.0, 1, 0.0), (1, 4.0, 0, 0.0), (1, 4.0, 1, 1.0), (2, 8.0, 0, 0.6), (2, 8.0, 1, 0.8)]
    with pytest.raises(ValueError):
        S.with_eigenpair(given, 1.0, [1.0])


def test_structure_ensemble_and_alignment(spark):
    seq = "MKTAYIAKQRQISF"
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    rows = [("a", r + 1, letter, *map(float, BASE[r])) for r, letter in enumerate(seq)]
    rows += [("b", r + 40, letter, *map(float, BASE[r] @ turn.T + 5)) for r, letter in enumerate(seq) if r != 0]
    rows += [("c", r, "W", float(r), 0.0, 0.0) for r in range(14)]
    members = spark.createDataFrame(rows, "conf string, residue int, letter string, x double, y double, z double")
    target = members.where("conf = 'a'").drop("conf")
    for how in ("iter", "target"):
        out = S.structure_ensemble(members, target, superpose=how).collect()
        at = {(r.conf, r.atom): np.array([r.x, r.y, r.z]) for r in out}
        assert {c for c, _ in at} == {"a", "b"} and ("b", 0) not in at and len(at) == 27
        shift = at["a", 3] - at["b", 3]
        assert np.abs(shift).max() < 1e-6 and max(np.abs(at["a", k] - at["b", k]).max() for k in range(1, 14)) < 1e-4
    raw = S.structure_ensemble(members, target, superpose=None)
    letters = raw.join(members.select("conf", "residue", "letter"), ["conf", "residue"]).select("conf", "atom", "letter")
    assert {r.conf: r.seq for r in S.ensemble_alignment(letters).collect()} == {"a": seq, "b": "-" + seq[1:]}
    mapping = spark.createDataFrame([(k, k + 1) for k in range(13)], "atom int, target int")
    joined = S.joined_ensembles(raw.where("conf = 'a'"), raw.where("conf = 'b'"), mapping, superpose=False)
    assert joined.where("conf = 'b'").agg(F.min("atom"), F.max("atom"), F.count("atom")).first()[:] == (2, 13, 12)


def test_central_and_products(spark, confs):
    mean = np.mean(CONFS, axis=0)
    d = [((c - mean) ** 2).sum() for c in CONFS]
    r = S.central_conformation(confs, "conf", "atom").first()
    assert r.conf == int(np.argmin(d)) and abs(r.distance2 - min(d)) < 1e-9
    a, b = RNG.uniform(0, 1, 6), RNG.uniform(0, 1, 6)
    profile = lambda x: spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "node int, sqfluct double")
    assert abs(S.square_inner_product(profile(a), profile(b)).first().value - (a @ b) ** 2 / (a @ a * (b @ b))) < 1e-12


@pytest.mark.parametrize("weights", [None, "w"])
def test_superposition_far_from_the_origin(spark, weights):
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    far = BASE @ turn.T + 1e8
    rows = [(c, a, *map(float, xyz), 1.0 + a % 3) for c, conf in enumerate((far, BASE)) for a, xyz in enumerate(conf)]
    confs = spark.createDataFrame(rows, "conf int, atom int, x double, y double, z double, w double")
    ref = confs.where("conf = 1").select("atom", "x", "y", "z")
    for r in E.transformations(confs, ref, "conf", "atom", weights).collect():
        want = turn.T if r.conf == 0 else np.eye(3)
        assert np.allclose(np.reshape(r.rotation, (3, 3)), want, atol=1e-6)


def test_response_profile(spark):
    v, t = RNG.normal(size=(2, 3, 6)), RNG.normal(size=(2, 6))
    rows = [(p, f, k // 3, k % 3, float(v[p, f, k])) for p in range(2) for f in range(3) for k in range(6)]
    responses = spark.createDataFrame(rows, "perturbed int, force int, node int, axis int, v double")
    target = spark.createDataFrame([(m, k // 3, k % 3, float(t[m, k])) for m in range(2) for k in range(6)], "mode int, node int, axis int, v double")
    o = np.abs(np.einsum("pfk,mk->pfm", v, t)) / np.linalg.norm(v, axis=2)[..., None] / np.linalg.norm(t, axis=1)
    for stat, f in (("max", np.max), ("mean", np.mean), ("sum", np.sum)):
        got = {r.perturbed: r.value for r in S.response_profile(responses, target, stat).collect()}
        assert np.allclose([got[0], got[1]], f(o.max(axis=2), axis=1))


def test_stiffness(spark):
    m = RNG.uniform(1, 9, (9, 9))
    rows = [(i, j, float(m[i, j])) for i in range(9) for j in range(i + 1, 9)]
    s = spark.createDataFrame(rows, "i int, j int, stiffness double")
    r = S.stiffness_range(s).first()
    up = {(i, j): v for i, j, v in rows}
    assert (r.least, r.most) == (min(up.values()), max(up.values()))
    assert S.stiffness_count(s, 3.0, 6.0).first().n == sum(3 < v < 6 for v in up.values())
    assert S.stiffness_count(s, 3.0, 6.0, 2).first().n == sum(3 < v < 6 for (i, j), v in up.items() if j - i > 2 and j < 8)
    far = {k: v for k, v in up.items() if k[1] - k[0] >= 4}
    for largest, best in ((True, max), (False, min)):
        r = S.stiffness_extreme(s, largest, 4).first()
        assert (r.i, r.j) == best(far, key=far.get)


def test_empty_ensembles(spark, confs):
    none = confs.where("conf < 0")
    assert S.central_conformation(none, "conf", "atom").count() == 0 and S.ensemble_modes(none).count() == 0
    assert E.mean_conformation(none, "atom").count() == 0


def test_signature_of_null_keys_and_far_values(spark):
    rows = [(None, 1e9 + 1, 1.0), (None, 1e9 + 3, 3.0), (None, 0.0, 0.0), ("a", 5.0, 2.0)]
    members = spark.createDataFrame(rows, "k string, v double, w double")
    weighted = {r.k: (r.mean, r.stddev) for r in W.signature(members, ("k",), "v", "w").collect()}
    assert weighted[None] == (pytest.approx(1e9 + 2.5), pytest.approx(np.sqrt(0.75))) and weighted["a"] == (5.0, 0.0)
    plain = {r.k: r.stddev for r in W.signature(members.where("v > 0"), ("k",), "v").collect()}
    assert plain == {None: pytest.approx(1.0), "a": 0.0}
    whole = W.signature(members.where("k = 'a'"), (), "v", "w").first()
    assert (whole["mean"], whole["min"]) == (5.0, 5.0)
