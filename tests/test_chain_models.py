"""Chain terms against derivatives taken numerically, and the membrane's scaling against its definition."""

from __future__ import annotations

import numpy as np
import pytest

from strandlake.operators import models as L
from strandlake.operators import networks as W

RNG = np.random.default_rng(8)
X = np.cumsum(RNG.normal(0, 2.2, (7, 3)), axis=0)


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame([("s", k, *map(float, p)) for k, p in enumerate(X)], "g string, node int, x double, y double, z double")


def dense(df, n=7):
    m = np.zeros((3 * n, 3 * n))
    for r in df.collect():
        m[3 * r.i + r.p, 3 * r.j + r.q] += r.value
    return m


def angle(x, k):
    u, v = x[k] - x[k + 1], x[k + 2] - x[k + 1]
    return np.arccos(u @ v / np.linalg.norm(u) / np.linalg.norm(v))


def torsion(x, k):
    a, b, c = np.diff(x[k : k + 4], axis=0)
    n, m = np.cross(a, b), np.cross(b, c)
    return np.arctan2(np.linalg.norm(b) * (a @ m), n @ m)


def gradient(f, k):
    out, h = np.zeros(X.size), 1e-6
    for t in range(X.size):
        up, down = X.copy(), X.copy()
        up.flat[t] += h
        down.flat[t] -= h
        out[t] = (f(up, k) - f(down, k)) / (2 * h)
    return out


def expected(bend, twist, curve):
    m = np.zeros((21, 21))
    for k in range(5):
        g = gradient(angle, k)
        m += bend * np.outer(g, g)
        for axis in range(3):
            s = np.zeros((7, 3))
            s[k : k + 3, axis] = (1, -2, 1)
            m += curve * np.outer(s, s)
    for k in range(4):
        g = gradient(torsion, k)
        m += twist * np.outer(g, g)
    return m


@pytest.mark.parametrize("constants", [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (10.0, 1.0, 20.0)])
def test_chain_terms(atoms, constants):
    assert np.allclose(dense(L.chain_terms(atoms, "node", *constants, keys=("g",))), expected(*constants), atol=1e-5)


def test_generalised_hessian(atoms):
    near = dense(W.hessian(atoms, "node", 4.0))
    m = dense(L.generalised_hessian(atoms, "node", 4.0, sequential=False, keys=("g",)))
    assert np.allclose(m, near + expected(10.0, 1.0, 20.0), atol=1e-4)
    for k in range(6):
        d = X[k + 1] - X[k]
        if d @ d > 16:
            block = np.outer(d, d) / (d @ d)
            a, b = slice(3 * k, 3 * k + 3), slice(3 * k + 3, 3 * k + 6)
            near[a, b] -= block
            near[b, a] -= block
            near[a, a] += block
            near[b, b] += block
    assert np.allclose(dense(L.generalised_hessian(atoms, "node", 4.0, keys=("g",))), near + expected(10.0, 1.0, 20.0), atol=1e-4)
    # shifts cost nothing; turns do only where the second difference is held
    for curve, free in ((20.0, 3), (0.0, 6)):
        w = np.linalg.eigvalsh(dense(L.generalised_hessian(atoms, "node", 4.0, curve=curve)))
        assert (np.abs(w[:free]) < 1e-6).all() and w[free] > 1e-4


def test_short_and_straight_chains(spark):
    line = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(4)], "node int, x double, y double, z double")
    assert L.chain_terms(line, "node", 0.0, 1.0, 0.0).count() == 0
    assert L.chain_terms(line.where("node < 2"), "node").count() == 0 and L.chain_terms(line.where("node < 0"), "node").count() == 0


def test_membrane_scaled(atoms):
    h = W.hessian(atoms, "node", 15.0)
    low, high = float(np.sort(X[:, 2])[1]) + 1e-6, float(np.sort(X[:, 2])[-2]) - 1e-6
    plain, got = dense(h), dense(L.membrane_scaled(h, atoms, 16.0, low, high))
    want = np.zeros_like(plain)
    f = [np.array([2.0, 2.0, 1.0]) if low < z < high else np.ones(3) for z in X[:, 2]]
    for i in range(7):
        for j in range(7):
            if i != j:
                a, b = slice(3 * i, 3 * i + 3), slice(3 * j, 3 * j + 3)
                want[a, b] = plain[a, b] * np.outer(f[i], f[i]) * np.outer(f[j], f[j])
                want[a, a] -= want[a, b]
    assert np.allclose(got, want) and not np.allclose(got, plain)
