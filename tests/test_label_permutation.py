"""Label permutation of homology metrics against brute force."""

import hashlib

import numpy as np
import pytest

from braidwork.operators import homology


def h0(x):
    w = [e[2] for e in homology.tree(homology.distances(x)) if e[2] > 0]
    return {"H0_count": len(w), "max_persistence": max(w), "total_persistence": sum(w)}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (12, 3)), rng.normal(0, 3, (9, 3))]
    labels = ["a"] * 12 + ["b"] * 9
    rows = [(k, labels[k], [float(v) for v in x[k]]) for k in range(21)] + [(99, "few", [0.0, 0.0, 0.0])]
    got = {r["metric"]: r for r in homology.label_permutation(spark.createDataFrame(rows, "k int, g string, x array<double>"), "k", "g", "x", 6, max_dim=0).collect()}

    def difference(dealt):
        a, b = (h0(x[[i for i, v in enumerate(dealt) if v == g]]) for g in "ab")
        return {m: a[m] - b[m] for m in a}

    seen, null = difference(labels), []
    for rep in range(6):
        order = sorted(range(21), key=lambda k: (hashlib.md5(f"42/{rep}/label/{k}".encode()).hexdigest(), k))
        null.append(difference([labels[k] for k in order]))
    for m, o in seen.items():
        v = np.array([n[m] for n in null])
        assert got[m].observed_difference == pytest.approx(o)
        assert got[m].z_score == pytest.approx((o - v.mean()) / v.std() if v.std() > 0 else 0)
        assert got[m].empirical_p == pytest.approx((np.sum(np.abs(v) >= abs(o)) + 1) / 7)
    assert (got["H1_count"].observed_difference, got["H1_count"].z_score, got["H1_count"].empirical_p) == (0, 0, 1)
    assert (got["H0_count"].group_a, got["H0_count"].group_b) == ("a", "b")


def test_needs_two_groups(spark):
    rows = [(k, "a", [float(k)]) for k in range(9)] + [(10, "b", [1.0])]
    assert homology.label_permutation(spark.createDataFrame(rows, "k int, g string, x array<double>"), "k", "g", "x").count() == 0


def test_registered_query_reports_dimension_0_alone_with_32_permutations(spark):
    from braidwork.plans.registry import QUERIES

    rows = {r["metric"]: r for r in QUERIES["label_permutation"](spark, "/root/testdata/sf0.001").collect()}
    assert rows and not {"H1_count", "topological_complexity"} & set(rows)
    assert all(abs(r.empirical_p * 33 - round(r.empirical_p * 33)) < 1e-3 for r in rows.values())
