"""Drift index and leakage audit against plain counting."""

import math
import random

import numpy as np
import pytest

from finops_spark.errors import FitError, SchemaError
from finops_spark.operators import drift

SCHEMA = "period string, y int, a double, b long, kind string, flat double"


def rows(n, shift, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        a = None if i % 17 == 0 else (float("nan") if i % 19 == 0 else 1e6 + shift + rng.gauss(0, 1) + 8 * y)
        out.append((f"p{i % 2}", y, a, rng.randint(0, 5), rng.choice(["u", "v", None, "w" if shift else "u"]), 3.0))
    return out


def plain_psi(reference, current):
    total, bins = 0.0, set(reference) | set(current)
    for b in bins:
        p, q = (max(side.count(b) / len(side) if side else 0.0, 1e-4) for side in (reference, current))
        total += (q - p) * math.log(q / p)
    return len(bins), total


def test_index_of_each_feature(spark):
    old, new = rows(400, 0.0, 1), rows(300, 2.0, 2)
    reference, current = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (old, new))
    fitted = drift.fit_bins(reference, ["a", "b", "kind", "flat"], bins=5)
    assert fitted.edges["flat"] == (3.0,) and fitted.texts == ("kind",) and len(fitted.edges["a"]) == 4
    got = {r.feature: r for r in drift.psi_by_feature(reference, current, fitted).collect()}
    where = {"a": 2, "b": 3, "kind": 4, "flat": 5}
    for name, at in where.items():
        def bin_of(v):
            if v is None or v != v:
                return "missing"
            return v if name == "kind" else sum(e <= v for e in fitted.edges[name])

        n, psi = plain_psi([bin_of(r[at]) for r in old], [bin_of(r[at]) for r in new])
        assert (got[name].n_reference, got[name].n_current, got[name].bins) == (400, 300, n)
        assert got[name].psi == pytest.approx(psi, abs=1e-12) and got[name].unstable == (psi > 0.1)
    assert got["a"].unstable and got["kind"].unstable and not got["flat"].unstable  # "w" is new: an empty bin before
    alert = drift.psi_alert(drift.psi_by_feature(reference, current, fitted)).first()
    assert alert.features == 4 and alert.alert and alert.total_psi == pytest.approx(sum(r.psi for r in got.values()))


def test_an_empty_batch_and_wrong_columns(spark):
    reference = spark.createDataFrame(rows(50, 0.0, 3), SCHEMA)
    fitted = drift.fit_bins(reference, ["a"])
    assert drift.psi_by_feature(reference, reference.limit(0), fitted).first().n_current == 0
    assert drift.psi_by_feature(reference.limit(0), reference.limit(0), fitted).collect() == []
    with pytest.raises(FitError):
        drift.fit_bins(reference.limit(0), ["a"])
    with pytest.raises(SchemaError):
        drift.fit_bins(reference, ["nothing"])


def test_leakage_by_window(spark):
    data = rows(500, 0.0, 4) + [(None, 1, 2.0, 1, "u", 3.0), (None, 0, 1.0, 2, "v", 3.0), ("p0", None, 5.0, 1, "u", 3.0)]
    table = spark.createDataFrame(data, SCHEMA).repartition(4)
    fitted = drift.fit_bins(table, ["a", "b", "kind", "flat"], bins=6)
    got = {(r.period, r.feature): r for r in drift.leakage_audit(table, fitted, "y", "period").collect()}
    assert len(got) == 12
    for (period, feature), r in got.items():
        at = {"a": 2, "b": 3, "kind": 4, "flat": 5}[feature]
        here = [x for x in data if x[0] == period and x[1] is not None]
        pairs = [(x[at], x[1]) for x in here if x[at] is not None and x[at] == x[at] and feature != "kind"]
        if feature in ("kind", "flat"):
            assert r.correlation is None
        else:
            v, y = np.array(pairs, float).T
            assert r.correlation == pytest.approx(np.corrcoef(v, y)[0, 1], abs=1e-9)
        cells = [(("missing" if x[at] is None or x[at] != x[at] else x[at] if feature == "kind" else sum(e <= x[at] for e in fitted.edges[feature])), x[1]) for x in here]
        mi = 0.0
        for b, y in set(cells):
            pxy = cells.count((b, y)) / len(cells)
            px, py = sum(c[0] == b for c in cells) / len(cells), sum(c[1] == y for c in cells) / len(cells)
            mi += pxy * math.log(pxy / (px * py))
        assert r.n == len(here) and r.mutual_information == pytest.approx(mi, abs=1e-9)
        assert r.leaks == (r.correlation is not None and abs(r.correlation) > 0.8)
    assert got["p0", "a"].leaks and got["p1", "a"].leaks and not got["p0", "b"].leaks
