from __future__ import annotations

import numpy as np
import pytest

from breezeframe.core import quantiles as module
from breezeframe.core.quantiles import quantiles

PROBS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_linear_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "one": rng.normal(size=1),
        "two": rng.normal(size=2),
        "three": rng.normal(size=3),
        "odd": rng.normal(size=41),
        "constant": np.full(50, 500.0),
        "ties": rng.integers(0, 4, 900).astype(float),
        "saturated": np.where(rng.random(3_000) < 0.6, 500.0, rng.uniform(0, 500, 3_000)),
        "heavy_tail": rng.standard_cauchy(20_000) * 1e6,
        "narrow": 1e9 + rng.normal(size=5_000) * 1e-3,
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    rows += [("odd", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        assert got[name]["n"] == len(values)
        for column, p in PROBS.items():
            assert got[name][column] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-9)


def test_every_small_group_size(spark):
    """Ranks next to a bracket edge are the hard case."""
    rng = np.random.default_rng(5)
    sizes = {f"n{k}": rng.normal(size=k) for k in range(1, 120)}
    rows = [(k, float(v)) for k, vs in sizes.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", PROBS).collect()}
    for name, values in sizes.items():
        for column, p in PROBS.items():
            assert got[name][column] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_without_keys(spark):
    df = spark.range(0, 1001).selectExpr("double(id) AS v")
    row = quantiles(df, [], "v", {"m": 0.5}).first()
    assert (row["n"], row["m"]) == (1001, 500.0)


@pytest.mark.parametrize("keys", [["g"], []])
def test_a_missed_bracket_is_widened(spark, monkeypatch, keys):
    """A sketch of ten centroids with a margin far below its error misses ranks on either side."""
    monkeypatch.setattr(module, "ACCURACY", 10)
    monkeypatch.setattr(module, "MARGIN", 1e-6)
    calls = []
    resolved = module._resolved
    monkeypatch.setattr(module, "_resolved", lambda *args: calls.append(1) or resolved(*args))
    rng = np.random.default_rng(9)
    groups = {"wide": rng.standard_cauchy(30_000), "even": rng.uniform(size=30_000), "small": rng.normal(size=4)}
    groups = groups if keys else {"wide": groups["wide"]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"] if keys else "wide": r for r in quantiles(df, keys, "v", PROBS).collect()}
    assert len(calls) == 2 and set(got) == set(groups)
    for name, values in groups.items():
        assert got[name]["n"] == len(values)
        for column, p in PROBS.items():
            assert got[name][column] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
