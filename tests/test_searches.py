"""Gate searches against a serial search, and correlations of many columns against pandas."""
import numpy as np
import pandas as pd
import pytest

from tickloom.operators import policy as pol, quality as ql


def serial_score(gate, profit, limit, target, min_edge=0.0):
    on = (gate >= limit) & (profit > min_edge)
    if not on.any():
        return None
    raw = np.clip(gate[on], 0, 1) * np.maximum(profit[on], 0)
    z = raw.std() + 1e-6
    size = np.clip(raw / z / (raw.max() / z), 0, 1) if raw.max() / z > 1e-12 else np.zeros(len(raw))
    r = size * profit[on]
    neg, eq = r[r < 0], np.cumsum(r)
    down = np.sqrt(np.mean(neg ** 2)) if len(neg) else 0.0
    fall = np.max(np.maximum.accumulate(eq) - eq)
    factor = min(max(r[r > 0].sum() / max(-neg.sum(), 1e-9), 0), 5)
    return r.mean() - 0.25 * down - 0.1 * fall - 0.15 * max(0.0, -np.quantile(r, 0.05)) + 0.05 * factor - 0.35 * abs(on.mean() - target)


def table(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"g": rng.random(n).round(3), "p": rng.normal(0.2, 1, n), "state": rng.choice(list("abcdefg"), n, p=[.3, .2, .2, .1, .1, .09, .01])})


@pytest.mark.parametrize("min_edge", [0.0, 0.3, -0.5])
def test_gate_search_against_serial(spark, min_edge):
    t = table(3000, 1)
    got = pol.gate_search(spark.createDataFrame(t), "g", "p", 0.1, (0.05, 0.2), n=21, min_edge=min_edge).toPandas()
    assert len(got) > 20
    for r in got.itertuples():
        assert r.score == pytest.approx(serial_score(t.g.to_numpy(), t.p.to_numpy(), r.threshold, 0.1, min_edge), abs=1e-9)
        assert r.active == ((t.g >= r.threshold) & (t.p > min_edge)).sum()


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_gate_offsets_against_serial(spark, seed):
    t, steps = table(2000, seed), (-0.2, -0.1, -0.05, 0.05, 0.1, 0.2)
    t.loc[t.state == "a", "p"] *= 20  # the largest weight is in a state whose own step decides whether it stays
    g, p, limit, want = t.g.to_numpy(), t.p.to_numpy(), np.full(len(t), 0.7), {}
    for s in sorted(t.state.unique()):
        m, want[s] = (t.state == s).to_numpy(), 0.0
        if m.sum() < 100:
            continue
        scores = []
        for step in sorted({*steps, 0.0}):
            trial = np.where(m, np.clip(0.7 + step, 0, 1), limit)
            scores.append((-round(serial_score(g, p, trial, 0.1), 12), step))
        want[s] = min(scores)[1]
        limit = np.where(m, np.clip(0.7 + want[s], 0, 1), limit)
    got = pol.gate_offsets(spark.createDataFrame(t), "g", "p", "state", 0.7, 0.1, steps=steps, least=100).toPandas()
    assert dict(zip(got.state, got.step)) == want and len(set(want.values())) > 1


def test_gate_searches_without_rows(spark):
    d = spark.createDataFrame([], "g double, p double, state string")
    assert pol.gate_search(d, "g", "p", 0.1, (0.05, 0.2)).count() == 0
    assert pol.gate_offsets(d, "g", "p", "state", 0.7, 0.1).count() == 0
    lost = spark.createDataFrame([(0.9, -1.0, "a"), (None, 1.0, "a"), (float("nan"), 1.0, None)], "g double, p double, state string")
    assert {(r.state, r.step) for r in pol.gate_offsets(lost, "g", "p", "state", 0.7, 0.1, least=1).collect()} == {("a", 0.0), (None, 0.0)}


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(700, 5))
    x = base[:, rng.integers(0, 5, 120)] + rng.normal(size=(700, 120)) * rng.random(120) + 1e6 * (rng.random(120) < 0.1)
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 3] = 4.25
    p = pd.DataFrame(x, columns=[f"c{i}" for i in range(120)])
    p.loc[5, "c7"] = np.inf
    got = ql.correlation_pairs(spark.createDataFrame(p).repartition(6), list(p.columns)).toPandas()
    want = p.replace(np.inf, np.nan).corr()
    assert len(got) == 120 * 119 // 2
    for r in got.itertuples():
        w = want.loc[r.a, r.b]
        assert (np.isnan(r.r) and "c3" in (r.a, r.b)) or r.r == pytest.approx(w, abs=1e-7)


def test_correlations_of_little(spark):
    d = spark.createDataFrame([(1.0, None, 2.0), (2.0, 3.0, 4.0), (None, 4.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in ql.correlation_pairs(d, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): None, ("a", "c"): pytest.approx(1.0), ("b", "c"): pytest.approx(1.0)}
    assert [r.r for r in ql.correlation_pairs(d.limit(0), ["a", "b"]).collect()] in ([None], [])
    assert ql.drop_correlated(d, ["a", "b", "c"], {"default": 0.9}, protected=("c",)) == ["c"]
