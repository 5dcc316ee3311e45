"""Networks trained through time, schedules and criteria, baselines, frames with values that aren't finite."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import econometrics as E
from seriesmill.operators import moments as M
from seriesmill.operators import networks as N
from seriesmill.spec import SeriesSpec


@pytest.mark.parametrize("kind", ["rnn", "gru", "lstm"])
@pytest.mark.parametrize("criterion", ["mse", "huber"])
def test_gradients_through_time(kind, criterion):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 2))
    cell = N.CELLS[kind](3, 2, 4, seed=2, output="tanh")
    state = tuple(rng.normal(size=a.shape) * 0.3 for a in cell.start(1))
    _, gradients, _ = N.through_time(cell, x, y, state, criterion)
    for p, g in zip(cell.parameters(), gradients, strict=True):
        for i in rng.choice(p.size, min(6, p.size), replace=False):
            at = np.unravel_index(i, p.shape)
            old, found = p[at], []
            for d in (1e-6, -1e-6):
                p[at] = old + d
                found.append(N.through_time(cell, x, y, state, criterion)[0])
            p[at] = old
            assert g[at] == pytest.approx((found[0] - found[1]) / 2e-6, rel=1e-4, abs=1e-8)


@pytest.mark.parametrize("kind", ["rnn", "gru", "lstm"])
def test_recurrent_networks_learn_what_needs_memory(kind):
    rng = np.random.default_rng(3)
    x = rng.choice([-1.0, 1.0], size=(600, 1))
    y = np.r_[0.0, x[:-1, 0]]  # the value before
    net = N.Recurrent(kind, 1, 1, 6, lr=0.02, seed=4)
    losses = net.fit(x, y, batch_size=25, epochs=30)
    assert losses[-1] < 0.1 < losses[0]
    assert np.mean((net.predict(x)[5:, 0] - y[5:]) ** 2) < 0.1


def test_schedules_and_criteria():
    assert N.scheduled(1.0, (), 7) == 1.0
    assert N.scheduled(1.0, ("exponential", 0.5), 3) == 0.125
    assert [N.scheduled(1.0, ("step", 2, 0.1), e) for e in (0, 1, 2)] == [1.0, 1.0, 0.1]
    assert N.scheduled(1.0, ("cosine", 10, 0.0), 5) == pytest.approx(0.5) and N.scheduled(1.0, ("cosine", 10, 0.1), 99) == pytest.approx(0.1)
    with pytest.raises(ValueError):
        N.scheduled(1.0, ("other",), 0)
    e = np.array([0.5, -3.0])
    assert N.CRITERIA["mae"][0](e) == 1.75 and N.CRITERIA["huber"][0](e) == (0.125 + 2.5) / 2
    x = np.random.default_rng(0).normal(size=(200, 2))
    y = x @ [1.0, -2.0]
    for criterion in N.CRITERIA:
        net = N.Perceptron(2, criterion=criterion, lr=0.05, schedule=("cosine", 30, 0.001))
        assert net.fit(x, y, 20, 30)[-1] < 0.05
        again = N.Perceptron.from_json(net.to_json(True))
        assert (again.criterion, list(again.schedule), again.epoch) == (criterion, ["cosine", 30, 0.001], 30)
        assert again.state.steps == net.state.steps and (again.predict(x) == net.predict(x)).all()


def test_least_squares():
    x = np.random.default_rng(5).normal(size=(50, 2))
    net = N.LeastSquares()
    assert net.fit(x, 3 + x @ [1.0, 2.0])[0] < 1e-20
    assert net.predict(np.zeros((1, 2)))[0] == pytest.approx(3)


def test_garch_filter_equals_its_recursion():
    rng = np.random.default_rng(6)
    y, par = rng.normal(size=80), E.Parameters((0.4, 0.1), (0.2,), (0.1, 0.05), (0.3,), 0.1, 0.2)
    u, h = E.filtered(y, par)
    for t in range(2, 80):
        assert u[t] == pytest.approx(y[t] - 0.1 - 0.4 * y[t - 1] - 0.1 * y[t - 2] - 0.2 * u[t - 1])
        assert h[t] ** 2 == pytest.approx(0.2 + 0.1 * u[t - 1] ** 2 + 0.05 * u[t - 2] ** 2 + 0.3 * h[t - 1] ** 2)


def test_long_frames_hold_what_is_in_them_only(spark):
    rng = np.random.default_rng(7)
    x = (1e6 + rng.normal(size=900)).tolist()
    x[100], x[450], x[700], x[5] = math.nan, math.inf, None, None
    spec = SeriesSpec.of("s", "t", "x")
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "s string, t long, x double")
    for w in (256, 257, 300):
        out = M.smstd(M.sma(df, spec, w, out="m"), spec, w, out="d")
        out = M.wma(out, spec, w, out="l").orderBy("t").collect()
        for t in range(900):
            frame = np.array([v for v in x[max(0, t - w + 1) : t + 1] if v is not None])
            with np.errstate(invalid="ignore"):
                want = frame.mean()
            assert out[t]["m"] == pytest.approx(want, rel=1e-12, nan_ok=True), (w, t)
            if np.isfinite(frame).all():
                assert out[t]["d"] == pytest.approx(frame.std(), rel=1e-4, abs=1e-6), (w, t)
                k = np.arange(1, len(frame) + 1)
                assert out[t]["l"] == pytest.approx(float((k * frame).sum() / k.sum()), rel=1e-9), (w, t)


def test_a_broken_import_is_not_taken_for_an_absent_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
import importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == sys.argv[1]:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()) > 50)
"""
    run = lambda name: subprocess.run([sys.executable, "-c", code, name], cwd=tmp_path, capture_output=True, text=True)
    assert run("seriesmill.llm").stdout.strip() == "True"
    if (root / "seriesmill" / "llm").is_dir():
        assert run("collections.abc").returncode == 0 and run("pyspark.sql").returncode != 0


def test_series_in_blocks_equal_whole_series(spark):
    """Nulls, a null key, a block without values and clashing names."""
    from seriesmill.operators import blocks as B
    from seriesmill.operators import metrics as X

    rng = np.random.default_rng(8)
    rows = [(s, t, None if (40 < t < 90 and s) or rng.random() < 0.1 else float(rng.uniform(1, 3)), t) for s in ("a", "b", None) for t in range(200)]
    df = spark.createDataFrame(rows, "s string, t long, x double, _r long")
    spec = SeriesSpec.of("s", "t", "x")
    pairs = [
        (B.drawdown(df, spec, out="v", blocks=16), X.drawdown(df, spec, out="v")),
        (B.perf_index(df, spec, out="v", blocks=16), X.perf_index(df, spec, out="v")),
        *((B.perf_returns(df, spec, k, out="v", blocks=16), X.perf_returns(df, spec, k, out="v")) for k in ("raw", "log", "pct")),
    ]
    for got, want in pairs:
        assert got.columns == want.columns
        order = lambda r: (str(r["s"]), r["t"])
        for a, b in zip(sorted(got.collect(), key=order), sorted(want.collect(), key=order), strict=True):
            assert a[:4] == b[:4] and (a["v"] == b["v"] or a["v"] == pytest.approx(b["v"], rel=1e-12))
    folds = {k: (k, F.col("x")) for k in ("max", "min", "sum", "product", "count", "first")}
    last = {r["s"]: r for r in B.running(df, spec, folds, 16).where("t = 199").collect()}
    for s in ("a", "b", None):
        x = [r[2] for r in rows if r[0] == s and r[2] is not None]
        assert last[s][4:6] == (max(x), min(x)) and last[s]["count"] == len(x) and last[s]["first"] == x[0]
        assert last[s]["sum"] == pytest.approx(sum(x)) and last[s]["product"] == pytest.approx(math.prod(x))
