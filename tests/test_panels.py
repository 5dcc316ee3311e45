"""Allocation, walk-forward models, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import allocation as A
from seriesmill.operators import metrics as X
from seriesmill.operators import networks as N
from seriesmill.operators import report as R
from seriesmill.operators import solvers as S
from seriesmill.operators import walkforward as K
from seriesmill.sources import tables as T
from seriesmill.spec import SeriesSpec

SPEC = SeriesSpec.of("s", "t")
RETURNS = np.random.default_rng(5).normal(0, 0.01, (300, 5)) * [1, 2, 3, 1.5, 2.5] + np.random.default_rng(6).normal(0, 0.005, (300, 1))


def panel(spark, x):
    rows = [(f"a{j}", i, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "s string, t int, x double")


@pytest.mark.parametrize("name", list(S.METHODS))
def test_weights_are_a_portfolio(name):
    w = S.METHODS[name](RETURNS)
    assert w.shape == (5,) and abs(w.sum() - 1) < 1e-9
    if name != "MVP":
        assert w.min() >= -1e-12 and w.max() <= 1 + 1e-12


@pytest.mark.parametrize("name", ["ERC", "HRP", "IVP", "MDP", "MVP_uc"])
def test_bounds_hold(name):
    w = S.METHODS[name](RETURNS, up_bound=0.25, low_bound=0.1)
    assert w.min() >= 0.1 - 1e-9 and w.max() <= 0.25 + 1e-9 and abs(w.sum() - 1) < 1e-9


def test_optima():
    v = S.covariance(RETURNS)
    w = S.erc(RETURNS)
    parts = w * (v @ w)
    assert parts.max() - parts.min() < 1e-4 * parts.sum()
    u = S.mvp_uc(RETURNS)
    rng = np.random.default_rng(1)
    for _ in range(200):
        z = rng.dirichlet(np.ones(5))
        assert u @ v @ u <= z @ v @ z + 1e-12
    d = np.sqrt(np.diag(v))
    m = S.mdp(RETURNS)
    for _ in range(200):
        z = rng.dirichlet(np.ones(5))
        assert (m @ d) / np.sqrt(m @ v @ m) >= (z @ d) / np.sqrt(z @ v @ z) - 1e-9
    assert np.allclose(S.mvp(RETURNS), np.linalg.inv(v) @ np.ones(5) / (np.linalg.inv(v) @ np.ones(5)).sum())
    with pytest.raises(ValueError):
        S.bounded(np.ones(3) / 3, 0.0, 0.2)


def test_covariance_and_ratio(spark):
    c = {(r["a"], r["b"]): r for r in A.covariance(panel(spark, RETURNS), SPEC).collect()}
    v = np.cov(RETURNS, rowvar=False)
    assert len(c) == 15
    assert c["a0", "a3"]["cov"] == pytest.approx(v[0, 3]) and c["a1", "a2"]["corr"] == pytest.approx(np.corrcoef(RETURNS.T)[1, 2])
    p = np.cov(RETURNS, rowvar=False, ddof=0)
    w = np.ones(5) / 5
    want = w @ np.sqrt(np.diag(p)) / np.sqrt(w @ p @ w)
    assert X.diversified_ratio(panel(spark, RETURNS), SPEC).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("drift", [True, False])
def test_rolling_allocation(spark, drift):
    prices = 100 * np.cumprod(1 + RETURNS, axis=0)
    n, s, total = 60, 25, len(prices)
    portfolio, weights = A.rolling_allocation(panel(spark, prices), SPEC, "IVP", n, s, drift=drift)
    got = [r["portfolio"] for r in portfolio.orderBy("t").collect()]
    want = np.full(total, 100.0)
    rets = np.vstack([np.full(5, np.nan), prices[1:] / prices[:-1] - 1])
    k = 0
    for t in range(n, total - 1, s):
        train = rets[t - n : t].copy()
        for j in range(5):
            bad = np.isnan(train[:, j])
            train[bad, j] = train[~bad, j][0]
        w = S.ivp(train)
        x = prices[t : min(t + s, total - 1) + 1]
        if drift:
            level = (x / x[0]) @ w
        else:
            level = np.cumprod(np.r_[0, (x[1:] / x[:-1] - 1) @ w] + 1)
        want[t : t + len(x)] = want[t] * level
        k += 1
    assert got == pytest.approx(list(want)) and weights.count() == 5 * k


def test_perceptron_learns_and_is_kept():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5]
    net = N.Perceptron(3, lr=0.05)
    losses = net.fit(x, y, 32, 30)
    assert losses[-1] < 0.01 < losses[0]
    again = N.Perceptron.from_json(net.to_json(True))
    assert np.allclose(again.predict(x), net.predict(x)) and again.steps == net.steps
    for cell in (N.RecurrentCell, N.GatedRecurrentCell, N.LongShortTermCell):
        assert N.unroll(cell(3, 2, 4), x[:10]).shape == (10, 2)


def test_gradient_is_right():
    net = N.Perceptron(2, layers=(3,), activation="tanh", optimiser="sgd", lr=1e-7)
    x, y = np.array([[0.3, -0.2], [0.1, 0.4]]), np.array([[0.5], [-0.1]])
    before, biases = [w.copy() for w in net.w], [b.copy() for b in net.b]
    loss = lambda: float(np.mean((net.predict(x) - y) ** 2))
    base = loss()
    net.train_on(x, y)
    g = (before[0][0, 0] - net.w[0][0, 0]) / 1e-7
    net.w, net.b = [w.copy() for w in before], biases
    net.w[0][0, 0] += 1e-6
    assert (loss() - base) / 1e-6 == pytest.approx(g, rel=1e-2, abs=1e-6)


def test_walk_forward(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=200)
    rows = [("k", i, float(0.5 * f[i]), float(f[i])) for i in range(200)]
    d = spark.createDataFrame(rows, "s string, t int, x double, f double")
    out = K.walk_forward(d, SPEC, ("f",), K.perceptron(lr=0.05), 60, 20, batch_size=16, epochs=20, models=("a", "b"))
    test = out.where("part = 'test'")
    windows = len(K.calendar(200, 60, 20))
    assert test.count() == 2 * 20 * windows
    assert test.agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0] < 0.1
    assert K.losses(out, SPEC).count() == 2 * windows
    for how in ("mean", "sum", "best", "bests"):
        assert K.ensemble(out, SPEC, how).count() == 20 * windows
    assert K.performance(out, SPEC).where("perf is null").count() == 0
    assert K.walk_forward(d.limit(10), SPEC, ("f",), K.perceptron(), 60, 20).count() == 0


def test_batches(spark):
    d = panel(spark, RETURNS[:10, :1])
    got = {r["t"]: r["batch"] for r in K.batches(d, SPEC, 2, 9, 3).collect()}
    assert got == {t: (t - 2) // 3 for t in range(2, 9)}
    assert K.batches(d, SPEC, 0, None, 3, shuffle=True).groupBy("batch").count().count() == 4


def test_tables(spark, tmp_path):
    wide = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 3.0)], "t int, a double, b double")
    long = T.from_wide(wide, "t", ["a", "b"])
    assert long.count() == 3 and T.to_wide(long, "t", keys=["a", "b"]).where("a is null").count() == 1
    assert T.vector(wide, ["a", "b"]).where("features is null").count() == 1
    T.save_models({"m": N.Perceptron(2).to_json()}, spark, str(tmp_path / "models"))
    assert N.Perceptron.from_json(T.load_models(spark, str(tmp_path / "models"))["m"]).n_in == 2
    T.log_losses(wide, str(tmp_path / "losses"))
    T.log_losses(wide, str(tmp_path / "losses"))
    assert T.read_table(spark, str(tmp_path / "losses"), columns=["t"]).count() == 4
    assert T.append(wide, wide).count() == 4
    assert T.autoregressive(spark, 2, 50, (0.5,)).groupBy("s").count().collect()[0]["count"] == 50


def test_report(spark):
    prices = 100 * np.cumprod(1 + RETURNS[:, :1], axis=0)
    d = panel(spark, prices).withColumn("sig", F.when(F.col("t") % 7 < 4, 1.0).otherwise(-1.0))
    b = R.backtest(d, SPEC, "sig", win=20)
    assert b.where("perf_idx is null or sharpe_iso is null").count() == 0
    k = R.figures(d, SPEC, {"it": "sig"})
    assert k.count() == 10 and "sharpe" in R.text_report(k)


def test_streaming_state(spark, tmp_path):
    from seriesmill.streaming.state import running, windowed

    x = RETURNS[:40, 0] + 1
    rows = spark.createDataFrame([("k", float(i), float(v)) for i, v in enumerate(x)], "s string, t double, x double")
    rows.where("t < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running(stream, "s", "t", "x", 0.9).writeStream.format("memory").queryName("run").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    rows.where("t >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = [r["ema"] for r in spark.sql("select * from run").orderBy("t").collect()]
    want = [x[0]]
    for v in x[1:]:
        want.append(0.9 * want[-1] + 0.1 * v)
    assert got == pytest.approx(want)
    batch = rows.withColumn("ts", (F.col("t") * 600).cast("timestamp"))
    assert windowed(batch, "s", "ts", "x").count() == 7


@pytest.mark.parametrize("blocks,w", [(1, 5), (7, 5), (40, 30), (3, 1)])
def test_blocks_equal_whole_series(spark, blocks, w):
    from seriesmill.operators import blocks as B
    from seriesmill.operators import moments as M

    rng = np.random.default_rng(blocks)
    rows = [(s, t, float(rng.normal())) for s, n in (("a", 150), ("b", 3), ("c", 1), (None, 20)) for t in range(n)]
    d = spark.createDataFrame(rows, "s string, t int, x double")
    op = lambda df, spec: M.roll_max(M.sma(df, spec, w, out="m"), spec, w, out="h")
    got = B.blocked(d, SPEC, w, op, blocks)
    assert got.columns == [*d.columns, "m", "h"]
    key = lambda r: (str(r[0]), r[1])
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(op(d, SPEC).collect(), key=key)]
    e = B.blocked(d, SPEC, B.reach(0.5), lambda df, spec: M.ema(df, spec, 0.5, out="e"), blocks)
    want = [r["e"] for r in sorted(M.ema(d, SPEC, 0.5, out="e").collect(), key=key)]
    assert [r["e"] for r in sorted(e.collect(), key=key)] == pytest.approx(want, rel=1e-12)
