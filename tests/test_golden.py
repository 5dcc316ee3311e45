"""Fixed inputs and results of each operator, to eight digits."""

import math

import numpy as np
import pytest

from seriesmill.functions import frames
from seriesmill.operators import econometrics as E
from seriesmill.operators import indicators as I
from seriesmill.operators import metrics as X
from seriesmill.operators import moments as M
from seriesmill.operators import scale as S
from seriesmill.spec import ArraySizeError, SeriesSpec, check_size, decay

SPEC = SeriesSpec.of("s", "t")
# Input series.
A = [60, 100, 80, 120, 160, 80]
B = [70, 100, 80, 120, 160, 80]
C = [100, 110, 80, 120, 160, 108]
D = [100, 110, 105, 110, 120, 108]
EE = [100, 80, 70, 75, 110, 80]
P = [10, 12, 15, 14, 16, 18, 16]
SIG = [1, 1, 1, 0, 1, 1, -1]


def frame(spark, xs, **more):
    cols = {"x": xs, **more}
    rows = [("k", i, *[float(c[i]) for c in cols.values()]) for i in range(len(xs))]
    return spark.createDataFrame(rows, "s string, t int, " + ", ".join(f"{c} double" for c in cols))


def column(df, name):
    return [r[0] for r in df.orderBy("t").select(name).collect()]


def close(got, want):
    assert got == pytest.approx(want, abs=1e-7, rel=1e-7)


# Expected columns.
COLUMNS = [
    (A, lambda d: M.sma(d, SPEC, 3, out="o"), [60, 80, 80, 100, 120, 120]),
    (A, lambda d: M.wma(d, SPEC, 3, out="o"), [60, 86.66666667, 83.33333333, 103.33333333, 133.33333333, 113.33333333]),
    (A, lambda d: M.ema(d, SPEC, w=3, out="o"), [60, 80, 80, 100, 130, 105]),
    (A, lambda d: M.ema(d, SPEC, 0.5, out="o"), [60, 80, 80, 100, 130, 105]),
    (A, lambda d: M.ema(d, SPEC, 0.0, out="o"), A),
    (A, lambda d: M.ema(d, SPEC, 1.0, out="o"), [60] * 6),
    (A, lambda d: M.smstd(d, SPEC, 3, out="o"), [0, 20, 16.32993162, 16.32993162, 32.65986324, 32.65986324]),
    (A, lambda d: M.wmstd(d, SPEC, 3, out="o"), [0, 18.85618083, 13.74368542, 17.95054936, 29.8142397, 35.90109871]),
    (A, lambda d: M.emstd(d, SPEC, w=3, out="o"), [0, 14.14213562, 10, 15.8113883, 23.97915762, 24.49489743]),
    (A, lambda d: M.roll_min(d, SPEC, 3, out="o"), [60, 60, 60, 80, 80, 80]),
    (A, lambda d: M.roll_max(d, SPEC, 3, out="o"), [60, 100, 100, 120, 160, 160]),
    (A, lambda d: I.bollinger_band(d, SPEC, 3, 2, out="b").withColumnRenamed("b_upper", "o"), [60, 120, 112.65986324, 132.65986324, 185.31972647, 185.31972647]),
    (A, lambda d: I.cci(d, SPEC, w=3, out="o"), [0, 66.66666667, 0, 100, 100, -100]),
    (A, lambda d: I.hma(d, SPEC, 3, out="o"), [60, 113.33333333, 76.66666667, 136.66666667, 186.66666667, 46.66666667]),
    (A, lambda d: I.macd_line(d, SPEC, 2, 4, out="o"), [0, 10.66666667, 4.62222222, 12.84740741, 21.7331358, -3.61855473]),
    (A, lambda d: I.signal_line(d, SPEC, 3, 2, 4, out="o"), [0, 5.33333333, 4.97777778, 8.91259259, 15.3228642, 5.85215473]),
    (A, lambda d: I.macd_hist(d, SPEC, 3, 2, 4, out="o"), [0, 5.33333333, -0.35555556, 3.93481481, 6.4102716, -9.47070947]),
    (A, lambda d: I.rsi(d, SPEC, 3, out="o"), [0, 99.99999804, 69.59769254, 85.55610891, 91.72201613, 30.00294321]),
    ([95, 100, 85, 105, 110, 90], lambda d: I.iso_vol(d, SPEC, 0.5, 2, 12, 3, out="o"), [1, 1, 2, 1.11289534, 0.88580571, 1.20664917]),
    (B, lambda d: X.drawdown(d, SPEC, out="o"), [0, 0, 0.2, 0, 0, 0.5]),
    (B, lambda d: X.drawdown(d, SPEC, True, out="o"), [0, 0, 20, 0, 0, 80]),
    (P, lambda d: X.perf_index(d, SPEC, out="o"), [100, 120, 150, 140, 160, 180, 160]),
    ([0, 20, 30, -10, 20, 20, -20], lambda d: X.perf_returns(d, SPEC, out="o"), [100, 120, 150, 140, 160, 180, 160]),
    (C, lambda d: X.roll_annual_return(d, SPEC, 12, out="o"), [0, 0.771561, -0.5904, 0.728, 2.08949828, 0.1664]),
    (D, lambda d: X.roll_annual_volatility(d, SPEC, 12, False, ddof=1, out="o"), [0, 0.24494897, 0.25777176, 0.21655755, 0.21313847, 0.27344193]),
    (B, lambda d: X.roll_calmar(d, SPEC, 12, out="o"), [0, 0, 3.52977926, 20.18950437, 31.35989887, 0.6122449]),
    (EE, lambda d: X.roll_drawdown(d, SPEC, 3, True, out="o"), [0, 20, 30, 5, 0, 30]),
    (EE, lambda d: X.roll_mdd(d, SPEC, 3, True, out="o"), [0, 20, 30, 10, 0, 30]),
    (A, lambda d: X.roll_mad(d, SPEC, 3, out="o"), [0, 20, 13.33333333, 13.33333333, 26.66666667, 26.66666667]),
    (B, lambda d: X.roll_mdd(d, SPEC, out="o"), [0, 0, 0.2, 0.2, 0.2, 0.5]),
    (B, lambda d: X.roll_mdd(d, SPEC, 3, out="o"), [0, 0, 0.2, 0.2, 0, 0.5]),
    (B, lambda d: X.roll_sharpe(d, SPEC, 0, 12, out="o"), [0, 10.10344078, 0.77721579, 3.99243019, 6.754557, 0.24475518]),
    (B, lambda d: X.roll_z_score(d, SPEC, 3, out="o"), [0, 1, -0.26726124, 1.22474487, 1.22474487, -1.22474487]),
    (B, lambda d: X.roll_z_score(d, SPEC, 3, "e", out="o"), [0, 1.41421356, -0.32444284, 1.30806216, 1.27096675, -1.04435741]),
    ([3, 4, 6, 8, 5, 3], lambda d: E.ma(d, SPEC, (0.8,), 3.0, out="o"), [0, 1, 2.2, 3.24, -0.592, 0.4736]),
]


@pytest.mark.parametrize("case", range(len(COLUMNS)))
def test_column(spark, case):
    xs, make, want = COLUMNS[case]
    close(column(make(frame(spark, xs)), "o"), want)


# Expected scalars.
SCALARS = [
    (C, lambda d: X.annual_return(d, SPEC, 12), 0.1664),
    (D, lambda d: X.annual_volatility(d, SPEC, 12, ddof=1), 0.2731896268610321),
    (D, lambda d: X.annual_volatility(d, SPEC, 12, False), 0.24961719),
    ([70, 100, 80, 120, 160, 105, 80], lambda d: X.calmar(d, SPEC, 12, 1), 0.6122449),
    ([70, 100, 80, 120, 160, 105, 80], lambda d: X.calmar(d, SPEC, 12), 0.51446018),
    ([70, 100, 90, 110, 150, 80], lambda d: X.mad(d, SPEC), 20),
    (B, lambda d: X.mdd(d, SPEC), 0.5),
    (B, lambda d: X.sharpe(d, SPEC, 0, 12), 0.24475518072327812),
    ([5, 5, 5], lambda d: X.sharpe(d, SPEC, 0, 12), math.inf),
    (B, lambda d: X.z_score(d, SPEC, 3, "e"), -1.0443574118998766),
    (B, lambda d: X.z_score(d, SPEC, 3), -1.224744871391589),
]


@pytest.mark.parametrize("case", range(len(SCALARS)))
def test_scalar(spark, case):
    xs, make, want = SCALARS[case]
    close([make(frame(spark, xs)).first()[1]], [want])


def test_accuracy(spark):
    d = frame(spark, [1, 0.5, -0.5, 0.8, -0.2], p=[0.5, 0.2, -0.5, 0.1, 0])
    close([X.accuracy(d, SPEC, "x", "p").first()[1], X.accuracy(d, SPEC, "x", "p", False).first()[1]], [0.8, 0.2])


def test_strategies(spark):
    d = frame(spark, P, g=SIG)
    close(column(X.perf_strat(d, SPEC, "g", out="o"), "o"), [100, 120, 150, 150, 170, 190, 210])
    close(column(X.perf_strat(d, SPEC, "g", reinvest=True, out="o"), "o"), [100, 120, 150, 150, 171.42857143, 192.85714286, 214.28571429])
    close(column(X.returns_strat(d, SPEC, "g", "raw", 10, out="o"), "o"), [0, 2, 3, 0, 2, 2, 2])


def test_arma_garch(spark):
    d = E.residuals(frame(spark, A), SPEC, E.Parameters((0.5,), (-0.3,), (0.1,), (0.1,), 0.2, 0.6))
    close(column(d, "u"), [59.8, 87.74, 56.122, 96.6366, 128.79098, 38.437294])
    close(column(d, "h"), [0.77459667, 18.92786306, 28.39466781, 19.90461264, 31.2102965, 41.91324270])


def test_parameters():
    p = E.get_parameters([0.2, 0.5, -0.3, 0.6, 0.1, 0.1], 1, 1, 1, 1)
    assert (p.phi, p.theta, p.alpha, p.beta, p.c, p.omega) == ((0.5,), (-0.3,), (0.1,), (0.1,), 0.2, 0.6)
    assert E.get_parameters([0.2]).phi == (0.0,)


def test_estimation_finds_an_autoregression():
    rng = np.random.default_rng(3)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.6 * y[t - 1] + rng.normal()
    par, nll, u, _ = E.estimation(y, (0.0, 0.1), 1, model="arma")
    assert abs(par.phi[0] - 0.6) < 0.1 and abs(nll - E.loglikelihood(u, np.ones(400))) < 1e-6


@pytest.mark.parametrize("kind,kw", [("std", {}), ("norm", {}), ("raw", {}), ("roll_std", {"w": 3}), ("roll_std", {"w": 3, "kind_moment": "e"}), ("roll_std", {"w": 3, "kind_moment": "w"}), ("roll_norm", {"w": 3})])
def test_scale_reverts(spark, kind, kw):
    d = frame(spark, A)
    m = S.Scale(kind, 1.0, 2.0, **kw).fit(d, SPEC)
    close(column(m.revert(m.scale(d), "scaled"), "reverted"), A)


def test_scaling(spark):
    d = frame(spark, A)
    want = (np.array(A) - np.mean(A)) / np.std(A)
    close(column(S.standardize(d, SPEC, out="o"), "o"), list(want))
    close(column(S.normalize(d, SPEC, -1, 1, out="o"), "o"), list(2 * (np.array(A) - 60) / 100 - 1))
    assert column(S.roll_normalize(d, SPEC, 3, out="o"), "o")[0] is None


def test_rolling_equals_scalar_on_the_window(spark):
    xs = [float(v) for v in np.random.default_rng(0).integers(50, 150, 30)]
    d = frame(spark, xs)
    for w in (5, 30, None):
        got = column(M.smstd(d, SPEC, w, 1, out="o"), "o")
        close(got[1:], [float(np.std(xs[max(0, t + 1 - (w or 99)) : t + 1], ddof=1)) for t in range(1, 30)])
        mad = column(X.roll_mad(d, SPEC, w, out="o"), "o")
        close(mad, [float(np.mean(np.abs(np.array(v) - np.mean(v)))) for v in (xs[max(0, t + 1 - (w or 99)) : t + 1] for t in range(30))])


def test_long_frames_equal_short_ones(spark, monkeypatch):
    xs = [float(v) for v in np.random.default_rng(1).integers(50, 150, 40)]
    d = frame(spark, xs)
    ops = [lambda: M.sma(d, SPEC, 7, out="o"), lambda: M.wma(d, SPEC, 7, out="o"), lambda: M.smstd(d, SPEC, 7, 1, out="o"), lambda: M.wmstd(d, SPEC, 7, out="o")]
    short = [column(f(), "o") for f in ops]
    monkeypatch.setattr(frames, "LONG", 3)
    for f, want in zip(ops, short, strict=True):
        close(column(f(), "o"), want)


def test_nulls_are_in_no_frame(spark):
    d = spark.createDataFrame([("k", 0, None), ("k", 1, 2.0), ("k", 2, None), ("k", 3, 4.0)], "s string, t int, x double")
    assert column(M.sma(d, SPEC, 3, out="o"), "o") == [None, 2.0, 2.0, 3.0]
    assert column(M.ema(d, SPEC, 0.5, out="o"), "o")[3] == 3.0
    assert column(M.ffill(d, SPEC, out="o"), "o") == [None, 2.0, 2.0, 4.0]
    assert column(M.bfill(d, SPEC, out="o"), "o") == [2.0, 2.0, 4.0, 4.0]


def test_errors(spark):
    d = frame(spark, [1, 0, 2])
    with pytest.raises(ValueError):
        M.sma(d, SPEC, -1)
    with pytest.raises(ValueError):
        M.smstd(d, SPEC, 3, 3)
    with pytest.raises(ValueError):
        decay(0)
    with pytest.raises(ValueError):
        X.perf_returns(d, SPEC, "other")
    with pytest.raises(ValueError):
        M.lags(d, SPEC, 0)
    with pytest.raises(ArraySizeError, match="minimum size is 4"):
        check_size(d, SPEC, 4)
    with pytest.raises(Exception, match="null value"):
        X.returns(d, SPEC).collect()


def test_one_exchange_for_many_indicators(spark):
    d = frame(spark, A).repartition(2)
    d = I.macd_hist(M.emstd(X.roll_mdd(M.sma(d, SPEC, 20), SPEC, 20), SPEC), SPEC)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_axis_swap(spark):
    d = spark.createDataFrame([("a", 0, 60.0), ("b", 0, 100.0), ("a", 1, 80.0), ("b", 1, 120.0)], "s string, t int, x double")
    got = X.mad(d, SPEC.swapped()).orderBy("t").collect()
    assert [r[1] for r in got] == [20.0, 20.0]

