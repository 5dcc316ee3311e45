"""One query per operator and, where SQL can express it, the SQL that DuckDB answers with the same rows.

Bases: events by event_type and (ts, event_id); prices, the mean order price by priority and day; a panel of those series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import blocks as B
from ..operators import econometrics as E
from ..operators import indicators as I
from ..operators import metrics as X
from ..operators import moments as M
from ..operators import report as R
from ..operators import scale as S
from ..operators import walkforward as K
from ..spec import SeriesSpec

EV = SeriesSpec.of("s", ("ts", "event_id"))
PX = SeriesSpec.of("s", "t")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("s"), "ts", F.col("value").alias("x"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("s"), F.col("o_orderdate").alias("t"), "o_totalprice")
    return rows.groupBy("s", "t").agg(F.round(F.avg("o_totalprice"), 4).alias("x"))


_EV = "ev AS (SELECT event_id, event_type AS s, ts, value AS x FROM events)"
_PX = "px AS (SELECT o_orderpriority AS s, o_orderdate AS t, round(avg(o_totalprice), 4) AS x FROM orders GROUP BY ALL)"
_BY = {"ev": "PARTITION BY s ORDER BY ts, event_id", "px": "PARTITION BY s ORDER BY t"}
_DAY = "CAST(CAST(t AS DATE) AS VARCHAR) AS t"


def rounded(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(c, 6) + 0.0


def day(name: str) -> Column:
    """A day as text, which reads the same wherever it is compared."""
    return F.col(name).cast("date").cast("string").alias(name)


def _sql_window(base: str, w: int | None) -> str:
    frame = "UNBOUNDED" if w is None else str(w - 1)
    return f"({_BY[base]} ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW)"


def _register(name: str, base: str, make: Callable[[DataFrame], DataFrame], outs: tuple[str, ...] = (), sql: str | None = None, scalar: bool = False) -> None:
    """make adds the columns outs to a base; sql: the SQL after `WITH <base>`, which names the same columns unrounded."""
    outs = outs or (name,)
    load = events if base == "ev" else prices

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keep = ["s"] if scalar else ["event_id"] if base == "ev" else ["s", day("t")]
        return make(load(spark, sf_dir)).select(*keep, *[rounded(c).alias(c) for c in outs])

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        cte = _EV if base == "ev" else _PX
        named = ["s"] if scalar else ["event_id"] if base == "ev" else ["s", _DAY]
        cols = ", ".join([*named, *[f"round({c}, 6) + 0.0 AS {c}" for c in outs]])
        SQL[name] = f"WITH {cte}, res AS ({sql}) SELECT {cols} FROM res"


def _rolling(name: str, base: str, make: Callable[[DataFrame], DataFrame], expr: str, w: int | None) -> None:
    """A query whose SQL is one expression over a frame: {w} that frame, {u} all rows so far, {b} the series in order."""
    u, b = _sql_window(base, None), f"({_BY[base]})"
    text = expr.format(w=_sql_window(base, w), u=u, b=b)
    _register(name, base, make, (), f"SELECT *, {text} AS {name} FROM {base}")


def _ema_sql(x: str, base: str, lam: float) -> str:
    return f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER {_sql_window(base, None)}, lambda a, v: {lam!r}::DOUBLE * a + {1 - lam!r}::DOUBLE * v)"


def _wma_sql(x: str, base: str, w: int) -> str:
    l = f"list({x}) OVER {_sql_window(base, w)}"
    return f"list_sum(list_transform({l}, lambda v, i: i * v)) / (len({l}) * (len({l}) + 1) / 2)"


# Moments

_rolling("sma", "ev", lambda d: M.sma(d, EV, 20), "avg(x) OVER {w}", 20)
#: Over frames longer than frames.LONG; scaled so that no mean of cents ends in a 5 at the last digit kept.
_rolling("sma_long", "ev", lambda d: M.sma(d, EV, 500, F.col("x") * 0.7310585, "sma_long"), "avg(x * 0.7310585::DOUBLE) OVER {w}", 500)
_rolling("roll_min", "ev", lambda d: M.roll_min(d, EV, 20), "min(x) OVER {w}", 20)
_rolling("roll_max", "ev", lambda d: M.roll_max(d, EV, 20), "max(x) OVER {w}", 20)
_rolling("smstd", "ev", lambda d: M.smstd(d, EV, 20, 1), "coalesce(stddev_samp(x) OVER {w}, 0)", 20)
_register("wma", "ev", lambda d: M.wma(d, EV, 20), sql=f"SELECT *, {_wma_sql('x', 'ev', 20)} AS wma FROM ev")
_register(
    "wmstd", "ev", lambda d: M.wmstd(d, EV, 20),
    sql=f"SELECT *, sqrt(greatest({_wma_sql('x * x', 'ev', 20)} - power({_wma_sql('x', 'ev', 20)}, 2), 0)) AS wmstd FROM ev",
)
_register("ema", "ev", lambda d: M.ema(d, EV, 0.94), sql=f"SELECT *, {_ema_sql('x', 'ev', 0.94)} AS ema FROM ev")
_EMSTD = f"SELECT *, sqrt({_ema_sql('power(x - m, 2)', 'ev', 0.94)}) AS emstd FROM (SELECT *, {_ema_sql('x', 'ev', 0.94)} AS m FROM ev)"
_register("emstd", "ev", lambda d: M.emstd(d, EV, 0.94), sql=_EMSTD)
_rolling("lag_features", "ev", lambda d: M.lags(d, EV, 3, out="l").withColumn("lag_features", F.col("l_1") + F.col("l_2") + F.col("l_3")), "coalesce(lag(x, 1) OVER {b}, 0) + coalesce(lag(x, 2) OVER {b}, 0) + coalesce(lag(x, 3) OVER {b}, 0)", None)
_rolling("dead_zone_sign", "ev", lambda d: M.dead_zone_sign(d, EV, 50.0, out="dead_zone_sign"), "CASE WHEN abs(x) < 50 THEN 0.0 ELSE sign(x)::DOUBLE END", None)
_rolling("prob_signal", "ev", lambda d: M.signal(d, EV, "prob", F.col("x") / 100, "prob_signal"), "CASE WHEN x / 100 < 0.5 THEN -1.0 ELSE 1.0 END", None)
_rolling("ffill", "ev", lambda d: M.ffill(d, EV, F.when(F.col("event_id") % 3 > 0, F.col("x"))), "last_value(CASE WHEN event_id % 3 > 0 THEN x END IGNORE NULLS) OVER {u}", None)

_rolling("bfill", "ev", lambda d: M.bfill(d, EV, F.when(F.col("event_id") % 3 > 0, F.col("x"))), "first_value(CASE WHEN event_id % 3 > 0 THEN x END IGNORE NULLS) OVER (PARTITION BY s ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", None)

# The same on blocks: a long series isn't one task


def _on_blocks(name: str, w: int, make: Callable[[DataFrame, SeriesSpec], DataFrame], like: str) -> None:
    _register(name, "ev", lambda d: B.blocked(d, EV, w, make, 32))
    SQL[name] = SQL[like].replace(f"AS {like} ", f"AS {name} ").replace(f"round({like},", f"round({name},")


_on_blocks("sma_blocked", 20, lambda d, s: M.sma(d, s, 20, out="sma_blocked"), "sma")
_on_blocks("wmstd_blocked", 20, lambda d, s: M.wmstd(d, s, 20, out="wmstd_blocked"), "wmstd")
_on_blocks("ema_blocked", B.reach(0.94), lambda d, s: M.ema(d, s, 0.94, out="ema_blocked"), "ema")

# Indicators

_register(
    "bollinger_band", "ev", lambda d: I.bollinger_band(d, EV, 20, 2.0), ("bollinger_upper", "bollinger_lower"),
    f"SELECT *, avg(x) OVER w + 2 * stddev_pop(x) OVER w AS bollinger_upper, avg(x) OVER w - 2 * stddev_pop(x) OVER w AS bollinger_lower FROM ev WINDOW w AS {_sql_window('ev', 20)}",
)
_MAD = "list_avg(list_transform(l, lambda v: abs(v - list_avg(l))))"
_register("roll_mad", "ev", lambda d: X.roll_mad(d, EV, 20), sql=f"SELECT *, {_MAD} AS roll_mad FROM (SELECT *, list(x) OVER {_sql_window('ev', 20)} AS l FROM ev)")
_register(
    "cci", "ev", lambda d: I.cci(d.withColumn("h", F.col("x") + 1).withColumn("l", F.col("x") - 2), EV, "h", "l", 20),
    sql=f"SELECT *, (p - list_avg(l)) / coalesce(nullif({_MAD}, 0), 1) / 0.015 AS cci FROM (SELECT *, list(p) OVER {_sql_window('ev', 20)} AS l FROM (SELECT *, (x + (x + 1) + (x - 2)) / 3 AS p FROM ev))",
)
_register(
    "hma", "ev", lambda d: I.hma(d, EV, 21),
    sql=f"SELECT *, {_wma_sql('y', 'ev', 4)} AS hma FROM (SELECT *, 2 * {_wma_sql('x', 'ev', 10)} - {_wma_sql('x', 'ev', 21)} AS y FROM ev)",
)


def _span(w: int) -> float:
    return 1 - 2 / (1 + w)


_MACD = f"SELECT *, {_ema_sql('x', 'ev', _span(12))} - {_ema_sql('x', 'ev', _span(26))} AS macd_line FROM ev"
_SIGNAL = f"SELECT *, {_ema_sql('macd_line', 'ev', _span(9))} AS signal_line FROM ({_MACD})"
_register("macd_line", "ev", lambda d: I.macd_line(d, EV), sql=_MACD)
_register("signal_line", "ev", lambda d: I.signal_line(d, EV), sql=_SIGNAL)
_register("macd_hist", "ev", lambda d: I.macd_hist(d, EV), sql=f"SELECT *, macd_line - signal_line AS macd_hist FROM ({_SIGNAL})")
_UD = f"SELECT *, greatest(c, 0.0) AS u, greatest(-c, 0.0) AS d FROM (SELECT *, ln(x / lag(x) OVER ({_BY['px']})) AS c FROM px)"
_register(
    "rsi", "px", lambda d: I.rsi(d, PX, 14),
    sql=f"SELECT *, coalesce(CASE WHEN c IS NOT NULL THEN 100 * {_ema_sql('u', 'px', _span(14))} / ({_ema_sql('u', 'px', _span(14))} + {_ema_sql('d', 'px', _span(14))} + 1e-8) END, 0) AS rsi FROM (SELECT s, t, x, c, CASE WHEN c IS NOT NULL THEN u END AS u, CASE WHEN c IS NOT NULL THEN d END AS d FROM ({_UD}))",
)


def _iso_sql(source: str, x: str, out: str, target: float = 0.2, leverage: float = 1.0, period: int = 252) -> str:
    r2 = f"power(lag({x}) OVER ({_BY['px']}) / {x} - 1, 2)"
    vol = f"SELECT *, CASE WHEN v <= 0 THEN 1e-8 ELSE v END AS vol FROM (SELECT *, sqrt({period}.0::DOUBLE * {_ema_sql('r2', 'px', _span(11))}) AS v FROM (SELECT *, {r2} AS r2 FROM {source}))"
    return f"SELECT *, least(coalesce({target}::DOUBLE / lag(vol) OVER ({_BY['px']}), 1), {leverage}) AS {out} FROM ({vol})"


_register("iso_vol", "px", lambda d: I.iso_vol(d, PX), sql=_iso_sql("px", "x", "iso_vol"))

# Drawdowns and performance

_rolling("drawdown", "ev", lambda d: X.drawdown(d, EV, True), "max(x) OVER {u} - x", None)
_rolling("drawdown_pct", "px", lambda d: X.drawdown(d, PX, out="drawdown_pct"), "1 - x / max(x) OVER {u}", None)
_rolling("roll_drawdown", "px", lambda d: X.roll_drawdown(d, PX, 20), "1 - x / max(x) OVER {w}", 20)
_FOLD = "list_max(list_transform(l, lambda v, i: 1 - v / list_max(l[1:i])))"
_register("roll_mdd", "px", lambda d: X.roll_mdd(d, PX, 20), sql=f"SELECT *, {_FOLD} AS roll_mdd FROM (SELECT *, list(x) OVER {_sql_window('px', 20)} AS l FROM px)")
_register("roll_mdd_all", "px", lambda d: X.roll_mdd(d, PX, None, out="roll_mdd_all"), sql=f"SELECT *, max(d) OVER {_sql_window('px', None)} AS roll_mdd_all FROM (SELECT *, 1 - x / max(x) OVER {_sql_window('px', None)} AS d FROM px)")
_rolling("perf_index", "px", lambda d: X.perf_index(d, PX), "100 * x / first_value(x) OVER {u}", None)
_register(
    "perf_returns", "px", lambda d: X.perf_returns(X.returns(d, PX, True, out="r"), PX, "log", 100.0, "r"),
    sql=f"SELECT *, 100 * exp(sum(r) OVER {_sql_window('px', None)}) AS perf_returns FROM (SELECT *, coalesce(ln(x / lag(x) OVER ({_BY['px']})), 0) AS r FROM px)",
)
_SIG = f"sg AS (SELECT *, coalesce(lag(z) OVER ({_BY['px']}), 0.0)::DOUBLE AS sig FROM (SELECT *, sign(x - avg(x) OVER {_sql_window('px', 20)})::DOUBLE AS z FROM px))"


def with_signal(df: DataFrame) -> DataFrame:
    """sig: the sign of the distance from the 20-row average, a row late."""
    df = M.sma(df, PX, 20, out="_m").withColumn("_z", F.signum(F.col("x") - F.col("_m")))
    return df.withColumn("sig", F.coalesce(F.lag("_z").over(PX.by), F.lit(0.0))).drop("_m", "_z")


def _signal(name: str, make: Callable[[DataFrame], DataFrame], sql: str, outs: tuple[str, ...] = (), scalar: bool = False) -> None:
    """A query over the prices with a signal; sql selects from sg."""
    _register(name, "px", lambda d: make(with_signal(d)), outs, f"WITH {_SIG} {sql}", scalar)


_U = _sql_window("px", None)
_P100 = f"100 * x / first_value(x) OVER {_U}"
_signal(
    "returns_strat", lambda d: X.returns_strat(d, PX, "sig"),
    f"SELECT *, coalesce(x / lag(x) OVER ({_BY['px']}) - 1, 0) * sig AS returns_strat FROM sg",
)
_signal(
    "perf_strat", lambda d: X.perf_strat(d, PX, "sig"),
    f"SELECT *, 100 + sum(r) OVER {_U} AS perf_strat FROM (SELECT *, coalesce(p - lag(p) OVER ({_BY['px']}), 0) * sig AS r FROM (SELECT *, {_P100} AS p FROM sg))",
)
_LOGRET = f"(SELECT *, coalesce(ln(x / lag(x) OVER ({_BY['px']})), 0) AS r FROM sg)"
_FEES = f"SELECT *, 100 * product((exp(r) - 1 - 0.0001::DOUBLE * coalesce(sig - b, 0)) * sig + 1) OVER {_U} AS perf_fees FROM (SELECT *, lag(sig) OVER ({_BY['px']}) AS b FROM {_LOGRET})"
_signal("perf_fees", lambda d: X.perf_fees(X.returns(d, PX, True, out="r"), PX, "sig", 0.0001, "r", base=100.0), _FEES)
_signal(
    "perf_signal", lambda d: X.perf_signal(X.returns(d, PX, True, out="r"), PX, "sig", "r"),
    f"SELECT *, 100 * exp(sum(r * sig) OVER {_U}) AS perf_signal FROM {_LOGRET}",
)

_signal(
    "perf_signal_pct", lambda d: X.perf_signal(X.returns(d, PX, False, out="r"), PX, "sig", "r", log=False, out="perf_signal_pct"),
    f"SELECT *, 100 * product(1 + q * sig) OVER {_U} AS perf_signal_pct FROM (SELECT *, coalesce(x / lag(x) OVER ({_BY['px']}) - 1, 0) AS q FROM sg)",
)



def _on_split_series(name: str, like: str, make: Callable[[DataFrame], DataFrame], scalar: bool = False) -> None:
    """A query whose series are split into blocks that carry what came before, with the SQL of the one that isn't."""
    _register(name, "px", make, scalar=scalar)
    SQL[name] = SQL[like].replace(f"AS {like} ", f"AS {name} ").replace(f"round({like},", f"round({name},").replace(f"AS {like} FROM", f"AS {name} FROM")


_on_split_series("drawdown_pct_blocked", "drawdown_pct", lambda d: B.drawdown(d, PX, out="drawdown_pct_blocked", blocks=32))
_on_split_series("perf_index_blocked", "perf_index", lambda d: B.perf_index(d, PX, out="perf_index_blocked", blocks=32))
_on_split_series("perf_returns_blocked", "perf_returns", lambda d: B.perf_returns(X.returns(d, PX, True, out="r"), PX, "log", 100.0, "r", "perf_returns_blocked", 32))

# Scalar metrics

_ENDS = "min_by(x, t) AS x0, max_by(x, t) AS x1, count(*) AS n"
_R = f"(SELECT *, coalesce(ln(x / lag(x) OVER ({_BY['px']})), 0) AS lr, coalesce(x / lag(x) OVER ({_BY['px']}) - 1, 0) AS pr, 1 - x / max(x) OVER {_U} AS dd FROM px)"
_AGG = f"(SELECT s, {_ENDS}, stddev_pop(lr) AS lv, stddev_pop(pr) AS pv, max(dd) AS dd FROM {_R} GROUP BY s)"
_ANNUAL = "power(x1 / x0, 252.0 / n) - 1"
_register("annual_return", "px", lambda d: X.annual_return(d, PX), sql=f"SELECT s, {_ANNUAL} AS annual_return FROM {_AGG}", scalar=True)
_register("annual_volatility", "px", lambda d: X.annual_volatility(d, PX, ddof=1), sql=f"SELECT s, sqrt(252.0) * lv * sqrt(n / (n - 1.0)) AS annual_volatility FROM {_AGG}", scalar=True)
_register("sharpe", "px", lambda d: X.sharpe(d, PX), sql=f"SELECT s, ({_ANNUAL}) / (sqrt(252.0) * pv) AS sharpe FROM {_AGG}", scalar=True)
_register("calmar", "px", lambda d: X.calmar(d, PX), sql=f"SELECT s, ({_ANNUAL}) / dd AS calmar FROM {_AGG}", scalar=True)
_register("mdd", "px", lambda d: X.mdd(d, PX), sql=f"SELECT s, dd AS mdd FROM {_AGG}", scalar=True)
_on_split_series("mdd_blocked", "mdd", lambda d: B.mdd(d, PX, out="mdd_blocked", blocks=32), scalar=True)
_register("mad", "px", lambda d: X.mad(d, PX), sql="SELECT s, avg(abs(x - m)) AS mad FROM (SELECT *, avg(x) OVER (PARTITION BY s) AS m FROM px) GROUP BY s", scalar=True)
_Z = f"SELECT *, (x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS roll_z_score FROM px WINDOW w AS {_sql_window('px', 20)}"
_register("roll_z_score", "px", lambda d: X.roll_z_score(d, PX, 20), sql=_Z)
_register("z_score", "px", lambda d: X.z_score(d, PX, 20), sql=f"SELECT s, max_by(roll_z_score, t) AS z_score FROM ({_Z}) GROUP BY s", scalar=True)
_signal(
    "accuracy", lambda d: X.accuracy(X.returns(d, PX, True, out="r"), PX, "r", "sig"),
    f"SELECT s, avg((sign(r) = sign(sig))::INT) AS accuracy FROM {_LOGRET} GROUP BY s", scalar=True,
)

# Rolling metrics, of two rows a year: with 252, powers of these prices would take more digits than a double has

_W = _sql_window("px", 60)
_RR = f"SELECT *, CASE WHEN count(x) OVER w <= 1 THEN 0 ELSE power(x / first_value(x) OVER w, 2.0 / (count(x) OVER w - 1)) - 1 END AS roll_annual_return FROM px WINDOW w AS {_W}"
_register("roll_annual_return", "px", lambda d: X.roll_annual_return(d, PX, 2, 60, 1), sql=_RR)
_RV = f"SELECT *, sqrt(2.0) * coalesce(stddev_samp(pr) OVER w, 0) AS rv FROM {_R} WINDOW w AS {_W}"
_register("roll_annual_volatility", "px", lambda d: X.roll_annual_volatility(d, PX, 2, False, 60, 1), sql=f"SELECT *, rv AS roll_annual_volatility FROM ({_RV})")
_register(
    "roll_sharpe", "px", lambda d: X.roll_sharpe(d, PX, 0.0, 2, 60, False, 1),
    sql=f"SELECT a.s, a.t, CASE WHEN rv = 0 THEN 0 ELSE roll_annual_return / rv END AS roll_sharpe FROM ({_RR}) a JOIN ({_RV}) b USING (s, t)",
)
#: The free rate is a column here.
_register(
    "roll_sharpe_free", "px", lambda d: X.roll_sharpe(d.withColumn("f", F.length("s") / 1000), PX, "f", 2, 60, False, 1, out="roll_sharpe_free"),
    sql=f"SELECT a.s, a.t, CASE WHEN rv = 0 THEN 0 ELSE (roll_annual_return - length(a.s) / 1000.0::DOUBLE) / rv END AS roll_sharpe_free FROM ({_RR}) a JOIN ({_RV}) b USING (s, t)",
)
_MDD60 = f"SELECT *, {_FOLD} AS d FROM (SELECT *, list(x) OVER {_W} AS l FROM px)"
_register(
    "roll_calmar", "px", lambda d: X.roll_calmar(d, PX, 2, 60, 1),
    sql=f"SELECT a.s, a.t, CASE WHEN d = 0 THEN 0 ELSE roll_annual_return / d END AS roll_calmar FROM ({_RR}) a JOIN ({_MDD60}) b USING (s, t)",
)

# Scaling

_WH = "OVER (PARTITION BY s)"
_rolling("standardize", "px", lambda d: S.standardize(d, PX, 1.0, 2.0), f"2 * (x - avg(x) {_WH}) / stddev_pop(x) {_WH} + 1", None)
_rolling("normalize", "px", lambda d: S.normalize(d, PX), f"(x - min(x) {_WH}) / (max(x) {_WH} - min(x) {_WH})", None)
_rolling("roll_standardize", "px", lambda d: S.roll_standardize(d, PX, 20), "(x - avg(x) OVER {w}) / nullif(stddev_pop(x) OVER {w}, 0)", 20)
_rolling("roll_normalize", "px", lambda d: S.roll_normalize(d, PX, 20), "(x - min(x) OVER {w}) / nullif(max(x) OVER {w} - min(x) OVER {w}, 0)", 20)


def _scaled(d: DataFrame) -> DataFrame:
    model = S.Scale("roll_norm", 0.0, 1.0, 20).fit(d, PX)
    return model.revert(model.scale(d), "scaled")


_register("scale_revert", "px", _scaled, ("scaled", "reverted"), f"SELECT *, CASE WHEN lo = hi THEN x / (2 * hi) ELSE (x - lo) / (hi - lo) END AS scaled, x AS reverted FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM px WINDOW w AS {_sql_window('px', 20)})")

def _scale(name: str, kind: str, a: float, b: float, expr: str, w: int | None = None) -> None:
    """A query that scales with a fitted model."""

    def scaled(d: DataFrame) -> DataFrame:
        return S.Scale(kind, a, b, w).fit(d, PX).scale(d, None, name)

    _rolling(name, "px", scaled, expr, w)


_scale("scale_std", "std", 1.0, 2.0, f"2 * (x - avg(x) {_WH}) / stddev_pop(x) {_WH} + 1")
_scale("scale_norm", "norm", -1.0, 1.0, f"2 * (x - min(x) {_WH}) / (max(x) {_WH} - min(x) {_WH}) - 1")
_scale("scale_raw", "raw", 0.0, 1.0, "x")
_scale("scale_roll_std", "roll_std", 0.0, 1.0, "(x - avg(x) OVER {w}) / coalesce(nullif(stddev_pop(x) OVER {w}, 0), 1)", 20)
_register(
    "batches", "px", lambda d: K.batches(d, PX, 10, 200, 16, out="batch"), ("batch",),
    f"SELECT *, floor((rn - 10) / 16) AS batch FROM (SELECT *, row_number() OVER ({_BY['px']}) - 1 AS rn FROM px) WHERE rn >= 10 AND rn < 200",
)

# Econometric filters

_register("ma_filter", "px", lambda d: E.ma(d, PX, (0.3,), 100.0, out="ma_filter"), sql=f"SELECT *, list_reduce(list(x - 100) OVER {_U}, lambda a, v: v - 0.3::DOUBLE * a) AS ma_filter FROM px")
_U1 = f"SELECT *, list_reduce(list(x - 100 - 0.5::DOUBLE * b) OVER {_U}, lambda a, v: v - 0.3::DOUBLE * a) AS u FROM (SELECT *, coalesce(lag(x) OVER ({_BY['px']}), 0) AS b FROM px)"
_register("arma_filter", "px", lambda d: E.arma(d, PX, (0.5,), (0.3,), 100.0, out="arma_filter"), sql=f"SELECT *, u AS arma_filter FROM ({_U1})")
_GP = E.Parameters((0.5,), (0.3,), (0.1,), (0.2,), 100.0, 0.6)
_H1 = f"SELECT *, sqrt(list_reduce(list(0.6::DOUBLE + 0.1::DOUBLE * g) OVER {_U}, lambda a, v: v + 0.2::DOUBLE * a)) AS h FROM (SELECT *, coalesce(power(lag(u) OVER ({_BY['px']}), 2), 0) AS g FROM ({_U1}))"
_register("arma_garch", "px", lambda d: E.residuals(d, PX, _GP), ("u", "h"), _H1)
_XP = E.Parameters((0.5,), (0.3,), (0.1,), (0.2,), 100.0, 0.6, (0.25,))
_U2 = _U1.replace("x - 100", "x - 0.25::DOUBLE * length(s) - 100")
_register("armax_garch", "px", lambda d: E.residuals(d.withColumn("z", F.length("s").cast("double")), PX, _XP, ("z",)), ("u", "h"), _H1.replace(_U1, _U2))
_register(
    "loglikelihood", "px", lambda d: X.loglikelihood(E.residuals(d, PX, _GP), PX, "u", "h").withColumn("loglikelihood", F.col("loglikelihood") / 1e9),
    sql=f"SELECT s, sum(ln(h * h) + power(u / h, 2) + ln(2 * pi())) / 2 / 1e9 AS loglikelihood FROM ({_H1}) GROUP BY s", scalar=True,
)


def _fit(d: DataFrame) -> DataFrame:
    ret = X.returns(d, PX, True, out="r").withColumn("x", F.col("r"))
    return E.fit_series(ret, PX, (0.0, 0.1, 0.1), 1, 1, model="arma").select("s", F.get("phi", F.lit(0)).alias("phi"), F.get("theta", F.lit(0)).alias("theta"), "c", "nll")


_register("estimation", "px", _fit, ("phi", "theta", "c", "nll"), scalar=True)

# Allocation

_COV = "SELECT a.s AS a, b.s AS b, count(*) AS n, CASE WHEN count(*) > 1 THEN round(covar_samp(a.x, b.x), 0) + 0.0 END AS cov, CASE WHEN count(*) > 1 THEN round(corr(a.x, b.x), 6) + 0.0 END AS corr FROM px a JOIN px b ON a.t = b.t AND a.s <= b.s GROUP BY ALL"


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.covariance(prices(spark, sf_dir), PX)
    return c.select("a", "b", "n", F.when(F.col("n") > 1, F.round("cov", 0) + 0.0).alias("cov"), F.when(F.col("n") > 1, rounded("corr")).alias("corr"))


QUERIES["covariance"], SQL["covariance"] = covariance, f"WITH {_PX} {_COV}"


def diversified_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.diversified_ratio(prices(spark, sf_dir), PX).select(rounded("ratio").alias("ratio"))


QUERIES["diversified_ratio"] = diversified_ratio
SQL["diversified_ratio"] = f"""WITH {_PX}, n AS (SELECT count(DISTINCT s) AS n FROM px),
f AS (SELECT px.* FROM px JOIN (SELECT t FROM px GROUP BY t HAVING count(*) = (SELECT n FROM n)) USING (t))
SELECT round((SELECT avg(d) FROM (SELECT stddev_pop(x) AS d FROM f GROUP BY s)) / (SELECT stddev_pop(p) FROM (SELECT avg(x) AS p FROM f GROUP BY t)), 6) + 0.0 AS ratio"""


def diversified_ratio_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = prices(spark, sf_dir)
    return X.diversified_ratio(px, PX, A.ivp_sql(px, PX)).select(rounded("ratio").alias("ratio"))


QUERIES["diversified_ratio_weighted"] = diversified_ratio_weighted
SQL["diversified_ratio_weighted"] = f"""WITH {_PX}, n AS (SELECT count(DISTINCT s) AS n FROM px),
w AS (SELECT s, v / sum(v) OVER () AS w FROM (SELECT s, 1 / var_samp(x) AS v FROM px GROUP BY s)),
f AS (SELECT px.*, w FROM px JOIN w USING (s) JOIN (SELECT t FROM px GROUP BY t HAVING count(*) = (SELECT n FROM n)) USING (t))
SELECT round((SELECT sum(d) FROM (SELECT any_value(w) * stddev_pop(x) AS d FROM f GROUP BY s)) / (SELECT stddev_pop(p) FROM (SELECT sum(w * x) AS p FROM f GROUP BY t)), 6) + 0.0 AS ratio"""


def ivp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ivp_sql(prices(spark, sf_dir), PX).select("s", rounded("weight").alias("weight"))


QUERIES["ivp"] = ivp
SQL["ivp"] = f"WITH {_PX} SELECT s, round(v / sum(v) OVER (), 6) + 0.0 AS weight FROM (SELECT s, 1 / var_samp(x) AS v FROM px GROUP BY s)"


def _allocation(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.weights(prices(spark, sf_dir), PX, method).select("s", F.round("weight", 6).alias("weight"))

    return query


QUERIES |= {m.lower(): _allocation(m) for m in ("ERC", "HRP", "MDP", "MVP", "MVP_uc")}
#: The weights of least variance solve covariance times weights = 1, here by elimination; gaps hold the last price.
SQL["mvp"] = f"""WITH RECURSIVE {_PX}, grid AS (SELECT s, t, x FROM (SELECT DISTINCT s FROM px) CROSS JOIN (SELECT DISTINCT t FROM px) LEFT JOIN px USING (s, t)),
held AS (SELECT s, t, last_value(x IGNORE NULLS) OVER (PARTITION BY s ORDER BY t) AS x FROM grid),
f AS (SELECT * FROM held WHERE t IN (SELECT t FROM held GROUP BY t HAVING count(x) = count(*))),
c AS (SELECT a.s AS a, b.s AS b, covar_samp(a.x, b.x) / 1e8 AS v FROM f a JOIN f b USING (t) GROUP BY ALL),
m AS (SELECT list(l ORDER BY a) AS m, count(*) AS n FROM (SELECT a, list_append(list(v ORDER BY b), 1.0) AS l FROM c GROUP BY a)),
g AS (SELECT 1 AS k, m, n FROM m UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END), n FROM g WHERE k <= n),
y AS (SELECT unnest(m)[-1] AS w, generate_subscripts(m, 1) AS i FROM g WHERE k = n + 1),
names AS (SELECT a AS s, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM c))
SELECT s, round(w / sum(w) OVER (), 6) AS weight FROM y JOIN names USING (i)"""


def rolling_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    portfolio, _ = A.rolling_allocation(prices(spark, sf_dir), PX, "ERC", 252, 63)
    return portfolio.select(day("t"), rounded("portfolio").alias("portfolio"))


def rolling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rolling_allocation(prices(spark, sf_dir), PX, "HRP", 252, 63)[1].select("win", day("t"), "s", rounded("weight").alias("weight"))


# Models and reports


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.returns(prices(spark, sf_dir), PX, True, out="r")
    for w in (6, 20, 60):
        d = X.roll_z_score(d, PX, w, out=f"z{w}")
    return d.withColumn("y", F.lead("r").over(PX.by))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    factory = K.perceptron((8,), activation="tanh", lr=0.01)
    return K.walk_forward(_features(spark, sf_dir), PX, ("z6", "z20", "z60"), factory, 252, 63, models=("a", "b", "c"), target="y")


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.performance(_predictions(spark, sf_dir), PX).select("s", day("t"), "model", "win", rounded("pred").alias("pred"), rounded("perf").alias("perf"))


def ensemble_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ensemble(_predictions(spark, sf_dir), PX, "bests", 2).select("s", day("t"), rounded("pred").alias("pred"))


def walk_forward_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrent networks of each kind, trained through time."""
    parts = [K.walk_forward(_features(spark, sf_dir), PX, ("z6", "z20", "z60"), K.recurrent(k, 4), 126, 63, models=(k,), target="y") for k in ("rnn", "gru", "lstm")]
    return K.performance(parts[0].union(parts[1]).union(parts[2]), PX).select("s", day("t"), "model", "win", rounded("pred").alias("pred"), rounded("perf").alias("perf"))


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline: a linear regression on each window of 63 rows, tested on the next 63."""
    rows = K.walk_forward(_features(spark, sf_dir), PX, ("z6", "z20"), K.least_squares(), 63, 63, target="y")
    return rows.where("part = 'test'").select("s", day("t"), "win", rounded("pred").alias("pred"))


def walk_forward_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.losses(_predictions(spark, sf_dir), PX)


_CURVES = ("perf_idx", "perf_est", "perf_iso", "drawdown_idx", "drawdown_est", "drawdown_iso", "sharpe_idx", "sharpe_est", "sharpe_iso")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices smoothed over 61 rows, fewer at the start: their daily jumps are so wide that a short position would be
    ruined in a day. The factor keeps means of rounded values from falling halfway between two others."""
    return M.sma(prices(spark, sf_dir), PX, 61, F.col("x") * 0.7310585, "m").select("s", "t", F.round("m", 4).alias("x"))


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of the underlying, the strategy and the volatility-scaled strategy: the flagship."""
    d = R.backtest(with_signal(index(spark, sf_dir)), PX, "sig", 2, 0.0001)
    return d.select("s", day("t"), *[(F.round(c, 4) + 0.0).alias(c) for c in _CURVES])


def key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.figures(with_signal(index(spark, sf_dir)), PX, {"strategy": "sig"}, fee=0.0001).select("s", "strategy", "metric", rounded("value").alias("value"))


QUERIES |= {f.__name__: f for f in (rolling_allocation, rolling_weights, walk_forward, walk_forward_losses, walk_forward_recurrent, least_squares, ensemble_best, backtest, key_figures)}

_INDEX = f"{_PX.replace('px AS', 'raw AS', 1)}, px AS (SELECT s, t, round(avg(x * 0.7310585::DOUBLE) OVER {_sql_window('px', 61)}, 4) AS x FROM raw)"
_BT = f"""WITH {_INDEX}, {_SIG},
a AS (SELECT *, lag(sig) OVER ({_BY['px']}) AS b FROM {_LOGRET}),
p AS (SELECT *, 100 * exp(sum(r) OVER {_U}) AS perf_idx, 100 * product((exp(r) - 1 - 0.0001::DOUBLE * coalesce(sig - b, 0)) * sig + 1) OVER {_U} AS perf_est FROM a),
i AS ({_iso_sql('p', 'perf_idx', 'iso', period=2)}),
j AS (SELECT *, iso * sig AS g, lag(iso * sig) OVER ({_BY['px']}) AS gb FROM i),
q AS (SELECT *, 100 * product((exp(r) - 1 - 0.0001::DOUBLE * coalesce(g - gb, 0)) * g + 1) OVER {_U} AS perf_iso FROM j)"""


def _curve_sql(p: str) -> str:
    w = _sql_window("px", 252)
    ret = f"power({p} / first_value({p}) OVER {w}, 2.0 / count({p}) OVER {w}) - 1"
    return f"round(1 - {p} / max({p}) OVER {_U}, 4) + 0.0 AS drawdown_{p[5:]}, round(CASE WHEN coalesce(v_{p[5:]}, 0) = 0 THEN 0 ELSE ({ret}) / v_{p[5:]} END, 4) + 0.0 AS sharpe_{p[5:]}"


_VOLS = ", ".join(f"sqrt(2.0) * stddev_pop(l_{k}) OVER {_sql_window('px', 252)} AS v_{k}" for k in ("idx", "est", "iso"))
_LOGS = ", ".join(f"coalesce(ln(perf_{k} / lag(perf_{k}) OVER ({_BY['px']})), 0) AS l_{k}" for k in ("idx", "est", "iso"))
SQL["backtest"] = f"{_BT}, l AS (SELECT *, {_LOGS} FROM q), v AS (SELECT *, {_VOLS} FROM l) SELECT s, {_DAY}, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _CURVES[:3])}, {', '.join(_curve_sql(c) for c in _CURVES[:3])} FROM v"

_KEY = "PARTITION BY s, strategy ORDER BY t"
_FIGURES = ("accuracy", "perf", "vol", "sharpe", "calmar")
SQL["key_figures"] = f"""WITH {_INDEX}, {_SIG}, a AS (SELECT *, lag(sig) OVER ({_BY['px']}) AS b FROM {_LOGRET}),
u AS (SELECT s, t, r, 'underlying' AS strategy, 1.0::DOUBLE AS g, 100 * product(exp(r)) OVER {_U} AS p FROM a
  UNION ALL SELECT s, t, r, 'strategy', sig, 100 * product((exp(r) - 1 - 0.0001::DOUBLE * coalesce(sig - b, 0)) * sig + 1) OVER {_U} FROM a),
w AS (SELECT *, p / lag(p) OVER ({_KEY}) - 1 AS c, 1 - p / max(p) OVER ({_KEY} ROWS UNBOUNDED PRECEDING) AS d FROM u),
f AS (SELECT s, strategy, avg((sign(r) = sign(g))::INT) AS accuracy, power(max_by(p, t) / min_by(p, t), 252.0::DOUBLE / count(*)) - 1 AS perf, sqrt(252.0::DOUBLE) * stddev_pop(c) AS vol, max(d) AS m FROM w GROUP BY ALL),
z AS (SELECT *, CASE WHEN vol = 0 THEN 0 ELSE perf / vol END AS sharpe, CASE WHEN m = 0 THEN 0 ELSE perf / m END AS calmar FROM f)
{' UNION ALL '.join(f"SELECT s, strategy, '{k}' AS metric, round({k}, 6) + 0.0 AS value FROM z" for k in _FIGURES)}"""
#: A regression on two features with a constant, by its normal equations over centred values.
_LS = f"(SELECT s, t, lead(r) OVER ({_BY['px']}) AS y, (x - avg(x) OVER w6) / coalesce(nullif(stddev_pop(x) OVER w6, 0), 1) AS p, (x - avg(x) OVER w20) / coalesce(nullif(stddev_pop(x) OVER w20, 0), 1) AS q FROM (SELECT *, coalesce(ln(x / lag(x) OVER ({_BY['px']})), 0) AS r FROM px) WINDOW w6 AS {_sql_window('px', 6)}, w20 AS {_sql_window('px', 20)})"
SQL["least_squares"] = f"""WITH {_PX}, l AS (SELECT * FROM {_LS} WHERE y IS NOT NULL), o AS (SELECT *, row_number() OVER ({_BY['px']}) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM l),
k AS (SELECT s, i // 63 AS win, avg(p) AS mp, avg(q) AS mq, avg(y) AS my, covar_pop(p, p) AS pp, covar_pop(p, q) AS pq, covar_pop(q, q) AS qq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy FROM o GROUP BY ALL)
SELECT s, {_DAY}, CAST(win AS INTEGER) AS win, round(my + (p - mp) * (py * qq - qy * pq) / (pp * qq - pq * pq) + (q - mq) * (qy * pp - py * pq) / (pp * qq - pq * pq), 6) + 0.0 AS pred
FROM o JOIN k USING (s) WHERE i // 63 = win + 1 AND (win + 2) * 63 <= n"""
