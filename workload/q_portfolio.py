"""Returns of holdings, overlays, leverage, performance, trades, costs and tax (H6-H13, G*, T1-T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import holdings, leverage, perf, resample, returns, tax, trades
from barloom.operators.ranking import RankParams
from barloom.plans import backtest
from barloom.session import materialise
from workload import panels as p
from workload.panels import CTES, define, rnd, with_ctes
from workload.q_momentum import N, _regime_test, _test
from workload.registry import query

_LABEL = "CAST(last_day(make_date({0} // 12, {0} % 12 + 1, 1)) AS DATE)"

# -- period returns ---------------------------------------------------------------------------


@query("equal_weight_returns", with_ctes(f"SELECT period_end, {rnd('ret')} AS ret FROM base_ret_d", "base_ret_d"))
def equal_weight_returns(spark, sf):
    """H6, H8: mean return of the names held; zero before the first holding."""
    _, t = _test(spark, sf)
    return p.rounded(t.returns.select("period_end", "ret"))


define(
    "drift_v",
    f"""SELECT s.rebalance_no, s.period_no, sum(coalesce(b.price / a.price, 0)) / {N} AS v FROM spell3 s JOIN held3 h USING (rebalance_no)
       JOIN panel a ON a.symbol = h.symbol AND a.period_no = s.reb LEFT JOIN panel b ON b.symbol = h.symbol AND b.period_no = s.period_no GROUP BY 1, 2""",
    "spell3",
    "held3",
    "panel",
)


@query(
    "drift_weight_returns",
    with_ctes(
        f"""SELECT s.period_no, {rnd('coalesce(r.r, 0)')} AS ret FROM span s LEFT JOIN (SELECT period_no,
        v / coalesce(lag(v) OVER (PARTITION BY rebalance_no ORDER BY period_no), 1) - 1 AS r FROM drift_v) r USING (period_no)""",
        "span",
        "drift_v",
    ),
)
def drift_weight_returns(spark, sf):
    """H7: share counts fixed between rebalances."""
    _, t = _test(spark, sf, hold=3, weighting="drift")
    return p.rounded(t.returns.select("period_no", "ret"))


@query(
    "regime_returns",
    with_ctes(
        f""", sp AS (SELECT rebalance_no, regime, period_no AS reb, CAST(unnest(range(period_no + 1, coalesce(lead(period_no) OVER (ORDER BY period_no),
            (SELECT max(period_no) FROM panel)) + 1)) AS INTEGER) AS period_no FROM rsched),
        eq AS (SELECT s.period_no, avg(x.r) AS r FROM sp s JOIN ranking h ON h.period_no = s.reb AND h.rank <= {N}
               JOIN ret x ON x.symbol = h.symbol AND x.period_no = s.period_no WHERE s.regime = 'equity' GROUP BY 1),
        gd AS (SELECT s.period_no, g.ret AS r FROM sp s JOIN sret g ON g.series_id = '1-URGENT' AND g.period_no = s.period_no WHERE s.regime = 'gold')
        SELECT s.period_no, {rnd('coalesce(e.r, g.r, 0)')} AS ret FROM span s LEFT JOIN eq e USING (period_no) LEFT JOIN gd g USING (period_no)""",
        "rsched",
        "ranking",
        "ret",
        "sret",
    ).replace(")\n,", "),", 1),
)
def regime_returns(spark, sf):
    """gold's return while in the gold regime."""
    _, t = _regime_test(spark, sf)
    return p.rounded(t.returns.select("period_no", "ret"))


# -- overlays ---------------------------------------------------------------------------------

define("mbars", "SELECT *, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS period_no FROM bars", "bars")
define(
    "stop_path",
    f"""SELECT rebalance_no, symbol, unnest(s.out) AS e FROM (SELECT rebalance_no, symbol, list_reduce(l, lambda s, x: CASE
          WHEN s.armed AND x.o > 0 THEN {{'paid': x.o, 'prev': x.c, 'inside': true, 'armed': false, 'used': s.used, 'base': s.base, 'out': list_append(s.out, {{'ts': x.ts, 'no': x.no, 'r': x.c / x.o - 1}})}}
          WHEN s.inside THEN {{'paid': s.paid, 'prev': x.c, 'inside': NOT (x.c <= s.paid * 0.9e0), 'armed': false, 'used': s.used, 'base': s.base, 'out': list_append(s.out, {{'ts': x.ts, 'no': x.no, 'r': x.c / s.prev - 1}})}}
          WHEN s.used < 2 AND x.c > s.base THEN {{'paid': s.paid, 'prev': x.c, 'inside': false, 'armed': true, 'used': s.used + 1, 'base': s.base, 'out': s.out}}
          ELSE {{'paid': s.paid, 'prev': x.c, 'inside': false, 'armed': false, 'used': s.used, 'base': s.base, 'out': s.out}} END,
          {{'paid': price, 'prev': price, 'inside': true, 'armed': false, 'used': 0, 'base': price, 'out': []::STRUCT(ts DATE, no INTEGER, r DOUBLE)[]}}) AS s
        FROM (SELECT s.rebalance_no, h.symbol, any_value(q.price) AS price, list({{'ts': b.ts, 'no': b.period_no, 'o': b.open, 'c': b.close}} ORDER BY b.ts) AS l
              FROM spell s JOIN held h USING (rebalance_no) JOIN panel q ON q.symbol = h.symbol AND q.period_no = s.reb
              JOIN mbars b ON b.symbol = h.symbol AND b.period_no = s.period_no GROUP BY 1, 2))""",
    "spell",
    "held",
    "panel",
    "mbars",
)
define(
    "stop_ret",
    f"""SELECT period_no, coalesce(product(1 + r) - 1, 0) AS ret FROM (SELECT DISTINCT period_no FROM spell) LEFT JOIN
       (SELECT e.no AS period_no, e.ts, sum(e.r) / {N} AS r FROM stop_path GROUP BY 1, 2) USING (period_no) GROUP BY 1""",
    "spell",
    "stop_path",
)


@query("stoploss_overlay", with_ctes(f"SELECT period_no, {rnd('ret')} AS ret FROM stop_ret", "stop_ret"))
def stoploss_overlay(spark, sf):
    """H9: per-slot stops with re-entry on daily bars."""
    panel, t = _test(spark, sf)
    out = returns.stoploss_overlay(panel, p.daily_bars(spark, sf), t.holdings, t.schedule, 10.0, 2)
    return p.rounded(out.select("period_no", "ret"))


define(
    "moves",
    """SELECT h.rebalance_no, h.symbol, 'entry' AS action FROM held h WHERE NOT EXISTS (SELECT 1 FROM held g WHERE g.symbol = h.symbol AND g.rebalance_no = h.rebalance_no - 1)
       UNION ALL SELECT h.rebalance_no + 1, h.symbol, 'exit' FROM held h WHERE h.rebalance_no < (SELECT max(rebalance_no) FROM sched)
         AND NOT EXISTS (SELECT 1 FROM held g WHERE g.symbol = h.symbol AND g.rebalance_no = h.rebalance_no + 1)""",
    "held",
    "sched",
)
define(
    "lag_ret",
    f"""SELECT t.period_no, coalesce(product(1 + d.r) - 1, 0) AS ret FROM
       (SELECT * FROM spell WHERE rebalance_no IN (SELECT rebalance_no FROM moves)) t LEFT JOIN (
       SELECT rebalance_no, period_no, ts, sum(r) / {N} AS r FROM (
         SELECT x.*, CASE WHEN kind = 'dropped' THEN CASE WHEN ts = d0 AND open > 0 THEN open / price - 1 END
              WHEN kind = 'added' THEN CASE WHEN ts = d0 THEN close / open - 1 WHEN has0 THEN close / prev - 1 END
              ELSE close / coalesce(prev, price) - 1 END AS r FROM (
           SELECT s.rebalance_no, s.reb, s.period_no, k.symbol, k.kind, b.ts, b.open, b.close, q.price, d0,
             lag(b.close) OVER w AS prev, first_value(b.ts) OVER w = d0 AS has0
           FROM (SELECT *, (SELECT min(m.ts) FROM mbars m WHERE m.period_no = spell.reb + 1) AS d0 FROM spell) s
           JOIN (SELECT h.rebalance_no, h.symbol, CASE WHEN m.symbol IS NULL THEN 'kept' ELSE 'added' END AS kind FROM held h
                   LEFT JOIN moves m ON m.rebalance_no = h.rebalance_no AND m.symbol = h.symbol AND m.action = 'entry'
                 UNION ALL SELECT rebalance_no, symbol, 'dropped' FROM moves WHERE action = 'exit') k USING (rebalance_no)
           JOIN mbars b ON b.symbol = k.symbol AND b.period_no = s.period_no
           LEFT JOIN panel q ON q.symbol = k.symbol AND q.period_no = s.reb
           WINDOW w AS (PARTITION BY s.rebalance_no, k.symbol, k.kind ORDER BY b.ts)) x) GROUP BY 1, 2, 3) d
       ON d.rebalance_no = t.rebalance_no AND d.period_no = t.period_no GROUP BY 1""",
    "spell",
    "moves",
    "held",
    "mbars",
    "panel",
)


@query("execution_lag_overlay", with_ctes(f"SELECT period_no, {rnd('ret')} AS ret FROM lag_ret", "lag_ret"))
def execution_lag_overlay(spark, sf):
    """Trades at the next day's open."""
    panel, t = _test(spark, sf)
    out = returns.execution_lag_overlay(panel, p.daily_bars(spark, sf), t.holdings, t.schedule)
    return p.rounded(out.select("period_no", "ret"))


@query(
    "merged_overlays",
    with_ctes(
        f"SELECT b.period_no, {rnd('coalesce(l.ret, s.ret, b.ret)')} AS ret FROM base_ret b LEFT JOIN stop_ret s USING (period_no) LEFT JOIN lag_ret l USING (period_no)",
        "base_ret",
        "stop_ret",
        "lag_ret",
    ),
)
def merged_overlays(spark, sf):
    """Both overlays, next-open execution wins."""
    panel, t = _test(spark, sf)
    out = backtest.with_overlays(t, panel, p.daily_bars(spark, sf), 10.0, 2, next_open=True)
    return p.rounded(out.select("period_no", "ret"))


# -- leverage ---------------------------------------------------------------------------------

_LEV = dict(trigger1_pct=5.0, leg1_pct=50.0, trigger2_pct=3.0, leg2_pct=40.0, hold=4)
define("srows", "SELECT series_id, period_no, ts, ret, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n FROM sret WHERE ret IS NOT NULL", "sret")
_DUE = "list_filter(s.cyc, lambda j: x.i <= j + 2)"
_HIT2 = f"(len({_DUE}) > 0 AND x.r <= -0.03e0)"
_BUSY = "len(list_filter(s.out, lambda t: t.leg = {0} AND t.b <= x.i + 1 AND t.e >= x.i + 1)) > 0"
_FIRE2 = f"({_HIT2} AND x.i + 1 <= x.n - 1 AND NOT ({_BUSY.format(2)}))"
_FIRE1 = f"(x.r <= -0.05e0 AND x.i + 1 <= x.n - 1 AND NOT ({_BUSY.format(1)}))"
_LEFT = f"(CASE WHEN {_HIT2} THEN []::INTEGER[] ELSE {_DUE} END)"
_EMPTY = "[]::STRUCT(leg INTEGER, i INTEGER, r DOUBLE, b INTEGER, e INTEGER)[]"
_EVENT = "[{{'leg': {0}, 'i': x.i, 'r': x.r, 'b': x.i + 1, 'e': least(x.i + 4, x.n - 1)}}]"
define(
    "tranches",
    f"""SELECT series_id, t.leg AS leg, t.i AS i, t.r AS r, t.b AS b, t.e AS e FROM (SELECT series_id, unnest(s.out) AS t FROM (
       SELECT series_id, list_reduce(list({{'i': i, 'n': n, 'r': ret}} ORDER BY i), lambda s, x: {{
          'cyc': CASE WHEN {_FIRE1} THEN list_append({_LEFT}, x.i) ELSE {_LEFT} END,
          'out': list_concat(list_concat(s.out, CASE WHEN {_FIRE2} THEN {_EVENT.format(2)} ELSE {_EMPTY} END),
                 CASE WHEN {_FIRE1} THEN {_EVENT.format(1)} ELSE {_EMPTY} END)}},
          {{'cyc': []::INTEGER[], 'out': {_EMPTY}}}) AS s FROM srows GROUP BY 1))""",
    "srows",
)


def _series_returns(spark, sf):
    s = resample.period_returns(p.series(spark, sf), "series_id", price="value")
    return s.where("ret IS NOT NULL")


@query(
    "leverage_tranches",
    with_ctes(f"SELECT series_id, leg, i AS trigger_no, {rnd('r')} AS period_return, b AS start_no, e AS end_no FROM tranches", "tranches"),
)
def leverage_tranches(spark, sf):
    """Drawdown-triggered tranches."""
    out = leverage.leverage_tranches(_series_returns(spark, sf), by="series_id", **_LEV)
    return p.rounded(out.drop("leg_pct"))


define(
    "lev",
    """SELECT s.series_id, s.ts, s.i, s.ret, coalesce(sum(CASE t.leg WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.4e0 END), 0e0) AS lev FROM srows s
       LEFT JOIN tranches t ON t.series_id = s.series_id AND s.i BETWEEN t.b AND t.e GROUP BY 1, 2, 3, 4""",
    "srows",
    "tranches",
)
define(
    "lev_path",
    """SELECT *, CASE WHEN eq > 0 THEN raw ELSE 0 END AS lr, eq * lev * (0.1e0 / 12) AS interest FROM (
       SELECT *, coalesce(product(1 + raw) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS eq FROM (
       SELECT *, ret * (1 + lev) - lev * (0.1e0 / 12) AS raw FROM lev))""",
    "lev",
)


@query(
    "leverage_overlay",
    with_ctes(f"SELECT series_id, ts, {rnd('lev')} AS lev_frac, {rnd('lr')} AS leveraged_return, {rnd('interest')} AS interest FROM lev_path", "lev_path"),
)
def leverage_overlay(spark, sf):
    """Levered returns."""
    rets = _series_returns(spark, sf)
    out = leverage.leverage_overlay(rets, leverage.leverage_tranches(rets, by="series_id", **_LEV), by="series_id")
    return p.rounded(out.select("series_id", "ts", "lev_frac", "leveraged_return", "interest"))


@query(
    "leverage_summary",
    with_ctes(
        f"SELECT series_id, {rnd('sum(interest) * 1000000', 2)} AS total_interest, (SELECT count(*) FROM tranches t WHERE t.series_id = l.series_id) AS n_tranches FROM lev_path l GROUP BY 1",
        "lev_path",
        "tranches",
    ),
)
def leverage_summary(spark, sf):
    """Interest and tranche count."""
    rets = materialise(_series_returns(spark, sf))
    t = materialise(leverage.leverage_tranches(rets, by="series_id", **_LEV))
    return p.rounded(leverage.leverage_summary(leverage.leverage_overlay(rets, t, by="series_id"), t, by="series_id"), 2)


define(
    "upto",
    """SELECT r.*, coalesce((SELECT min(j.i) FROM path j WHERE j.series_id = r.series_id AND j.i > r.i AND j.nav >= r.high * 1.02e0), n - 1) AS e FROM path r""",
    "path",
)
define(
    "path",
    """SELECT *, max(nav) OVER (PARTITION BY series_id ORDER BY i) AS high FROM (SELECT *, product(1 + ret) OVER (PARTITION BY series_id ORDER BY i) AS nav FROM srows)""",
    "srows",
)
define(
    "tranches_up",
    CTES["tranches"].replace("{'i': i, 'n': n, 'r': ret}", "{'i': i, 'n': n, 'r': ret, 'e': CAST(e AS INTEGER)}").replace("least(x.i + 4, x.n - 1)", "x.e").replace("FROM srows GROUP", "FROM upto GROUP"),
    "upto",
)


@query(
    "leverage_ath_recovery",
    with_ctes(f"SELECT series_id, leg, i AS trigger_no, {rnd('r')} AS period_return, b AS start_no, e AS end_no, CASE leg WHEN 1 THEN 50e0 ELSE 40e0 END AS leg_pct FROM tranches_up", "tranches_up"),
)
def leverage_ath_recovery(spark, sf):
    """H12 with tranches held until recovery."""
    rets = _series_returns(spark, sf)
    out = leverage.leverage_tranches(rets, 5.0, 50.0, 3.0, 40.0, "ath_recovery", recovery_pct=2.0, by="series_id")
    return p.rounded(out)


# -- performance ------------------------------------------------------------------------------

define(
    "path",
    """SELECT *, cum / max(cum) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS dd FROM (
       SELECT *, product(1 + ret) OVER (PARTITION BY series_id ORDER BY ts) AS cum FROM sret WHERE ret IS NOT NULL)""",
    "sret",
)


@query("drawdown", with_ctes(f"SELECT series_id, ts, {rnd('cum')} AS cum, {rnd('dd')} AS drawdown FROM path", "path"))
def drawdown(spark, sf):
    """Growth, running high and drawdown."""
    out = perf.equity_path(_series_returns(spark, sf), "series_id", ts="ts")
    return p.rounded(out.select("series_id", "ts", "cum", "drawdown"))


def _perf_sql(key, src, dd):
    return f"""SELECT {key}, count(*) AS n_periods, {rnd('pow(product(1 + ret), 12e0 / count(*)) - 1')} AS cagr,
      {rnd('stddev_samp(ret) * sqrt(12e0)')} AS volatility, {rnd('avg(ret) * 12 / (stddev_samp(ret) * sqrt(12e0))')} AS sharpe,
      {rnd(f'min({dd})')} AS max_drawdown, {rnd('product(1 + ret) - 1', 4)} AS total_return FROM {src} GROUP BY 1"""


@query("perf_stats", with_ctes(_perf_sql("series_id", "path", "dd"), "path"))
def perf_stats(spark, sf):
    """G1: performance row per series."""
    out = perf.perf_stats(_series_returns(spark, sf), "series_id", ts="ts")
    return p.rounded(p.rounded(out, 6, "total_return"), 4, "cagr", "volatility", "sharpe", "max_drawdown")


@query("annual_returns", with_ctes(f"SELECT series_id, year(ts) AS year, {rnd('product(1 + ret) - 1')} AS annual_return FROM path GROUP BY 1, 2", "path"))
def annual_returns(spark, sf):
    """Return per calendar year."""
    return p.rounded(perf.annual_returns(_series_returns(spark, sf), "series_id", ts="ts"))


@query("annual_max_drawdown", with_ctes(f"SELECT series_id, year(ts) AS year, {rnd('min(dd)')} AS max_drawdown FROM path GROUP BY 1, 2", "path"))
def annual_max_drawdown(spark, sf):
    """Worst drawdown of each year, high since inception."""
    return p.rounded(perf.annual_max_drawdown(_series_returns(spark, sf), "series_id", ts="ts"))


define("spath", "SELECT *, cum / max(cum) OVER (ORDER BY period_no) - 1 AS dd FROM (SELECT *, product(1 + ret) OVER (ORDER BY period_no) AS cum FROM base_ret_d)", "base_ret_d")
define("bpath", "SELECT *, cum / max(cum) OVER (ORDER BY period_no) - 1 AS dd FROM (SELECT *, product(1 + ret) OVER (ORDER BY period_no) AS cum FROM bret WHERE ret IS NOT NULL)", "bret")


def _bench_returns(spark, sf):
    b = p.benchmark(spark, sf).withColumn("_one", F.lit(1))
    return resample.period_returns(b, "_one", price="value").where("ret IS NOT NULL").select("period_end", "ret")


@query(
    "yearly_table",
    with_ctes(
        f"""SELECT year, {rnd('s.r')} AS strategy_return, {rnd('s.d')} AS strategy_max_drawdown, {rnd('b.r')} AS benchmark_return, {rnd('b.d')} AS benchmark_max_drawdown
        FROM (SELECT year(period_end) AS year, product(1 + ret) - 1 AS r, min(dd) AS d FROM spath GROUP BY 1) s
        FULL JOIN (SELECT year(period_end) AS year, product(1 + ret) - 1 AS r, min(dd) AS d FROM bpath GROUP BY 1) b USING (year)""",
        "spath",
        "bpath",
    ),
)
def yearly_table(spark, sf):
    """Strategy and benchmark by year."""
    _, t = _test(spark, sf)
    out = perf.yearly_table(t.returns.select("strategy_id", "period_end", "ret"), _bench_returns(spark, sf))
    return p.rounded(out.drop("strategy_id"))


@query(
    "benchmark_alignment",
    with_ctes(
        f"SELECT a.period_end, {rnd('a.ret')} AS ret, {rnd('b.ret')} AS benchmark_return FROM base_ret_d a JOIN bret b USING (period_end) WHERE b.ret IS NOT NULL",
        "base_ret_d",
        "bret",
    ),
)
def benchmark_alignment(spark, sf):
    """Periods both series have."""
    _, t = _test(spark, sf)
    out = perf.align_benchmark(t.returns, _bench_returns(spark, sf))
    return p.rounded(out.select("period_end", "ret", "benchmark_return"))


def _flagship_sql(n):
    held = f"SELECT s.period_no, r.symbol FROM ranking r JOIN (SELECT period_no FROM counts WHERE cnt >= {n}) s USING (period_no) WHERE r.rank <= {n}"
    # with a holding time of one period every period with enough names is a rebalance
    return with_ctes(
        f""", h AS ({held}), sp AS (SELECT period_no AS reb, CAST(unnest(range(period_no + 1, coalesce(lead(period_no) OVER (ORDER BY period_no), (SELECT max(period_no) FROM panel)) + 1)) AS INTEGER) AS period_no
          FROM (SELECT DISTINCT period_no FROM h)),
        r0 AS (SELECT s.period_no, coalesce(avg(x.r), 0) AS ret FROM span s LEFT JOIN sp USING (period_no) LEFT JOIN h ON h.period_no = sp.reb
          LEFT JOIN ret x ON x.symbol = h.symbol AND x.period_no = s.period_no GROUP BY 1),
        r1 AS (SELECT 'default' AS strategy_id, *, cum / max(cum) OVER (ORDER BY period_no) - 1 AS dd FROM (SELECT *, product(1 + ret) OVER (ORDER BY period_no) AS cum FROM r0))
        {_perf_sql('strategy_id', 'r1', 'dd')}""",
        "ranking",
        "counts",
        "span",
        "ret",
        "panel",
    ).replace(")\n,", "),", 1)


@query("momentum_backtest", _flagship_sql(3))
def momentum_backtest(spark, sf):
    """Flagship: ranking, top 3, equal-weight returns, performance row."""
    _, t = _test(spark, sf, n=3)
    out = perf.perf_stats(t.returns)
    return p.rounded(p.rounded(out, 6, "total_return"), 4, "cagr", "volatility", "sharpe", "max_drawdown")


@query(
    "custom_start",
    with_ctes(
        f"SELECT year(period_end) AS year, {rnd('product(1 + ret) - 1')} AS annual_return FROM base_ret_d WHERE period_end >= DATE '1998-06-15' GROUP BY 1",
        "base_ret_d",
    ),
)
def custom_start(spark, sf):
    """Results from a chosen day on, rankings with full history."""
    _, t = _test(spark, sf)
    late = t.returns.where("period_end >= DATE '1998-06-15'")
    return p.rounded(perf.annual_returns(late).drop("strategy_id"))


# -- trades, turnover, tax ----------------------------------------------------------------------

define("moves_d", f"SELECT m.rebalance_no, m.symbol, m.action, s.period_no, {_LABEL.format('s.period_no')} AS d FROM moves m JOIN sched s USING (rebalance_no)", "moves", "sched")


@query("holdings_events", with_ctes("SELECT d AS event_date, symbol, action FROM moves_d WHERE d >= DATE '1998-01-01'", "moves_d"))
def holdings_events(spark, sf):
    """Entries and exits since a day."""
    _, t = _test(spark, sf)
    out = holdings.holdings_events(t.holdings, t.schedule, "1998-01-01")
    return out.select("event_date", "symbol", "action")


@query(
    "current_positions",
    with_ctes(
        "SELECT h.symbol, (SELECT max(d) FROM moves_d m WHERE m.symbol = h.symbol AND action = 'entry') AS entry_date FROM held h WHERE rebalance_no = (SELECT max(rebalance_no) FROM sched)",
        "held",
        "moves_d",
    ),
)
def current_positions(spark, sf):
    """Last holdings with the start of their streak."""
    _, t = _test(spark, sf)
    return holdings.current_positions(t.holdings, t.schedule).select("symbol", "entry_date")


define("nav", "SELECT period_no, product(1 + ret) OVER (ORDER BY period_no) AS nav FROM base_ret", "base_ret")
define(
    "tlog",
    f"""SELECT e.symbol, e.period_no AS en, e.d AS entry_date, p.price AS entry_price, x.period_no AS xn, x.d AS exit_date,
         coalesce(q.price, CASE WHEN x.d IS NULL THEN (SELECT arg_max(price, period_no) FROM panel z WHERE z.symbol = e.symbol) END) AS exit_price,
         floor(n.nav / {N} * 1000000 / p.price + 0.5e0) AS qty, CASE WHEN x.d IS NULL THEN 'open' ELSE 'closed' END AS status
       FROM moves_d e JOIN panel p ON p.symbol = e.symbol AND p.period_no = e.period_no JOIN nav n ON n.period_no = e.period_no
       LEFT JOIN moves_d x ON x.symbol = e.symbol AND x.action = 'exit' AND x.rebalance_no = (SELECT min(rebalance_no) FROM moves y WHERE y.symbol = e.symbol AND y.action = 'exit' AND y.rebalance_no > e.rebalance_no)
       LEFT JOIN panel q ON q.symbol = e.symbol AND q.period_no = x.period_no
       WHERE e.action = 'entry' AND (x.d IS NULL OR q.price IS NOT NULL)""",
    "moves_d",
    "panel",
    "nav",
)


def _log(spark, sf):
    panel, t = _test(spark, sf)
    return trades.trade_log(panel, t.returns, t.holdings, t.schedule, N), t, panel


@query(
    "trade_log",
    with_ctes(
        f"""SELECT symbol, entry_date, {rnd('entry_price', 2)} AS entry_price, exit_date, {rnd('exit_price', 2)} AS exit_price, CAST(qty AS BIGINT) AS qty,
        {rnd('qty * (exit_price - entry_price)', 2)} AS pnl, {rnd('exit_price / entry_price - 1', 2)} AS pnl_pct,
        CAST(coalesce(exit_date, (SELECT max(period_end) FROM panel)) - entry_date AS INTEGER) AS hold_days, status FROM tlog""",
        "tlog",
    ),
)
def trade_log(spark, sf):
    """Discrete trades behind the holdings."""
    return p.rounded(_log(spark, sf)[0].drop("strategy_id"), 2)


@query(
    "pnl_split",
    with_ctes(
        f"""SELECT count(*) FILTER (status = 'closed') AS n_closed, count(*) FILTER (status = 'open') AS n_open,
        {rnd("coalesce(sum(qty * (exit_price - entry_price)) FILTER (status = 'closed'), 0)", 2)} AS realized_pnl,
        {rnd("coalesce(sum(qty * (exit_price - entry_price)) FILTER (status = 'open'), 0)", 2)} AS unrealized_pnl FROM tlog""",
        "tlog",
    ),
)
def pnl_split(spark, sf):
    """Realised and unrealised profit."""
    return p.rounded(perf.pnl_split(_log(spark, sf)[0]).drop("strategy_id"), 2)


_BUY = "((0.10e0 + 0.015e0 + 0.0035e0 * 1.18e0 + 0.15e0) / 100)"
_SELL = "((0.10e0 + 0.0035e0 * 1.18e0 + 0.15e0) / 100)"
define(
    "turn",
    f"""SELECT s.rebalance_no, s.period_no, count(*) FILTER (m.action = 'entry') AS a, count(*) FILTER (m.action = 'exit') AS x,
       count(*) FILTER (m.action = 'entry') / {N} * {_BUY} + count(*) FILTER (m.action = 'exit') / {N} * {_SELL} AS drag
       FROM sched s LEFT JOIN moves m USING (rebalance_no) GROUP BY 1, 2""",
    "sched",
    "moves",
)


@query(
    "turnover",
    with_ctes(f"SELECT period_no, a AS n_added, x AS n_dropped, {rnd(f'a / {N}')} AS buy_fraction, {rnd(f'x / {N}')} AS sell_fraction, {rnd('drag', 9)} AS cost_drag FROM turn", "turn"),
)
def turnover(spark, sf):
    """Turnover and cost drag per rebalance."""
    _, t = _test(spark, sf)
    return p.rounded(tax.turnover(t.holdings, t.schedule, n=N).drop("strategy_id", "rebalance_no"), 9)


@query(
    "after_cost_nav",
    with_ctes(
        f"""SELECT period_no, {rnd('product(1 + ret) OVER w', 4)} AS nav_gross, {rnd('product((1 + ret) * (1 - coalesce(drag, 0))) OVER w', 4)} AS nav_post_cost
        FROM base_ret LEFT JOIN turn USING (period_no) WINDOW w AS (ORDER BY period_no)""",
        "base_ret",
        "turn",
    ),
)
def after_cost_nav(spark, sf):
    """Value after trading costs."""
    _, t = _test(spark, sf)
    out = tax.after_cost_nav(t.returns, tax.turnover(t.holdings, t.schedule, n=N))
    return p.rounded(out.select("period_no", "nav_gross", "nav_post_cost"), 4)


define(
    "lots",
    f"""SELECT symbol, entry_date, exit_date, n.nav / {N} * (exit_price / entry_price - 1) * 1000000 AS gain, exit_date - entry_date >= 365 AS is_ltcg
       FROM tlog JOIN nav n ON n.period_no = tlog.en WHERE exit_date IS NOT NULL""",
    "tlog",
    "nav",
)


def _lots(spark, sf):
    log, t, _ = _log(spark, sf)
    nav = perf.equity_path(t.returns).select("strategy_id", F.col("period_end").alias("entry_date"), F.col("cum").alias("nav"))
    return tax.realized_lots(log.withColumn("n_active", F.lit(N)), nav)


@query("realized_lots", with_ctes(f"SELECT symbol, entry_date, exit_date, {rnd('gain', 2)} AS gain, is_ltcg FROM lots", "lots"))
def realized_lots(spark, sf):
    """Gain and term of each closed lot."""
    return p.rounded(_lots(spark, sf).select("symbol", "entry_date", "exit_date", "gain", "is_ltcg"), 2)


_ST, _LT = "(s.st + x.st)", "(s.lt + x.lt)"
_OFF = f"(CASE WHEN {_ST} < 0 AND {_LT} > 0 THEN least(-{_ST}, {_LT}) ELSE 0e0 END)"


@query(
    "capital_gains_tax",
    with_ctes(
        f""", y AS (SELECT make_date(CAST(year(exit_date) + CASE WHEN month(exit_date) > 3 THEN 1 ELSE 0 END AS INTEGER), 3, 31) AS cp,
             coalesce(sum(gain) FILTER (NOT is_ltcg), 0e0) AS st, coalesce(sum(gain) FILTER (is_ltcg), 0e0) AS lt FROM lots GROUP BY 1),
        f AS (SELECT unnest(s.out) AS e FROM (SELECT list_reduce(list({{'cp': cp, 'st': st, 'lt': lt}} ORDER BY cp), lambda s, x: {{
             'st': least({_ST} + {_OFF}, 0e0), 'lt': least({_LT} - {_OFF}, 0e0),
             'out': list_append(s.out, {{'cp': x.cp, 'st': x.st, 'lt': x.lt, 'sc': least({_ST} + {_OFF}, 0e0), 'lc': least({_LT} - {_OFF}, 0e0),
               'owed': (greatest({_ST} + {_OFF}, 0e0) * 0.2e0 + greatest({_LT} - {_OFF} - 125000, 0e0) * 0.125e0) * 1.04e0}})}},
             {{'st': 0e0, 'lt': 0e0, 'out': []::STRUCT(cp DATE, st DOUBLE, lt DOUBLE, sc DOUBLE, lc DOUBLE, owed DOUBLE)[]}}) AS s FROM y))
        SELECT e.cp AS checkpoint, {rnd('e.st', 2)} AS st_gain, {rnd('e.lt', 2)} AS lt_gain, {rnd('e.owed', 2)} AS tax_owed, {rnd('e.sc', 2)} AS st_carry, {rnd('e.lc', 2)} AS lt_carry FROM f""",
        "lots",
    ).replace(")\n,", "),", 1),
)
def capital_gains_tax(spark, sf):
    """Tax per fiscal year with netting and carried losses."""
    return p.rounded(tax.capital_gains_tax(_lots(spark, sf)).drop("strategy_id"), 2)


def _after_tax(spark, sf):
    panel, t = _test(spark, sf)
    return tax.after_tax_nav(t.returns, panel, t.holdings, t.schedule, n=N)


_OWED_ST, _OWED_LT = "(b.st + least(greatest(b.lt, 0e0), greatest(-b.st, 0e0)))", "(b.lt - least(greatest(b.lt, 0e0), greatest(-b.st, 0e0)))"
define(
    "account",
    f"""WITH r AS (SELECT period_no, ret, coalesce(drag, 0e0) AS drag, row_number() OVER (ORDER BY period_no) AS pos, {_LABEL.format('period_no')} AS d, lead(period_no) OVER (ORDER BY period_no) IS NULL AS final
         FROM base_ret LEFT JOIN turn USING (period_no)),
       sold AS (SELECT xn AS period_no, list({{'pos': e.pos, 'g': exit_price / entry_price - 1, 'long': exit_date - entry_date >= 365}}) AS lots,
         CAST(count(*) FILTER (exit_date - entry_date < 365) AS INTEGER) AS ns, CAST(count(*) FILTER (exit_date - entry_date >= 365) AS INTEGER) AS nl
         FROM tlog JOIN r e ON e.period_no = en WHERE exit_date IS NOT NULL GROUP BY 1),
       f AS (SELECT list_reduce(list({{'pos': pos, 'r': ret, 'drag': drag, 'assess': final OR month(d) = 3, 'lots': coalesce(lots, []::STRUCT(pos BIGINT, g DOUBLE, "long" BOOLEAN)[])}} ORDER BY pos),
         lambda s, x: list_transform([{{'hist': list_append(s.hist, s.nav * (1 + x.r) * (1 - x.drag)), 'post': s.nav * (1 + x.r) * (1 - x.drag), 'cost': s.nav * (1 + x.r) * x.drag * 1000000}}],
         lambda a: list_transform([{{'st': s.st + coalesce(list_sum(list_transform(x.lots, lambda l: CASE WHEN l.long THEN 0e0 ELSE a.hist[l.pos] / {N} * 1000000 * l.g END)), 0e0),
                                    'lt': s.lt + coalesce(list_sum(list_transform(x.lots, lambda l: CASE WHEN l.long THEN a.hist[l.pos] / {N} * 1000000 * l.g ELSE 0e0 END)), 0e0)}}],
         lambda b: list_transform([{{'owed': CASE WHEN x.assess AND a.post > 0 THEN (greatest({_OWED_ST}, 0e0) * 0.2e0 + greatest({_OWED_LT} - 125000, 0e0) * 0.125e0) * 1.04e0 ELSE 0e0 END}}],
         lambda c: {{'nav': a.post * (1 - CASE WHEN c.owed > 0 THEN least(c.owed / (a.post * 1000000), 1e0) ELSE 0e0 END), 'hist': a.hist,
                     'st': CASE WHEN x.assess THEN least({_OWED_ST}, 0e0) ELSE b.st END, 'lt': CASE WHEN x.assess THEN least({_OWED_LT}, 0e0) ELSE b.lt END,
                     'out': list_append(s.out, {{'pos': x.pos, 'net': a.post * (1 - CASE WHEN c.owed > 0 THEN least(c.owed / (a.post * 1000000), 1e0) ELSE 0e0 END), 'cost': a.cost, 'tax': c.owed}})}})[1])[1])[1],
         {{'nav': 1e0, 'hist': []::DOUBLE[], 'st': 0e0, 'lt': 0e0, 'out': []::STRUCT(pos BIGINT, net DOUBLE, cost DOUBLE, tax DOUBLE)[]}}) AS s FROM r LEFT JOIN sold USING (period_no))
       SELECT r.period_no, r.d AS period_end, product((1 + ret) * (1 - drag)) OVER (ORDER BY r.period_no) AS post, o.net, o.cost, o.tax, coalesce(ns, 0) AS ns, coalesce(nl, 0) AS nl
       FROM (SELECT unnest(s.out) AS o FROM f) JOIN r ON r.pos = o.pos LEFT JOIN sold USING (period_no)""",
    "base_ret",
    "turn",
    "tlog",
)


@query(
    "after_tax_nav",
    with_ctes(
        f"SELECT period_no, period_end, {rnd('post', 4)} AS nav_post_cost, {rnd('net', 4)} AS nav_net, {rnd('cost', 4)} AS cost_paid, {rnd('tax', 4)} AS tax_paid, ns AS n_stcg, nl AS n_ltcg FROM account",
        "account",
    ),
)
def after_tax_nav(spark, sf):
    """Value after costs and tax; lots are sized by the after-tax value."""
    return p.rounded(_after_tax(spark, sf).drop("strategy_id"), 4)


@query(
    "tax_totals",
    with_ctes(
        f"SELECT 'default' AS strategy_id, {rnd('sum(cost)', 2)} AS total_cost, {rnd('sum(tax)', 2)} AS total_tax, sum(ns) AS n_stcg_trades, sum(nl) AS n_ltcg_trades FROM account",
        "account",
    ),
)
def tax_totals(spark, sf):
    """Totals of the after-tax path."""
    return p.rounded(tax.tax_totals(_after_tax(spark, sf)), 2)


define("stop_path_once", CTES["stop_path"].replace("s.used < 2", "s.used < 1"), "spell", "held", "panel", "mbars")
define("stop_ret_once", CTES["stop_ret"].replace("stop_path", "stop_path_once"), "spell", "stop_path_once")
define(
    "mrows",
    """SELECT 'default' AS series_id, b.period_no, coalesce(l.ret, s.ret, b.ret) AS ret, CAST(row_number() OVER (ORDER BY b.period_no) - 1 AS INTEGER) AS i, CAST(count(*) OVER () AS INTEGER) AS n
       FROM base_ret b LEFT JOIN stop_ret_once s USING (period_no) LEFT JOIN lag_ret l USING (period_no)""",
    "base_ret",
    "stop_ret_once",
    "lag_ret",
)
define(
    "mtranches",
    CTES["tranches"].replace("-0.05e0", "-0.07e0").replace("-0.03e0", "-0.05e0").replace("x.i + 4", "x.i + 6").replace("FROM srows", "FROM mrows"),
    "mrows",
)
define(
    "mlev",
    """SELECT period_no, ret, product(1 + ret) OVER (ORDER BY period_no) AS cum FROM (SELECT period_no, CASE WHEN eq > 0 THEN raw ELSE 0 END AS ret FROM (
       SELECT *, coalesce(product(1 + raw) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS eq FROM (
       SELECT i, period_no, ret * (1 + lev) - lev * (0.1e0 / 12) AS raw FROM (SELECT r.i, r.period_no, r.ret, 0.5e0 * count(t.leg) AS lev FROM mrows r LEFT JOIN mtranches t ON r.i BETWEEN t.b AND t.e GROUP BY 1, 2, 3)))
       JOIN bret b USING (period_no) WHERE b.ret IS NOT NULL)""",
    "mrows",
    "mtranches",
    "bret",
)


@query(
    "levered_backtest",
    with_ctes(
        f"""SELECT 'default' AS strategy_id, count(*) AS n_periods, {rnd('CASE WHEN product(1 + ret) > 0 THEN log10(pow(product(1 + ret), 12e0 / count(*))) END')} AS log_cagr, {rnd('stddev_samp(ret) * sqrt(12e0)', 4)} AS volatility,
        {rnd('avg(ret) * 12 / (stddev_samp(ret) * sqrt(12e0))')} AS sharpe, {rnd('min(cum / peak - 1)')} AS max_drawdown, {rnd('log10(product(1 + ret))')} AS log_total_return FROM (SELECT *, max(cum) OVER (ORDER BY period_no) AS peak FROM mlev)""",
        "mlev",
    ),
)
def levered_backtest(spark, sf):
    """Backtest with both overlays, leverage applied after them, aligned to the benchmark last."""
    panel, t = _test(spark, sf)
    rets = materialise(backtest.with_overlays(t, panel, p.daily_bars(spark, sf), 10.0, 1, next_open=True))
    lev = backtest.levered(rets).drop("lev_frac", "interest")
    stats = backtest.report(lev, _bench_returns(spark, sf))["stats"]
    # on the test prices money grows by many powers of ten, so growth is given as its logarithm
    grown = {f"log_{x}": F.log10(1 + F.col(x)) for x in ("cagr", "total_return")}
    return p.rounded(p.rounded(stats.withColumns(grown).drop("cagr", "total_return"), 4, "sharpe", "max_drawdown", *grown), 6, "volatility")


# -- other grids and regimes ---------------------------------------------------------------------

define(
    "wrk",
    """SELECT symbol, period_no, row_number() OVER (PARTITION BY period_no ORDER BY round(m, 9) DESC, symbol) AS rank, count(*) OVER (PARTITION BY period_no) AS cnt
       FROM (SELECT a.symbol, a.period_no, e.price / s.price - 1 AS m FROM wpanel a JOIN wpanel e ON e.symbol = a.symbol AND e.period_no = a.period_no - 4
         JOIN wpanel s ON s.symbol = a.symbol AND s.period_no = a.period_no - 30 WHERE a.price >= 10)""",
    "wpanel",
)
define("wreb", f"SELECT DISTINCT period_no FROM wrk WHERE cnt >= {N} AND period_no >= (SELECT min(period_no) + 31 FROM wpanel)", "wrk", "wpanel")
define(
    "wspell",
    """SELECT period_no AS reb, CAST(unnest(range(period_no + 1, coalesce(lead(period_no) OVER (ORDER BY period_no), (SELECT max(period_no) FROM wpanel)) + 1)) AS INTEGER) AS period_no FROM wreb""",
    "wreb",
    "wpanel",
)


@query(
    "weekly_backtest",
    with_ctes(
        f"""SELECT DATE '1970-01-02' + CAST(s.period_no * 7 AS INTEGER) AS period_end, {rnd('coalesce(avg(b.price / a.price - 1), 0)')} AS ret
        FROM (SELECT CAST(unnest(range((SELECT min(period_no) + 31 FROM wpanel), (SELECT max(period_no) + 1 FROM wpanel))) AS INTEGER) AS period_no) s
        LEFT JOIN wspell p USING (period_no) LEFT JOIN wrk h ON h.period_no = p.reb AND h.rank <= {N}
        LEFT JOIN wpanel b ON b.symbol = h.symbol AND b.period_no = s.period_no LEFT JOIN wpanel a ON a.symbol = h.symbol AND a.period_no = s.period_no - 1 GROUP BY 1""",
        "wspell",
        "wrk",
        "wpanel",
    ),
)
def weekly_backtest(spark, sf):
    """The whole backtest on the weekly grid."""
    panel = p.weekly_panel(spark, sf)
    s = backtest.Strategy(RankParams(lookback=26, skip=4), n=N, freq="week")
    return p.rounded(backtest.run(panel, [s]).returns.select("period_end", "ret"))


define("rheld", f"SELECT s.rebalance_no, r.symbol FROM rsched s JOIN ranking r USING (period_no) WHERE s.regime = 'equity' AND r.rank <= {N}", "rsched", "ranking")


@query(
    "regime_events",
    with_ctes(
        f"""SELECT {_LABEL.format('s.period_no')} AS event_date, m.symbol, m.action FROM (
        SELECT h.rebalance_no, h.symbol, 'entry' AS action FROM rheld h WHERE NOT EXISTS (SELECT 1 FROM rheld g WHERE g.symbol = h.symbol AND g.rebalance_no = h.rebalance_no - 1)
        UNION ALL SELECT h.rebalance_no + 1, h.symbol, 'exit' FROM rheld h WHERE NOT EXISTS (SELECT 1 FROM rheld g WHERE g.symbol = h.symbol AND g.rebalance_no = h.rebalance_no + 1)) m
        JOIN rsched s USING (rebalance_no)""",
        "rheld",
        "rsched",
    ),
)
def regime_events(spark, sf):
    """The gold position is no equity trade; names leave when gold comes in."""
    _, t = _regime_test(spark, sf)
    return holdings.holdings_events(t.holdings, t.schedule).select("event_date", "symbol", "action")
