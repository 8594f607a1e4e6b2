"""Indicators on bars, trading rules, sizing and trade measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.operators import grid, indicators, perf, ranking, resample, signals, trades
from barloom.operators.ranking import RankParams
from barloom.plans.swing import levered_equity, universe_bars
from barloom.session import materialise
from workload import panels as p
from workload.panels import CTES, define, rnd, with_ctes
from workload.q_portfolio import _LEV
from workload.registry import query

# -- indicators -------------------------------------------------------------------------------


def _indexed(spark, sf):
    return grid.with_index(p.daily_bars(spark, sf))


define(
    "chan",
    """SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_close,
       CASE WHEN count(high) OVER w3 = 3 THEN max(high) OVER w3 END AS upper, CASE WHEN count(low) OVER w1 = 1 THEN min(low) OVER w1 END AS lower
       FROM ibars WINDOW w3 AS (PARTITION BY symbol ORDER BY idx RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING),
       w1 AS (PARTITION BY symbol ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)""",
    "ibars",
)


@query("previous_close", with_ctes("SELECT symbol, ts, prev_close FROM chan", "chan"))
def previous_close(spark, sf):
    """Close of the previous calendar slot."""
    return indicators.previous_close(_indexed(spark, sf)).select("symbol", "ts", "prev_close")


@query("channel", with_ctes("SELECT symbol, ts, upper, lower FROM chan", "chan"))
def channel(spark, sf):
    """Channel edges of the preceding slots."""
    return indicators.channel(_indexed(spark, sf), 3, 1).select("symbol", "ts", "upper", "lower")


def _ema_sql(src, key, spans, value="close"):
    """Averages with gap decay by a list fold: (key, idx, e1, e2)."""
    ys = {f"y{i}": 2.0 / (n + 1.0) for i, n in enumerate(spans, 1)}
    nxt = ", ".join(
        f"'{y}': CASE WHEN x.v IS NULL THEN s.{y} WHEN s.at IS NULL THEN x.v ELSE (pow(1 - {a!r}e0, x.i - s.at) * s.{y} + {a!r}e0 * x.v) / (pow(1 - {a!r}e0, x.i - s.at) + {a!r}e0) END"
        for y, a in ys.items()
    )
    init = ", ".join(f"'{y}': NULL::DOUBLE" for y in ys)
    outs = ", ".join(f"'{y}': z.{y}" for y in ys)
    cols = ", ".join(f"e.{y} AS e{i}" for i, y in enumerate(ys, 1))
    typ = ", ".join(f"{y} DOUBLE" for y in ys)
    return f"""SELECT {key}, e.i AS idx, {cols} FROM (SELECT {key}, unnest(s.out) AS e FROM (SELECT {key}, list_reduce(list({{'i': idx, 'v': {value}}} ORDER BY idx),
        lambda s, x: list_transform([{{'at': CASE WHEN x.v IS NULL THEN s.at ELSE x.i END, {nxt}}}],
          lambda z: {{'at': z.at, {", ".join(f"'{y}': z.{y}" for y in ys)}, 'out': list_append(s.out, {{'i': x.i, {outs}}})}})[1],
        {{'at': NULL::INTEGER, {init}, 'out': []::STRUCT(i INTEGER, {typ})[]}}) AS s FROM {src} GROUP BY 1))"""


define("emas", _ema_sql("ibars", "symbol", (5, 20)), "ibars")


@query("ema", with_ctes(f"SELECT symbol, idx, {rnd('e1', 4)} AS fast, {rnd('e2', 4)} AS slow FROM emas", "emas"))
def ema(spark, sf):
    """Exponential averages that decay through gaps."""
    out = indicators.ema(_indexed(spark, sf), {"fast": 5, "slow": 20})
    return p.rounded(out.select("symbol", "idx", "fast", "slow"), 4)


_A = "(1e0 / 14)"
define(
    "rsis",
    f"""SELECT symbol, e.i AS idx, e.rsi AS rsi FROM (SELECT symbol, unnest(s.out) AS e FROM (SELECT symbol, list_reduce(list({{'i': idx, 'v': close}} ORDER BY idx), lambda s, x:
        list_transform([CASE WHEN s.at IS NULL OR x.i - s.at <> 1 THEN {{'n': s.n, 'l': s.l, 'g': s.g, 'd': s.d}}
          WHEN s.n = 0 THEN {{'n': 1, 'l': x.i, 'g': greatest(x.v - s.v, 0e0), 'd': greatest(s.v - x.v, 0e0)}}
          ELSE {{'n': s.n + 1, 'l': x.i, 'g': (pow(1 - {_A}, x.i - s.l) * s.g + {_A} * greatest(x.v - s.v, 0e0)) / (pow(1 - {_A}, x.i - s.l) + {_A}),
               'd': (pow(1 - {_A}, x.i - s.l) * s.d + {_A} * greatest(s.v - x.v, 0e0)) / (pow(1 - {_A}, x.i - s.l) + {_A})}} END],
          lambda z: {{'at': x.i, 'v': x.v, 'n': z.n, 'l': z.l, 'g': z.g, 'd': z.d, 'out': list_append(s.out, {{'i': x.i,
             'rsi': CASE WHEN z.n < 14 OR NOT z.d > 0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + z.g / z.d) END}})}})[1],
        {{'at': NULL::INTEGER, 'v': NULL::DOUBLE, 'n': 0, 'l': NULL::INTEGER, 'g': NULL::DOUBLE, 'd': NULL::DOUBLE, 'out': []::STRUCT(i INTEGER, rsi DOUBLE)[]}}) AS s
        FROM ibars GROUP BY 1))""",
    "ibars",
)
define("rsix", "SELECT *, coalesce(rsi >= 45 AND lag(rsi) OVER (PARTITION BY symbol ORDER BY idx) < 45, false) AS crossed FROM rsis", "rsis")


@query("rsi", with_ctes(f"SELECT symbol, idx, {rnd('rsi')} AS rsi FROM rsis", "rsis"))
def rsi(spark, sf):
    """Wilder's relative strength."""
    return p.rounded(indicators.rsi(_indexed(spark, sf)).select("symbol", "idx", "rsi"))


@query("fresh_cross", with_ctes("SELECT symbol, idx FROM rsix WHERE crossed", "rsix"))
def fresh_cross(spark, sf):
    """Upward crosses of a threshold."""
    out = indicators.fresh_cross(indicators.rsi(_indexed(spark, sf)), threshold=45.0)
    return out.where("crossed").select("symbol", "idx")


@query(
    "next_open",
    with_ctes("SELECT a.symbol, a.ts, b.open AS next_open FROM ibars a LEFT JOIN ibars b ON b.symbol = a.symbol AND b.idx = a.idx + 1", "ibars"),
)
def next_open(spark, sf):
    """Price of the next-slot fill."""
    return indicators.next_open(_indexed(spark, sf)).select("symbol", "ts", "next_open")


@query("gap_up_signals", with_ctes("SELECT symbol, ts, open AS fill FROM chan WHERE prev_close > 0 AND open >= prev_close * 1.5e0", "chan"))
def gap_up_signals(spark, sf):
    """T4: opens well above the previous close."""
    out = signals.gap_up(indicators.previous_close(_indexed(spark, sf)), 50.0)
    return out.where("signal").select("symbol", "ts", "fill")


@query("channel_signals", with_ctes("SELECT symbol, ts, greatest(open, upper) AS fill FROM chan WHERE open > 0 AND high >= upper", "chan"))
def channel_signals(spark, sf):
    """T5: highs reaching the channel."""
    out = signals.channel_breakout(indicators.channel(_indexed(spark, sf), 3, 1))
    return out.where("signal").select("symbol", "ts", "fill")


# -- universe in force ------------------------------------------------------------------------

N = 8
define("univ", f"SELECT r.period_no AS universe_no, symbol, rank AS entry_rank FROM ranking r JOIN counts USING (period_no) WHERE cnt >= {N} AND rank <= {N} AND r.period_no IN (SELECT period_no FROM span)", "ranking", "counts")
define("weak", f"SELECT universe_no, symbol, entry_rank FROM (SELECT r.period_no AS universe_no, symbol, row_number() OVER (PARTITION BY r.period_no ORDER BY rank DESC) AS entry_rank FROM ranking r JOIN counts USING (period_no) WHERE cnt >= {N} AND r.period_no IN (SELECT period_no FROM span)) WHERE entry_rank <= {N}", "ranking", "counts")


def _in_force(src, univ, name, *needs):
    define(
        name,
        f"""SELECT b.*, u.entry_rank FROM (SELECT x.*, q.universe_no FROM (SELECT *, CAST(year(ts) * 12 + month(ts) - 2 AS INTEGER) AS _key FROM {src}
            WHERE symbol IN (SELECT symbol FROM {univ})) x ASOF JOIN (SELECT DISTINCT universe_no FROM {univ}) q ON x._key >= q.universe_no) b
            LEFT JOIN {univ} u ON u.symbol = b.symbol AND u.universe_no = b.universe_no""",
        univ,
        *needs,
    )


_in_force("chan", "univ", "u_chan", "chan")


def _universe(spark, sf, weakest=False):
    panel = p.monthly_panel(spark, sf)
    ranked = ranking.rank_universe(panel, [RankParams()])
    first = panel.agg(F.min("period_no")).scalar() + 14
    return materialise(ranking.universe_calendar(ranked.where(F.col("period_no") >= first), N, weakest))


@query("universe_in_force", with_ctes("SELECT symbol, ts, entry_rank FROM u_chan", "u_chan"))
def universe_in_force(spark, sf):
    """Bars with the rank of their name in the universe in force."""
    return universe_bars(_indexed(spark, sf), _universe(spark, sf)).select("symbol", "ts", "entry_rank")


# -- trading rules ----------------------------------------------------------------------------


def _types(ts):
    pos = f"STRUCT(ts {ts}, price DOUBLE, rk BIGINT, stop DOUBLE, target DOUBLE)"
    out = f"STRUCT(ts {ts}, price DOUBLE, rk BIGINT, stop DOUBLE, target DOUBLE, xts {ts}, xprice DOUBLE, why VARCHAR)"
    return pos, out


def _shut(price, why, s="s"):
    return f"list_append({s}.out, {{'ts': {s}.pos.ts, 'price': {s}.pos.price, 'rk': {s}.pos.rk, 'stop': {s}.pos.stop, 'target': {s}.pos.target, 'xts': x.ts, 'xprice': {price}, 'why': {why}}})"


def _open(price, rk, stop, target="NULL::DOUBLE"):
    return f"{{'ts': x.ts, 'price': {price}, 'rk': {rk}, 'stop': {stop}, 'target': {target}}}"


def _fold(src, key, item, first, second, extra, ts="DATE", open_rows=True):
    """Two-stage list fold: ``first`` -> z(pos, out, ..), ``second`` adds the orders for the next slot."""
    pos, out = _types(ts)
    tail = ""
    if open_rows:
        tail = f"""UNION ALL SELECT {key}, s.pos.ts, s.pos.price, s.pos.rk, s.pos.stop, s.pos.target, NULL, s.lastc, 'open', 'open' FROM f WHERE s.pos IS NOT NULL AND s.lastc IS NOT NULL"""
    return f"""WITH f AS MATERIALIZED (SELECT {key}, list_reduce(list({item} ORDER BY idx), lambda s, x: list_transform([{first}], lambda z: {second})[1],
        {{'pos': NULL::{pos}, 'out': []::{out}[], 'lastc': NULL::DOUBLE{extra}}}) AS s FROM {src} GROUP BY ALL)
        SELECT {key}, e.ts AS entry_date, e.price AS entry_price, e.rk AS entry_rank, e.stop AS stop_price, e.target AS target_price, e.xts AS exit_date, e.xprice AS exit_price, e.why AS exit_reason, 'closed' AS status
        FROM (SELECT {key}, unnest(s.out) AS e FROM f) {tail}"""


_LASTC = "'lastc': CASE WHEN x.idx = x.mx THEN x.c END"
_EX = "CASE WHEN s.pos IS NULL THEN NULL WHEN x.lower IS NOT NULL AND x.l <= x.lower THEN least(x.o, x.lower) WHEN x.h >= s.pos.target THEN greatest(x.o, s.pos.target) END"
_EW = "CASE WHEN x.lower IS NOT NULL AND x.l <= x.lower THEN 'trailing_donchian' ELSE 'target' END"
define(
    "brk",
    _fold(
        "(SELECT *, (SELECT max(idx) FROM cal) AS mx FROM u_chan)",
        "symbol",
        "{'idx': idx, 'mx': mx, 'ts': ts, 'o': open, 'h': high, 'l': low, 'c': close, 'lower': lower, 'fill': CASE WHEN open > 0 AND high >= upper THEN greatest(open, upper) END, 'rk': entry_rank}",
        f"{{'pos': CASE WHEN {_EX} > 0 THEN NULL ELSE s.pos END, 'out': CASE WHEN {_EX} > 0 THEN {_shut(_EX, _EW)} ELSE s.out END}}",
        f"{{'pos': CASE WHEN z.pos IS NULL AND x.rk IS NOT NULL AND x.fill > 0 AND x.lower < x.fill THEN {_open('x.fill', 'x.rk', 'x.lower', 'x.fill + 2e0 * (x.fill - x.lower)')} ELSE z.pos END, 'out': z.out, {_LASTC}}}",
        "",
    ),
    "u_chan",
    "cal",
)
_TRADE_COLS = (
    "symbol, entry_date, {e} AS entry_price, CAST(entry_rank AS INTEGER) AS entry_rank, {s} AS stop_price, {t} AS target_price, exit_date, {x} AS exit_price, exit_reason, status".format(
        e=rnd("entry_price", 4), s=rnd("stop_price", 4), t=rnd("target_price", 4), x=rnd("exit_price", 4)
    )
)


def _breakouts(spark, sf):
    bars = signals.channel_breakout(indicators.channel(_indexed(spark, sf), 3, 1))
    return signals.breakout_trades(universe_bars(bars, _universe(spark, sf)))


@query("breakout_trades", with_ctes(f"SELECT {_TRADE_COLS} FROM brk", "brk"))
def breakout_trades(spark, sf):
    """Channel entries, trailing stop and target."""
    return p.rounded(_breakouts(spark, sf).drop("strategy_id"), 4)


_GX = "CASE WHEN s.pos IS NULL THEN NULL WHEN x.l <= s.pos.price * 0.7e0 THEN least(x.o, s.pos.price * 0.7e0) WHEN x.h >= s.pos.target THEN greatest(x.o, s.pos.target) END"
define(
    "gap",
    _fold(
        "(SELECT *, (SELECT max(idx) FROM cal) AS mx FROM u_chan)",
        "symbol",
        "{'idx': idx, 'mx': mx, 'ts': ts, 'o': open, 'h': high, 'l': low, 'c': close, 'fill': CASE WHEN prev_close > 0 AND open >= prev_close * 1.5e0 THEN open END, 'rk': entry_rank}",
        f"{{'pos': CASE WHEN {_GX} > 0 THEN NULL ELSE s.pos END, 'out': CASE WHEN {_GX} > 0 THEN {_shut(_GX, "CASE WHEN x.l <= s.pos.price * 0.7e0 THEN 'fixed_pct' ELSE 'target' END")} ELSE s.out END}}",
        f"{{'pos': CASE WHEN z.pos IS NULL AND x.rk IS NOT NULL AND x.fill > 0 THEN {_open('x.fill', 'x.rk', 'x.fill * 0.7e0', 'x.fill + 2e0 * (x.fill - x.fill * 0.7e0)')} ELSE z.pos END, 'out': z.out, {_LASTC}}}",
        "",
    ),
    "u_chan",
    "cal",
)


@query("gap_up_trades", with_ctes(f"SELECT {_TRADE_COLS} FROM gap", "gap"))
def gap_up_trades(spark, sf):
    """Gap entries with a fixed stop and a target."""
    bars = indicators.channel(indicators.previous_close(_indexed(spark, sf)), 3, 1)
    rows = universe_bars(signals.gap_up(bars, 50.0), _universe(spark, sf))
    return p.rounded(signals.breakout_trades(rows, "fixed_pct", 30.0, 2.0).drop("strategy_id"), 4)


define(
    "dense",
    """SELECT g.symbol, g.ts, g.idx, b.open, b.close FROM (SELECT s.symbol, c.ts, c.idx FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal c) g
       LEFT JOIN bars b USING (symbol, ts)""",
    "bars",
    "cal",
)
define("demas", _ema_sql("dense", "symbol", (5, 20)), "dense")
define("dema_bars", "SELECT dense.*, e1, e2, (SELECT max(idx) FROM cal) AS mx FROM dense JOIN demas USING (symbol, idx)", "dense", "demas", "cal")
_in_force("dema_bars", "univ", "u_dema", "dema_bars")
_in_force("dema_bars", "weak", "w_dema", "dema_bars")
_EMA_ITEM = "{'idx': idx, 'mx': mx, 'ts': ts, 'o': open, 'c': close, 'ef': e1, 'es': e2, 'rk': entry_rank}"
_ORDERS = ", 'leave': NULL::VARCHAR, 'est': NULL::DOUBLE, 'erk': NULL::BIGINT"


def _ema_rule(src, short):
    lt, gt = (">", "<") if short else ("<", ">")
    a, b = ("close_above_ema_slow", "ema_fast_above_ema_slow") if short else ("close_below_ema_slow", "ema_fast_below_ema_slow")
    target = "x.o - 2e0 * greatest(s.est - x.o, x.o * 1e0 / 100)" if short else "NULL::DOUBLE"
    opens = f"(s.erk IS NOT NULL AND s.pos IS NULL AND x.o > 0 AND x.o {gt} s.est)"
    shuts = "(s.leave IS NOT NULL AND s.pos IS NOT NULL AND x.o > 0)"
    hit = "WHEN x.c <= z.pos.target THEN 'target_hit'" if short else ""
    first = f"{{'pos': CASE WHEN {opens} THEN {_open('x.o', 's.erk', 's.est', target)} WHEN {shuts} THEN NULL ELSE s.pos END, 'out': CASE WHEN {shuts} THEN {_shut('x.o', 's.leave')} ELSE s.out END}}"
    enter = f"z.pos IS NULL AND x.rk IS NOT NULL AND x.ef {gt} x.es"
    second = f"""{{'pos': z.pos, 'out': z.out, {_LASTC}, 'leave': CASE WHEN z.pos IS NOT NULL AND x.c IS NOT NULL AND x.ef IS NOT NULL THEN CASE {hit} WHEN x.c {lt} x.es THEN '{a}' WHEN x.ef {lt} x.es THEN '{b}' END END,
        'est': CASE WHEN {enter} THEN x.es END, 'erk': CASE WHEN {enter} THEN x.rk END}}"""
    return _fold(src, "symbol", _EMA_ITEM, first, second, _ORDERS)


define("xlong", _ema_rule("u_dema", False), "u_dema")
define("xshort", _ema_rule("w_dema", True), "w_dema")


def _ema_bars(spark, sf):
    dense = grid.densify(p.daily_bars(spark, sf).select("symbol", "ts", "open", "close"))
    return indicators.ema(materialise(dense), {"ema_fast": 5, "ema_slow": 20})


@query("ema_cross_long", with_ctes(f"SELECT {_TRADE_COLS} FROM xlong", "xlong"))
def ema_cross_long(spark, sf):
    """Average cross, long."""
    out = signals.ema_cross_trades(universe_bars(_ema_bars(spark, sf), _universe(spark, sf)))
    return p.rounded(out.drop("strategy_id"), 4)


@query("ema_cross_short", with_ctes(f"SELECT {_TRADE_COLS} FROM xshort", "xshort"))
def ema_cross_short(spark, sf):
    """Mirrored on the weakest names, with a target."""
    rows = universe_bars(_ema_bars(spark, sf), _universe(spark, sf, weakest=True))
    return p.rounded(signals.ema_cross_trades(rows, short=True, use_target=True).drop("strategy_id"), 4)


define("rbars", "SELECT ibars.*, rsix.crossed, (SELECT max(idx) FROM cal) AS mx FROM ibars JOIN rsix USING (symbol, idx)", "ibars", "rsix", "cal")
_in_force("rbars", "univ", "u_rsi", "rbars")
_HERE = "(x.idx - 1 = s.seen)"
_RSHUT = f"(s.leave IS NOT NULL AND s.pos IS NOT NULL AND {_HERE} AND x.o > 0)"
_ROPEN = f"(s.erk IS NOT NULL AND s.pos IS NULL AND {_HERE} AND x.o > 0 AND x.o - s.est > 0 AND NOT ((x.o - s.est) / x.o * 100e0 > 40))"
_RTRIG = "(z.pos IS NULL AND x.rk IS NOT NULL AND s.al IS NOT NULL AND x.c > s.ah)"
_RARM = "(z.pos IS NULL AND x.rk IS NOT NULL AND x.x)"
define(
    "rrev",
    _fold(
        "u_rsi",
        "symbol",
        "{'idx': idx, 'mx': mx, 'ts': ts, 'o': open, 'h': high, 'l': low, 'c': close, 'x': crossed, 'rk': entry_rank}",
        f"{{'pos': CASE WHEN {_ROPEN} THEN {_open('x.o', 's.erk', 's.est', 'x.o + 5e0 * greatest(x.o - s.est, x.o * 0.1e0 / 100)')} WHEN {_RSHUT} THEN NULL ELSE s.pos END, 'out': CASE WHEN {_RSHUT} THEN {_shut('x.o', 's.leave')} ELSE s.out END}}",
        f"""{{'pos': z.pos, 'out': z.out, {_LASTC}, 'leave': CASE WHEN z.pos IS NOT NULL THEN CASE WHEN x.c < z.pos.stop THEN 'stoploss' WHEN x.c >= z.pos.target THEN 'target' WHEN x.ts - z.pos.ts >= 45 THEN 'time_exit' END END,
        'est': CASE WHEN {_RTRIG} THEN s.al END, 'erk': CASE WHEN {_RTRIG} THEN x.rk END, 'seen': x.idx,
        'ah': CASE WHEN {_RARM} THEN x.h WHEN {_RTRIG} THEN NULL ELSE s.ah END, 'al': CASE WHEN {_RARM} THEN x.l WHEN {_RTRIG} THEN NULL ELSE s.al END}}""",
        _ORDERS + ", 'seen': NULL::INTEGER, 'ah': NULL::DOUBLE, 'al': NULL::DOUBLE",
    ),
    "u_rsi",
)


@query("rsi_reversal", with_ctes(f"SELECT {_TRADE_COLS} FROM rrev", "rrev"))
def rsi_reversal(spark, sf):
    """Alert, trigger, next-open entry."""
    bars = indicators.fresh_cross(indicators.rsi(_indexed(spark, sf)), threshold=45.0)
    out = signals.rsi_reversal_trades(universe_bars(bars, _universe(spark, sf)), max_stop_pct=40.0)
    return p.rounded(out.drop("strategy_id"), 4)


_WEEK = "CAST((CAST({0} AS DATE) - DATE '1970-01-02' + 6) // 7 AS INTEGER)"
define(
    "wrank",
    f"""SELECT period_no AS universe_no, symbol, row_number() OVER (PARTITION BY period_no ORDER BY round(m, 9) DESC, symbol) AS entry_rank FROM (
        SELECT a.symbol, a.period_no, a.price / b.price - 1 AS m FROM wk a JOIN wk b ON b.symbol = a.symbol AND b.period_no = a.period_no - 1 WHERE a.price > 0 AND b.price > 0) QUALIFY entry_rank <= 4""",
    "wk",
)
define("wk", f"SELECT symbol, {_WEEK.format('ts')} AS period_no, arg_max(close, ts) AS price FROM hours GROUP BY 1, 2", "hours")
define(
    "obars",
    f"""SELECT x.*, u.entry_rank FROM (SELECT h.symbol, h.ts, h.idx, h.open, h.close, {_WEEK.format('h.ts')} AS period_no, o.range_high, o.range_low,
          h.ts = max(h.ts) OVER (PARTITION BY {_WEEK.format('h.ts')}) AS is_last FROM ihours h LEFT JOIN orange o ON o.symbol = h.symbol AND o.period_no = {_WEEK.format('h.ts')}) x
        LEFT JOIN wrank u ON u.symbol = x.symbol AND u.universe_no = x.period_no - 1
        WHERE range_high IS NOT NULL AND x.period_no > (SELECT min(universe_no) FROM wrank) AND x.symbol IN (SELECT symbol FROM wrank)""",
    "ihours",
    "orange",
    "wrank",
)


def _orb_rule(short):
    lt = ">" if short else "<"
    stop = "x.rh" if short else "x.rl"
    beyond = "x.c < x.rl" if short else "x.c > x.rh"
    shuts = f"(s.leave IS NOT NULL AND s.pos IS NOT NULL AND {_HERE} AND x.o > 0)"
    side = "x.o < x.rh" if short else "x.o > x.rl"
    opens = f"(s.erk IS NOT NULL AND s.pos IS NULL AND {_HERE} AND x.o > 0 AND {side})"
    first = f"{{'pos': CASE WHEN {opens} THEN {_open('x.o', 's.erk', stop)} WHEN {shuts} THEN NULL ELSE s.pos END, 'n': CASE WHEN {opens} THEN s.n + 1 ELSE s.n END, 'out': CASE WHEN {shuts} THEN {_shut('x.o', 's.leave')} ELSE s.out END}}"
    enter = f"(NOT x.last AND z.pos IS NULL AND x.rk IS NOT NULL AND z.n <= 4 AND {beyond})"
    second = f"""{{'pos': CASE WHEN x.last THEN NULL ELSE z.pos END, 'out': CASE WHEN x.last AND z.pos IS NOT NULL THEN {_shut('x.c', "'month_end'", 'z')} ELSE z.out END, 'lastc': x.c, 'n': z.n,
        'leave': CASE WHEN NOT x.last AND z.pos IS NOT NULL AND x.c {lt} z.pos.stop THEN 'stoploss' END, 'est': NULL::DOUBLE, 'erk': CASE WHEN {enter} THEN x.rk END, 'seen': x.idx, 'mts': x.ts}}"""
    body = _fold("obars", "symbol, period_no", "{'idx': idx, 'ts': ts, 'o': open, 'c': close, 'rh': range_high, 'rl': range_low, 'last': is_last, 'rk': entry_rank}",
                 first, second, _ORDERS + ", 'seen': NULL::INTEGER, 'n': 0, 'mts': NULL::TIMESTAMP", ts="TIMESTAMP", open_rows=False)
    return body + " UNION ALL SELECT symbol, period_no, s.pos.ts, s.pos.price, s.pos.rk, s.pos.stop, s.pos.target, s.mts, s.lastc, 'month_end', 'closed' FROM f WHERE s.pos IS NOT NULL"


define("orb_long", _orb_rule(False), "obars")
define("orb_short", _orb_rule(True), "obars")
_ORB_COLS = "symbol, period_no, strftime(entry_date, '%Y-%m-%d %H:%M') AS entry_at, entry_price, CAST(entry_rank AS INTEGER) AS entry_rank, stop_price, strftime(exit_date, '%Y-%m-%d %H:%M') AS exit_at, exit_price, exit_reason"


def _orb(spark, sf, short):
    bars = p.intraday_bars(spark, sf)
    weekly = resample.resample_last(bars, "week")
    ranked = ranking.rank_universe(weekly, [RankParams(lookback=1, skip=0, min_price=0.0)])
    universe = materialise(ranking.universe_calendar(ranked, 4))
    ranges = resample.opening_range(bars, 3, "week")
    rows = resample.last_bar_of_period(grid.with_index(bars), "week").join(ranges, ["period_no", "symbol"], "left")
    out = signals.opening_range_trades(universe_bars(rows, universe, freq="week"), short=short)
    at = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return out.select(
        "symbol", "period_no", at("entry_date").alias("entry_at"), "entry_price", "entry_rank", "stop_price",
        at("exit_date").alias("exit_at"), "exit_price", "exit_reason",
    )


@query("opening_range_long", with_ctes(f"SELECT {_ORB_COLS} FROM orb_long", "orb_long"))
def opening_range_long(spark, sf):
    """Opening-range breakouts within a period."""
    return _orb(spark, sf, False)


@query("opening_range_short", with_ctes(f"SELECT {_ORB_COLS} FROM orb_short", "orb_short"))
def opening_range_short(spark, sf):
    """The same, short."""
    return _orb(spark, sf, True)


# -- sizing and measures ----------------------------------------------------------------------

define(
    "sized",
    """SELECT *, CASE WHEN risked > 0 THEN pnl / risked END AS r_multiple FROM (SELECT *, qty * (exit_price - entry_price) AS pnl, qty * (entry_price - stop_price) AS risked FROM (
       SELECT *, least(10000e0 / (entry_price - stop_price), 200000e0 / entry_price) AS qty FROM brk))""",
    "brk",
)


def _sized(spark, sf):
    t = materialise(trades.size_by_risk(_breakouts(spark, sf)))
    last = p.daily_bars(spark, sf).agg(F.max("ts")).scalar()
    return materialise(trades.trade_measures(t, last_ts=last))


@query(
    "sized_trades",
    with_ctes(
        f"""SELECT symbol, entry_date, {rnd('qty')} AS qty, {rnd('risked', 4)} AS risked, {rnd('pnl', 4)} AS pnl, {rnd('exit_price / entry_price - 1')} AS pnl_pct,
        {rnd('r_multiple')} AS r_multiple, CAST(coalesce(exit_date, (SELECT max(ts) FROM cal)) - entry_date AS INTEGER) AS hold_days FROM sized""",
        "sized",
        "cal",
    ),
)
def sized_trades(spark, sf):
    """Risk-based size, profit, R-multiple, holding time."""
    out = _sized(spark, sf).select("symbol", "entry_date", "qty", "risked", "pnl", "pnl_pct", "r_multiple", "hold_days")
    return p.rounded(p.rounded(out, 6, "risked", "pnl"), 4, "qty", "pnl_pct", "r_multiple")


@query(
    "slot_sized_trades",
    with_ctes(
        f"""SELECT symbol, entry_date, {rnd('200000e0 / entry_price')} AS qty, {rnd('200000e0 / entry_price * greatest(stop_price - entry_price, entry_price * 1e0 / 100)', 4)} AS risked,
        {rnd('200000e0 / entry_price * (entry_price - exit_price)', 4)} AS pnl, {rnd('1 - exit_price / entry_price')} AS pnl_pct, {rnd('5000000e0 / 100 / entry_price')} AS share_qty FROM xshort""",
        "xshort",
    ),
)
def slot_sized_trades(spark, sf):
    """Equal slots for short trades, and a fixed share of capital."""
    rows = universe_bars(_ema_bars(spark, sf), _universe(spark, sf, weakest=True))
    t = signals.ema_cross_trades(rows, short=True, use_target=True)
    shares = trades.size_by_share(t, 1_000_000.0, 5.0).withColumnRenamed("qty", "share_qty").drop("risked")
    out = trades.trade_measures(trades.size_by_slot(shares), short=True)
    out = out.select("symbol", "entry_date", "qty", "risked", "pnl", "pnl_pct", "share_qty")
    return p.rounded(p.rounded(out, 6, "risked", "pnl"), 4, "qty", "pnl_pct", "share_qty")


define(
    "curve",
    """SELECT c.ts, 1000000e0 + coalesce(sum(b.pnl) OVER (ORDER BY c.ts), 0) + coalesce(f.v, 0) AS equity FROM cal c
       LEFT JOIN (SELECT exit_date AS ts, sum(pnl) AS pnl FROM sized WHERE status = 'closed' GROUP BY 1) b USING (ts)
       LEFT JOIN (SELECT b.ts, sum(t.qty * (b.close - t.entry_price)) AS v FROM sized t JOIN bars b ON b.symbol = t.symbol AND b.ts >= t.entry_date AND (t.exit_date IS NULL OR b.ts < t.exit_date) GROUP BY 1) f USING (ts)""",
    "cal",
    "sized",
    "bars",
)


@query("equity_curve", with_ctes(f"SELECT ts, {rnd('equity', 2)} AS equity FROM curve", "curve"))
def equity_curve(spark, sf):
    """Trades marked to market on every slot."""
    return p.rounded(trades.equity_curve(_sized(spark, sf), p.daily_bars(spark, sf)).drop("strategy_id"), 2)


@query(
    "trade_stats",
    with_ctes(
        f"""SELECT {rnd('e.last', 2)} AS end_equity, {rnd('e.last / 1000000 - 1')} AS total_return,
        {rnd('CASE WHEN e.last > 0 THEN pow(e.last / 1000000, 1 / (e.days / 365.25e0)) - 1 END')} AS cagr, {rnd('e.dd')} AS max_drawdown, t.n AS n_trades, {rnd('t.w')} AS win_rate,
        {rnd('t.r')} AS avg_r, {rnd('1e0 / 3')} AS breakeven_win_rate, t.o AS n_open FROM
        (SELECT arg_max(equity, ts) AS last, max(ts) - min(ts) AS days, min(equity / peak - 1) AS dd FROM (SELECT *, max(equity) OVER (ORDER BY ts) AS peak FROM curve)) e,
        (SELECT count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) FILTER (status = 'closed') AS w, avg(r_multiple) FILTER (status = 'closed') AS r, count(*) FILTER (status = 'open') AS o FROM sized) t""",
        "curve",
        "sized",
    ),
)
def trade_stats(spark, sf):
    """Result card."""
    t = _sized(spark, sf)
    equity = materialise(trades.equity_curve(t, p.daily_bars(spark, sf)))
    out = perf.trade_stats(t, equity, 1_000_000.0, 2.0).drop("strategy_id")
    return p.rounded(p.rounded(out, 6, "end_equity"), 2, *[x for x in out.columns if x != "end_equity"])


define(
    "erows",
    """SELECT 'default' AS series_id, period_no, ret, CAST(row_number() OVER (ORDER BY period_no) - 1 AS INTEGER) AS i, CAST(count(*) OVER () AS INTEGER) AS n FROM (
       SELECT period_no, equity / lag(equity) OVER (ORDER BY period_no) - 1 AS ret FROM emonths) WHERE ret IS NOT NULL""",
    "emonths",
)
define("emonths", "SELECT CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS period_no, arg_max(equity, ts) AS equity FROM curve GROUP BY 1", "curve")
define("etranches", CTES["tranches"].replace("FROM srows", "FROM erows"), "erows")
define(
    "elev",
    """SELECT *, 1000000e0 * product(1 + CASE WHEN eq > 0 THEN raw ELSE 0 END) OVER (ORDER BY i) AS lev_equity, eq * lev * (0.1e0 / 12) AS interest FROM (
       SELECT *, coalesce(product(1 + raw) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS eq FROM (
       SELECT *, ret * (1 + lev) - lev * (0.1e0 / 12) AS raw FROM (SELECT s.i, s.ret, coalesce(sum(CASE t.leg WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.4e0 END), 0e0) AS lev
       FROM erows s LEFT JOIN etranches t ON s.i BETWEEN t.b AND t.e GROUP BY 1, 2)))""",
    "erows",
    "etranches",
)


@query(
    "levered_trading_rule",
    with_ctes(
        f"""SELECT {rnd('p.last', 2)} AS end_equity, {rnd('CASE WHEN p.last > 0 THEN pow(p.last / 1000000, 1 / y) - 1 END')} AS cagr, {rnd('p.dd')} AS max_drawdown, {rnd('l.last', 2)} AS levered_equity,
        {rnd('CASE WHEN l.last > 0 THEN pow(l.last / 1000000, 1 / y) - 1 END')} AS levered_cagr, {rnd('l.dd')} AS levered_drawdown, {rnd('l.interest', 2)} AS total_interest, (SELECT count(*) FROM etranches) AS n_tranches
        FROM (SELECT arg_max(equity, period_no) AS last, min(equity / peak - 1) AS dd, (last_day(make_date(max(period_no) // 12, max(period_no) % 12 + 1, 1)) - last_day(make_date(min(period_no) // 12, min(period_no) % 12 + 1, 1))) / 365.25e0 AS y
          FROM (SELECT *, max(equity) OVER (ORDER BY period_no) AS peak FROM emonths)) p,
        (SELECT arg_max(lev_equity, i) AS last, min(lev_equity / peak - 1) AS dd, sum(interest) * 1000000 AS interest FROM (SELECT *, max(lev_equity) OVER (ORDER BY i) AS peak FROM elev)) l""",
        "emonths",
        "elev",
        "etranches",
    ),
)
def levered_trading_rule(spark, sf):
    """Leverage on the monthly equity of the breakout rule."""
    equity = trades.equity_curve(_sized(spark, sf), p.daily_bars(spark, sf))
    out = levered_equity(equity, **_LEV).drop("strategy_id")
    money = ["end_equity", "levered_equity", "total_interest"]
    return p.rounded(p.rounded(out, 6, *money), 2, *[x for x in out.columns if x not in money])


@query("exit_reasons", with_ctes("SELECT exit_reason, count(*) AS n FROM brk GROUP BY 1", "brk"))
def exit_reasons(spark, sf):
    """Why trades ended."""
    return perf.exit_reasons(_breakouts(spark, sf)).drop("strategy_id")


@query(
    "r_histogram",
    with_ctes(
        "SELECT CAST(least(floor((least(greatest(r_multiple, -3e0), 10e0) + 3e0) / 0.325e0), 39) AS INTEGER) AS bin, count(*) AS n FROM sized WHERE status = 'closed' AND r_multiple IS NOT NULL GROUP BY 1",
        "sized",
    ),
)
def r_histogram(spark, sf):
    """Distribution of clipped R-multiples."""
    return perf.r_histogram(_sized(spark, sf)).drop("strategy_id")


@query("compounding_steps", with_ctes("SELECT ts, CAST(greatest(floor(ln(max(equity) OVER (ORDER BY ts) / 1000000) / ln(1.05e0)), 0) AS INTEGER) AS n_steps FROM curve", "curve"))
def compounding_steps(spark, sf):
    """Ratchet of the sizing capital."""
    equity = trades.equity_curve(_sized(spark, sf), p.daily_bars(spark, sf))
    return perf.compounding_steps(equity, 1_000_000.0, 5.0).select("ts", "n_steps")


@query(
    "paired_signals",
    with_ctes(
        _fold(
            "chan",
            "symbol",
            "{'idx': idx, 'ts': ts, 'p': close, 'i': coalesce(close > upper, false), 'o': coalesce(close < lower, false)}",
            f"{{'pos': CASE WHEN x.o THEN NULL ELSE s.pos END, 'out': CASE WHEN x.o AND s.pos IS NOT NULL THEN {_shut('x.p', 'NULL::VARCHAR')} ELSE s.out END}}",
            f"{{'pos': CASE WHEN z.pos IS NULL AND x.i THEN {_open('x.p', '0', 'NULL::DOUBLE')} ELSE z.pos END, 'out': z.out, 'lastc': NULL::DOUBLE}}",
            "",
        )
        .replace("WITH f AS MATERIALIZED", ", f AS MATERIALIZED", 1)
        .replace(
            "SELECT symbol, e.ts AS entry_date, e.price AS entry_price, e.rk AS entry_rank, e.stop AS stop_price, e.target AS target_price, e.xts AS exit_date, e.xprice AS exit_price, e.why AS exit_reason, 'closed' AS status",
            "SELECT symbol, e.ts AS entry_date, e.price AS entry_price, e.xts AS exit_date, e.xprice AS exit_price, 'closed' AS status",
        )
        .replace(
            "SELECT symbol, s.pos.ts, s.pos.price, s.pos.rk, s.pos.stop, s.pos.target, NULL, s.lastc, 'open', 'open' FROM f WHERE s.pos IS NOT NULL AND s.lastc IS NOT NULL",
            "SELECT symbol, s.pos.ts, s.pos.price, NULL, NULL, 'open' FROM f WHERE s.pos IS NOT NULL",
        ),
        "chan",
    ).replace(")\n,", "),", 1),
)
def paired_signals(spark, sf):
    """First exit after an entry, then the next entry."""
    bars = indicators.channel(_indexed(spark, sf), 3, 1)
    rows = bars.select(
        "symbol",
        "ts",
        F.col("close").alias("price"),
        c.holds(F.col("close") > F.col("upper")).alias("enter"),
        c.holds(F.col("close") < F.col("lower")).alias("leave"),
    )
    return trades.pair_trades(rows, ["symbol"])
