"""Rotation strategies and cash-flow analytics (H14-H16, C*, G17, G19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cashflows, resample, rotation
from barloom.session import materialise
from workload import panels as p
from workload.panels import define, rnd, with_ctes
from workload.q_signals import _ema_sql
from workload.registry import query

# -- rotation ---------------------------------------------------------------------------------

define("legs", "SELECT * FROM (VALUES ('5-LOW', 0), ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3)) t(series_id, pos)")
define("dtrail", "SELECT series_id, ts, value / lag(value, 55) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS tr FROM dseries", "dseries")
define(
    "rslog",
    """SELECT d.ts, CASE WHEN b.rs > 0 THEN b.series_id ELSE '5-LOW' END AS chosen, b.rs AS best_rs FROM (
         SELECT min(ts) AS ts FROM dtrail WHERE series_id = '5-LOW' AND tr IS NOT NULL GROUP BY year(ts), quarter(ts)) d
       LEFT JOIN (SELECT c.ts, arg_max(c.series_id, (c.tr - r.tr, -l.pos)) AS series_id, max(c.tr - r.tr) AS rs FROM dtrail c
         JOIN legs l USING (series_id) JOIN dtrail r ON r.series_id = '5-LOW' AND r.ts = c.ts WHERE l.pos > 0 AND c.tr - r.tr IS NOT NULL GROUP BY 1) b USING (ts)""",
    "dtrail",
    "legs",
)
define(
    "filled",
    """SELECT series_id, ts, v / lag(v) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS r, v FROM (
       SELECT g.series_id, g.ts, last_value(d.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ts) AS v FROM
       (SELECT s.series_id, t.ts FROM (SELECT DISTINCT series_id FROM dseries) s CROSS JOIN (SELECT ts FROM dseries WHERE series_id = '5-LOW') t) g
       LEFT JOIN dseries d USING (series_id, ts))""",
    "dseries",
)


def _legs(spark, sf):
    """One portfolio: the lowest priority as reference, the others as candidates in order."""
    names = p.series_daily(spark, sf).groupBy("series_id").agg(F.min(F.lit("p1")).alias("portfolio_id"))
    pos = F.substr("series_id", F.lit(1), F.lit(1)).cast("int") % 5
    return names.where("substr(series_id, 1, 1) <> '4'").select("portfolio_id", "series_id", pos.alias("pos"))


@query("rs_rotation_log", with_ctes(f"SELECT ts AS rebalance_date, chosen, {rnd('best_rs')} AS best_rs FROM rslog", "rslog"))
def rs_rotation_log(spark, sf):
    """Quarterly choice by relative strength."""
    _, log = rotation.rs_rotation(p.series_daily(spark, sf), _legs(spark, sf))
    return p.rounded(log.drop("portfolio_id"))


@query(
    "rs_rotation_returns",
    with_ctes(
        f"""SELECT h.ts AS ts, held, {rnd('r')} AS ret FROM (SELECT t.ts, (SELECT arg_max(chosen, l.ts) FROM rslog l WHERE l.ts < t.ts) AS held
        FROM (SELECT ts FROM dseries WHERE series_id = '5-LOW') t) h JOIN filled f ON f.series_id = h.held AND f.ts = h.ts WHERE r IS NOT NULL""",
        "rslog",
        "filled",
        "dseries",
    ),
)
def rs_rotation_returns(spark, sf):
    """Daily returns of the rotation."""
    rets, _ = rotation.rs_rotation(p.series_daily(spark, sf), _legs(spark, sf))
    return p.rounded(rets.drop("portfolio_id"))


define("sidx", "SELECT series_id, ts, value, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS idx FROM dseries WHERE series_id = '4-NOT SPECIFIED'", "dseries")
define("semas", _ema_sql("sidx", "series_id", (60, 15), "value"), "sidx")
define(
    "votes",
    """SELECT *, CASE WHEN spot > el THEN 1 ELSE 0 END + CASE WHEN spot > es THEN 1 ELSE 0 END + CASE WHEN rse > rsd THEN 1 ELSE 0 END AS votes FROM (
       SELECT e.ts, last_value(s.value IGNORE NULLS) OVER w AS spot, last_value(m.e1 IGNORE NULLS) OVER w AS el, last_value(m.e2 IGNORE NULLS) OVER w AS es,
         e.r AS re, d.r AS rd, e.v / lag(e.v, 20) OVER w - 1 AS rse, d.v / lag(d.v, 20) OVER w - 1 AS rsd
       FROM filled e JOIN filled d ON d.ts = e.ts AND d.series_id = '1-URGENT' LEFT JOIN sidx s ON s.ts = e.ts LEFT JOIN semas m ON m.idx = s.idx
       WHERE e.series_id = '5-LOW' WINDOW w AS (ORDER BY e.ts))""",
    "filled",
    "sidx",
    "semas",
)
define(
    "vhold",
    """SELECT *, coalesce(lag(holding) OVER (ORDER BY ts), '5-LOW') AS was FROM (SELECT *, coalesce(last_value(target IGNORE NULLS) OVER (ORDER BY ts), '5-LOW') AS holding FROM (
       SELECT *, CASE WHEN month(ts) <> month(lag(ts) OVER w) OR year(ts) <> year(lag(ts) OVER w) THEN CASE WHEN lag(rse) OVER w IS NOT NULL AND lag(rsd) OVER w IS NOT NULL THEN
           CASE WHEN lag(votes) OVER w >= 2 THEN '5-LOW' ELSE '1-URGENT' END END END AS target, lag(ts) OVER w AS dts, lag(votes) OVER w AS dvotes
       FROM votes WINDOW w AS (ORDER BY ts)))""",
    "votes",
)


def _vote(spark, sf):
    s = p.series_daily(spark, sf)
    ids = s.agg(F.min("series_id").alias("a"), F.max("series_id").alias("b"))
    legs = ids.select(
        F.lit("p1").alias("portfolio_id"),
        F.lit("4-NOT SPECIFIED").alias("spot_id"),
        F.col("b").alias("equity_id"),
        F.col("a").alias("defensive_id"),
    )
    spot = s.where("series_id = '4-NOT SPECIFIED'")
    return rotation.vote_rotation(spot, s, legs, 60, 15, 20, 2)


@query("vote_rotation_returns", with_ctes(f"SELECT ts, {rnd('r')} AS ret FROM (SELECT ts, CASE WHEN was = '5-LOW' THEN re ELSE rd END AS r FROM vhold) WHERE r IS NOT NULL", "vhold"))
def vote_rotation_returns(spark, sf):
    """Daily returns of the vote rotation."""
    return p.rounded(_vote(spark, sf)[0].drop("portfolio_id"))


@query("vote_rotation_signals", with_ctes("SELECT ts AS exec_date, dts AS decision_date, holding AS position, dvotes AS votes FROM vhold WHERE target IS NOT NULL AND holding <> was", "vhold"))
def vote_rotation_signals(spark, sf):
    """Executed flips."""
    return _vote(spark, sf)[1].select("exec_date", "decision_date", "position", "votes")


@query(
    "vote_rotation_diagnostics",
    with_ctes(f"SELECT ts, {rnd('spot', 2)} AS spot, {rnd('el', 2)} AS ema_long, {rnd('es', 2)} AS ema_short, votes, holding FROM vhold", "vhold"),
)
def vote_rotation_diagnostics(spark, sf):
    """The vote day by day."""
    return p.rounded(_vote(spark, sf)[2].select("ts", "spot", "ema_long", "ema_short", "votes", "holding"), 2)


# -- cash flows -------------------------------------------------------------------------------


def _rets(spark, sf):
    s = resample.period_returns(p.series(spark, sf), "series_id", price="value")
    return s.where("ret IS NOT NULL").select("series_id", "ts", "ret")


define("rr", "SELECT series_id, ts, ret FROM sret WHERE ret IS NOT NULL", "sret")
define(
    "sip",
    """SELECT *, sum(1000e0 / coalesce(prv, 1)) OVER w AS units, count(*) OVER w * 1000e0 AS invested FROM (
       SELECT *, lag(nav) OVER w AS prv FROM (SELECT *, product(1 + ret) OVER (PARTITION BY series_id ORDER BY ts) AS nav FROM rr) WINDOW w AS (PARTITION BY series_id ORDER BY ts))
       WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    "rr",
)


@query("periodic_investment", with_ctes(f"SELECT series_id, ts, {rnd('nav')} AS nav, {rnd('units')} AS units, invested, {rnd('units * nav')} AS value FROM sip", "sip"))
def periodic_investment(spark, sf):
    """A fixed amount every month."""
    out = cashflows.periodic_investment(_rets(spark, sf), 1000.0)
    return p.rounded(out.select("series_id", "ts", "nav", "units", "invested", "value"))


def _xirr_sql(key, flows):
    """Newton's iteration over each portfolio's list of yearly-scaled flows."""
    npv = "list_sum(list_transform({0}, lambda c: c.a / pow(1 + {1}, c.t)))"
    dnpv = "list_sum(list_transform({0}, lambda c: -c.t * c.a / pow(1 + {1}, c.t + 1)))"
    return f"""xf AS MATERIALIZED (SELECT {key}, sum(n) AS n, list({{'t': (d - d0) / 365e0, 'a': a}} ORDER BY d) AS f FROM (
          SELECT *, min(d) OVER (PARTITION BY {key}) AS d0 FROM (SELECT {key}, CAST(ts AS DATE) AS d, sum(amount) AS a, count(*) AS n FROM {flows} GROUP BY 1, 2)) GROUP BY 1),
        it AS (SELECT {key}, n, f, 0.15e0 AS rate, false AS done, 0 AS k FROM xf
          UNION ALL SELECT {key}, n, f, CASE WHEN abs(nw - rate) < 1e-8 OR nw > -0.999e0 THEN nw ELSE -0.999e0 + 1e-6 END, abs(nw - rate) < 1e-8, k + 1 FROM (
            SELECT *, rate - {npv.format('f', 'rate')} / {dnpv.format('f', 'rate')} AS nw FROM it WHERE NOT done AND k < 100)),
        sol AS (SELECT {key}, n, f, arg_max(rate, k) AS rate, bool_or(done) AS done FROM it GROUP BY 1, 2, 3),
        xr AS (SELECT {key}, CASE WHEN n >= 2 AND (done OR abs({npv.format('f', 'rate')}) < 1) THEN rate END AS xirr FROM sol)"""


define("cflows", """SELECT o_custkey AS portfolio_id, CAST(o_orderdate AS DATE) AS ts, -CAST(round(o_totalprice * 100) AS BIGINT) / 100e0 AS amount FROM orders
       UNION ALL SELECT o_custkey, CAST(max(o_orderdate) AS DATE) + 200, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) * 112 // 100 AS BIGINT) / 100e0 FROM orders GROUP BY 1""")


@query("money_weighted_return", with_ctes(f", {_xirr_sql('portfolio_id', 'cflows')} SELECT portfolio_id, {rnd('xirr')} AS xirr FROM xr", "cflows").replace(")\n,", "),", 1))
def money_weighted_return(spark, sf):
    """One money-weighted return per customer."""
    o = p.table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    day = F.col("o_orderdate").cast("date")
    out = o.select(F.col("o_custkey").alias("portfolio_id"), day.alias("ts"), (-cents / F.lit(100.0)).alias("amount"))
    total = F.call_function("div", F.sum(cents) * 112, F.lit(100))
    final = o.groupBy(F.col("o_custkey").alias("portfolio_id")).agg(
        F.date_add(F.max(day), 200).alias("ts"), (total / F.lit(100.0)).alias("amount")
    )
    return p.rounded(cashflows.xirr(out.unionByName(final)))


@query(
    "periodic_investment_xirr",
    with_ctes(
        f""", pf AS (SELECT series_id, ts, -1000e0 AS amount FROM sip UNION ALL SELECT series_id, max(ts), arg_max(units * nav, ts) FROM sip GROUP BY 1),
        {_xirr_sql('series_id', 'pf')} SELECT series_id, {rnd('xirr')} AS xirr FROM xr""",
        "sip",
    ).replace(")\n,", "),", 1),
)
def periodic_investment_xirr(spark, sf):
    """Money-weighted return of the monthly plan."""
    path = materialise(cashflows.periodic_investment(_rets(spark, sf), 1000.0))
    return p.rounded(cashflows.xirr(cashflows.investment_flows(path, 1000.0), "series_id"))


define(
    "dyn",
    """SELECT series_id, unnest(s.out) AS e FROM (SELECT series_id, list_reduce(list({'ts': ts, 'r': ret, 'l': lret} ORDER BY ts), lambda s, x:
       list_transform([CASE
          WHEN s.ta IS NULL AND s.nav <= s.ath * (1 - 8e0 / 100) THEN {'ta': s.ath, 'u': CASE WHEN s.lu * s.ln > 0 THEN s.u + s.lu * s.ln / s.nav ELSE s.u END, 'lu': 0e0, 'mv': 'triggered'}
          WHEN s.ta IS NOT NULL AND s.nav >= s.ta * (1 + 5e0 / 100) THEN {'ta': NULL, 'u': s.u, 'lu': s.lu, 'mv': 'recovered'}
          ELSE {'ta': s.ta, 'u': s.u, 'lu': s.lu, 'mv': NULL} END], lambda z: {
          'ta': z.ta, 'u': z.u + CASE WHEN z.ta IS NULL THEN 1000 * 0.7e0 ELSE 1000e0 END / s.nav, 'lu': z.lu + CASE WHEN z.ta IS NULL THEN 1000 * (1 - 0.7e0) / s.ln ELSE 0e0 END,
          'nav': s.nav * (1 + x.r), 'ln': s.ln * (1 + x.l), 'ath': greatest(s.ath, s.nav * (1 + x.r)),
          'out': list_append(s.out, {'ts': x.ts, 'st': CASE WHEN z.ta IS NULL THEN 'normal' ELSE 'aggressive' END, 'mv': z.mv,
             'sv': (z.u + CASE WHEN z.ta IS NULL THEN 1000 * 0.7e0 ELSE 1000e0 END / s.nav) * (s.nav * (1 + x.r)),
             'lv': (z.lu + CASE WHEN z.ta IS NULL THEN 1000 * (1 - 0.7e0) / s.ln ELSE 0e0 END) * (s.ln * (1 + x.l)), 'n': len(s.out) + 1})})[1],
       {'ta': NULL::DOUBLE, 'u': 0e0, 'lu': 0e0, 'nav': 1e0, 'ln': 1e0, 'ath': 1e0, 'out': []::STRUCT(ts DATE, st VARCHAR, mv VARCHAR, sv DOUBLE, lv DOUBLE, n INTEGER)[]}) AS s
       FROM (SELECT a.series_id, a.ts, a.ret, coalesce(b.ret, 0) / 10 AS lret FROM rr a LEFT JOIN rr b ON b.series_id = '5-LOW' AND b.ts = a.ts) GROUP BY 1)""",
    "rr",
)


def _dynamic(spark, sf):
    rets = materialise(_rets(spark, sf))
    liquid = rets.where("series_id = '5-LOW'").select("ts", F.col("ret").alias("_l"))
    both = rets.join(liquid, "ts", "left").withColumn("liquid_ret", F.coalesce("_l", F.lit(0.0)) / 10)
    return cashflows.dynamic_allocation(both, 1000.0, 70.0, 8.0, 5.0)


@query(
    "dynamic_allocation",
    with_ctes(
        f"""SELECT series_id, e.ts AS ts, e.st AS state, e.mv AS transition, {rnd('e.sv', 4)} AS strategy_value, {rnd('e.lv', 4)} AS liquid_value,
        {rnd('e.sv + e.lv', 4)} AS value, e.n * 1000e0 AS invested FROM dyn""",
        "dyn",
    ),
)
def dynamic_allocation(spark, sf):
    """Two sleeves with a drawdown trigger."""
    return p.rounded(_dynamic(spark, sf), 4)


@query(
    "allocation_summary",
    with_ctes(
        "SELECT series_id, count(*) AS n_periods, count(*) FILTER (e.st = 'aggressive') AS aggressive_periods, count(e.mv) // 2 AS n_cycles FROM dyn GROUP BY 1",
        "dyn",
    ),
)
def allocation_summary(spark, sf):
    """Periods in the aggressive state and cycles."""
    return cashflows.allocation_summary(_dynamic(spark, sf))


define(
    "epi",
    """SELECT series_id, e.ts AS ts, e.nav AS nav, e.b AS b, e.f AS f, e.dd AS dd FROM (SELECT series_id, unnest(s.out) AS e FROM (SELECT series_id, list_reduce(list({'ts': ts, 'r': ret} ORDER BY ts), lambda s, x:
       list_transform([{'fire': s.ta IS NULL AND s.nav <= s.ath * (1 - 10e0 / 100), 'reset': s.ta IS NOT NULL AND s.nav >= s.ta * (1 + 2e0 / 100)}], lambda z: {
          'ta': CASE WHEN z.fire THEN s.ath WHEN z.reset THEN NULL ELSE s.ta END, 'nav': s.nav * (1 + x.r), 'ath': greatest(s.ath, s.nav * (1 + x.r)),
          'out': list_append(s.out, {'ts': x.ts, 'nav': s.nav * (1 + x.r), 'b': s.nav, 'f': z.fire, 'dd': CASE WHEN z.fire THEN s.nav / s.ath - 1 END})})[1],
       {'ta': NULL::DOUBLE, 'nav': 1e0, 'ath': 1e0, 'out': []::STRUCT(ts DATE, nav DOUBLE, b DOUBLE, f BOOLEAN, dd DOUBLE)[]}) AS s FROM rr GROUP BY 1))""",
    "rr",
)
define(
    "epv",
    """SELECT *, sum(CASE WHEN f THEN 5000e0 / b ELSE 0e0 END) OVER w * nav AS value, count(*) FILTER (f) OVER w * 5000e0 AS invested
       FROM epi WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    "epi",
)


def _episodes(spark, sf):
    e = cashflows.drawdown_episodes(_rets(spark, sf), 10.0, 2.0)
    return materialise(cashflows.episode_values(e, 5000.0))


@query("drawdown_episodes", with_ctes(f"SELECT series_id, ts, f AS fired, {rnd('dd')} AS drawdown_at, {rnd('value', 4)} AS value, invested FROM epv", "epv"))
def drawdown_episodes(spark, sf):
    """One investment per drawdown episode."""
    out = _episodes(spark, sf).select("series_id", "ts", "fired", "drawdown_at", "value", "invested")
    return p.rounded(p.rounded(out, 6, "value"), 4, "drawdown_at")


@query(
    "episode_breakdown",
    with_ctes(
        f""", pf AS (SELECT series_id, ts, -5000e0 AS amount FROM epi WHERE f UNION ALL SELECT series_id, max(ts), arg_max(value, ts) FROM epv GROUP BY 1 HAVING bool_or(f)),
        {_xirr_sql('series_id', 'pf')} SELECT series_id, arg_max(invested, ts) AS total_invested, {rnd('arg_max(value, ts)', 4)} AS final_value, count(*) FILTER (f) AS n_triggers,
        {rnd('any_value(x.xirr)')} AS xirr FROM epv LEFT JOIN xr x USING (series_id) GROUP BY 1""",
        "epv",
    ).replace(")\n,", "),", 1),
)
def episode_breakdown(spark, sf):
    """Per instrument totals of the drawdown plan."""
    out = cashflows.episode_breakdown(_episodes(spark, sf), 5000.0)
    return p.rounded(p.rounded(out, 6, "final_value"), 4, "xirr")


define("epx", "SELECT * FROM epv WHERE (series_id <> '2-HIGH' OR ts >= DATE '1996-01-01') AND (series_id <> '3-MEDIUM' OR month(ts) <> 7)", "epv")


@query(
    "combined_sleeves",
    with_ctes(
        f"""SELECT ts, {rnd('sum(coalesce(v, 0))', 4)} AS value, sum(coalesce(i, 0)) AS invested FROM (
        SELECT g.ts, last_value(e.value IGNORE NULLS) OVER w AS v, last_value(e.invested IGNORE NULLS) OVER w AS i FROM
        (SELECT s.series_id, t.ts FROM (SELECT DISTINCT series_id FROM epx) s CROSS JOIN (SELECT DISTINCT ts FROM epx) t) g LEFT JOIN epx e USING (series_id, ts)
        WINDOW w AS (PARTITION BY g.series_id ORDER BY g.ts)) GROUP BY 1""",
        "epx",
    ),
)
def combined_sleeves(spark, sf):
    """C4: sleeves of different histories added up."""
    v = _episodes(spark, sf).where("series_id <> '2-HIGH' OR ts >= DATE '1996-01-01'").where("series_id <> '3-MEDIUM' OR month(ts) <> 7")
    return p.rounded(cashflows.combine_sleeves(v), 4)


@query(
    "plan_comparison",
    with_ctes(
        f"""SELECT a.series_id, a.ts, {rnd('a.units * a.nav', 4)} AS value, {rnd('b.value', 4)} AS other_value, {rnd('a.units * a.nav + b.value', 4)} AS combined_value
        FROM sip a LEFT JOIN epv b USING (series_id, ts)""",
        "sip",
        "epv",
    ),
)
def plan_comparison(spark, sf):
    """Two plans side by side and added up."""
    sip = cashflows.periodic_investment(_rets(spark, sf), 1000.0)
    return p.rounded(cashflows.compare_series(sip, _episodes(spark, sf)), 4)
