"""Indicators, ranking, holdings, returns, overlays and performance on the monthly panel (W*, H*, T1-T3, G*, J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import holdings, indicators, perf, ranking, resample
from barloom.operators.ranking import RankParams
from barloom.plans import backtest
from workload import panels as p
from workload.panels import define, rnd, with_ctes
from workload.registry import query

N = 5

# -- indicators -------------------------------------------------------------------------------


@query("period_prices", with_ctes("SELECT symbol, period_end, period_no, price FROM panel", "panel"))
def period_prices(spark, sf):
    """The monthly panel itself."""
    return p.monthly_panel(spark, sf)


@query("period_returns", with_ctes(f"SELECT symbol, period_end, {rnd('r')} AS ret FROM ret", "ret"))
def period_returns(spark, sf):
    """One-period return, NULL across a gap."""
    return p.rounded(resample.period_returns(p.monthly_panel(spark, sf)).select("symbol", "period_end", "ret"))


@query(
    "period_returns_padded",
    with_ctes(
        f"""SELECT symbol, period_no, {rnd('px / lag(px) OVER (PARTITION BY symbol ORDER BY period_no) - 1')} AS ret FROM (
        SELECT g.symbol, g.no AS period_no, last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.no) AS px
        FROM (SELECT symbol, CAST(unnest(range(min(period_no), (SELECT max(period_no) + 1 FROM panel))) AS INTEGER) AS no
              FROM panel WHERE period_no % 5 <> 3 GROUP BY 1) g
        LEFT JOIN panel p ON p.symbol = g.symbol AND p.period_no = g.no AND p.period_no % 5 <> 3)""",
        "panel",
    ),
)
def period_returns_padded(spark, sf):
    """One-period return with missing periods carried forward."""
    panel = p.monthly_panel(spark, sf).withColumn("price", F.when(F.col("period_no") % 5 != 3, F.col("price")))
    return p.rounded(resample.period_returns(panel, gap="pad").select("symbol", "period_no", "ret"))


define(
    "mom",
    """SELECT a.symbol, a.period_end, a.period_no, a.price, e.price / s.price - 1 AS mom FROM panel a
       LEFT JOIN panel e ON e.symbol = a.symbol AND e.period_no = a.period_no - 1
       LEFT JOIN panel s ON s.symbol = a.symbol AND s.period_no = a.period_no - 13""",
    "panel",
)
define(
    "vol",
    """SELECT a.symbol, a.period_no, stddev_samp(b.r) * sqrt(12e0) AS vol FROM panel a
       LEFT JOIN ret b ON b.symbol = a.symbol AND b.period_no BETWEEN a.period_no - 12 AND a.period_no - 1 GROUP BY 1, 2""",
    "ret",
)


@query("momentum_score", with_ctes(f"SELECT symbol, period_end, {rnd('mom')} AS score FROM mom", "mom"))
def momentum_score(spark, sf):
    """Trailing return with skip."""
    return p.rounded(indicators.momentum(p.monthly_panel(spark, sf), 12, 1).select("symbol", "period_end", "score"))


@query("trailing_volatility", with_ctes(f"SELECT symbol, period_no, {rnd('vol')} AS volatility FROM vol", "vol"))
def trailing_volatility(spark, sf):
    """Annualised volatility of the same window."""
    out = indicators.trailing_volatility(p.monthly_panel(spark, sf), 12, 1)
    return p.rounded(out.select("symbol", "period_no", "volatility"))


@query(
    "relative_return",
    with_ctes(
        f"""SELECT a.series_id, a.ts, {rnd('a.value / b.value - 1')} AS trail_24, {rnd('a.value / c.value - 1')} AS trail_9 FROM series a
        LEFT JOIN series b ON b.series_id = a.series_id AND b.period_no = a.period_no - 24
        LEFT JOIN series c ON c.series_id = a.series_id AND c.period_no = a.period_no - 9""",
        "series",
    ),
)
def relative_return(spark, sf):
    """Trailing returns of aligned series."""
    out = indicators.relative_return(p.series(spark, sf), [24, 9])
    return p.rounded(out.select("series_id", "ts", "trail_24", "trail_9"))


@query(
    "own_trailing_return",
    with_ctes(f"SELECT series_id, ts, {rnd('value / lag(value, 55) OVER (PARTITION BY series_id ORDER BY ts) - 1')} AS trailing_return FROM dseries", "dseries"),
)
def own_trailing_return(spark, sf):
    """Return over the series' own rows."""
    out = indicators.own_trailing_return(p.series_daily(spark, sf), 55)
    return p.rounded(out.select("series_id", "ts", "trailing_return"))


# -- ranking ----------------------------------------------------------------------------------

define(
    "ranking",
    """SELECT symbol, period_end, period_no, price, mom, row_number() OVER (PARTITION BY period_no ORDER BY round(mom, 9) DESC, symbol) AS rank
       FROM mom WHERE mom IS NOT NULL AND price >= 10""",
    "mom",
)
define(
    "franking",
    """SELECT symbol, period_end, period_no, score, vol, row_number() OVER (PARTITION BY period_no ORDER BY round(score, 9) DESC, symbol) AS rank
       FROM (SELECT m.*, v.vol, m.mom / v.vol AS score FROM mom m JOIN vol v USING (symbol, period_no) JOIN high52 h USING (symbol, period_end)
       WHERE m.mom IS NOT NULL AND m.price >= 10 AND m.mom <= 3 AND v.vol <= 4 AND v.vol > 1e-9 AND m.price / h.high_52w >= 0.3
       AND EXISTS (SELECT 1 FROM members s WHERE s.symbol = m.symbol AND m.period_end >= s."start" AND (s."end" IS NULL OR m.period_end <= s."end")))""",
    "mom",
    "vol",
    "high52",
    "members",
)


def _ranking(spark, sf, panel=None):
    return ranking.rank_universe(panel or p.monthly_panel(spark, sf), [RankParams()])


@query("ranking", with_ctes(f"SELECT period_end, symbol, {rnd('mom')} AS score, rank FROM ranking", "ranking"))
def rank_all(spark, sf):
    """Momentum rank of every eligible name in every period."""
    return p.rounded(_ranking(spark, sf).select("period_end", "symbol", "score", "rank"))


@query("ranking_in_ranges", with_ctes(f"SELECT period_end, symbol, {rnd('mom')} AS score, rank FROM ranking", "ranking"))
def ranking_in_ranges(spark, sf):
    """W6 for very large cross-sections: ranked in score ranges."""
    out = ranking.rank_whole(ranking.score_universe(p.monthly_panel(spark, sf), [RankParams()]))
    return p.rounded(out.select("period_end", "symbol", "score", "rank"))


@query(
    "ranking_filtered",
    with_ctes(f"SELECT period_end, symbol, {rnd('score')} AS score, {rnd('vol')} AS volatility, rank FROM franking", "franking"),
)
def ranking_filtered(spark, sf):
    """Risk-adjusted score with all filters and point-in-time membership."""
    params = RankParams(
        max_volatility_pct=400.0,
        use_risk_adjusted=True,
        max_trailing_return_pct=300.0,
        max_drawdown_from_52w_high_pct=70.0,
        use_membership=True,
    )
    out = ranking.rank_universe(
        p.monthly_panel(spark, sf), [params], p.membership(spark, sf), daily=p.daily_bars(spark, sf)
    )
    return p.rounded(out.select("period_end", "symbol", "score", "volatility", "rank"))


_GRID = [(lb, sk, u) for lb in (6, 12) for sk in (0, 1) for u in (None, "small")]


@query(
    "ranking_many_strategies",
    with_ctes(
        """SELECT 'l' || lb || '_s' || sk || '_' || u AS strategy_id, period_end, symbol, row_number() OVER (PARTITION BY lb, sk, u, period_no ORDER BY round(m, 9) DESC, symbol) AS rank FROM (
        SELECT a.symbol, a.period_end, a.period_no, lb, sk, u, e.price / s.price - 1 AS m FROM panel a
        CROSS JOIN (VALUES (6, 0), (6, 1), (12, 0), (12, 1)) g(lb, sk) CROSS JOIN (VALUES ('all'), ('small')) h(u)
        JOIN panel e ON e.symbol = a.symbol AND e.period_no = a.period_no - sk
        JOIN panel s ON s.symbol = a.symbol AND s.period_no = a.period_no - sk - lb
        WHERE a.price >= 10 AND (u = 'all' OR a.symbol IN (SELECT symbol FROM brands WHERE k <= 10)))""",
        "panel",
        "brands",
    ),
)
def ranking_many_strategies(spark, sf):
    """A grid of parameter sets in one plan."""
    params = [RankParams(f"l{lb}_s{sk}_{u or 'all'}", lb, sk, universe=u) for lb, sk, u in _GRID]
    out = ranking.rank_universe(p.monthly_panel(spark, sf), params, universes=p.universes(spark, sf))
    return out.select("strategy_id", "period_end", "symbol", "rank")


@query(
    "universe_calendar_weakest",
    with_ctes(
        f"""SELECT period_end, symbol, entry_rank FROM (SELECT *, row_number() OVER (PARTITION BY period_no ORDER BY rank DESC) AS entry_rank,
        count(*) OVER (PARTITION BY period_no) AS n FROM ranking JOIN brands USING (symbol) WHERE k % 2 = 0)
        WHERE n >= {N} AND entry_rank <= {N} AND period_end >= DATE '1997-01-01'""",
        "ranking",
        "brands",
    ),
)
def universe_calendar_weakest(spark, sf):
    """The weakest names of a restricted universe with the count gate."""
    allowed = p.universes(spark, sf).where("universe_id = 'tradable'")
    out = ranking.universe_calendar(_ranking(spark, sf), N, weakest=True, allowed=allowed, start="1997-01-01")
    return out.select("period_end", "symbol", "entry_rank")


@query(
    "latest_ranking_table",
    with_ctes(
        f"""SELECT symbol, rank, coalesce(company, '-') AS company, coalesce(industry, '-') AS industry, {rnd('price', 2)} AS price,
        CASE WHEN rank <= 10 THEN 'Buy zone' WHEN rank <= 18 THEN 'Hold zone' ELSE 'Out' END AS zone FROM ranking
        LEFT JOIN (SELECT p_brand AS symbol, min(p_name) AS company, max(p_type) AS industry FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1) USING (symbol)
        WHERE period_no = (SELECT max(period_no) FROM ranking WHERE period_no BETWEEN (SELECT max(period_no) FROM panel) - 3 AND (SELECT max(period_no) FROM panel))""",
        "ranking",
    ),
)
def latest_ranking_table(spark, sf):
    """The newest ranking with names and zones, falling back up to three periods."""
    panel = p.monthly_panel(spark, sf)
    last = panel.agg(F.max("period_no")).scalar()
    names = p.table(spark, sf, "part").where("p_brand <> 'Brand#3'").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.min("p_name").alias("company"), F.max("p_type").alias("industry")
    )
    out = ranking.ranked_table(ranking.latest_ranked(_ranking(spark, sf, panel), last), names)
    return p.rounded(out.select("symbol", "rank", "company", "industry", "price", "zone"), 2)


@query("needed_symbols", with_ctes("SELECT DISTINCT symbol FROM ranking WHERE rank <= 2 AND period_end >= DATE '2000-06-01'", "ranking"))
def needed_symbols(spark, sf):
    """Every name ever ranked near the top."""
    return ranking.needed_symbols(_ranking(spark, sf), 2, "2000-06-01")


@query("all_universe_symbols", with_ctes("SELECT DISTINCT symbol FROM universe", "universe"))
def all_universe_symbols(spark, sf):
    """Union of all lists."""
    return p.universes(spark, sf).select("symbol").distinct()


@query(
    "coverage",
    with_ctes(
        "SELECT count(DISTINCT symbol) AS n_symbols, min(period_end) AS first_day, max(period_end) AS last_day, count(DISTINCT period_end) AS n_periods FROM panel",
        "panel",
    ),
)
def coverage(spark, sf):
    """What the panel holds."""
    return perf.coverage(p.monthly_panel(spark, sf))


# -- holdings ---------------------------------------------------------------------------------

define("span", "SELECT CAST(unnest(range((SELECT min(period_no) + 14 FROM panel), (SELECT max(period_no) + 1 FROM panel))) AS INTEGER) AS period_no", "panel")
define("counts", "SELECT s.period_no, count(r.symbol) AS cnt FROM span s LEFT JOIN ranking r USING (period_no) GROUP BY 1", "span", "ranking")


@query("average_eligible", with_ctes(f"SELECT {rnd('avg(nullif(cnt, 0))')} AS avg_eligible FROM counts", "counts"))
def average_eligible(spark, sf):
    """Mean size of the ranked universe."""
    panel = p.monthly_panel(spark, sf)
    span = holdings.strategy_periods(panel, [RankParams()])
    counts = span.join(holdings.ranked_counts(_ranking(spark, sf, panel)), ["strategy_id", "period_no"], "left").na.fill(0)
    return p.rounded(perf.average_eligible(counts).drop("strategy_id"))



def _schedule_sql(hold: int, n: int) -> str:
    """Due dates by a list fold over the periods."""
    return f"""SELECT e.no AS period_no, CAST(row_number() OVER (ORDER BY e.no) - 1 AS INTEGER) AS rebalance_no FROM (SELECT unnest(s.out) AS e FROM (
      SELECT list_reduce(list({{'no': period_no, 'cnt': cnt}} ORDER BY period_no), lambda s, x:
        CASE WHEN (len(s.out) = 0 OR s.age + 1 >= {hold}) AND x.cnt >= {n} THEN {{'age': 0, 'out': list_append(s.out, {{'no': x.no}})}}
             ELSE {{'age': s.age + 1, 'out': s.out}} END, {{'age': 0, 'out': []::STRUCT(no INTEGER)[]}}) AS s FROM counts))"""


define("sched", _schedule_sql(1, N), "counts")
define("sched3", _schedule_sql(3, N), "counts")
define("held", f"SELECT s.period_no, s.rebalance_no, r.period_end, r.symbol, r.rank AS slot FROM sched s JOIN ranking r USING (period_no) WHERE r.rank <= {N}", "sched", "ranking")
define("held3", f"SELECT s.period_no, s.rebalance_no, r.period_end, r.symbol, r.rank AS slot FROM sched3 s JOIN ranking r USING (period_no) WHERE r.rank <= {N}", "sched3", "ranking")
for _i in ("", "3"):
    define(
        f"spell{_i}",
        f"""SELECT rebalance_no, period_no AS reb, CAST(unnest(range(period_no + 1, coalesce(lead(period_no) OVER (ORDER BY period_no),
            (SELECT max(period_no) FROM panel)) + 1)) AS INTEGER) AS period_no FROM sched{_i}""",
        f"sched{_i}",
        "panel",
    )
define(
    "base_ret",
    """SELECT s.period_no, coalesce(avg(r.r), 0) AS ret FROM span s LEFT JOIN spell USING (period_no)
       LEFT JOIN held h ON h.rebalance_no = spell.rebalance_no LEFT JOIN ret r ON r.symbol = h.symbol AND r.period_no = s.period_no GROUP BY 1""",
    "span",
    "spell",
    "held",
    "ret",
)
define("base_ret_d", "SELECT base_ret.*, CAST(last_day(make_date(period_no // 12, period_no % 12 + 1, 1)) AS DATE) AS period_end FROM base_ret", "base_ret")


def _test(spark, sf, panel=None, **kw):
    panel = panel or p.monthly_panel(spark, sf)
    rank = kw.pop("rank", RankParams())
    return panel, backtest.run(panel, [backtest.Strategy(rank, n=kw.pop("n", N), **kw)])


@query("rebalance_schedule", with_ctes("SELECT period_no, rebalance_no FROM sched3", "sched3"))
def rebalance_schedule(spark, sf):
    """H1: due dates with retry."""
    _, t = _test(spark, sf, hold=3)
    return t.schedule.select("period_no", "rebalance_no")


@query("top_n_holdings", with_ctes("SELECT period_end AS rebalance_date, symbol, slot FROM held", "held"))
def top_n_holdings(spark, sf):
    """H2: the first N of each rebalance."""
    _, t = _test(spark, sf)
    return t.holdings.select("rebalance_date", "symbol", "slot")


define(
    "band",
    f"""SELECT e.no AS period_no, e.k AS rebalance_no, unnest(e.held) AS symbol, generate_subscripts(e.held, 1) AS slot FROM (SELECT unnest(s.out) AS e FROM (
       SELECT list_reduce(list({{'no': period_no, 'k': rebalance_no, 'best': best}} ORDER BY period_no), lambda s, x: {{
          'held': list_concat(list_filter(s.held, lambda h: list_contains(x.best, h)),
             list_slice(list_filter(x.best, lambda b: NOT list_contains(s.held, b)), 1,
                greatest({N} - len(list_filter(s.held, lambda h: list_contains(x.best, h))), 0))),
          'out': list_append(s.out, {{'no': x.no, 'k': x.k, 'held': list_concat(list_filter(s.held, lambda h: list_contains(x.best, h)),
             list_slice(list_filter(x.best, lambda b: NOT list_contains(s.held, b)), 1,
                greatest({N} - len(list_filter(s.held, lambda h: list_contains(x.best, h))), 0)))}})}},
         {{'held': []::VARCHAR[], 'out': []::STRUCT(no INTEGER, k INTEGER, held VARCHAR[])[]}}) AS s
       FROM (SELECT s.period_no, s.rebalance_no, list(r.symbol ORDER BY r.rank) AS best FROM sched s JOIN ranking r USING (period_no) WHERE r.rank <= 8 GROUP BY 1, 2)))""",
    "sched",
    "ranking",
)


@query("exit_band_holdings", with_ctes("SELECT period_no, symbol, slot FROM band", "band"))
def exit_band_holdings(spark, sf):
    """H3: hysteresis at 1.6 x N."""
    _, t = _test(spark, sf, exit_band_pct=60.0)
    return t.holdings.select("period_no", "symbol", "slot")


define(
    "rsig",
    """SELECT s.period_no, c.cnt, coalesce(gn.value / gb.value > en.value / eb.value, false) AS to_gold, coalesce(en.value / ec.value > gn.value / gc.value, false) AS to_equity
       FROM span s JOIN counts c USING (period_no)
       LEFT JOIN series gn ON gn.series_id = '1-URGENT' AND gn.period_no = s.period_no LEFT JOIN series gb ON gb.series_id = '1-URGENT' AND gb.period_no = s.period_no - 10
       LEFT JOIN series gc ON gc.series_id = '1-URGENT' AND gc.period_no = s.period_no - 4
       LEFT JOIN series en ON en.series_id = '2-HIGH' AND en.period_no = s.period_no LEFT JOIN series eb ON eb.series_id = '2-HIGH' AND eb.period_no = s.period_no - 10
       LEFT JOIN series ec ON ec.series_id = '2-HIGH' AND ec.period_no = s.period_no - 4""",
    "counts",
    "span",
    "series",
)
define(
    "rsched",
    f"""SELECT e.no AS period_no, e.r AS regime, CAST(row_number() OVER (ORDER BY e.no) - 1 AS INTEGER) AS rebalance_no FROM (SELECT unnest(s.out) AS e FROM (
      SELECT list_reduce(list({{'no': period_no, 'cnt': cnt, 'g': to_gold, 'e': to_equity}} ORDER BY period_no), lambda s, x: CASE
        WHEN (s.gold OR s.holding) AND s.age + 1 < 2 THEN {{'gold': s.gold, 'holding': s.holding, 'age': s.age + 1, 'out': s.out}}
        WHEN (s.gold AND NOT x.e) OR (NOT s.gold AND x.g) THEN {{'gold': true, 'holding': false, 'age': 0, 'out': list_append(s.out, {{'no': x.no, 'r': 'gold'}})}}
        WHEN x.cnt >= {N} THEN {{'gold': false, 'holding': true, 'age': 0, 'out': list_append(s.out, {{'no': x.no, 'r': 'equity'}})}}
        ELSE {{'gold': false, 'holding': s.holding, 'age': s.age + 1, 'out': s.out}} END,
        {{'gold': false, 'holding': false, 'age': 0, 'out': []::STRUCT(no INTEGER, r VARCHAR)[]}}) AS s FROM rsig))""",
    "rsig",
)


def _regime_test(spark, sf):
    panel = p.monthly_panel(spark, sf)
    s = backtest.Strategy(RankParams(), hold=2, n=N, regime=("2-HIGH", "1-URGENT"), gold_entry=10, gold_exit=4)
    return panel, backtest.run(panel, [s], series=p.series(spark, sf))


@query("regime_schedule", with_ctes("SELECT period_no, regime, rebalance_no FROM rsched", "rsched"))
def regime_schedule(spark, sf):
    """H4: two-threshold switch between equity and gold, evaluated at due dates."""
    _, t = _regime_test(spark, sf)
    return t.schedule.select("period_no", "regime", "rebalance_no")


define(
    "rseg",
    """SELECT *, sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER (ORDER BY rebalance_no) AS seg FROM (
       SELECT *, CAST(last_day(make_date(period_no // 12, period_no % 12 + 1, 1)) AS DATE) AS d,
         coalesce(regime <> lag(regime) OVER (ORDER BY rebalance_no), true) AS flip FROM rsched)""",
    "rsched",
)


@query(
    "regime_segments",
    with_ctes(
        """SELECT CAST(seg AS BIGINT) AS segment_no, min(d) AS start, coalesce(lead(min(d)) OVER (ORDER BY seg), (SELECT max(d) FROM rseg)) AS last_rebalance,
        any_value(regime) AS regime FROM rseg GROUP BY seg""",
        "rseg",
    ),
)
def regime_segments(spark, sf):
    """H5: stretches of one regime."""
    _, t = _regime_test(spark, sf)
    return holdings.regime_segments(t.schedule).drop("strategy_id")

