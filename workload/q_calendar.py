"""Cleaning, calendars, resampling, alignment and joins (A*, R*, J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.operators import clean, grid, indicators, ranking, resample, upsert
from workload import panels as p
from workload.panels import define, rnd, with_ctes
from workload.registry import query

# -- cleaning ---------------------------------------------------------------------------------


@query(
    "repair_spikes",
    with_ctes(
        f"""SELECT symbol, ts, spike AS repaired, {rnd('CASE WHEN spike THEN (prv + nxt) / 2 ELSE close END')} AS close FROM (
        SELECT a.symbol, a.ts, a.close, b.close AS prv, n.close AS nxt,
          coalesce((a.close / b.close > 1.5 OR a.close / b.close < 2e0 / 3) AND (a.close / b.close) * (n.close / a.close) > 0.9
                   AND (a.close / b.close) * (n.close / a.close) < 1.1, false) AS spike
        FROM ibars a LEFT JOIN ibars b ON b.symbol = a.symbol AND b.idx = a.idx - 1
        LEFT JOIN ibars n ON n.symbol = a.symbol AND n.idx = a.idx + 1)""",
        "ibars",
    ),
)
def repair_spikes(spark, sf):
    """A1: one-slot spikes that revert."""
    out = clean.repair_spikes(p.daily_bars(spark, sf))
    return p.rounded(out.select("symbol", "ts", "repaired", "close"))


@query(
    "repair_crash_runs",
    with_ctes(
        """, lists AS (SELECT series_id, list({'ts': ts, 'v': value} ORDER BY ts) AS l FROM dseries GROUP BY 1),
        state AS (SELECT series_id, list_reduce(l, lambda s, x: CASE
            WHEN s.good IS NULL THEN {'good': x.v, 'bad': []::STRUCT(ts DATE, v DOUBLE)[], 'out': [{'ts': x.ts, 'value': x.v, 'repaired': false}]}
            WHEN x.v / s.good < 0.85 THEN {'good': s.good, 'bad': list_append(s.bad, x), 'out': s.out}
            ELSE {'good': x.v, 'bad': []::STRUCT(ts DATE, v DOUBLE)[], 'out': list_concat(s.out,
                list_transform(s.bad, lambda b, i: CASE WHEN abs(x.v / s.good - 1) < 0.03
                  THEN {'ts': b.ts, 'value': s.good + (x.v - s.good) * i / (len(s.bad) + 1), 'repaired': true}
                  ELSE {'ts': b.ts, 'value': b.v, 'repaired': false} END), [{'ts': x.ts, 'value': x.v, 'repaired': false}])} END,
            {'good': NULL::DOUBLE, 'bad': []::STRUCT(ts DATE, v DOUBLE)[], 'out': []::STRUCT(ts DATE, value DOUBLE, repaired BOOLEAN)[]}) AS s FROM lists)
        SELECT series_id, e.ts AS ts, """
        + rnd("e.value", 8)
        + """ AS value, e.repaired AS repaired FROM (SELECT series_id, unnest(list_concat(s.out,
            list_transform(s.bad, lambda b: {'ts': b.ts, 'value': b.v, 'repaired': false}))) AS e FROM state)""",
        "dseries",
    ).replace(")\n,", "),", 1),
)
def repair_crash_runs(spark, sf):
    """A2: multi-day crashes that fully revert."""
    return p.rounded(clean.repair_crash_runs(p.series_daily(spark, sf)), 8)


@query(
    "densify",
    with_ctes(
        "SELECT s.symbol, c.ts, c.idx, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal c LEFT JOIN bars b USING (symbol, ts)",
        "cal",
    ),
)
def densify(spark, sf):
    """A3: every instrument on every slot."""
    return grid.densify(p.daily_bars(spark, sf)).select("symbol", "ts", "idx", "close")


@query(
    "interpolate_linear",
    with_ctes(
        f"""SELECT symbol, ts, {rnd('CASE WHEN v IS NOT NULL THEN v WHEN lo.v IS NULL THEN NULL WHEN hi.v IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * (pos - lo.p) / (hi.p - lo.p) END')} AS value FROM (
        SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'p': pos, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS lo,
          first_value(CASE WHEN v IS NOT NULL THEN {{'p': pos, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi
        FROM (SELECT symbol, ts, CASE WHEN volume > 30 THEN close END AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM bars))""",
        "bars",
    ),
)
def interpolate_linear(spark, sf):
    """A4: straight lines across missing values."""
    rows = p.daily_bars(spark, sf).select("symbol", "ts", F.when(F.col("volume") > 30, F.col("close")).alias("value"))
    return p.rounded(grid.interpolate_linear(rows))


@query(
    "adjust_open",
    with_ctes(f"SELECT symbol, ts, {rnd('open * (adj_close / close)', 4)} AS open, {rnd('adj_close', 4)} AS close FROM bars", "bars"),
)
def adjust_open(spark, sf):
    """A5: open on the adjusted basis."""
    return p.rounded(
        clean.adjust_open(p.daily_bars(spark, sf)).select("symbol", "ts", "open", F.col("adj_close").alias("close")), 4
    )


@query("series_since", with_ctes("SELECT series_id, ts, value FROM dseries WHERE series_id <> '1-URGENT' OR ts >= DATE '1997-06-20'", "dseries"))
def series_since(spark, sf):
    """A10: stray first rows of one series cut off."""
    s = p.series_daily(spark, sf)
    late = clean.since(s.where("series_id = '1-URGENT'"), "1997-06-20")
    return s.where("series_id <> '1-URGENT'").unionByName(late)


@query(
    "last_complete_period",
    with_ctes(
        """SELECT symbol, coalesce(max(period_end) FILTER (WHERE period_end <= DATE '2001-10-15'), max(period_end)) AS last_period,
        max(period_end) > DATE '2001-10-15' AS is_partial FROM panel GROUP BY 1""",
        "panel",
    ),
)
def last_complete_period(spark, sf):
    """Latest period that has ended."""
    return grid.last_complete_period(p.monthly_panel(spark, sf), "2001-10-15", "symbol")


@query(
    "normalize_names",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(upper(text), '&', ' AND '),
        '[.\-,()'']', ' ', 'g'), '\b(LIMITED|LTD)\b', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) AS name
        FROM (SELECT p_partkey AS doc_id, 'The ' || p_name || ' & Co. (' || p_brand || '), Limited' AS text FROM part)""",
)
def normalize_names(spark, sf):
    """Names in comparable form."""
    text = F.concat(F.lit("The "), "p_name", F.lit(" & Co. ("), "p_brand", F.lit("), Limited"))
    return p.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), c.normalize_name(text).alias("name"))


# -- calendar and resampling -----------------------------------------------------------------


@query(
    "resample_month",
    with_ctes("SELECT symbol, last_day(ts) AS period_end, arg_max(close, ts) AS price FROM bars WHERE volume > 30 GROUP BY 1, 2", "bars"),
)
def resample_month(spark, sf):
    """Last non-null value of each month."""
    rows = p.daily_bars(spark, sf).withColumn("close", F.when(F.col("volume") > 30, F.col("close")))
    return resample.resample_last(rows, "month").select("symbol", "period_end", "price")


@query(
    "resample_week",
    with_ctes(
        "SELECT symbol, ts + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS period_end, arg_max(close, ts) AS price FROM bars GROUP BY 1, 2",
        "bars",
    ),
)
def resample_week(spark, sf):
    """R2: last value of each week ending on Friday."""
    return resample.resample_last(p.daily_bars(spark, sf), "week").select("symbol", "period_end", "price")


define(
    "hpairs",
    """SELECT ts, min(ts) OVER w AS first_ts, max(ts) OVER w AS last_ts FROM (
       SELECT ts, CAST(ts AS DATE) AS d, (row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) - 1) // 2 AS pair
       FROM hcal) WINDOW w AS (PARTITION BY d, pair)""",
    "hcal",
)


@query(
    "pair_bars_last_label",
    with_ctes(
        "SELECT symbol, strftime(last_ts, '%Y-%m-%d %H:%M') AS at, arg_min(open, h.ts) AS open, arg_max(close, h.ts) AS close FROM hours h JOIN hpairs q ON h.ts = q.ts GROUP BY 1, 2",
        "hours",
        "hpairs",
    ),
)
def pair_bars_last_label(spark, sf):
    """Two-slot bars, named after their last slot."""
    bars = p.intraday_bars(spark, sf).select("symbol", "ts", "open", "close")
    out = resample.pair_bars(bars, 2, "last")
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "open", "close")


@query(
    "pair_bars_first_label",
    with_ctes(
        "SELECT symbol, strftime(first_ts, '%Y-%m-%d %H:%M') AS at, arg_min(open, h.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, h.ts) AS close FROM hours h JOIN hpairs q ON h.ts = q.ts GROUP BY 1, 2",
        "hours",
        "hpairs",
    ),
)
def pair_bars_first_label(spark, sf):
    """Full two-slot bars, named after their first slot."""
    out = resample.pair_bars(p.intraday_bars(spark, sf), 2, "first")
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "open", "high", "low", "close")


@query(
    "compound_returns",
    with_ctes(f"SELECT series_id, year(ts) AS year, {rnd('product(1 + ret) - 1')} AS period_return FROM sret GROUP BY 1, 2", "sret"),
)
def compound_returns(spark, sf):
    """Returns compounded to a coarser grid."""
    s = resample.period_returns(p.series(spark, sf), "series_id", price="value").withColumn("year", F.year("ts"))
    return p.rounded(resample.compound(s, "ret", ["series_id", "year"]))


@query(
    "quarter_rebalance_dates",
    with_ctes("SELECT year(ts) * 4 + quarter(ts) - 1 AS quarter_no, min(ts) AS rebalance_date FROM dseries WHERE ts >= DATE '1995-05-10' GROUP BY 1", "dseries"),
)
def quarter_rebalance_dates(spark, sf):
    """First trading day of each quarter."""
    return resample.quarterly_rebalance_dates(p.series_daily(spark, sf), F.lit("1995-05-10").cast("date"))


@query(
    "month_execution_dates",
    with_ctes(
        "SELECT lag(b) OVER (ORDER BY a) AS decision_date, a AS exec_date FROM (SELECT min(ts) AS a, max(ts) AS b FROM dseries GROUP BY year(ts), month(ts)) QUALIFY decision_date IS NOT NULL",
        "dseries",
    ),
)
def month_execution_dates(spark, sf):
    """Decide on a month's last day, execute on the next month's first."""
    return resample.month_execution(p.series_daily(spark, sf))


define(
    "orange",
    """SELECT wk AS period_no, h.symbol, max(high) AS range_high, min(low) AS range_low FROM (
       SELECT ts, wk, row_number() OVER (PARTITION BY wk ORDER BY ts) AS n FROM (
         SELECT ts, CAST((CAST(ts AS DATE) - DATE '1970-01-02' + 6) // 7 AS INTEGER) AS wk,
                min(CAST(ts AS DATE)) OVER (PARTITION BY (CAST(ts AS DATE) - DATE '1970-01-02' + 6) // 7) AS d0 FROM hcal)
       WHERE CAST(ts AS DATE) = d0) s JOIN hours h ON h.ts = s.ts WHERE s.n <= 3 GROUP BY 1, 2""",
    "hcal",
    "hours",
)


@query("opening_range", with_ctes("SELECT * FROM orange", "orange"))
def opening_range(spark, sf):
    """High and low of each week's first bars."""
    return resample.opening_range(p.intraday_bars(spark, sf), resample.opening_bars(180), "week")


@query(
    "last_bar_of_period",
    with_ctes(
        """SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM hours WHERE ts IN (
        SELECT max(ts) FROM hours GROUP BY (CAST(ts AS DATE) - DATE '1970-01-02' + 6) // 7)""",
        "hours",
    ),
)
def last_bar_of_period(spark, sf):
    """Bars on the last slot of their period."""
    out = resample.last_bar_of_period(p.intraday_bars(spark, sf), "week").where("is_last_bar")
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


_GAPS = """SELECT symbol, CAST(prev AS DATE) AS gap_start, CAST(ts AS DATE) AS gap_end FROM (
    SELECT o_custkey AS symbol, o_orderdate AS ts, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS prev
    FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) WHERE ts - prev > INTERVAL 180 DAYS"""


def _gaps(spark, sf):
    o = p.table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("ts"))
    return resample.find_gaps(o, 180)


@query("find_gaps", _GAPS)
def find_gaps(spark, sf):
    """Holes in an instrument's history."""
    return _gaps(spark, sf).select(
        "symbol", F.col("gap_start").cast("date").alias("gap_start"), F.col("gap_end").cast("date").alias("gap_end")
    )


@query(
    "backfill_windows",
    f"""WITH g AS ({_GAPS}), w AS (SELECT *, gap_start - 1 AS lo, gap_end + 1 AS hi FROM g),
    r AS (SELECT *, unnest(range(0, (hi - lo + 90) // 91)) AS k FROM w)
    SELECT symbol, gap_start, CAST(k AS INTEGER) AS request_no, CAST(greatest(hi - CAST(k * 91 AS INTEGER) - 90, lo) AS DATE) AS from_day,
      CAST(hi - CAST(k * 91 AS INTEGER) AS DATE) AS to_day FROM r""",
)
def backfill_windows(spark, sf):
    """Gaps cut into request windows."""
    out = resample.backfill_windows(_gaps(spark, sf))
    day = lambda x, name: F.col(x).cast("date").alias(name)
    return out.select("symbol", day("gap_start", "gap_start"), "request_no", day("from_ts", "from_day"), day("to_ts", "to_day"))


# -- joins -----------------------------------------------------------------------------------


@query(
    "members_on_date",
    with_ctes(
        """SELECT symbol, period_end, price FROM panel WHERE EXISTS (SELECT 1 FROM members m WHERE m.symbol = panel.symbol
        AND period_end >= m."start" AND (m."end" IS NULL OR period_end <= m."end"))""",
        "panel",
        "members",
    ),
)
def members_on_date(spark, sf):
    """Point-in-time membership, both ends inclusive."""
    return ranking.members_on(p.monthly_panel(spark, sf), p.membership(spark, sf), "period_end").select(
        "symbol", "period_end", "price"
    )


@query(
    "allowed_universe",
    with_ctes("SELECT symbol, period_end, price FROM panel WHERE symbol IN (SELECT symbol FROM brands WHERE k <= 10 AND k % 2 = 0)", "panel", "brands"),
)
def allowed_universe(spark, sf):
    """Intersection of two symbol sets as a semi join."""
    u = p.universes(spark, sf)
    both = u.where("universe_id = 'small'").select("symbol").intersect(u.where("universe_id = 'tradable'").select("symbol"))
    return p.monthly_panel(spark, sf).join(both, "symbol", "left_semi").select("symbol", "period_end", "price")


@query(
    "asof_join",
    """SELECT o.o_orderkey AS order_id, r.ts AS matched_ts, r.value FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) o
    ASOF LEFT JOIN (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS ts, count(*) AS value FROM orders
      WHERE o_orderstatus = 'P' GROUP BY 1, 2) r ON o.o_orderpriority = r.k AND o.d >= r.ts""",
)
def asof_join(spark, sf):
    """Latest value at or before each row, in time blocks."""
    o = p.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderpriority").alias("k"),
        F.col("o_orderdate").cast("date").alias("ts"),
        "o_orderstatus",
    )
    right = o.where("o_orderstatus = 'P'").groupBy("k", "ts").agg(F.count("*").alias("value"))
    return grid.asof_join(o.drop("o_orderstatus"), right, "k", ["value"]).select("order_id", "matched_ts", "value")


define(
    "high52",
    """SELECT a.symbol, a.period_end, max(b.close) AS high_52w FROM panel a LEFT JOIN bars b ON b.symbol = a.symbol
       AND b.ts >= a.period_end - 365 AND b.ts < a.period_end GROUP BY 1, 2""",
    "panel",
    "bars",
)


@query("trailing_high", with_ctes("SELECT * FROM high52", "high52"))
def trailing_high(spark, sf):
    """Highest close of the year before each period end."""
    return indicators.trailing_high(p.daily_bars(spark, sf), p.monthly_panel(spark, sf))


_UPERIODS = "(SELECT DISTINCT period_no, period_end FROM panel WHERE period_no % 3 = 0)"


@query(
    "assign_period_raw",
    with_ctes(
        f"SELECT b.symbol, b.ts, u.period_no AS universe_no FROM bars b ASOF LEFT JOIN {_UPERIODS} u ON b.ts >= u.period_end",
        "bars",
        "panel",
    ),
)
def assign_period_raw(spark, sf):
    """Latest universe period by the raw day."""
    periods = p.monthly_panel(spark, sf).where("period_no % 3 = 0").select("period_no").distinct()
    return ranking.assign_period(p.daily_bars(spark, sf), periods, "raw").select("symbol", "ts", "universe_no")


@query(
    "assign_period_month_start",
    with_ctes(
        f"SELECT b.symbol, b.ts, u.period_no AS universe_no FROM (SELECT *, CAST(date_trunc('month', ts) AS DATE) AS m FROM bars) b ASOF LEFT JOIN {_UPERIODS} u ON b.m >= u.period_end",
        "bars",
        "panel",
    ),
)
def assign_period_month_start(spark, sf):
    """Latest universe period seen from the start of the bar's month."""
    periods = p.monthly_panel(spark, sf).where("period_no % 3 = 0").select("period_no").distinct()
    return ranking.assign_period(p.daily_bars(spark, sf), periods).select("symbol", "ts", "universe_no")


@query(
    "align_series",
    with_ctes(
        """SELECT series_id, ts, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts), 0) AS value FROM (
        SELECT g.series_id, g.ts, d.value FROM (SELECT s.series_id, t.ts FROM (SELECT DISTINCT series_id FROM dseries) s
          CROSS JOIN (SELECT ts FROM dseries WHERE series_id = '5-LOW') t) g
        LEFT JOIN (SELECT * FROM dseries WHERE day(ts) > 10 OR series_id = '5-LOW') d USING (series_id, ts))""",
        "dseries",
    ),
)
def align_series(spark, sf):
    """Other series carried onto one series' calendar."""
    s = p.series_daily(spark, sf)
    sparse = s.where("dayofmonth(ts) > 10 OR series_id = '5-LOW'")
    return grid.align(sparse, s.where("series_id = '5-LOW'").select("ts"), before=0.0)


@query("missing_symbols", with_ctes("SELECT symbol FROM brands WHERE symbol NOT IN (SELECT symbol FROM bars WHERE volume > 150)", "bars", "brands"))
def missing_symbols(spark, sf):
    """Needed minus present."""
    needed = p.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"))
    return ranking.missing_symbols(needed, p.daily_bars(spark, sf).where("volume > 150"))


@query(
    "next_trading_day",
    with_ctes(
        "SELECT symbol, period_end, (SELECT min(ts) FROM cal WHERE ts > period_end) AS next_ts FROM panel",
        "panel",
        "cal",
    ),
)
def next_trading_day(spark, sf):
    """First trading day after each rebalance."""
    panel = p.monthly_panel(spark, sf).select("symbol", "period_end")
    return grid.next_slot(panel, grid.calendar(p.daily_bars(spark, sf)), "period_end")


@query(
    "snap_to_period",
    with_ctes(
        "SELECT o_orderkey AS order_id, (SELECT max(period_end) FROM (SELECT DISTINCT period_end FROM panel) WHERE period_end <= CAST(o_orderdate AS DATE)) AS period_end FROM orders",
        "panel",
    ),
)
def snap_to_period(spark, sf):
    """Freely chosen dates snapped to the latest period end."""
    o = p.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("ts"))
    return grid.snap_to_period(o, p.monthly_panel(spark, sf)).select("order_id", "period_end")


# -- incremental maintenance ------------------------------------------------------------------


_SPLIT = "DATE '1999-01-01'"


def _halves(spark, sf):
    cols = ["symbol", "ts", "open", "close"]
    bars = p.daily_bars(spark, sf).select(*cols)
    existing = bars.where("ts < DATE '1999-01-01'")
    fresh = bars.where("ts >= DATE '1998-11-17'").withColumn("close", F.col("close") + 1)
    return existing, fresh


@query(
    "upsert_fresh_wins",
    with_ctes(f"SELECT symbol, ts, open, {rnd('CASE WHEN ts >= DATE $$1998-11-17$$ THEN close + 1 ELSE close END', 2)} AS close FROM bars".replace("$$", "'"), "bars"),
)
def upsert_fresh_wins(spark, sf):
    """A fresh window overwrites what it overlaps."""
    return p.rounded(upsert.upsert(*_halves(spark, sf)), 2)


@query(
    "upsert_existing_wins",
    with_ctes(f"SELECT symbol, ts, open, {rnd('CASE WHEN ts >= DATE $$1999-01-01$$ THEN close + 1 ELSE close END', 2)} AS close FROM bars".replace("$$", "'"), "bars"),
)
def upsert_existing_wins(spark, sf):
    """A backfill never overwrites."""
    return p.rounded(upsert.upsert(*_halves(spark, sf), prefer="existing"), 2)


@query(
    "splice_sources",
    with_ctes(
        f"""SELECT symbol, ts, open, close FROM bars WHERE ts < {_SPLIT} AND volume > 30 UNION ALL
        SELECT symbol, ts, open, {rnd('close + 1', 2)} FROM bars WHERE NOT (ts < {_SPLIT} AND volume > 30)""",
        "bars",
    ),
)
def splice_sources(spark, sf):
    """One source before a cutoff, the other elsewhere."""
    bars = p.daily_bars(spark, sf)
    cols = ["symbol", "ts", "open", "close"]
    second = bars.select(*cols).withColumn("close", F.col("close") + 1)
    return p.rounded(upsert.splice(bars.where("volume > 30").select(*cols), second, "1999-01-01"), 2)


@query(
    "coverage_report",
    with_ctes(
        """SELECT symbol, earliest, CASE WHEN earliest <= DATE '1995-01-03' THEN 'already_covered'
        WHEN symbol IN (SELECT symbol FROM brands WHERE k % 2 = 0) THEN 'backfilled' ELSE 'no_older_data' END AS status
        FROM (SELECT symbol, min(ts) AS earliest FROM bars WHERE volume > 60 GROUP BY 1)""",
        "bars",
        "brands",
    ),
)
def coverage_report(spark, sf):
    """U4: backfill status per instrument."""
    bars = p.daily_bars(spark, sf)
    older = bars.join(p.universes(spark, sf).where("universe_id = 'tradable'"), "symbol", "left_semi")
    return upsert.coverage_report(bars.where("volume > 60"), older, "1995-01-03")
