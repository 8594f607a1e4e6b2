"""Streams and the recompute job."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.operators import strategies
from barloom.plans import recompute
from barloom.session import scratch_path
from barloom.sources import sinks, stored
from barloom.streaming import bars as sb
from workload import panels as p
from workload.panels import define, rnd, with_ctes
from workload.registry import query


class Feed:
    """The events as a folder that files arrive in, and the stream that reads it, some files per micro-batch.

    Each arrival brings a quarter of the time span, in as many files as Spark writes.  With ``late``, every tenth user's events come an
    arrival later.
    """

    def __init__(self, spark, sf, late: bool = False):
        self.spark, self.path = spark, scratch_path(spark, "feed")
        events = p.table(spark, sf, "events")
        low, high = events.agg(F.min("ts"), F.max("ts")).first()
        seconds = lambda x: F.unix_seconds(x.cast("timestamp"))
        share = (seconds(F.col("ts")) - seconds(F.lit(low))) / (seconds(F.lit(high)) - seconds(F.lit(low)) + 1)
        after = F.when(F.col("user_id") % 10 == 0, 1).otherwise(0) if late else F.lit(0)
        self.events = events.withColumn("_file", F.least(F.floor(share * 4) + after, F.lit(3)))
        self.schema = events.schema

    def arrive(self, *files: int) -> None:
        for k in files:
            self.events.where(F.col("_file") == k).drop("_file").write.mode("append").parquet(self.path)

    def close(self) -> None:
        """Two rows far in the future, which end all that is open."""
        for year in (2200, 2201):
            row = self.events.drop("_file").limit(1).withColumns({"ts": F.lit(f"{year}-01-01").cast("timestamp_ntz"), "user_id": F.lit(-1).cast(self.schema["user_id"].dataType)})
            row.write.mode("append").parquet(self.path)

    def ticks(self, files: int | None = None):
        """The stream, at most ``files`` in a micro-batch; None takes all that has arrived at once."""
        reader = self.spark.readStream.schema(self.schema)
        raw = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(self.path)
        return raw.select(
            F.col("event_type").alias("symbol"), c.wall_clock_to_instant("ts").alias("ts"), F.col("value").alias("price"), "user_id"
        )


@query("stream_bars", with_ctes("SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, open, high, low, close, n FROM hours", "hours"))
def stream_bars(spark, sf):
    """Hourly bars from a tick stream over several micro-batches, with rows days late and a restart in between."""
    feed = Feed(spark, sf, late=True)
    parts, store, progress = (scratch_path(spark, x) for x in ("parts", "bars", "progress"))
    done = -1
    for files in ((0, 1), (2, 3)):
        feed.arrive(*files)
        sb.stream_partials(feed.ticks(files=1), parts, progress).awaitTermination()
        done = sb.settle(spark, parts, store, done)
    at = F.date_format(c.instant_to_wall_clock("ts"), "yyyy-MM-dd HH:mm")
    return stored.read_parts(spark, store).select("symbol", at.alias("at"), "open", "high", "low", "close", "n")


@query("stream_open_bars", with_ctes("SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, open, high, low, close, n FROM hours", "hours"))
def stream_open_bars(spark, sf):
    """Hourly bars held as state and appended once, when the watermark of two hours has passed their end."""
    feed = Feed(spark, sf)
    out, progress = scratch_path(spark, "bars"), scratch_path(spark, "progress")
    for arrive in (lambda: feed.arrive(0), lambda: feed.arrive(1, 2), lambda: feed.arrive(3), feed.close):
        arrive()
        sb.upsert_stream(sb.tumbling_bars(feed.ticks(), late="2 hours"), out, progress, mode="append").awaitTermination()
    at = F.date_format(c.instant_to_wall_clock("ts"), "yyyy-MM-dd HH:mm")
    got = sb.read_upserts(spark, out, ["symbol", "ts"]).where(F.year("ts") < 2190)
    return got.select("symbol", at.alias("at"), "open", "high", "low", "close", "n")


@query(
    "stream_gap_sessions",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, count(*) AS n FROM (
       SELECT *, sum(CASE WHEN ts - prev < INTERVAL 12 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
       SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s""",
)
def stream_gap_sessions(spark, sf):
    """U8: uninterrupted stretches on a stream; each is appended once, when the watermark has passed its end."""
    feed = Feed(spark, sf)
    out, progress = scratch_path(spark, "sessions"), scratch_path(spark, "progress")
    for arrive in (lambda: feed.arrive(0, 1), lambda: feed.arrive(2, 3), feed.close):
        arrive()
        stream = sb.gap_sessions(feed.ticks().withColumn("symbol", F.col("user_id")), "12 hours", "1 hour")
        sb.upsert_stream(stream, out, progress, mode="append").awaitTermination()
    got = sb.read_upserts(spark, out, ["symbol", "first_ts"]).where("symbol <> -1")
    at = lambda x: F.date_format(c.instant_to_wall_clock(x), "yyyy-MM-dd HH:mm:ss")
    return got.select(F.col("symbol").alias("user_id"), at("first_ts").alias("first_at"), at("last_ts").alias("last_at"), "n")


def _saved(spark, sf):
    """A registry derived from the nations: one strategy each, every seventh unusable."""
    k = F.col("n_nationkey")
    params = F.to_json(
        F.struct(
            F.lit("all").alias("universe"),
            F.lit("Monthly").alias("rebal_freq"),
            F.when(k % 7 != 6, 6 + k % 3 * 3).alias("lookback_months"),
            (k % 2).alias("skip_months"),
            F.lit(1).alias("hold_months"),
            (3 + k % 2 * 2).alias("n_stocks"),
            F.lit(10.0).alias("min_price"),
            F.lit("equal_monthly").alias("weighting_mode"),
        )
    )
    return p.table(spark, sf, "nation").select(F.col("n_name").alias("strategy_id"), F.col("n_name").alias("name"), params.alias("parameters"))


define(
    "saved",
    "SELECT n_name AS strategy_id, 6 + n_nationkey % 3 * 3 AS lb, n_nationkey % 2 AS sk, 3 + n_nationkey % 2 * 2 AS n FROM nation WHERE n_nationkey % 7 <> 6",
)
define(
    "srank",
    """SELECT * FROM (SELECT strategy_id, lb, sk, n, period_no, symbol, row_number() OVER (PARTITION BY strategy_id, period_no ORDER BY round(m, 9) DESC, symbol) AS rank, count(*) OVER (PARTITION BY strategy_id, period_no) AS cnt
       FROM (SELECT g.*, a.symbol, a.period_no, e.price / s.price - 1 AS m FROM saved g CROSS JOIN panel a
         JOIN panel e ON e.symbol = a.symbol AND e.period_no = a.period_no - g.sk JOIN panel s ON s.symbol = a.symbol AND s.period_no = a.period_no - g.sk - g.lb
         WHERE a.price >= 10 AND a.period_no >= (SELECT min(period_no) FROM panel) + g.lb + g.sk + 1)) WHERE rank <= n AND cnt >= n""",
    "saved",
    "panel",
)
define("sreb", "SELECT strategy_id, period_no, row_number() OVER (PARTITION BY strategy_id ORDER BY period_no) AS k FROM (SELECT DISTINCT strategy_id, period_no FROM srank)", "srank")
define("sheld", "SELECT r.strategy_id, r.symbol, r.period_no, b.k FROM srank r JOIN sreb b USING (strategy_id, period_no)", "srank", "sreb")
define(
    "smoves",
    """SELECT h.strategy_id, h.symbol, h.k, 'entry' AS action FROM sheld h WHERE NOT EXISTS (SELECT 1 FROM sheld g WHERE g.strategy_id = h.strategy_id AND g.symbol = h.symbol AND g.k = h.k - 1)
       UNION ALL SELECT h.strategy_id, h.symbol, h.k + 1, 'exit' FROM sheld h WHERE NOT EXISTS (SELECT 1 FROM sheld g WHERE g.strategy_id = h.strategy_id AND g.symbol = h.symbol AND g.k = h.k + 1)""",
    "sheld",
)
define(
    "sevents",
    """SELECT m.strategy_id, m.symbol, m.action, b.k, CAST(last_day(make_date(b.period_no // 12, b.period_no % 12 + 1, 1)) AS DATE) AS event_date
       FROM smoves m JOIN sreb b USING (strategy_id, k)""",
    "smoves",
    "sreb",
)


def _recompute(spark, sf):
    return recompute.recompute_all(_saved(spark, sf), {"month": p.monthly_panel(spark, sf)})


@query(
    "recomputed_events",
    with_ctes(
        """SELECT strategy_id, event_date, symbol, action FROM sevents e WHERE event_date >= (
        SELECT max(d) - INTERVAL 6 MONTH FROM (SELECT strategy_id AS s, CAST(last_day(make_date(period_no // 12, period_no % 12 + 1, 1)) AS DATE) AS d FROM sreb) WHERE s = e.strategy_id)""",
        "sevents",
        "sreb",
    ),
)
def recomputed_events(spark, sf):
    """Recent events of all registered strategies in one job."""
    return _recompute(spark, sf).events


@query(
    "recomputed_positions",
    with_ctes(
        """SELECT h.strategy_id, h.symbol, (SELECT max(event_date) FROM sevents e WHERE e.strategy_id = h.strategy_id AND e.symbol = h.symbol AND e.action = 'entry') AS entry_date
        FROM sheld h WHERE h.k = (SELECT max(k) FROM sreb b WHERE b.strategy_id = h.strategy_id)""",
        "sheld",
        "sevents",
    ),
)
def recomputed_positions(spark, sf):
    """Current positions of all strategies, replaced by key."""
    path = scratch_path(spark, "positions")
    sinks.replace_keys(_recompute(spark, sf).positions, path)
    return spark.read.schema("strategy_id STRING, symbol STRING, entry_date DATE").parquet(path)


@query("recompute_rejects", "SELECT n_name AS strategy_id, n_name AS name FROM nation WHERE n_nationkey % 7 = 6")
def recompute_rejects(spark, sf):
    """Strategies with unusable parameters are set aside."""
    return recompute.rejected(_saved(spark, sf))




# -- strategies as a relation, on two grids ---------------------------------------------------------


def _suppliers(spark, sf):
    """A registry with a strategy for each supplier: months and weeks, filters, universes, and rows no run can use."""
    k = F.col("s_suppkey")
    params = F.to_json(
        F.struct(
            F.when(k % 4 == 1, "tradable").otherwise("all").alias("universe"),
            F.when(k % 3 == 0, "Weekly").otherwise("Monthly").alias("rebal_freq"),
            F.when(k % 9 != 8, 3 + k % 4 * 3).alias("lookback_months"),
            (k % 2).alias("skip_months"),
            F.lit(1).alias("hold_months"),
            (3 + k % 3).alias("n_stocks"),
            (20_000.0 + k % 4 * 5_000).alias("min_price"),
            F.lit("Adj Close").alias("price_col"),
            (k % 5 == 0).alias("use_risk_adjusted"),
            F.when(k % 6 == 1, 300.0).alias("max_volatility_pct"),
            F.when(k % 7 == 2, 30.0).alias("max_trailing_return_pct"),
        )
    )
    return p.table(spark, sf, "supplier").select(F.col("s_name").alias("strategy_id"), F.col("s_name").alias("name"), params.alias("parameters"))


define(
    "xsaved",
    """SELECT s_name AS strategy_id, CASE WHEN s_suppkey % 3 = 0 THEN 'week' ELSE 'month' END AS grid, 3 + s_suppkey % 4 * 3 AS lb, s_suppkey % 2 AS sk, 3 + s_suppkey % 3 AS n,
       20000e0 + s_suppkey % 4 * 5000 AS least, s_suppkey % 4 = 1 AS small, s_suppkey % 5 = 0 AS adjusted, s_suppkey % 6 = 1 AS calm, s_suppkey % 7 = 2 AS capped
       FROM supplier WHERE s_suppkey % 9 <> 8""",
)
define("xpanel", "SELECT 'month' AS grid, symbol, period_end, period_no, price FROM panel UNION ALL SELECT 'week', symbol, period_end, period_no, price FROM wpanel", "panel", "wpanel")
define("xreturns", "SELECT a.grid, a.symbol, a.period_no, a.price / b.price - 1 AS r FROM xpanel a JOIN xpanel b ON a.grid = b.grid AND a.symbol = b.symbol AND b.period_no = a.period_no - 1", "xpanel")
define(
    "xwindows",
    """SELECT w.grid, lb, sk, a.symbol, a.period_no, any_value(e.price / s.price - 1) AS m, stddev_samp(r) * sqrt(12e0) AS v FROM (SELECT DISTINCT grid, lb, sk FROM xsaved) w JOIN xpanel a ON a.grid = w.grid
       JOIN xpanel e ON e.grid = a.grid AND e.symbol = a.symbol AND e.period_no = a.period_no - sk JOIN xpanel s ON s.grid = a.grid AND s.symbol = a.symbol AND s.period_no = a.period_no - sk - lb
       LEFT JOIN xreturns r ON r.grid = a.grid AND r.symbol = a.symbol AND r.period_no BETWEEN a.period_no - sk - lb + 1 AND a.period_no - sk GROUP BY w.grid, lb, sk, a.symbol, a.period_no""",
    "xsaved",
    "xpanel",
    "xreturns",
)
define(
    "xrank",
    """SELECT * FROM (SELECT strategy_id, grid, lb, sk, n, period_no, period_end, symbol, row_number() OVER (PARTITION BY strategy_id, period_no ORDER BY round(CASE WHEN adjusted THEN m / v ELSE m END, 9) DESC, symbol) AS rank,
       count(*) OVER (PARTITION BY strategy_id, period_no) AS cnt FROM xsaved JOIN xwindows USING (grid, lb, sk) JOIN xpanel USING (grid, symbol, period_no)
       WHERE price >= least AND (NOT small OR symbol IN (SELECT symbol FROM universe WHERE universe_id = 'tradable')) AND (NOT calm OR v <= 3) AND (NOT capped OR m <= 0.3e0) AND (NOT adjusted OR v > 1e-9)) WHERE rank <= n""",
    "xwindows",
    "xsaved",
    "universe",
)
define(
    "xreb",
    """SELECT strategy_id, grid, period_no, row_number() OVER (PARTITION BY strategy_id ORDER BY period_no) AS k FROM (SELECT DISTINCT strategy_id, x.grid, period_no FROM xrank x
       WHERE cnt >= n AND period_no >= (SELECT min(period_no) FROM xpanel q WHERE q.grid = x.grid) + lb + sk + 1)""",
    "xrank",
    "xpanel",
)
define("xheld", "SELECT r.strategy_id, r.symbol, b.k FROM xrank r JOIN xreb b USING (strategy_id, period_no)", "xrank", "xreb")
define(
    "xevents",
    """SELECT m.strategy_id, m.symbol, m.action, CASE WHEN grid = 'week' THEN DATE '1970-01-02' + CAST(b.period_no * 7 AS INTEGER) ELSE CAST(last_day(make_date(b.period_no // 12, b.period_no % 12 + 1, 1)) AS DATE) END AS event_date
       FROM (SELECT h.strategy_id, h.symbol, h.k, 'entry' AS action FROM xheld h ANTI JOIN (SELECT strategy_id, symbol, k + 1 AS k FROM xheld) g USING (strategy_id, symbol, k)
       UNION ALL SELECT h.strategy_id, h.symbol, h.k + 1, 'exit' FROM xheld h ANTI JOIN (SELECT strategy_id, symbol, k - 1 AS k FROM xheld) g USING (strategy_id, symbol, k)) m JOIN xreb b USING (strategy_id, k)""",
    "xheld",
    "xreb",
)


@query("ranking_strategy_table", with_ctes("SELECT strategy_id, period_end, symbol, rank FROM xrank", "xrank"))
def ranking_strategy_table(spark, sf):
    """A table of strategies on two grids ranked by one plan, whatever their number."""
    saved = recompute.strategy_table(_suppliers(spark, sf))
    panel = strategies.one_panel({"month|Adj Close": p.monthly_panel(spark, sf), "week|Adj Close": p.weekly_panel(spark, sf)})
    ranked = strategies.rank_best(panel, saved, universes=p.universes(spark, sf))
    return ranked.select("strategy_id", "period_end", "symbol", "rank")


@query(
    "recomputed_on_two_grids",
    with_ctes("SELECT strategy_id, event_date, symbol, action FROM xevents e WHERE event_date >= (SELECT max(event_date) - INTERVAL 6 MONTH FROM (SELECT strategy_id AS s, CASE WHEN grid = 'week' THEN DATE '1970-01-02' + CAST(period_no * 7 AS INTEGER) ELSE CAST(last_day(make_date(period_no // 12, period_no % 12 + 1, 1)) AS DATE) END AS event_date FROM xreb) WHERE s = e.strategy_id)", "xevents", "xreb"),
)
def recomputed_on_two_grids(spark, sf):
    """A monthly, weekly and partly unusable registry recomputed by one plan."""
    panels = {"month": p.monthly_panel(spark, sf), "week": p.weekly_panel(spark, sf)}
    return recompute.recompute_all(_suppliers(spark, sf), panels, universes=p.universes(spark, sf)).events


# -- a stored table, topped up ----------------------------------------------------------------------


@query(
    "merged_partitions",
    with_ctes(
        f"""SELECT symbol, ts, {rnd('close', 2)} AS close, {rnd('volume', 2)} AS volume FROM (SELECT symbol, ts, close, volume FROM bars WHERE volume > 30
        AND NOT (ts >= DATE '2000-06-15' AND volume > 60) UNION ALL SELECT symbol, ts, close + 1, volume FROM bars WHERE ts >= DATE '2000-06-15' AND volume > 60
        UNION ALL SELECT symbol, ts, close, volume FROM bars WHERE volume <= 30 AND ts < DATE '1996-01-01')""",
        "bars",
    ),
)
def merged_partitions(spark, sf):
    """A table stored by month, topped up by a window of fresh rows and by older rows that do not replace any."""
    path = scratch_path(spark, "stored")
    bars = p.daily_bars(spark, sf).select("symbol", "ts", "close", "volume")
    stored.write_parts(bars.where("volume > 30"), path)
    fresh = bars.where("ts >= DATE '2000-06-15' AND volume > 60").withColumn("close", F.col("close") + 1)
    stored.merge_into(path, fresh, ["symbol", "ts"])
    older = bars.where("ts < DATE '1996-01-01'").withColumn("close", F.when(F.col("volume") > 30, F.lit(-1.0)).otherwise(F.col("close")))
    stored.merge_into(path, older, ["symbol", "ts"], prefer="existing")
    return p.rounded(stored.read_parts(spark, path).select("symbol", "ts", "close", "volume"), 2)
