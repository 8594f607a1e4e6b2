"""Per-instrument trading rules, as questions to all bars at once.

What an entry would lead to does not depend on whether it is taken: its exit is the first bar that crosses a level (:func:`first_crossing`) or
meets a condition.  Which entries are taken is then a chain of trades that do not overlap (:func:`taken`), or, where neither entries nor exits
look at the trade itself, an automaton of two states (:func:`two_states`).  Only the alert of :func:`rsi_reversal_trades`, which outlives
trades, is carried from bar to bar.

Input bars hold one row per (strategy_id, symbol, slot) with the columns each rule names, among them
``entry_rank`` (rank in the universe in force, NULL outside it).  Every instrument is traded on its
own with unit size; sizing is a column expression afterwards (:mod:`barloom.operators.trades`).
Signals seen on a close are filled at the open of the next *calendar* slot; a fill into a missing
open is dropped, the rule then re-evaluates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.functions import frames as fr
from barloom.functions.fold import ordered_fold
from barloom.operators.crossings import first_crossing, next_events, taken, two_states
from barloom.session import materialise

KEYS = ["strategy_id", "symbol"]


def _trade_schema(df: DataFrame) -> str:
    t = df.schema["ts"].dataType.simpleString()
    return (
        f"entry_date {t}, entry_price DOUBLE, entry_rank INT, stop_price DOUBLE, target_price DOUBLE, "
        f"exit_date {t}, exit_price DOUBLE, exit_reason STRING, status STRING"
    )


class _Book:
    """Position of one instrument and the rows it gives."""

    def __init__(self):
        self.at = None
        self.last_close = None

    @property
    def flat(self):
        return self.at is None

    def buy(self, ts, price, rank, stop, target=None):
        self.at = (ts, price, rank, stop, target)

    def close(self, ts, price, reason):
        row = (*self.at, ts, price, reason, "closed")
        self.at = None
        return row

    def rest(self):
        """The open trade, marked at the close of the calendar's last slot (no close, no row)."""
        if self.at is not None and self.last_close is not None:
            yield (*self.at, None, self.last_close, "open", "open")


def gap_up(bars: DataFrame, gap_pct: float = 1.0) -> DataFrame:
    """Open at least ``gap_pct`` above the previous close -> ``signal, fill`` (the open)."""
    hit = c.holds((F.col("prev_close") > 0) & (F.col("open") >= F.col("prev_close") * (1 + gap_pct / 100.0)))
    return bars.withColumn("signal", hit & c.holds(F.col("open") > 0)).withColumn("fill", F.when(F.col("signal"), F.col("open")))


def channel_breakout(bars: DataFrame) -> DataFrame:
    """High reaches the channel's upper edge -> ``signal, fill`` (the edge, or the open above it)."""
    hit = c.holds((F.col("open") > 0) & (F.col("high") >= F.col("upper")))
    return bars.withColumn("signal", hit).withColumn("fill", F.when(F.col("signal"), F.greatest("open", "upper")))


def breakout_trades(
    bars: DataFrame, exit_mode: str = "trailing_donchian", stop_pct: float = 8.0, risk_reward: float = 2.0
) -> DataFrame:
    """Trade ``signal``/``fill`` rows with a stop and a target.

    Needs ``open, high, low, close, lower, signal, fill, entry_rank``.  ``trailing_donchian`` reads the
    stop from ``lower`` anew on every bar, ``fixed_pct`` keeps it below the entry.  Per bar: stop
    first (fill at the lower of open and stop), else target (higher of open and target), then entries,
    so a symbol may leave and re-enter on one bar but never leaves on its entry bar.
    """
    if exit_mode not in ("trailing_donchian", "fixed_pct"):
        raise ValueError("exit_mode must be 'trailing_donchian' or 'fixed_pct'")
    trailing = exit_mode == "trailing_donchian"

    rows = _rows(bars, ["open", "high", "low", "close", "lower", "signal", "fill"])
    col = F.col
    complete = col("high").isNotNull() & col("low").isNotNull() & (col("open") > 0)
    stop = col("lower") if trailing else col("fill") * (1 - stop_pct / 100.0)
    if trailing:
        stopped = c.holds(complete & (col("low") <= col("lower")))
        rows = rows.withColumn("_high", F.when(complete & ~stopped, col("high")))
        there = F.when(stopped & (F.least("open", "lower") > 0), col("idx"))
        rows = rows.withColumn("_s", fr.before(F.min(there), KEYS, F.desc("idx")))
    else:
        rows = rows.withColumns({"_high": F.when(complete, col("high")), "_low": F.when(complete, col("low"))})
    rows = materialise(rows)
    entry = rows.withColumn("_stop", stop).withColumn("_target", col("fill") + risk_reward * (col("fill") - col("_stop")))
    entry = entry.where(c.holds(col("signal") & (col("fill") > 0) & (col("_stop") < col("fill"))) & col("entry_rank").isNotNull())
    entry = first_crossing(entry, rows, KEYS, "_target", "_high", True, hit="_t")
    if not trailing:
        entry = first_crossing(entry, rows, KEYS, "_stop", "_low", False, hit="_s")
    entry = materialise(entry.withColumn("_out", F.least("_s", "_t")))
    at = rows.select(*KEYS, col("idx").alias("_out"), col("ts").alias("_ts"), col("open").alias("_open"), col("lower").alias("_lower"))
    trades = taken(entry, KEYS, "idx", "_out").join(at, [*KEYS, "_out"], "left")
    by_stop = c.holds(col("_s") == col("_out"))
    level = col("_lower") if trailing else col("_stop")
    price = F.when(by_stop, F.least("_open", level)).otherwise(F.greatest("_open", "_target"))
    trades = trades.withColumns({"_price": price, "_why": F.when(by_stop, exit_mode).otherwise("target"), "_paid": col("fill"), "_from": col("ts")})
    return _trades(trades, _marks(rows))


def ema_cross_trades(
    bars: DataFrame,
    short: bool = False,
    use_target: bool = False,
    risk_reward: float = 2.0,
    min_stop_pct: float = 1.0,
) -> DataFrame:
    """Cross of the fast and the slow average, long or (mirrored) short.

    Needs ``open, close, ema_fast, ema_slow, entry_rank``.  Long: enter after a close with fast above
    slow, leave after a close below slow, or fast below slow.  The slow average of the signal bar is
    the initial stop; an entry whose open is not beyond it is dropped.  Short trades may have a target
    ``risk_reward`` times the stop distance (at least ``min_stop_pct`` of the entry), tested on the
    close before the stops.
    """
    s = -1.0 if short else 1.0
    by_close, by_cross = (
        ("close_above_ema_slow", "ema_fast_above_ema_slow") if short else ("close_below_ema_slow", "ema_fast_below_ema_slow")
    )

    col = F.col
    above = lambda x, y: s * (x - y) > 0
    rows = _rows(bars, ["open", "close", "ema_fast", "ema_slow"])
    rows = _with_next(rows, KEYS, ["ts", "open"])
    known = col("ema_fast").isNotNull() & col("ema_slow").isNotNull()
    held_by = known & col("close").isNotNull() & col("_can")
    worse = above(col("ema_slow"), col("close"))
    crossed = above(col("ema_slow"), col("ema_fast"))
    enter = known & above(col("ema_fast"), col("ema_slow")) & col("_can") & above(col("next_open"), col("ema_slow")) & col("entry_rank").isNotNull()
    rows = rows.withColumns(
        {
            "_enter": c.holds(enter),
            "_leave": c.holds(held_by & (worse | crossed)),
            "_why": F.when(worse, by_close).otherwise(by_cross),
            "_paid": col("next_open"),
            "_from": col("next_ts"),
            "_stop": col("ema_slow"),
        }
    )
    risk = F.greatest(s * (col("_paid") - col("_stop")), col("_paid") * min_stop_pct / 100.0)
    rows = rows.withColumn("_target", col("_paid") + s * risk_reward * risk if use_target else F.lit(None).cast("double"))
    if not use_target:
        events = two_states(rows, KEYS, "_enter", "_leave").where((~col("inside") & col("_enter")) | (col("inside") & col("_leave")))
        events = next_events(events, KEYS, ["_why", "_from", "_paid"])
        trades = events.where("NOT inside").withColumns({"_ts": col("next__from"), "_price": col("next__paid"), "_why": col("next__why")})
        return _trades(trades, _marks(_rows(bars, ["close"])))
    later = F.when(col("_leave"), col("idx"))
    rows = rows.withColumns({"_x": fr.before(F.min(later), KEYS, F.desc("idx")), "_close": F.when(c.holds(held_by), col("close"))})
    rows = materialise(rows)
    entry = first_crossing(rows.where("_enter"), rows, KEYS, "_target", "_close", not short, hit="_t")
    at = rows.select(*KEYS, col("idx").alias("_j"), col("next_ts").alias("_ts"), col("next_open").alias("_price"), col("_why").alias("_by"))
    entry = entry.withColumn("_j", F.least("_x", "_t")).withColumn("_out", col("_j") + 1)
    trades = taken(materialise(entry), KEYS, "idx", "_out").join(at, [*KEYS, "_j"], "left")
    trades = trades.withColumn("_why", F.when(c.holds(col("_t") == col("_j")), "target_hit").otherwise(col("_by")))
    return _trades(trades, _marks(rows))


def opening_range_trades(
    bars: DataFrame, short: bool = False, max_reentries: int = 4, stop_mode: str = "range", stop_pct: float = 8.0
) -> DataFrame:
    """Breakout of the period's opening range; positions never leave their period.

    Needs ``open, close, range_high, range_low, period_no, is_last_bar, entry_rank``.  A close beyond
    the range enters at the next open (at most ``max_reentries`` + 1 fills per period); the stop is
    the opposite edge or ``stop_pct`` from the entry, on closes; on the period's last slot positions
    are closed at that close and nothing is entered.  A symbol without a close there is closed at its
    last close of the period.  A period is independent work; its range
    is the same on all its bars.
    """
    if stop_mode not in ("range", "fixed_pct"):
        raise ValueError("stop_mode must be 'range' or 'fixed_pct'")
    s = -1.0 if short else 1.0

    col, by = F.col, [*KEYS, "period_no"]
    above = lambda x, y: s * (x - y) > 0
    rows = bars.where("range_high IS NOT NULL").select(
        *by, "idx", "ts", "open", "close", "range_high", "range_low", "is_last_bar", "entry_rank"
    )
    edge, back = ("range_low", "range_high") if short else ("range_high", "range_low")
    rows = _with_next(rows, by, ["ts", "open", back])
    stop = col(f"next_{back}") if stop_mode == "range" else col("next_open") * (1 - s * stop_pct / 100.0)
    ready = ~c.holds(col("is_last_bar")) & col("close").isNotNull() & col("_can")
    rows = rows.withColumns({"_stop": stop, "_paid": col("next_open"), "_from": col("next_ts"), "_target": F.lit(None).cast("double")})
    enter = ready & col("entry_rank").isNotNull() & above(col("close"), col(edge)) & above(col("_paid"), col("_stop"))
    rows = rows.withColumns({"_enter": c.holds(enter), "_leave": c.holds(ready & above(col(back), col("close"))), "_why": F.lit("stoploss")})
    if stop_mode == "range":
        events = two_states(rows, by, "_enter", "_leave").where((~col("inside") & col("_enter")) | (col("inside") & col("_leave")))
        events = next_events(events, by, ["_from", "_paid"])
        trades = events.where("NOT inside").withColumns({"_ts": col("next__from"), "_price": col("next__paid")})
    else:
        rows = materialise(rows.withColumn("_close", F.when(c.holds(ready), col("close"))))
        entry = first_crossing(rows.where("_enter"), rows, by, "_stop", "_close", short, hit="_j", strict=True).withColumn("_out", col("_j") + 1)
        at = rows.select(*by, col("idx").alias("_j"), col("next_ts").alias("_ts"), col("next_open").alias("_price"))
        trades = taken(materialise(entry), by, "idx", "_out").join(at, [*by, "_j"], "left")
    fill = F.row_number().over(fr.ordered(by, "idx"))
    trades = trades.withColumn("_fill", fill).where(col("_fill") <= max_reentries + 1)
    mark = rows.where("close > 0").groupBy(*by).agg(F.max_by(F.struct("ts", "close"), "idx").alias("_mark"))
    ended = trades.join(mark, by, "left").withColumn("_open", col("_ts").isNull()).where("NOT _open OR _mark IS NOT NULL")
    ended = ended.withColumns(
        {
            "_ts": F.coalesce("_ts", "_mark.ts"),
            "_price": F.when(col("_open"), col("_mark.close")).otherwise(col("_price")),
            "_why": F.when(col("_open"), "month_end").otherwise(col("_why")),
            "status": F.lit("closed"),
        }
    )
    return _shaped(ended, by)


def rsi_reversal_trades(
    bars: DataFrame,
    target_multiple: float = 5.0,
    max_hold_days: int = 45,
    max_stop_pct: float = 4.0,
    min_stop_pct: float = 0.1,
) -> DataFrame:
    """Alert bar, trigger close, next-open entry.

    Needs ``open, high, low, close, crossed, entry_rank``.  A bar on which the oscillator crosses up
    becomes the alert; a later close above its high enters at the next open with the alert's low as
    stop, unless that stop is wider than ``max_stop_pct``.  Exits on closes: stop, then target
    (``target_multiple`` stop distances), then ``max_hold_days`` elapsed days.  Alerts are tracked only
    while the instrument is flat, has no order and is in the universe; an alert consumed by a trigger
    may be replaced by the same bar.
    """

    class Rule(_Book):
        def __init__(self):
            super().__init__()
            self.leave = self.enter = self.seen = self.alert = None

        def row(self, r):
            here = r.idx - 1 == self.seen
            tradable = r.open is not None and r.open > 0
            if self.leave is not None and here and tradable and not self.flat:
                yield self.close(r.ts, r.open, self.leave)
            if self.enter is not None and here and self.flat and tradable:
                stop, rank = self.enter
                raw = r.open - stop
                if raw > 0 and not raw / r.open * 100.0 > max_stop_pct:
                    risk = max(raw, r.open * min_stop_pct / 100.0)
                    self.buy(r.ts, r.open, rank, stop, r.open + target_multiple * risk)
            self.leave = self.enter = None
            self.seen = r.idx
            self.last_close = r.close if r.is_last else None
            if r.close is None:
                return
            if not self.flat:
                entered, _, _, stop, target = self.at
                if r.close < stop:
                    self.leave = "stoploss"
                elif r.close >= target:
                    self.leave = "target"
                elif (r.ts - entered).days >= max_hold_days:
                    self.leave = "time_exit"
            elif r.entry_rank is not None:
                if self.alert is not None and r.close > self.alert[0]:
                    self.enter = (self.alert[1], r.entry_rank)
                    self.alert = None
                if r.crossed and r.high is not None and r.low is not None:
                    self.alert = (r.high, r.low)

        def end(self):
            return self.rest()

    return _run(bars, ["open", "high", "low", "close", "crossed"], Rule)


def _rows(bars: DataFrame, needs: list[str]) -> DataFrame:
    last = bars.agg(F.max("idx")).scalar()
    return bars.select(*KEYS, "idx", "ts", *needs, "entry_rank", (F.col("idx") == last).alias("is_last"))


def _with_next(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the key's next row and ``_can``: it is the next slot and opens there."""
    w = fr.ordered(by, "idx")
    rows = rows.withColumns({f"next_{x}": F.lead(x).over(w) for x in ["idx", *columns]})
    return rows.withColumn("_can", c.holds((F.col("next_idx") == F.col("idx") + 1) & (F.col("next_open") > 0)))


def _marks(rows: DataFrame) -> DataFrame:
    """Close of each instrument at the calendar's last slot."""
    return rows.where("is_last AND close IS NOT NULL").select(*KEYS, F.col("close").alias("_mark"))


def _shaped(trades: DataFrame, by: list[str]) -> DataFrame:
    names = {
        "_from": "entry_date", "_paid": "entry_price", "entry_rank": "entry_rank", "_stop": "stop_price", "_target": "target_price",
        "_ts": "exit_date", "_price": "exit_price", "_why": "exit_reason", "status": "status",
    }
    return trades.select(*by, *[F.col(k).cast("int").alias(v) if k == "entry_rank" else F.col(k).alias(v) for k, v in names.items()])


def _trades(trades: DataFrame, marks: DataFrame) -> DataFrame:
    """Trades with an exit, and the open ones marked at the close of the calendar's last slot (no close, no row)."""
    out = trades.join(marks, KEYS, "left").withColumn("status", F.when(F.col("_ts").isNull(), "open").otherwise("closed"))
    out = out.where("status = 'closed' OR _mark IS NOT NULL")
    is_open = F.col("status") == "open"
    out = out.withColumns(
        {"_price": F.when(is_open, F.col("_mark")).otherwise(F.col("_price")), "_why": F.when(is_open, "open").otherwise(F.col("_why"))}
    )
    return _shaped(out, KEYS)


def _run(bars: DataFrame, needs: list[str], rule: type) -> DataFrame:
    last = bars.agg(F.max("idx")).scalar()
    rows = bars.select(*KEYS, "idx", "ts", *needs, "entry_rank", (F.col("idx") == last).alias("is_last"))
    return ordered_fold(rows, KEYS, ["idx"], rule, _trade_schema(bars))
