"""Trading rules against a walk from bar to bar, and the questions they are made of."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.scan import linear_scan
from barloom.operators import clean, crossings, indicators, ranking, signals

DAY = dt.date(2020, 1, 1)
NEEDS = {
    "breakout": "open high low close lower signal fill",
    "ema": "open close ema_fast ema_slow",
    "range": "period_no open close range_high range_low is_last_bar",
}


def frame(spark, rows, kind):
    types = {"signal": "boolean", "is_last_bar": "boolean", "period_no": "int"}
    columns = NEEDS[kind].split()
    ddl = "strategy_id string, symbol string, idx int, ts date, entry_rank int, " + ", ".join(f"{x} {types.get(x, 'double')}" for x in columns)
    return spark.createDataFrame([("s", r["symbol"], r["idx"], DAY + dt.timedelta(r["idx"]), r["entry_rank"], *[r[x] for x in columns]) for r in rows], ddl)


def draw_bars(rng, kind, symbols=6, slots=160):
    """Bars with absent slots, absent values, and prices that cross their levels often."""
    rows = []
    for k in range(symbols):
        price = 100.0
        for idx in range(slots):
            price = max(1.0, price * rng.uniform(0.9, 1.115))
            if rng.random() < 0.06:
                continue
            some = lambda x, p=0.04: None if rng.random() < p else round(x, 1)
            r = {"symbol": f"x{k}", "idx": idx, "entry_rank": rng.choice([None, 1, 2]), "open": some(price * rng.uniform(0.97, 1.03)), "close": some(price)}
            if rng.random() < 0.02:
                r["open"] = 0.0
            if kind == "breakout":
                r |= {"high": some(price * rng.uniform(1.0, 1.1)), "low": some(price * rng.uniform(0.9, 1.0)), "lower": some(price * 0.94, 0.1)}
                r["signal"] = rng.random() < 0.4
                r["fill"] = r["open"] if r["signal"] else None
            elif kind == "ema":
                r |= {"ema_fast": some(price * rng.uniform(0.95, 1.05)), "ema_slow": some(price * rng.uniform(0.96, 1.04))}
            else:
                month = idx // 20
                r |= {"period_no": month, "range_high": 100.0 + month % 3 * 20, "range_low": 90.0 + month % 3 * 20, "is_last_bar": idx % 20 == 19}
                if month == 4:
                    r |= {"range_high": None, "range_low": None}
            rows.append(r)
    return rows


def keyed(rows, *names):
    out = {}
    for r in sorted(rows, key=lambda r: r["idx"]):
        out.setdefault(tuple(r[n] for n in names), []).append(r)
    return out


def walk_breakouts(rows, trailing, stop_pct, risk_reward):
    last, out = max(r["idx"] for r in rows), []
    for key, bars in keyed(rows, "symbol").items():
        held = None
        for r in bars:
            if held and None not in (r["low"], r["high"], r["open"]) and r["open"] > 0:
                stop = r["lower"] if trailing else held[3]
                price = why = None
                if stop is not None and r["low"] <= stop:
                    price, why = min(r["open"], stop), "stop"
                elif r["high"] >= held[4]:
                    price, why = max(r["open"], held[4]), "target"
                if price is not None and price > 0:
                    out.append((*key, *held, r["idx"], price, why))
                    held = None
            if not held and r["signal"] and r["entry_rank"] is not None and r["fill"] is not None and r["fill"] > 0:
                stop = r["lower"] if trailing else r["fill"] * (1 - stop_pct / 100.0)
                if stop is not None and stop < r["fill"]:
                    held = (r["idx"], r["fill"], r["entry_rank"], stop, r["fill"] + risk_reward * (r["fill"] - stop))
        if held and bars[-1]["idx"] == last and bars[-1]["close"] is not None:
            out.append((*key, *held, None, bars[-1]["close"], "open"))
    return out


def walk_averages(rows, short, use_target, risk_reward=2.0, min_stop_pct=1.0):
    s, last, out = -1.0 if short else 1.0, max(r["idx"] for r in rows), []
    names = ("close_above_ema_slow", "ema_fast_above_ema_slow") if short else ("close_below_ema_slow", "ema_fast_below_ema_slow")
    for key, bars in keyed(rows, "symbol").items():
        held = leave = enter = seen = None
        for r in bars:
            can = r["idx"] - 1 == seen and r["open"] is not None and r["open"] > 0
            if leave and can and held:
                out.append((*key, *held, r["idx"], r["open"], leave))
                held = None
            if enter and can and not held and s * (r["open"] - enter[0]) > 0:
                risk = max(s * (r["open"] - enter[0]), r["open"] * min_stop_pct / 100.0)
                held = (r["idx"], r["open"], enter[1], enter[0], r["open"] + s * risk_reward * risk if use_target else None)
            leave, enter, seen = None, None, r["idx"]
            known = r["ema_fast"] is not None and r["ema_slow"] is not None
            if held:
                if known and r["close"] is not None:
                    if use_target and s * (r["close"] - held[4]) >= 0:
                        leave = "target_hit"
                    elif s * (r["close"] - r["ema_slow"]) < 0:
                        leave = names[0]
                    elif s * (r["ema_fast"] - r["ema_slow"]) < 0:
                        leave = names[1]
            elif known and r["entry_rank"] is not None and s * (r["ema_fast"] - r["ema_slow"]) > 0:
                enter = (r["ema_slow"], r["entry_rank"])
        if held and bars[-1]["idx"] == last and bars[-1]["close"] is not None:
            out.append((*key, *held, None, bars[-1]["close"], "open"))
    return out


def walk_ranges(rows, short, stop_mode, stop_pct, max_reentries):
    s, out = -1.0 if short else 1.0, []
    for key, bars in keyed([r for r in rows if r["range_high"] is not None], "symbol", "period_no").items():
        held = enter = seen = mark = None
        leave, fills, done = False, 0, False
        for r in bars:
            can = r["idx"] - 1 == seen and r["open"] is not None and r["open"] > 0
            if leave and can and held:
                out.append((*key, *held, r["idx"], r["open"], "stoploss"))
                held = None
            if enter is not None and can and not held:
                back = r["range_high"] if short else r["range_low"]
                stop = back if stop_mode == "range" else r["open"] * (1 - s * stop_pct / 100.0)
                if s * (r["open"] - stop) > 0:
                    held, fills = (r["idx"], r["open"], enter, stop, None), fills + 1
            leave, enter, seen = False, None, r["idx"]
            if r["close"] is not None and r["close"] > 0:
                mark = (r["idx"], r["close"])
            if r["is_last_bar"]:
                done = True
                if held and mark:
                    out.append((*key, *held, *mark, "month_end"))
                    held = None
                continue
            if r["close"] is None:
                continue
            if held:
                leave = s * (r["close"] - held[3]) < 0
            elif r["entry_rank"] is not None and fills <= max_reentries:
                if r["close"] < r["range_low"] if short else r["close"] > r["range_high"]:
                    enter = r["entry_rank"]
        if held and mark and not done:
            out.append((*key, *held, *mark, "month_end"))
    return out


def found(df, *by):
    rows = []
    for r in df.collect():
        days = lambda d: None if d is None else (d - DAY).days
        rows.append((*[r[b] for b in by], days(r.entry_date), r.entry_price, r.entry_rank, r.stop_price, r.target_price, days(r.exit_date), r.exit_price, r.exit_reason))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("mode", ["trailing_donchian", "fixed_pct"])
def test_breakouts_against_a_walk(spark, mode):
    rows = draw_bars(random.Random(1), "breakout")
    got = found(signals.breakout_trades(frame(spark, rows, "breakout"), mode, 7.0, 1.0), "symbol")
    want = [(*t[:-1], mode if t[-1] == "stop" else t[-1]) for t in walk_breakouts(rows, mode == "trailing_donchian", 7.0, 1.0)]
    assert got == sorted(want, key=repr) and {t[-1] for t in want} >= {mode, "target"} and len(want) > 60


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("use_target", [False, True])
def test_averages_against_a_walk(spark, short, use_target):
    rows = draw_bars(random.Random(2), "ema")
    got = found(signals.ema_cross_trades(frame(spark, rows, "ema"), short, use_target, 1.5), "symbol")
    want = walk_averages(rows, short, use_target, 1.5)
    assert got == sorted(want, key=repr) and len({t[-1] for t in want}) >= 2 and len(want) > 60


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("mode", ["range", "fixed_pct"])
def test_ranges_against_a_walk(spark, short, mode):
    rows = draw_bars(random.Random(3), "range", 25)
    got = found(signals.opening_range_trades(frame(spark, rows, "range"), short, 1, mode, 3.0), "symbol", "period_no")
    want = walk_ranges(rows, short, mode, 3.0, 1)
    assert got == sorted(want, key=repr) and len({t[-1] for t in want}) == 2 and len(want) > 40


def test_first_crossing_anywhere_in_the_series(spark):
    rng = random.Random(4)
    rows = [(k, i, None if rng.random() < 0.1 else rng.random() ** (1 + k * 6)) for k in (1, 2) for i in range(700) if rng.random() > 0.3]
    bars = spark.createDataFrame(rows, "symbol int, idx int, v double")
    asks = [(k, i, rng.random()) for k in (1, 2, 3) for i in range(-5, 720, 7)]
    frame_ = spark.createDataFrame(asks, "symbol int, idx int, level double")
    for above, strict in ((True, False), (False, False), (True, True), (False, True)):
        out = crossings.first_crossing(frame_, bars, ["symbol"], "level", "v", above, strict=strict, block=5)
        for r in out.collect():
            ok = (lambda v: v > r.level if strict else v >= r.level) if above else (lambda v: v < r.level if strict else v <= r.level)  # noqa: B023
            want = min((i for k, i, v in rows if k == r.symbol and i > r.idx and v is not None and ok(v)), default=None)
            assert r.hit == want


def test_two_states_and_chains(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.random() < 0.3, rng.random() < 0.3) for k in "abc" for i in range(200)]
    got = crossings.two_states(spark.createDataFrame(rows, "k string, idx int, e boolean, l boolean"), ["k"], "e", "l")
    states = {}
    for k, i, e, l in rows:  # noqa: E741
        now = states.get((k, i), False)
        states[k, i + 1] = not now if (l if now else e) else now
    assert all(r.inside == states.get((r.k, r.idx), False) for r in got.collect())

    spans = [(k, i, rng.choice([None, i, i + rng.randint(0, 5)]) if i > 900 else i + rng.randint(0, 5)) for k in "ab" for i in range(1_000) if rng.random() < 0.8]
    picked = crossings.taken(spark.createDataFrame(spans, "k string, idx long, out long"), ["k"])
    want, free = [], {}
    for k, i, o in spans:
        if i >= free.get(k, 0):
            want.append((k, i))
            free[k] = 10**9 if o is None else o
    assert sorted((r.k, r.idx) for r in picked.collect()) == sorted(want)


def test_crash_runs_against_a_walk(spark):
    rng, rows = random.Random(8), []
    for k in "abc":
        base = 100.0
        for i in range(300):
            base *= rng.uniform(0.97, 1.03)
            value = base * (rng.choice([0.2, 0.5, 0.84, 0.86]) if rng.random() < 0.3 else 1.0)
            rows.append((k, DAY + dt.timedelta(i), None if rng.random() < 0.05 else value))
    want = {}
    for k in "abc":
        good, bad = None, []
        for t, v in [(t, v) for s, t, v in rows if s == k and v is not None]:
            want[k, t] = (v, False)
            if good is not None and v < 0.85 * good:
                bad.append((t, v))
                continue
            if good is not None and abs(v / good - 1) < 0.03:
                for i, (b, _) in enumerate(bad, 1):
                    want[k, b] = (good + (v - good) * i / (len(bad) + 1), True)
            good, bad = v, []
    got = clean.repair_crash_runs(spark.createDataFrame(rows, "series_id string, ts date, value double"))
    assert "InPandas" not in got._jdf.queryExecution().toString()
    found_ = {(r.series_id, r.ts): (r.value, r.repaired) for r in got.collect()}
    assert set(found_) == set(want) and all(found_[x] == (pytest.approx(want[x][0]), want[x][1]) for x in want)
    assert sum(r for _, r in want.values()) > 30


def test_equal_scores_are_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scored = spark.range(4_000).select(F.lit("s").alias("strategy_id"), F.lit(5).alias("period_no"), F.format_string("x%05d", "id").alias("symbol"), (F.col("id") % 2 * 0.0).alias("score"))
        got = ranking.rank_whole(scored)
        ranges = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) >= 4 and max(r["count"] for r in ranges) < 2_500
    assert all(r["rank"] == int(r.symbol[1:]) + 1 for r in got.collect())


def test_rules_walk_no_bars_in_python(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    few = {k: frame(spark, draw_bars(random.Random(6), k, 1, 30), k) for k in NEEDS}
    for df in (
        signals.breakout_trades(few["breakout"]),
        signals.breakout_trades(few["breakout"], "fixed_pct"),
        signals.ema_cross_trades(few["ema"]),
        signals.ema_cross_trades(few["ema"], short=True, use_target=True),
        signals.opening_range_trades(few["range"]),
        signals.opening_range_trades(few["range"], stop_mode="fixed_pct"),
    ):
        assert "InPandas" not in plan(df) and "InArrow" not in plan(df)


def test_scan_over_many_blocks(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([None, 0.0, 1.0, 0.2, 0.9, 0.99]) if rng.random() < 0.2 else 0.95, rng.uniform(-1, 1)) for k in "ab" for i in range(900) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, idx int, p double, q double")
    for block in (4, 64):
        got = {(r.k, r.idx): (r.y, r.z) for r in linear_scan(df, "k", "idx", {"y": (F.col("p"), F.col("q")), "z": (F.lit(0.5), F.col("p"))}, block).collect()}
        y, z = {}, {}
        for k, i, p, q in rows:
            y[k] = y.get(k, 0.0) if p is None else p * y.get(k, 0.0) + q
            z[k] = z.get(k, 0.0) if p is None else 0.5 * z.get(k, 0.0) + p
            assert got[k, i] == (pytest.approx(y[k], rel=1e-9, abs=1e-12), pytest.approx(z[k], rel=1e-9, abs=1e-12))


def test_scan_of_one_long_key(spark):
    df = spark.range(200_000).selectExpr("'a' AS symbol", "id AS idx", "100 + id % 7 AS close")
    last = indicators.ema(df, {"fast": 5, "slow": 20}).where("idx = 199999").first()
    for name, n in (("fast", 5), ("slow", 20)):
        a, y = 2 / (n + 1), 100.0
        for k in range(199_500, 200_000):
            y = (1 - a) * y + a * (100 + k % 7)
        assert last[name] == pytest.approx(y, rel=1e-9)
