"""Parsers of vendor payloads that arrive as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators.upsert import keep_last


def parse_nav_json(df: DataFrame, payload: str = "payload", by: str = "series_id") -> DataFrame:
    """``{"data": [{"date": "dd-MM-yyyy", "nav": "12.3"}, ..]}`` -> ``(by, ts, value)``; unreadable rows are dropped."""
    rows = df.select(by, F.inline(F.from_json(payload, schemas.NAV_PAYLOAD)["data"]))
    return rows.select(
        by, F.try_to_date("date", "dd-MM-yyyy").alias("ts"), F.col("nav").try_cast("double").alias("value")
    ).where("ts IS NOT NULL AND value IS NOT NULL")


def parse_candles(df: DataFrame, payload: str = "payload", by: str = "symbol") -> DataFrame:
    """``{"data": {"candles": [[time, o, h, l, c, volume, oi], ..]}}`` -> bars, one per (by, ts).

    The offset is cut off the time (wall clock stays), open interest is dropped.
    """
    rows = df.select(by, F.explode(F.from_json(payload, schemas.CANDLE_PAYLOAD)["data"]["candles"]).alias("_c"))
    wall = F.regexp_replace(F.replace(F.col("_c")[0], F.lit("T"), F.lit(" ")), r"(Z|[+-]\d{2}:?\d{2})$", "")
    value = lambda i: F.col("_c")[i].try_cast("double")
    bars = rows.select(
        by,
        wall.try_cast("timestamp_ntz").alias("ts"),
        value(1).alias("open"),
        value(2).alias("high"),
        value(3).alias("low"),
        value(4).alias("close"),
        value(5).alias("volume"),
    ).where("ts IS NOT NULL")
    return keep_last(bars, [by, "ts"])


def grouped_number(text: str | Column) -> Column:
    """Number with thousands separators; a dash or anything unreadable is NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, ",", "").try_cast("double")


def parse_index_history(df: DataFrame, by: str = "symbol", seq: str = "seq") -> DataFrame:
    """Index history rows of text -> bars.

    Columns ``(by, day 'dd MMM yyyy', open, high, low, close, seq)``; missing open/high/low take the
    close, volume is 0, of several rows of a day the last (by ``seq``) stays.
    """
    close = grouped_number("close")
    bars = df.select(
        by,
        F.try_to_date("day", "dd MMM yyyy").alias("ts"),
        *[F.coalesce(grouped_number(x), close).alias(x) for x in ("open", "high", "low")],
        close.alias("close"),
        close.alias("adj_close"),
        F.lit(0.0).alias("volume"),
        seq,
    ).where("ts IS NOT NULL")
    return keep_last(bars, [by, "ts"], seq).drop(seq)


def instrument_map(df: DataFrame, kind: str = "EQUITY", exchange: str = "NSE_EQ") -> DataFrame:
    """Instrument master -> ``(symbol, instrument_key)`` of one kind on one exchange."""
    rows = df.where((F.col("instrument_type") == kind) & (F.col("exchange") == exchange))
    return rows.select(F.col("tradingsymbol").alias("symbol"), "instrument_key")
