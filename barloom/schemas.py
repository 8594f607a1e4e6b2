"""Explicit schemas (DDL text) of every table the library reads or writes; nothing is inferred."""

from __future__ import annotations

#: One file per instrument, header row, as written by the data vendors.
BAR_FILE = "Date STRING, `Adj Close` DOUBLE, Close DOUBLE, High DOUBLE, Low DOUBLE, Open DOUBLE, Volume DOUBLE"
INTRADAY_FILE = "Datetime STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE"
SYMBOL_FILE = "Symbol STRING"
SNAPSHOT_FILE = "`Company Name` STRING, Industry STRING, Symbol STRING, Series STRING, `ISIN Code` STRING"
INDEX_EVENT_FILE = "`Event Date` STRING, `Scrip Name` STRING, Description STRING"

#: Payload structures of the JSON sources.
NAV_PAYLOAD = "STRUCT<data: ARRAY<STRUCT<date: STRING, nav: STRING>>>"
CANDLE_PAYLOAD = "STRUCT<data: STRUCT<candles: ARRAY<ARRAY<STRING>>>>"

BARS = (
    "symbol STRING, ts DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adj_close DOUBLE, volume DOUBLE"
)
SERIES = "series_id STRING, ts DATE, value DOUBLE"
MEMBERSHIP = "symbol STRING, start DATE, end DATE"
HOLDINGS = (
    "strategy_id STRING, rebalance_date DATE, period_no INT, symbol STRING, slot INT, n_active INT, regime STRING"
)
TRADES = (
    "symbol STRING, entry_date TIMESTAMP_NTZ, entry_price DOUBLE, entry_rank INT, stop_price DOUBLE, "
    "target_price DOUBLE, exit_date TIMESTAMP_NTZ, exit_price DOUBLE, exit_reason STRING, status STRING"
)

#: Parameters of a registered strategy as stored in its JSON text.
STRATEGY_PARAMS = (
    "universe STRING, rebal_freq STRING, lookback_months INT, skip_months INT, hold_months INT, n_stocks INT, "
    "min_price DOUBLE, price_col STRING, use_membership_filter BOOLEAN, weighting_mode STRING, "
    "use_exit_band BOOLEAN, exit_band_pct DOUBLE, use_regime_filter BOOLEAN, gold_entry_lookback INT, "
    "gold_exit_lookback INT, max_volatility_pct DOUBLE, use_risk_adjusted BOOLEAN, "
    "max_trailing_return_pct DOUBLE, max_drawdown_from_52w_high_pct DOUBLE"
)
