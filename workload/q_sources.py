"""Sources, payload parsers, sinks and registry."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import clean
from barloom.session import scratch_path
from barloom.sources import cache, files, payloads, registry, sinks
from workload import panels as p
from workload.panels import with_ctes
from workload.registry import query


def _one_file_each(df, name: str, columns: list[str]) -> str:
    """``df`` as CSV files with a header, one per value of ``name`` and named after it.

    Half of the files have the columns in reverse order.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "csv")
    turn = F.pmod(F.xxhash64(name), F.lit(2))
    for k, order in enumerate((columns, columns[::-1])):
        part = df.where(turn == k).select(name, *order)
        part.repartition(name).write.partitionBy(name).option("header", "true").csv(f"{path}/{k}")
    _name_after_folders(spark, path)
    return path


def _name_after_folders(spark, path: str) -> None:
    """Move the only data file of each ``key=value`` folder below ``path/*`` to ``path/files/value.csv``."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(at(f"{path}/files"))
    for found in fs.globStatus(at(f"{path}/[01]/*=*/part-*")):
        file = found.getPath()
        value = urllib.parse.unquote(file.getParent().getName().split("=", 1)[1])
        fs.rename(file, at(at(f"{path}/files"), f"{value}.csv"))
    for k in (0, 1):
        fs.delete(at(f"{path}/{k}"), True)


def _bars_as_files(spark, sf):
    """The daily bars as vendor files with dotted and spaced names; that of brand 9 has no adjusted close."""
    bars = p.daily_bars(spark, sf).select(
        F.concat(F.replace("symbol", F.lit("Brand#"), F.lit("B ")), F.lit(".NS")).alias("symbol"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.col("adj_close").alias("Adj Close"),
        F.col("close").alias("Close"),
        F.col("high").alias("High"),
        F.when(F.col("symbol") != "Brand#7", F.col("low")).alias("Low"),
        F.col("open").alias("Open"),
        F.col("volume").alias("Volume"),
    )
    columns = bars.columns[1:]
    path = _one_file_each(bars.where("symbol <> 'B 9.NS'"), "symbol", columns)
    nine = _one_file_each(bars.where("symbol = 'B 9.NS'"), "symbol", [x for x in columns if x != "Adj Close"])
    return [path, nine]


@query(
    "read_bar_files",
    with_ctes("SELECT replace(symbol, 'Brand#', 'B ') || '.NS' AS symbol, ts, adj_close FROM bars WHERE symbol <> 'Brand#9'", "bars"),
)
def read_bar_files(spark, sf):
    """One field of a folder of per-instrument files."""
    return files.read_bars(spark, _bars_as_files(spark, sf), fields=["adj_close"])


@query(
    "read_ohlc_files",
    with_ctes(
        "SELECT replace(symbol, 'Brand#', 'B ') || '.NS' AS symbol, ts, open, high, low, close FROM bars WHERE symbol <> 'Brand#7'",
        "bars",
    ),
)
def read_ohlc_files(spark, sf):
    """Full bars; an instrument without one of the fields is left out."""
    ohlc = ["open", "high", "low", "close"]
    return files.read_bars(spark, _bars_as_files(spark, sf), fields=ohlc, require=ohlc)


@query(
    "quoted_snapshots",
    """SELECT make_date(2019 + p_partkey % 3, 7, 25) AS as_of, 'P' || p_partkey AS symbol, 'The "' || p_name || '", ' || chr(10) || p_brand AS company,
       CASE WHEN p_partkey % 3 <> 1 THEN p_type END AS industry, CASE WHEN p_partkey % 5 = 0 THEN 'Symbol' ELSE 'EQ' END AS series, CAST(NULL AS VARCHAR) AS isin FROM part""",
)
def quoted_snapshots(spark, sf):
    """Constituent lists with quotes, commas and line breaks in their cells, several files a day, columns by name."""
    part, path = p.table(spark, sf, "part"), scratch_path(spark, "snapshots")
    rows = part.select(
        F.make_date((F.lit(2019) + F.col("p_partkey") % 3).cast("int"), F.lit(7), F.lit(25)).alias("as_of"),
        F.concat(F.lit('The "'), "p_name", F.lit('", \n'), "p_brand").alias("Company Name"),
        F.col("p_type").alias("Industry"),
        F.when(F.col("p_partkey") % 5 == 0, "Symbol").otherwise("EQ").alias("SERIES"),
        F.concat(F.lit("P"), "p_partkey").alias("Symbol"),
    )
    full, short = rows.where("year(as_of) <> 2020"), rows.where("year(as_of) = 2020").select("as_of", "Symbol", "SERIES", "Company Name")
    for some in (full, short):
        some.write.mode("append").partitionBy("as_of").option("header", "true").option("escape", '"').csv(path)
    return files.read_snapshots(spark, path, label="folder")


@query("read_intraday_files", with_ctes("SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, open, close FROM hours", "hours"))
def read_intraday_files(spark, sf):
    """S3: intraday open/close scan; the offset is cut, the wall clock stays."""
    bars = p.intraday_bars(spark, sf).select(
        "symbol",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("Datetime"),
        F.col("open").alias("Open"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.col("close").alias("Close"),
        F.col("n").alias("Volume"),
    )
    path = _one_file_each(bars, "symbol", bars.columns[1:])
    bars = files.read_bars(spark, path, schemas.INTRADAY_FILE, ["open", "close"], intraday=True)
    return bars.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "open", "close")


@query(
    "refreshed_cache",
    with_ctes("SELECT 'B ' || k AS symbol, ts, close, volume FROM bars JOIN brands USING (symbol) WHERE ts < DATE '2000-07-01' OR k <= 5", "bars", "brands"),
)
def refreshed_cache(spark, sf):
    """A consolidated copy built on the first miss, then refreshed for the instruments whose files changed."""
    source, copy = scratch_path(spark, "vendor"), scratch_path(spark, "copy")
    brand = F.replace("symbol", F.lit("Brand#"), F.lit("")).cast("int")
    bars = p.daily_bars(spark, sf).select(
        F.concat(F.lit("B "), brand).alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.col("close").alias("Close"), F.col("volume").alias("Volume")
    )
    arrive = lambda some: some.write.mode("append").partitionBy("symbol").option("header", "true").csv(source)
    refresh = lambda: cache.refresh(spark, source, copy, lambda paths: files.read_bars(spark, paths, fields=["close", "volume"], label="folder"), "folder")
    arrive(bars.where("Date < '2000-07-01'"))
    refresh()
    arrive(bars.where((F.col("Date") >= "2000-07-01") & (F.substring("symbol", 3, 9).cast("int") <= 5)))
    refresh()
    return cache.read_cache(spark, copy).select("symbol", "ts", "close", "volume")


@query("bar_table_roundtrip", with_ctes("SELECT symbol, ts, close, volume FROM bars WHERE year(ts) >= 1997", "bars"))
def bar_table_roundtrip(spark, sf):
    """Consolidated columnar table; the year filter prunes partitions."""
    path = scratch_path(spark, "bars")
    sinks.write_bars(p.daily_bars(spark, sf), path)
    return files.read_table(spark, path).where("year >= 1997").select("symbol", "ts", "close", "volume")


@query(
    "series_with_fallback",
    with_ctes("SELECT symbol AS series_id, ts, coalesce(CASE WHEN day(ts) > 3 THEN adj_close END, close) AS value FROM bars", "bars"),
)
def series_with_fallback(spark, sf):
    """Adjusted close where there is one, else the close."""
    bars = p.daily_bars(spark, sf).withColumn("adj_close", F.when(F.dayofmonth("ts") > 3, F.col("adj_close")))
    return files.read_series(bars)


@query(
    "named_instrument_series",
    with_ctes("SELECT 'index_' || k AS series_id, ts, close AS value FROM bars JOIN brands USING (symbol) WHERE k <= 5", "bars", "brands"),
)
def named_instrument_series(spark, sf):
    """Daily series of the instruments a dimension table names."""
    brand = F.replace("symbol", F.lit("Brand#"), F.lit("")).cast("int")
    dim = p.universes(spark, sf).where("universe_id = 'small'").where(brand <= 5)
    dim = dim.select(F.concat(F.lit("index_"), brand).alias("series_id"), "symbol")
    return files.read_series(p.daily_bars(spark, sf), dim, "close")


@query(
    "fund_nav_lookup",
    with_ctes("SELECT substr(series_id, 3) AS fund, ts, value AS nav FROM series WHERE substr(series_id, 1, 1) IN ('1', '2', '3')", "series"),
)
def fund_nav_lookup(spark, sf):
    """Fund values by scheme code, through the fund dimension."""
    s = p.series(spark, sf)
    funds = s.select("series_id").distinct().where("substr(series_id, 1, 1) IN ('1', '2', '3')")
    dim = funds.select(F.col("series_id").alias("scheme_code"), F.substr("series_id", F.lit(3)).alias("fund"))
    return s.join(dim, F.col("series_id") == F.col("scheme_code")).select("fund", "ts", F.col("value").alias("nav"))


@query("universe_lists", with_ctes("SELECT universe_id, symbol FROM universe", "universe"))
def universe_lists(spark, sf):
    """Symbol lists, the set named after its file."""
    u = p.universes(spark, sf).select("universe_id", F.concat(F.lit(" "), "symbol").alias("Symbol"), F.lit("EQ").alias("Series"))
    return files.read_symbol_sets(spark, _one_file_each(u, "universe_id", ["Symbol", "Series"]))


@query("parse_nav_json", with_ctes("SELECT series_id, ts, value FROM dseries WHERE day(ts) <> 1", "dseries"))
def parse_nav_json(spark, sf):
    """NAV payloads; unreadable values are dropped."""
    nav = F.when(F.dayofmonth("ts") == 1, F.lit("N.A.")).otherwise(F.col("value").cast("string"))
    entry = F.struct(F.date_format("ts", "dd-MM-yyyy").alias("date"), nav.alias("nav"))
    text = (
        p.series_daily(spark, sf)
        .groupBy("series_id", F.trunc("ts", "month"))
        .agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("payload"))
    )
    return payloads.parse_nav_json(text)


@query(
    "parse_candle_json",
    with_ctes("SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, open, high, low, close, CAST(n AS DOUBLE) AS volume FROM hours", "hours"),
)
def parse_candle_json(spark, sf):
    """Candle arrays to bars, duplicates removed."""
    cell = F.array(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")),
        *[F.col(x).cast("string") for x in ("open", "high", "low", "close", "n")],
        F.lit("0"),
    )
    bars = p.intraday_bars(spark, sf)
    text = (
        bars.unionByName(bars)
        .groupBy("symbol", F.to_date("ts"))
        .agg(F.to_json(F.struct(F.struct(F.collect_list(cell).alias("candles")).alias("data"))).alias("payload"))
    )
    out = payloads.parse_candles(text)
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "open", "high", "low", "close", "volume")


@query(
    "parse_index_history",
    with_ctes(
        """SELECT series_id AS symbol, ts, CASE WHEN day(ts) % 2 = 0 THEN value ELSE value - 1 END AS open, value + 2 AS high,
        value AS low, value AS close, value AS adj_close, 0e0 AS volume FROM dseries""",
        "dseries",
    ),
)
def parse_index_history(spark, sf):
    """Text history with dashes and thousands separators; the last of several rows of a day stays."""
    money = lambda v: F.format_number(v, 2)
    rows = p.series_daily(spark, sf).select(
        F.col("series_id").alias("symbol"),
        F.date_format("ts", "dd MMM yyyy").alias("day"),
        F.when(F.dayofmonth("ts") % 2 == 0, F.lit("-")).otherwise(money(F.col("value") - 1)).alias("open"),
        money(F.col("value") + 2).alias("high"),
        F.lit("-").alias("low"),
        money(F.col("value")).alias("close"),
        F.lit(2).alias("seq"),
    )
    stale = rows.withColumns({"close": F.lit("1.00"), "seq": F.lit(1)})
    return p.rounded(payloads.parse_index_history(rows.unionByName(stale)), 2)


@query(
    "clean_symbol_list",
    with_ctes("SELECT symbol FROM brands WHERE k NOT IN (3, 4)", "brands"),
)
def clean_symbol_list(spark, sf):
    """Trim, drop blanks, header rows and index underlyings."""
    n = F.col("p_partkey") % 10
    raw = p.table(spark, sf, "part").select(
        F.explode(
            F.array(F.concat(F.lit(" "), "p_brand", F.lit("  ")), F.when(n == 0, "Symbol").when(n == 1, "  ").otherwise("SYMBOL"))
        ).alias("Symbol")
    )
    return clean.clean_symbol_list(raw, exclude=["Brand#3", "Brand#4"])


@query(
    "instrument_map",
    "SELECT p_brand || p_partkey AS symbol, 'K|' || p_partkey AS instrument_key FROM part WHERE p_size < 25 AND p_type = 'ECONOMY'",
)
def instrument_map(spark, sf):
    """Instrument master to symbol/key pairs."""
    master = p.table(spark, sf, "part").select(
        F.concat("p_brand", "p_partkey").alias("tradingsymbol"),
        F.concat(F.lit("K|"), "p_partkey").alias("instrument_key"),
        F.when(F.col("p_size") < 25, "EQUITY").otherwise("FUTSTK").alias("instrument_type"),
        F.when(F.col("p_type") == "ECONOMY", "NSE_EQ").otherwise("NSE_FO").alias("exchange"),
    )
    return payloads.instrument_map(master)


@query(
    "parse_index_events",
    with_ctes("SELECT date, 'Customer ' || symbol AS name, action, count(*) AS n FROM mevents GROUP BY ALL", "mevents"),
)
def parse_index_events(spark, sf):
    """inclusion/exclusion log with dates of mixed form."""
    e = p.membership_events(spark, sf)
    text = F.when(F.dayofmonth("date") % 2 == 0, F.date_format("date", "dd-MM-yyyy")).otherwise(
        F.date_format("date", "yyyy-MM-dd 00:00:00")
    )
    what = F.when(F.col("action") == "IN", "Inclusion into Index").otherwise("Exclusion from Index")
    raw = e.select(
        text.alias("Event Date"), F.concat(F.lit("Customer "), "symbol", F.lit(" ")).alias("Scrip Name"), what.alias("Description")
    )
    return files.parse_index_events(raw).groupBy("date", "name", "action").agg(F.count("*").alias("n"))


@query(
    "read_snapshots",
    with_ctes("SELECT DISTINCT as_of, CASE WHEN symbol % 5 = 0 THEN 'C' || (symbol + 1) ELSE 'C' || symbol END AS symbol FROM snaps", "snaps"),
)
def read_snapshots(spark, sf):
    """Dated constituent lists, symbols made canonical."""
    snaps = p.snapshots(spark, sf)
    code = F.concat(F.lit("C"), "symbol")
    lists = snaps.select(
        F.date_format("as_of", "yyyy-MM-dd").alias("as_of"),
        F.lit("Name, Ltd.").alias("Company Name"),
        F.lit("Any").alias("Industry"),
        F.concat(F.lit(" "), code).alias("Symbol"),
        F.lit("EQ").alias("Series"),
        F.lit("-").alias("ISIN Code"),
    )
    path = _one_file_each(lists, "as_of", lists.columns[1:])
    canon = snaps.where("symbol % 5 = 0").select(
        code.alias("symbol"), F.concat(F.lit("C"), F.col("symbol") + 1).alias("canonical")
    ).distinct()
    return files.read_snapshots(spark, path, canon).select("as_of", "symbol").distinct()


@query("report_roundtrip", with_ctes("SELECT series_id, ts, round(value, 2) AS value FROM series", "series"))
def report_roundtrip(spark, sf):
    """A result table as CSV with header."""
    path = scratch_path(spark, "report")
    sinks.write_report(p.series(spark, sf).select("series_id", "ts", "value"), path)
    return spark.read.schema("series_id STRING, ts DATE, value DOUBLE").option("header", "true").csv(path)


@query(
    "replace_by_key",
    with_ctes(
        "SELECT series_id AS strategy_id, ts, CASE WHEN substr(series_id, 1, 1) IN ('1', '2') THEN value + 1 ELSE value END AS value FROM series WHERE substr(series_id, 1, 1) <> '3' AND NOT (substr(series_id, 1, 1) = '1' AND year(ts) < 1998)",
        "series",
    ),
)
def replace_by_key(spark, sf):
    """Replaced keys lose their old rows, also where nothing replaces them; other keys keep theirs."""
    path = scratch_path(spark, "results")
    s = p.series(spark, sf).select(F.col("series_id").alias("strategy_id"), "ts", "value")
    sinks.replace_keys(s, path)
    new = s.where("substr(strategy_id, 1, 1) IN ('1', '2')").withColumn("value", F.col("value") + 1)
    sinks.replace_keys(new.where("NOT (substr(strategy_id, 1, 1) = '1' AND year(ts) < 1998)"), path, keys=s.where("substr(strategy_id, 1, 1) IN ('1', '2', '3')"))
    back = spark.read.schema("strategy_id STRING, ts DATE, value DOUBLE").parquet(path)
    return p.rounded(back, 2)


def _registry(spark, sf):
    s = p.table(spark, sf, "supplier")
    params = F.to_json(
        F.struct(
            F.lit("small").alias("universe"),
            (F.col("s_nationkey") % 4 * 3).alias("lookback_months"),
            F.lit(1).alias("skip_months"),
            F.lit(1).alias("hold_months"),
            F.when(F.col("s_suppkey") % 7 != 0, 5).alias("n_stocks"),
            F.lit(10.0).alias("min_price"),
        )
    )
    return s.select(
        F.concat(F.lit("s"), "s_suppkey").alias("strategy_id"),
        F.concat(F.lit("name "), F.col("s_suppkey").cast("int") % 40).alias("name"),
        params.alias("parameters"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_computed_at"),
        "s_suppkey",
    )


@query(
    "registry_admission",
    """WITH reg AS (SELECT 's' || s_suppkey AS strategy_id, 'name ' || (s_suppkey % 40) AS name, s_suppkey FROM supplier),
    cand AS (SELECT c.*, EXISTS (SELECT 1 FROM reg r WHERE r.s_suppkey < 20 AND r.name = c.name) AS taken,
             min(strategy_id) OVER (PARTITION BY name) = strategy_id AS first FROM reg c WHERE s_suppkey >= 10),
    pos AS (SELECT strategy_id, row_number() OVER (ORDER BY strategy_id) AS pos FROM cand WHERE NOT taken AND first)
    SELECT strategy_id, name, pos IS NOT NULL AND pos <= 30 - (SELECT count(*) FROM reg WHERE s_suppkey < 20) AS admitted,
      CASE WHEN pos IS NULL THEN 'name exists' WHEN pos > 30 - (SELECT count(*) FROM reg WHERE s_suppkey < 20) THEN 'registry full' END AS reason
    FROM cand LEFT JOIN pos USING (strategy_id)""",
)
def registry_admission(spark, sf):
    """Unique names and the cap."""
    r = _registry(spark, sf)
    out = registry.admit(r.where("s_suppkey < 20"), r.where("s_suppkey >= 10").select("strategy_id", "name"), cap=30)
    return out.select("strategy_id", "name", "admitted", "reason")


@query(
    "registry_parameters",
    """SELECT 's' || s_suppkey AS strategy_id, s_nationkey % 4 * 3 AS lookback_months,
       s_suppkey % 7 <> 0 AND s_nationkey % 4 > 0 AS valid,
       CASE WHEN s_suppkey % 7 <> 0 AND s_nationkey % 4 > 0 THEN '2024-02-01' END AS computed_on FROM supplier""",
)
def registry_parameters(spark, sf):
    """Typed parameters from JSON, unusable rows marked, recompute stamp."""
    typed = registry.with_parameters(_registry(spark, sf))
    stamped = registry.mark_computed(typed, typed.where("valid"), "2024-02-01 00:00:00")
    return stamped.select(
        "strategy_id",
        F.col("p.lookback_months").alias("lookback_months"),
        "valid",
        F.date_format("last_computed_at", "yyyy-MM-dd").alias("computed_on"),
    )


@query(
    "registry_events",
    """SELECT CAST(o_orderdate AS DATE) AS event_date, CAST(o_custkey AS VARCHAR) AS symbol, 'entry' AS action
       FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1999-06-01'""",
)
def registry_events(spark, sf):
    """Events of one strategy since a day."""
    events = p.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("strategy_id"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("o_custkey").cast("string").alias("symbol"),
        F.lit("entry").alias("action"),
    )
    return registry.list_events(events, "1-URGENT", "1999-06-01")


@query(
    "staleness",
    "SELECT event_type AS symbol, max(CAST(ts AS DATE)) AS data_as_of, DATE '2024-02-15' - max(CAST(ts AS DATE)) AS days_stale FROM events GROUP BY 1",
)
def staleness(spark, sf):
    """Age of the newest row."""
    from barloom.operators import grid

    e = p.table(spark, sf, "events").withColumnRenamed("event_type", "symbol")
    return grid.staleness_days(e, "2024-02-15", "symbol")


