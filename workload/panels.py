"""Panels derived from the test tables, in Spark and as SQL common table expressions.

Raw rows reach a panel through one hash aggregation with map-side combine, so a brand, priority or
event type holding a large share of all rows is reduced where it lies and leaves at most one row per
calendar slot.  Averages are integer-exact (cents, integer division) so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import columns as c
from barloom.session import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents_average(value: str) -> Column:
    """Average in whole cents, integer division."""
    cents = F.sum(F.floor(F.col(value) * 100 + 0.5))
    return F.call_function("div", cents, F.count("*")).cast("double") / 100.0


#: Places on a day's tape and cents of a price; their product fits a long.
_TAPE, _CENTS = 2**30, 2**32


def _priced(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """``(symbol, ts, open, high, low, close, adj_close, volume)`` per brand and ship date."""
    # place in the tape, then price, packed into one long: a plain minimum stays in the hash aggregate,
    # a minimum over a struct would sort every row
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) % _TAPE
    first = place * _CENTS + cents
    bars = (
        _priced(spark, sf)
        .groupBy("symbol", F.col("l_shipdate").cast("date").alias("ts"))
        .agg(
            ((F.min(first) % _CENTS) / 100.0).alias("open"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            cents_average("l_extendedprice").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    adj = F.when(F.col("ts") < F.lit("1998-01-01").cast("date"), F.col("close") / 2).otherwise(F.col("close"))
    return materialise(bars.withColumn("adj_close", adj))


def monthly_panel(spark: SparkSession, sf: str) -> DataFrame:
    """``(symbol, period_end, period_no, price)``: average price per brand and ship month."""
    return materialise(
        _priced(spark, sf)
        .groupBy("symbol", c.period_no("l_shipdate").alias("period_no"))
        .agg(cents_average("l_extendedprice").alias("price"))
        .select("symbol", c.period_end_of("period_no").alias("period_end"), "period_no", "price")
    )


def weekly_panel(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(
        _priced(spark, sf)
        .groupBy("symbol", c.period_no("l_shipdate", "week").alias("period_no"))
        .agg(cents_average("l_extendedprice").alias("price"))
        .select("symbol", c.period_end_of("period_no", "week").alias("period_end"), "period_no", "price")
    )


def intraday_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars per event type."""
    return materialise(
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.count("*").alias("n"),
        )
        .withColumnRenamed("hour", "ts")
    )


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly average order value per priority: ``(series_id, ts, period_no, value)``."""
    return materialise(
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), c.period_no("o_orderdate").alias("period_no"))
        .agg(cents_average("o_totalprice").alias("value"))
        .select("series_id", c.period_end_of("period_no").alias("ts"), "period_no", "value")
    )


def series_daily(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"))
        .agg(cents_average("o_totalprice").alias("value"))
    )


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly average order value over all orders: ``(period_end, period_no, value)``."""
    return materialise(
        table(spark, sf, "orders")
        .groupBy(c.period_no("o_orderdate").alias("period_no"))
        .agg(cents_average("o_totalprice").alias("value"))
        .select(c.period_end_of("period_no").alias("period_end"), "period_no", "value")
    )


def _brand_no(col: str = "p_brand") -> Column:
    return F.replace(F.col(col), F.lit("Brand#"), F.lit("")).cast("int")


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """``(symbol, start, end)`` per brand."""
    k = _brand_no("symbol")
    return (
        table(spark, sf, "part")
        .select(F.col("p_brand").alias("symbol"))
        .distinct()
        .select(
            "symbol",
            F.add_months(F.lit("1995-01-01").cast("date"), k).alias("start"),
            F.when(k % 3 != 0, F.lit("1999-12-31").cast("date")).alias("end"),
        )
    )


def universes(spark: SparkSession, sf: str) -> DataFrame:
    """``(universe_id, symbol)``: ``small`` (first ten brands) and ``tradable`` (even brands)."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("_k", _brand_no("symbol"))
    small = brands.where("_k <= 10").select(F.lit("small").alias("universe_id"), "symbol")
    return small.unionByName(brands.where("_k % 2 = 0").select(F.lit("tradable").alias("universe_id"), "symbol"))


def membership_events(spark: SparkSession, sf: str) -> DataFrame:
    """``(symbol, date, action)``: orders opened count as IN, finished ones as OUT."""
    o = table(spark, sf, "orders").where("o_orderstatus IN ('O', 'F')")
    return o.select(
        F.col("o_custkey").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "O", "IN").otherwise("OUT").alias("action"),
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """``(as_of, symbol)``: customers ordering in a year, dated at its start."""
    o = table(spark, sf, "orders")
    return o.select(
        F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("as_of"), F.col("o_custkey").alias("symbol")
    ).distinct()


# -- the same in SQL ------------------------------------------------------------------------------

_PRICED = "lineitem l JOIN part p ON l.l_partkey = p.p_partkey"
_AVG = "CAST(sum(CAST(round({0} * 100) AS BIGINT)) // count(*) AS DOUBLE) / 100"
_MONTH = "(year({0}) * 12 + month({0}) - 1)"

CTES: dict[str, str] = {
    "bars": f"""SELECT *, CASE WHEN ts < DATE '1998-01-01' THEN close / 2 ELSE close END AS adj_close FROM (
        SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS ts,
               arg_min(l_extendedprice, ((l_orderkey * 8 + l_linenumber) % 1073741824, l_extendedprice)) AS open,
               max(l_extendedprice) AS high, min(l_extendedprice) AS low,
               {_AVG.format('l_extendedprice')} AS close, sum(l_quantity) AS volume
        FROM {_PRICED} GROUP BY 1, 2)""",
    "cal": "SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT ts FROM bars)",
    "ibars": "SELECT bars.*, cal.idx FROM bars JOIN cal USING (ts)",
    "panel": f"""SELECT p.p_brand AS symbol, last_day(l.l_shipdate) AS period_end,
        CAST({_MONTH.format('l.l_shipdate')} AS INTEGER) AS period_no, {_AVG.format('l_extendedprice')} AS price
        FROM {_PRICED} GROUP BY 1, 2, 3""",
    "wpanel": f"""SELECT symbol, DATE '1970-01-02' + CAST(period_no * 7 AS INTEGER) AS period_end, period_no, price FROM (
        SELECT p.p_brand AS symbol,
        CAST((CAST(l.l_shipdate AS DATE) - DATE '1970-01-02' + 6) // 7 AS INTEGER) AS period_no,
        {_AVG.format('l_extendedprice')} AS price FROM {_PRICED} GROUP BY 1, 2)""",
    "ret": """SELECT a.*, a.price / b.price - 1 AS r FROM panel a
        LEFT JOIN panel b ON a.symbol = b.symbol AND b.period_no = a.period_no - 1""",
    "hours": """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY 1, 2""",
    "hcal": "SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT ts FROM hours)",
    "ihours": "SELECT hours.*, hcal.idx FROM hours JOIN hcal USING (ts)",
    "series": f"""SELECT o_orderpriority AS series_id, last_day(o_orderdate) AS ts,
        CAST({_MONTH.format('o_orderdate')} AS INTEGER) AS period_no, {_AVG.format('o_totalprice')} AS value
        FROM orders GROUP BY 1, 2, 3""",
    "sret": """SELECT a.*, a.value / b.value - 1 AS ret FROM series a
        LEFT JOIN series b ON b.series_id = a.series_id AND b.period_no = a.period_no - 1""",
    "dseries": f"""SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, {_AVG.format('o_totalprice')} AS value
        FROM orders GROUP BY 1, 2""",
    "bench": f"""SELECT last_day(o_orderdate) AS period_end, CAST({_MONTH.format('o_orderdate')} AS INTEGER) AS period_no,
        {_AVG.format('o_totalprice')} AS value FROM orders GROUP BY 1, 2""",
    "bret": """SELECT a.period_end, a.period_no, a.value / b.value - 1 AS ret FROM bench a
        LEFT JOIN bench b ON b.period_no = a.period_no - 1""",
    "brands": "SELECT DISTINCT p_brand AS symbol, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS k FROM part",
    "members": """SELECT symbol, CAST(DATE '1995-01-01' + to_months(k) AS DATE) AS "start",
        CASE WHEN k % 3 <> 0 THEN DATE '1999-12-31' END AS "end" FROM brands""",
    "universe": """SELECT 'small' AS universe_id, symbol FROM brands WHERE k <= 10
        UNION ALL SELECT 'tradable', symbol FROM brands WHERE k % 2 = 0""",
    "mevents": """SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date,
        CASE WHEN o_orderstatus = 'O' THEN 'IN' ELSE 'OUT' END AS action FROM orders WHERE o_orderstatus IN ('O', 'F')""",
    "snaps": "SELECT DISTINCT make_date(year(o_orderdate), 1, 1) AS as_of, o_custkey AS symbol FROM orders",
}

_NEEDS = {
    "cal": ["bars"],
    "ibars": ["cal"],
    "ret": ["panel"],
    "hcal": ["hours"],
    "ihours": ["hcal"],
    "sret": ["series"],
    "bret": ["bench"],
    "members": ["brands"],
    "universe": ["brands"],
}


def define(name: str, sql: str, *needs: str) -> None:
    """Add a shared CTE for the query modules."""
    CTES[name] = sql
    _NEEDS[name] = list(needs)


def with_ctes(body: str, *names: str) -> str:
    """``WITH <names and what they need> body``."""
    done: list[str] = []

    def visit(n):
        if n in done:
            return
        for d in _NEEDS.get(n, ()):
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in done)
    return f"WITH RECURSIVE {head}\n{body}" if done else body


def rnd(expr: str, digits: int = 6) -> str:
    """Rounded output expression without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = 6, *skip: str) -> DataFrame:
    """Round every double column of a result."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in skip]
    return df.withColumns({d: F.round(d, digits) + F.lit(0.0) for d in doubles}) if doubles else df
