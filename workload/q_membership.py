"""Membership construction and name resolution (M*, J10-J12, G18, S14 pipeline)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import membership as m
from barloom.plans.membership import build_membership
from barloom.session import materialise
from workload import panels as p
from workload.panels import define, with_ctes
from workload.registry import query

define(
    "ivals",
    """SELECT symbol, date AS "start", nd AS "end" FROM (SELECT *, lead(date) OVER w AS nd FROM (
       SELECT *, lag(action) OVER w AS pa FROM (SELECT DISTINCT symbol, date, action FROM mevents) WINDOW w AS (PARTITION BY symbol ORDER BY date, action))
       WHERE (pa IS NULL AND action = 'IN') OR pa <> action WINDOW w AS (PARTITION BY symbol ORDER BY date, action)) WHERE action = 'IN'""",
    "mevents",
)


@query("membership_intervals", with_ctes('SELECT symbol, "start", "end" FROM ivals', "ivals"))
def membership_intervals(spark, sf):
    """M2: event log to intervals."""
    return m.collapse_intervals(p.membership_events(spark, sf))


@query(
    "snapshot_diff",
    with_ctes(
        """, k AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS k FROM (SELECT DISTINCT as_of FROM snaps)), s AS (SELECT symbol, k FROM snaps JOIN k USING (as_of))
        SELECT k.as_of AS date, symbol, action FROM (SELECT symbol, k, 'IN' AS action FROM s a WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.symbol = a.symbol AND b.k = a.k - 1)
        UNION ALL SELECT symbol, k + 1, 'OUT' FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.symbol = a.symbol AND b.k = a.k + 1)) x JOIN k USING (k)""",
        "snaps",
    ).replace(")\n,", "),", 1),
)
def snapshot_diff(spark, sf):
    """M1: changes between consecutive snapshots."""
    return m.snapshot_diff(p.snapshots(spark, sf)).drop("source")


define(
    "yearly",
    "SELECT CAST(DATE '1995-07-01' + to_years(CAST(year(o_orderdate) - 1995 AS INTEGER)) AS DATE) AS as_of, o_custkey AS symbol FROM orders WHERE month(o_orderdate) >= 7 GROUP BY ALL",
)


@query(
    "snapshot_reconciliation",
    with_ctes(
        """SELECT (SELECT CAST(min(as_of) - 1 AS DATE) FROM yearly) AS date, symbol, 'OUT' AS action FROM (SELECT symbol, sum(CASE action WHEN 'IN' THEN 1 ELSE -1 END) AS b FROM mevents
        WHERE date < (SELECT min(as_of) FROM yearly) GROUP BY 1) WHERE b > 0 AND (CASE WHEN symbol % 5 = 0 THEN symbol + 1 ELSE symbol END) NOT IN
        (SELECT CASE WHEN symbol % 5 = 0 THEN symbol + 1 ELSE symbol END FROM yearly WHERE as_of = (SELECT min(as_of) FROM yearly))""",
        "mevents",
        "yearly",
    ),
)
def snapshot_reconciliation(spark, sf):
    """Intervals the earliest of all snapshots disproves; a snapshot of July holds who orders in the rest of its year."""
    orders = p.table(spark, sf, "orders").where(F.month("o_orderdate") >= 7)
    snaps = orders.select(F.make_date(F.year("o_orderdate"), F.lit(7), F.lit(1)).alias("as_of"), F.col("o_custkey").alias("symbol")).distinct()
    events = p.membership_events(spark, sf)
    canon = snaps.select("symbol").unionByName(events.select("symbol")).distinct()
    canon = canon.where("symbol % 5 = 0").select("symbol", (F.col("symbol") + 1).alias("canonical"))
    return m.reconcile_with_snapshot(events, snaps, canon).drop("source")


def _masters(spark, sf):
    part = p.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_partkey").alias("seq"))
    code = F.concat(F.lit("P"), "p_partkey")
    label = F.concat("p_name", F.lit(" "), "p_brand")
    master = part.where("p_partkey % 3 = 0").select(code.alias("symbol"), label.alias("company"), "seq")
    changed = part.where("p_partkey % 3 = 1").select(
        code.alias("symbol"),
        F.concat(label, F.lit(" Ltd.")).alias("prev_name"),
        F.concat(label, F.lit(" & Sons")).alias("new_name"),
        "seq",
    )
    renamed = part.where("p_partkey % 3 = 2").select(
        F.concat(label, F.lit(" "), "p_type").alias("company"),
        code.alias("old_symbol"),
        F.concat(F.lit("P"), F.col("p_partkey") + 1).alias("new_symbol"),
        "seq",
    )
    return master, changed, renamed


define(
    "aliases",
    """SELECT n AS norm_name, arg_min(s, (lvl, o, s)) AS symbol FROM (
       SELECT trim(upper(p_name || ' ' || p_brand)) AS n, 'P' || p_partkey AS s, 0 AS lvl, -p_partkey AS o FROM part WHERE p_partkey % 3 = 0
       UNION ALL SELECT upper(p_name || ' ' || p_brand), 'P' || p_partkey, 1, 2 * p_partkey FROM part WHERE p_partkey % 3 = 1
       UNION ALL SELECT upper(p_name || ' ' || p_brand) || ' AND SONS', 'P' || p_partkey, 1, 2 * p_partkey + 1 FROM part WHERE p_partkey % 3 = 1
       UNION ALL SELECT upper(p_name || ' ' || p_brand || ' ' || p_type), t, 2, 2 * p_partkey FROM (SELECT *, 'P' || CASE WHEN p_partkey + 1 IN (SELECT p_partkey FROM part) THEN p_partkey + 1 ELSE p_partkey END AS t FROM part WHERE p_partkey % 3 = 2)
       UNION ALL SELECT 'P' || p_partkey, 'P' || CASE WHEN p_partkey + 1 IN (SELECT p_partkey FROM part) THEN p_partkey + 1 ELSE p_partkey END, 2, 2 * p_partkey + 1 FROM part WHERE p_partkey % 3 = 2) GROUP BY 1""",
)


@query("alias_table", with_ctes("SELECT * FROM aliases", "aliases"))
def alias_table(spark, sf):
    """Names to symbols by precedence."""
    return m.build_alias_table(*_masters(spark, sf))


def _named_log(spark, sf):
    """An inclusion log over part names, some with typing errors."""
    base = F.concat("p_name", F.lit(" "), "p_brand")
    n = F.col("p_partkey") % 5
    name = (
        F.when(n == 0, F.concat(base, F.lit(", Limited")))
        .when(n == 1, F.overlay(base, F.lit("x"), F.lit(3)))
        .when(n == 2, F.concat(F.lit("Unknown Firm "), "p_partkey", F.lit(" of "), "p_type"))
        .when(n == 3, F.concat(base, F.lit(" & Sons")))
        .otherwise(F.concat("p_brand", F.lit(" "), "p_name"))
    )
    return p.table(spark, sf, "part").select(
        F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")).alias("date"),
        name.alias("name"),
        F.when(F.col("p_partkey") % 2 == 0, "IN").otherwise("OUT").alias("action"),
    )


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(upper(name), '&', ' AND '), '[.\-,()'']', ' ', 'g'), '\b(LIMITED|LTD)\b', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'))"""
define(
    "nlog",
    f"""SELECT *, {_NORM} AS norm FROM (SELECT CAST(DATE '1998-01-01' + CAST(p_partkey % 900 AS INTEGER) AS DATE) AS date, CASE WHEN p_partkey % 2 = 0 THEN 'IN' ELSE 'OUT' END AS action,
       CASE p_partkey % 5 WHEN 0 THEN base || ', Limited' WHEN 1 THEN substr(base, 1, 2) || 'x' || substr(base, 4) WHEN 2 THEN 'Unknown Firm ' || p_partkey || ' of ' || p_type
       WHEN 3 THEN base || ' & Sons' ELSE p_brand || ' ' || p_name END AS name FROM (SELECT *, p_name || ' ' || p_brand AS base FROM part))""",
)
define(
    "npairs",
    """SELECT w, norm_name AS k FROM (SELECT DISTINCT norm AS w FROM nlog WHERE norm <> '' AND norm NOT IN (SELECT norm_name FROM aliases)) JOIN (SELECT * FROM aliases WHERE norm_name <> '')
       ON 1e0 * least(length(w), length(norm_name)) >= 0.78e0 * greatest(length(w), length(norm_name)) AND levenshtein(w, norm_name) <= 0.12e0 * (length(w) + length(norm_name)) + 1e-9""",
    "nlog",
    "aliases",
)
# the longest common block (first in the known name, then in the wanted one), then the same left and right of it
_BLOCK_OF = """list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(list_filter(range(1, length(x) - i + 2), lambda n: strpos(y, substr(x, i, n)) > 0), lambda n: {'n': n, 'i': -i}))))"""
define(
    "nblocks",
    f"""SELECT w, k, k AS x, w AS y, 0::BIGINT AS n FROM npairs UNION ALL
       SELECT w, k, unnest([substr(x, 1, -b.i - 1), substr(x, b.n - b.i)]), unnest([substr(y, 1, strpos(y, substr(x, -b.i, b.n)) - 1), substr(y, strpos(y, substr(x, -b.i, b.n)) + b.n)]), unnest([b.n, 0])
       FROM (SELECT *, {_BLOCK_OF} AS b FROM nblocks WHERE x <> '' AND y <> '') WHERE b IS NOT NULL""",
    "npairs",
)
define(
    "nclose",
    "SELECT w, arg_max(k, (score, k)) AS k FROM (SELECT w, k, 2e0 * sum(n) / (length(w) + length(k)) AS score FROM nblocks GROUP BY w, k) WHERE score >= 0.88e0 GROUP BY w",
    "nblocks",
)
define(
    "nresolved",
    """SELECT l.date, l.action, l.name, coalesce(a.symbol, f.symbol) AS symbol, CASE WHEN a.symbol IS NOT NULL THEN 'exact' WHEN f.symbol IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END AS method
       FROM nlog l LEFT JOIN aliases a ON a.norm_name = l.norm LEFT JOIN nclose ON w = l.norm LEFT JOIN aliases f ON f.norm_name = nclose.k""",
    "nlog",
    "aliases",
    "nclose",
)


@query("resolved_names", with_ctes("SELECT name, symbol, method, count(*) AS n FROM nresolved GROUP BY ALL", "nresolved"))
def resolved_names(spark, sf):
    """Exact, else closest name."""
    aliases = materialise(m.build_alias_table(*_masters(spark, sf)))
    return m.resolve_names(_named_log(spark, sf), aliases).groupBy("name", "symbol", "method").agg(F.count("*").alias("n"))


@query("resolution_report", with_ctes("SELECT method, count(*) AS n_events, count(DISTINCT name) AS n_names FROM nresolved GROUP BY 1", "nresolved"))
def resolution_report(spark, sf):
    """M3: names by method of resolution."""
    aliases = materialise(m.build_alias_table(*_masters(spark, sf)))
    return m.resolution_report(m.resolve_names(_named_log(spark, sf), aliases))


@query(
    "rename_components",
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey % 7 <> 0),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
    k AS (SELECT a, min(b) AS l, min(b) FILTER (b % 4 = 1) AS act FROM r GROUP BY 1)
    SELECT CAST(a AS BIGINT) AS symbol, CAST(coalesce(act, l) AS BIGINT) AS canonical FROM k""",
)
def rename_components(spark, sf):
    """Every symbol of a rename chain to one canonical symbol."""
    part = p.table(spark, sf, "part")
    edges = part.where("p_partkey % 7 <> 0").select(
        F.col("p_partkey").alias("old"), F.call_function("div", F.col("p_partkey"), F.lit(2)).alias("new")
    )
    active = part.where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("symbol"))
    return m.canonicalize(edges, active)


define(
    "pcanon",
    """SELECT symbol, coalesce(min(CASE WHEN listed THEN member END), min(member)) AS canonical FROM (
       SELECT a AS symbol, b AS member, b IN (SELECT 'P' || p_partkey FROM part WHERE p_partkey % 3 = 0) AS listed FROM (
       SELECT 'P' || p_partkey AS a, unnest(['P' || p_partkey, 'P' || (p_partkey + 1)]) AS b FROM part WHERE p_partkey % 3 = 2
       UNION ALL SELECT 'P' || (p_partkey + 1), unnest(['P' || p_partkey, 'P' || (p_partkey + 1)]) FROM part WHERE p_partkey % 3 = 2)) GROUP BY 1""",
)
define("psnaps", "SELECT DISTINCT make_date(year(l_shipdate), 7, 1) AS as_of, 'P' || l_partkey AS symbol FROM lineitem")
define(
    "pevents",
    """SELECT date, symbol, action FROM nresolved WHERE symbol IS NOT NULL
       UNION ALL SELECT (SELECT CAST(min(as_of) - 1 AS DATE) FROM psnaps), symbol, 'OUT' FROM (SELECT symbol, coalesce(canonical, symbol) AS c, sum(CASE action WHEN 'IN' THEN 1 ELSE -1 END) AS b
       FROM nresolved LEFT JOIN pcanon USING (symbol) WHERE symbol IS NOT NULL AND date < (SELECT min(as_of) FROM psnaps) GROUP BY 1, 2) WHERE b > 0
       AND c NOT IN (SELECT coalesce(canonical, symbol) FROM psnaps LEFT JOIN pcanon USING (symbol) WHERE as_of = (SELECT min(as_of) FROM psnaps))
       UNION ALL SELECT as_of, symbol, action FROM (SELECT symbol, k, 'IN' AS action FROM pmarks a ANTI JOIN (SELECT symbol, k + 1 AS k FROM pmarks) b USING (symbol, k) WHERE k > 1
       UNION ALL SELECT symbol, k + 1, 'OUT' FROM pmarks a ANTI JOIN (SELECT symbol, k - 1 AS k FROM pmarks) b USING (symbol, k)) JOIN (SELECT as_of, row_number() OVER (ORDER BY as_of) AS k FROM (SELECT DISTINCT as_of FROM psnaps)) USING (k)""",
    "nresolved",
    "pcanon",
    "psnaps",
    "pmarks",
)
define(
    "pmarks",
    "SELECT DISTINCT coalesce(canonical, symbol) AS symbol, k FROM psnaps LEFT JOIN pcanon USING (symbol) JOIN (SELECT as_of, row_number() OVER (ORDER BY as_of) AS k FROM (SELECT DISTINCT as_of FROM psnaps)) USING (as_of)",
    "psnaps",
    "pcanon",
)


@query(
    "membership_pipeline",
    with_ctes(
        """SELECT symbol, date AS "start", nd AS "end" FROM (SELECT *, lead(date) OVER w AS nd FROM (SELECT *, lag(action) OVER w AS pa FROM (SELECT DISTINCT symbol, date, action FROM pevents) WINDOW w AS (PARTITION BY symbol ORDER BY date, action))
        WHERE (pa IS NULL AND action = 'IN') OR pa <> action WINDOW w AS (PARTITION BY symbol ORDER BY date, action)) WHERE action = 'IN'""",
        "pevents",
    ),
)
def membership_pipeline(spark, sf):
    """M4: log, resolution, renames, snapshots and reconciliation to intervals."""
    master, changed, renamed = _masters(spark, sf)
    aliases = materialise(m.build_alias_table(master, changed, renamed))
    canon = materialise(m.canonicalize(
        renamed.select(F.col("old_symbol").alias("old"), F.col("new_symbol").alias("new")), master.select("symbol")
    ))
    line = p.table(spark, sf, "lineitem")
    snaps = line.select(
        F.make_date(F.year("l_shipdate"), F.lit(7), F.lit(1)).alias("as_of"), F.concat(F.lit("P"), "l_partkey").alias("symbol")
    ).distinct()
    built = build_membership(_named_log(spark, sf), aliases, canon, snaps)
    return built.intervals


