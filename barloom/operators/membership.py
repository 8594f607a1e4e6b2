"""Point-in-time membership from event logs and snapshots; names, renames and their resolution."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from barloom.functions import columns as c
from barloom.operators.components import connected_components
from barloom.session import materialise


def collapse_intervals(events: DataFrame, by: str = "symbol", day: str = "date") -> DataFrame:
    """IN/OUT events -> ``(by, start, end)``: the first IN opens, the first OUT closes, repeats are ignored.

    On one day IN comes before OUT, so the log reduces to its distinct (instrument, day, action)
    first: what reaches an instrument's window is bounded by its days, however often an event is
    repeated.  An interval without an OUT stays open.
    """
    distinct = events.select(by, day, "action").distinct()
    w = Window.partitionBy(by).orderBy(day, "action")
    turns = distinct.withColumn("_before", F.lag("action").over(w)).where(
        (F.col("_before").isNull() & (F.col("action") == "IN")) | (F.col("_before") != F.col("action"))
    )
    return (
        turns.withColumn("end", F.lead(day).over(w))
        .where("action = 'IN'")
        .select(by, F.col(day).alias("start"), "end")
    )


def snapshot_diff(snapshots: DataFrame, by: str = "symbol", as_of: str = "as_of") -> DataFrame:
    """IN/OUT events between consecutive snapshots, dated at the later one: ``(date, by, action, source)``."""
    ordinals = snapshots.agg(F.array_sort(F.collect_set(as_of)).alias("_all")).select(
        F.posexplode("_all").alias("_k", as_of)
    )
    rows = snapshots.select(by, as_of).distinct().join(ordinals, as_of)
    w = Window.partitionBy(by).orderBy("_k")
    rows = rows.withColumns({"_p": F.lag("_k").over(w), "_n": F.lead("_k").over(w)})
    joined = rows.where("_k > 0 AND (_p IS NULL OR _p < _k - 1)").select(by, "_k", F.lit("IN").alias("action"))
    gone = rows.where("_n IS NULL OR _n > _k + 1").select(by, (F.col("_k") + 1).alias("_k"), F.lit("OUT").alias("action"))
    return joined.unionByName(gone).join(ordinals, "_k").select(
        F.col(as_of).alias("date"), by, "action", F.lit("snapshot_diff").alias("source")
    )


def reconcile_with_snapshot(
    events: DataFrame, snapshot: DataFrame, canon: DataFrame | None = None, by: str = "symbol"
) -> DataFrame:
    """Close intervals the earliest snapshot disproves.

    A symbol with more INs than OUTs before the snapshot's day that is not in it (after canonical
    renaming) gets an OUT on the day before.  ``snapshot(as_of, symbol)``; only its earliest day counts.
    """
    first = snapshot.agg(F.min("as_of")).scalar()
    earliest = snapshot.where(F.col("as_of") == first).select(by)
    balance = (
        events.where(F.col("date") < first)
        .groupBy(by)
        .agg(F.sum(F.when(F.col("action") == "IN", 1).otherwise(-1)).alias("_balance"))
        .where("_balance > 0")
    )
    if canon is not None:
        balance = apply_canon(balance.withColumn("_canon", F.col(by)), canon, "_canon")
        earliest = apply_canon(earliest, canon, by)
    else:
        balance = balance.withColumn("_canon", F.col(by))
    missing = balance.join(earliest.select(F.col(by).alias("_canon")).distinct(), "_canon", "left_anti")
    return missing.select(
        F.date_sub(first, 1).alias("date"),
        by,
        F.lit("OUT").alias("action"),
        F.lit("reconciliation_vs_earliest_snapshot").alias("source"),
    )


def apply_canon(df: DataFrame, canon: DataFrame, column: str = "symbol") -> DataFrame:
    """Replace renamed symbols by their canonical one; others stay."""
    m = canon.select(F.col("symbol").alias(column), F.col("canonical").alias("_to"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def build_alias_table(master: DataFrame, name_changes: DataFrame, symbol_changes: DataFrame) -> DataFrame:
    """Normalised name -> symbol, by precedence: ``(norm_name, symbol)``.

    ``master(symbol, company, seq)``: the last entry of a name wins.  Then
    ``name_changes(symbol, prev_name, new_name, seq)`` and ``symbol_changes(company, old_symbol,
    new_symbol, seq)``: the first entry wins, and only for names not seen before; a symbol change points to
    its new symbol if that is still listed, else to the old one.  Decided by one ``min_by`` per name.
    """
    listed = master.select(F.col("symbol").alias("new_symbol"), F.lit(True).alias("_listed")).distinct()
    sc = symbol_changes.join(listed, "new_symbol", "left").withColumn(
        "_symbol", F.when(F.col("_listed"), F.col("new_symbol")).otherwise(F.col("old_symbol"))
    )

    def part(df, name, symbol, level, seq):
        return df.select(
            c.normalize_name(name).alias("norm_name"),
            F.col(symbol).alias("symbol"),
            F.struct(F.lit(level).alias("level"), seq.alias("seq"), F.col(symbol).alias("s")).alias("_order"),
        )

    seq2 = F.col("seq").cast("long") * 2
    every = (
        part(master, "company", "symbol", 0, -F.col("seq").cast("long"))
        .unionByName(part(name_changes, "prev_name", "symbol", 1, seq2))
        .unionByName(part(name_changes, "new_name", "symbol", 1, seq2 + 1))
        .unionByName(part(sc, "company", "_symbol", 2, seq2))
        .unionByName(part(sc, "old_symbol", "_symbol", 2, seq2 + 1))
    )
    return every.groupBy("norm_name").agg(F.min_by("symbol", "_order").alias("symbol"))


def resolve_names(names: DataFrame, aliases: DataFrame, cutoff: float = 0.88, name: str = "name") -> DataFrame:
    """Name -> symbol: exact on the normalised name, else the closest alias, else unresolved.

    Adds ``symbol, method`` (``exact``/``fuzzy``/``unresolved``).  Each distinct name is resolved once and
    joined back, so repeated names cost one lookup.
    """
    todo = names.select(name).distinct().withColumn("norm_name", c.normalize_name(name))
    known = materialise(todo.join(aliases, "norm_name", "left"))
    rest = known.where("symbol IS NULL").select("norm_name").distinct()
    close = fuzzy_resolve(rest, aliases.select("norm_name"), cutoff)
    fuzzy = close.join(aliases.withColumnRenamed("norm_name", "match").withColumnRenamed("symbol", "_fuzzy"), "match")
    known = known.join(fuzzy.select("norm_name", "_fuzzy"), "norm_name", "left")
    method = (
        F.when(F.col("symbol").isNotNull(), "exact").when(F.col("_fuzzy").isNotNull(), "fuzzy").otherwise("unresolved")
    )
    resolved = known.select(name, method.alias("method"), F.coalesce("symbol", "_fuzzy").alias("symbol"))
    return names.join(resolved, name, "left")


@pandas_udf(T.DoubleType())
def _similarity(candidate: pd.Series, wanted: pd.Series) -> pd.Series:
    matcher = difflib.SequenceMatcher()
    out, last = [], None
    for x, w in zip(candidate, wanted):
        if w != last:
            matcher.set_seq2(w)
            last = w
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


# the optimizer would otherwise copy the scoring below the deduplication and run it twice
_similarity = _similarity.asNondeterministic()


#: Pairs that one task scores, and names whose segments it looks up.
_SCORED, _NAMED = 5_000, 5_000


def fuzzy_resolve(wanted: DataFrame, known: DataFrame, cutoff: float = 0.88, name: str = "norm_name") -> DataFrame:
    """Closest known name with a matching-blocks ratio of at least ``cutoff``: ``(name, match, score)``.

    Exact, without comparing all pairs.  Matching blocks are a common subsequence, so a ratio of ``r``
    bounds the edit distance by ``(1 - r) * (total length)``.  Cut a known name into one segment more than
    that many edits: one segment survives untouched and stands in the wanted name, shifted by no
    more than the edits allow (the segment filter of edit-distance joins).  Segments are therefore
    equi-join keys that lose nothing; what they bring together is thinned by the letters the names do not share, before it is
    shuffled, then by the built-in bounded ``levenshtein``, which also gives each pair the best ratio it could have.  Only each name's most promising pairs are scored, then
    those that could still reach what they gave.  Equal scores go to the alphabetically last name.
    """
    pairs = materialise(_candidates(wanted.select(name).distinct(), known.select(name).distinct(), cutoff, name))
    most = pairs.groupBy(name).agg(F.max("_most").alias("_top"))
    first = _scored(pairs.join(most, name).where("_most = _top").select(name, "_known"), name)
    reached = first.groupBy(name).agg(F.greatest(F.max("score"), F.lit(cutoff)).alias("_least"))
    # bounds and scores are quotients of the same whole numbers, so a pair that can draw level is not below
    rest = pairs.join(most, name).join(reached, name).where("_most < _top AND _most >= _least")
    scored = first.unionByName(_scored(rest.select(name, "_known"), name)).where(F.col("score") >= cutoff)
    return scored.groupBy(name).agg(
        F.max_by("_known", F.struct("score", "_known")).alias("match"), F.max("score").alias("score")
    )


def _scored(pairs: DataFrame, name: str) -> DataFrame:
    """``pairs`` with their ratio, dealt out by their number: a pair is a few bytes but costs some 100 microseconds."""
    pairs = materialise(pairs)
    spread = pairs.repartition(pairs.count() // _SCORED + 1, name)
    return materialise(spread.withColumn("score", _similarity("_known", name)))


def _letters(name: str) -> Column:
    """The letters of a name as 128 bits ``(a, b)``: the first ``x``, the second ``x`` and so on each set the bit their hash names.

    A bit that only one of two names has stands for a letter of it that the other lacks.
    """

    def half(bits: Column, low: int) -> Column:
        bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n - low)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, n: F.when((n >= low) & (n < low + 64), a.bitwiseOR(bit(n))).otherwise(a))

    def hashed(letters: Column) -> Column:
        return F.transform(letters, lambda x, i: F.pmod(F.xxhash64(x, i - F.array_position(letters, x)), F.lit(128)).cast("int"))

    return c.let(F.sort_array(F.split(name, "")), lambda x: c.let(hashed(x), lambda n: F.struct(half(n, 0).alias("a"), half(n, 64).alias("b"))))


def _candidates(wanted: DataFrame, known: DataFrame, cutoff: float, name: str) -> DataFrame:
    """Pairs ``(name, _known, _most)`` that can reach ``cutoff``, a superset of those that do, and the best ratio each can have."""
    reach = (2 - cutoff) / cutoff  # longest partner relative to a name's length
    tiny = 1e-9

    def segments(df):
        """Add the edits a name of length ``_L`` must survive and one row per segment ``_i``."""
        longest = F.floor(F.col("_of") * reach + tiny)
        edits = F.floor((1 - cutoff) * (F.col("_of") + longest) + tiny)
        cut = df.withColumn("_tau", edits.cast("int"))
        cut = cut.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_tau"))))
        edge = lambda i: F.floor(i * F.col("_of") / (F.col("_tau") + 1)).cast("int")
        return cut.withColumns({"_from": edge(F.col("_i")), "_len": edge(F.col("_i") + 1) - edge(F.col("_i"))})

    def key(of, seg):
        # names that meet by chance are told apart by the edit distance
        return F.xxhash64(of, "_i", seg).alias("_key")

    def numbered(df, id_):
        rows = df.where(F.length(name) > 0).select(name, F.monotonically_increasing_id().alias(id_))
        return materialise(rows.withColumns({"_own": F.length(name), "_x": _letters(name)}).select(name, id_, "_own", F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b")))

    def lengths(df, as_):
        return df.select(F.col("_own").alias(as_)).distinct()

    names, others = numbered(wanted, "_w"), numbered(known, "_k")
    partner = F.sequence(
        F.greatest(F.ceil(F.col("_own") / reach - tiny).cast("int"), F.lit(1)), F.floor(F.col("_own") * reach + tiny).cast("int")
    )
    spans = lengths(names, "_own").withColumn("_of", F.explode(partner)).join(lengths(others, "_of"), "_of")
    # written, so that the join below is planned by the size of what can meet at all
    k = segments(others.withColumn("_of", F.col("_own")).join(spans.select("_of").distinct(), "_of", "left_semi"))
    k = materialise(
        k.select("_k", "_of", F.col("_a").alias("_ka"), F.col("_b").alias("_kb"), key("_of", F.substring(name, F.col("_from") + 1, F.col("_len"))))
    )

    # a name becomes hundreds of rows, so few names make a task
    w = names.join(spans, "_own").repartition(names.count() // _NAMED + 1, "_w", "_of")
    w = segments(w)
    # edits left and right of the segment add up, which halves the shift window
    gap = F.col("_own") - F.col("_of")
    low = F.greatest(F.col("_from") + F.ceil((gap - F.col("_tau")) / 2).cast("int"), F.lit(0))
    high = F.least(F.col("_from") + F.floor((gap + F.col("_tau")) / 2).cast("int"), F.col("_own") - F.col("_len"))
    w = w.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    w = w.withColumn("_at", F.explode(F.sequence("_low", "_high")))
    w = w.select("_w", "_own", "_a", "_b", key("_of", F.substring(name, F.col("_at") + 1, F.col("_len"))))

    # numbers meet, not names; what either name has alone is not among the letters of a common subsequence
    met = w.join(k, "_key")
    shared = cutoff * (F.col("_own") + F.col("_of")) / 2 - tiny
    alone = lambda x, y: F.bit_count(F.col(f"{x}a").bitwiseAND(F.bitwise_not(f"{y}a"))) + F.bit_count(F.col(f"{x}b").bitwiseAND(F.bitwise_not(f"{y}b")))
    met = met.where((F.col("_own") - alone("_", "_k") >= shared) & (F.col("_of") - alone("_k", "_") >= shared))
    met = met.select("_w", "_k").distinct()
    met = met.join(names.select("_w", name), "_w").join(others.select("_k", F.col(name).alias("_known")), "_k").select(name, "_known")
    total = F.length(name) + F.length("_known")
    # letters outside a common subsequence are as odd or even in number as all letters
    even = lambda d: d + F.abs((total - d) % 2)
    allowed = F.floor((1 - cutoff) * total + tiny).cast("int")
    near = met.withColumn("_edits", F.call_function("levenshtein", F.col(name), F.col("_known"), allowed)).where("_edits >= 0")
    near = near.withColumn("_most", (total - even(F.col("_edits"))) / total)
    return near.where(F.col("_most") >= cutoff - tiny).select(name, "_known", "_most")


def canonicalize(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Every symbol of a rename chain -> one canonical symbol: ``(symbol, canonical)``.

    ``edges(old, new)``, undirected; ``active(symbol)``.  Canonical is the smallest active member of the
    connected component (:func:`barloom.operators.components.connected_components`), else its smallest member.
    """
    pairs = edges.where("old IS NOT NULL AND new IS NOT NULL")
    symbols = pairs.select(F.col("old").alias("symbol")).union(pairs.select("new")).distinct()
    parts = connected_components(pairs, "old", "new").withColumnRenamed("node", "symbol")
    live = active.select("symbol", F.lit(True).alias("_active")).distinct()
    marked = symbols.join(parts, "symbol", "left").join(live, "symbol", "left").withColumn("_part", F.coalesce("component", "symbol"))
    chosen = marked.groupBy("_part").agg(
        F.coalesce(F.min(F.when(F.col("_active"), F.col("symbol"))), F.min("symbol")).alias("canonical")
    )
    return marked.join(chosen, "_part").select("symbol", "canonical")


def resolution_report(resolved: DataFrame) -> DataFrame:
    """How many names were resolved by each method."""
    return resolved.groupBy("method").agg(F.count("*").alias("n_events"), F.countDistinct("name").alias("n_names"))


def unresolved_names(resolved: DataFrame) -> DataFrame:
    return resolved.where("method = 'unresolved'").select("name").distinct()
