"""Quality rules: per-document counts, and the frequency of lines across documents.  DataFrame functions only.

Lines are normalised (lower case, white space runs as one space, trimmed) and hashed.  Per host a line is
counted once per document, and also by all distinct *neighbourhoods* it stands in (hashes of the lines before and
after), which may be several in one document.  A line is boilerplate where both counts exceed ``max(min_docs, share * documents of the host)``:
lines of a document that was copied many times keep their neighbours, so copies of a good document are left
to deduplication, while a notice turns up between ever different lines.  The inner lines of a menu or licence of several
lines keep theirs too; with ``blocks`` the neighbours are therefore taken outside the run of lines that are in
more documents than the limit, so that whole blocks go, while the run of a copy is its whole text.  Near copies
that differ in single lines count like blocks between different lines.  A document is
depleted when fewer than ``min_words`` words, or less than ``min_left`` of its words, stay after such lines are removed.

Scale: a row's lines are reduced to distinct hashes and places before anything moves.  Counting is two aggregations with
map-side combine, so neither a hot host nor a line that all documents share meets in one task.  What comes
back to the documents is, per document, the few hashes to remove (with ``blocks`` also those of lines in many documents); the text itself is shuffled only when
the cleaned text is asked for and that side is too large to broadcast.

Defined results: a null text has no words and no lines; a null host is a host of its own; equal rows get equal
verdicts, and rows that share an id but not the text are told apart; an empty table gives no rows; other columns
of the input pass through :func:`apply` unchanged (working columns have a ``_q_`` prefix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialise

#: White space of the word definition.
SPACE = r"[\x20\x09-\x0D]+"
#: A boilerplate line is in more documents (and neighbourhoods) of a host than this ...
MIN_DOCS = 50
#: ... and than this share of the host's documents.
SHARE = 0.02
#: What has to be left of a document.
MIN_WORDS = 10
MIN_LEFT = 0.2
#: A document fails with fewer words, or with a larger percentage of repeated words.
BASE_WORDS = 10
BASE_REPEATED = 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for all lambdas inside the body."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column) -> Column:
    """Words inside 5-word windows that occur at least twice among the words ``w``."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 5)
        return F.when(F.size(w) > 5, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])))

    def covered(h: Column) -> Column:
        entry = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        places = _bound(F.sort_array(entry), twice)
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), F.aggregate(places, start, step, lambda a: a["n"]))

    return F.coalesce(_bound(_bound(w, windows), covered), F.lit(0)).cast("long")


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    w = words(text)
    out = docs.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": without(" \t\n\x0b\f\r").cast("long"),
            "n_symbols": (F.length(text) - without("#*$%&|<>")).cast("long"),
            "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(w),
        }
    )
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _lines(text: Column) -> Column:
    """``(h, n)`` of each line: hash of its normal form (null without a word) and its words; in order."""
    normal = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), SPACE, " ")))
    entry = lambda x: F.struct(
        F.when(x != "", F.xxhash64(x)).alias("h"), F.when(x != "", F.size(F.split(x, " "))).otherwise(0).alias("n")
    )
    return F.transform(normal, entry)


def _key(docs: DataFrame, host_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(text_col), F.col(host_col), *[F.col(c) for c in ("doc_id",) if c in docs.columns])


def _hits(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``(_q_key, _q_bad)``: which of the ``lines`` (host, _q_key, h) of a document are ``found`` (host, h)."""
    hits = lines.alias("l").join(found.alias("b"), F.expr("l.h = b.h and l.host <=> b.host"), "left_semi")
    return hits.groupBy("_q_key").agg(F.collect_set("h").alias("_q_bad"))


def frequent_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, share: float = SHARE,
    blocks: bool = False,
) -> DataFrame:
    """``(host, h, n_docs, n_places)`` of the lines above the limits of their host."""
    full = lambda lines: F.filter(F.transform(lines, lambda x: x["h"]), lambda h: h.isNotNull())
    around = lambda s, i, j: F.xxhash64(F.coalesce(F.get(s, i), F.lit(0)), F.coalesce(F.get(s, j), F.lit(0)))

    def single(s: Column) -> Column:
        return F.transform(s, lambda h, i: F.struct(h.alias("h"), around(s, i - 1, i + 1).alias("place")))

    def whole(s: Column, often: Column) -> Column:
        """Lines of runs of ``often`` lines, each with what stands around its run."""
        other = F.filter(F.transform(s, lambda h, i: F.when(~F.array_contains(often, h), i)), lambda i: i.isNotNull())

        def cut(edges: Column) -> Column:
            def run(i: Column, k: Column) -> Column:
                end = F.get(edges, k + 1)
                place = around(s, i, end).alias("place")
                return F.transform(F.slice(s, i + 2, end - i - 1), lambda h: F.struct(h.alias("h"), place))

            return F.flatten(F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), run))

        return _bound(F.concat(F.array(F.lit(-1)), other, F.array(F.size(s))), cut)

    def once(places: Column) -> Column:
        # all places of a line count, the document itself only once
        first = lambda s, x, i: F.coalesce(F.get(s, i - 1)["h"] != x["h"], F.lit(True)).cast("int")
        mark = lambda s: F.transform(s, lambda x, i: x.withField("first", first(s, x, i)))
        return _bound(F.sort_array(F.array_distinct(places)), mark)

    host = F.col(host_col).alias("host")
    hosts = docs.groupBy(host).agg(F.count("*").alias("all_docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.col("all_docs") * share)

    def above(counted: DataFrame, *names: str) -> DataFrame:
        many = counted.where(" and ".join(f"{n} > {min_docs}" for n in names)).alias("c")
        over = many.join(hosts.alias("t"), F.expr("c.host <=> t.host"))
        for n in names:
            over = over.where(F.col(n) > limit)
        return over.select("c.host", "h", *names)

    if blocks:
        lists = materialise(docs.select(host, _key(docs, host_col, text_col).alias("_q_key"), full(_lines(F.col(text_col))).alias("s")))
        lines = lists.select("host", "_q_key", F.explode(F.array_distinct("s")).alias("h"))
        often = above(lines.groupBy("host", "h").agg(F.count("*").alias("n_docs")), "n_docs").select("host", "h")
        placed = lists.join(_hits(lines, often), "_q_key").select("host", whole(F.col("s"), F.col("_q_bad")).alias("x"))
        rows = placed.select("host", F.explode(once(F.col("x"))).alias("x"))
    else:
        rows = docs.select(host, F.explode(once(_bound(full(_lines(F.col(text_col))), single))).alias("x"))
    counted = (
        rows.groupBy("host", F.col("x.h").alias("h"), "x.place")
        .agg(F.sum("x.first").alias("n"))
        .groupBy("host", "h")
        .agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_places"))
    )
    return above(counted, "n_docs", "n_places")


def apply(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    share: float = SHARE,
    min_words: int = MIN_WORDS,
    min_left: float = MIN_LEFT,
    blocks: bool = False,
) -> DataFrame:
    """``docs`` with the columns of :func:`counts`, n_removed_lines, n_removed_words, depleted, kept and
    ``clean_text``, the text without lines above the limits (unchanged, null included, where none is)."""
    bad = frequent_lines(docs, host_col, text_col, min_docs, share, blocks).select("host", "h")
    key = _key(docs, host_col, text_col)
    lines = docs.select(
        F.col(host_col).alias("host"), key.alias("_q_key"), F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: x["h"]))).alias("h")
    ).where("h is not null")
    per_doc = _hits(lines, bad)

    counted = counts(docs, text_col).withColumns({"_q_key": key, "_q_lines": _lines(F.col(text_col))})
    joined = counted.join(per_doc, "_q_key", "left")
    hit = lambda x: F.array_contains(F.col("_q_bad"), x["h"])
    removed = F.filter("_q_lines", lambda x: x["h"].isNotNull() & hit(x))
    stay = F.filter(
        F.split(F.col(text_col), "\n"),
        lambda x, i: ~F.coalesce(F.array_contains(F.col("_q_bad"), F.get(F.col("_q_lines"), i)["h"]), F.lit(False)),
    )
    none = F.col("_q_bad").isNull()
    out = joined.withColumns(
        {
            "n_removed_lines": F.when(none, F.lit(0)).otherwise(F.size(removed)).cast("long"),
            "n_removed_words": F.when(none, F.lit(0)).otherwise(
                F.aggregate(removed, F.lit(0), lambda n, x: n + x["n"])
            ).cast("long"),
            "clean_text": F.when(none, F.col(text_col)).otherwise(F.array_join(stay, "\n")),
        }
    )
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    return (
        out.withColumn("depleted", depleted)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("_q_key", "_q_bad", "_q_lines")
    )
