"""Secret scans over a trigram inverted index.  DataFrame functions only.

Each rule is a regular expression.  :func:`trigram_query` derives from it the trigrams (lower case) that any
match must hold, as alternatives of which each is a set of trigrams that must all be there.  The index
has a posting ``(trigram, id)`` for every trigram that some rule asks for; trigrams that no query can
ask for are not stored.  Intersecting the postings of each alternative gives candidate documents, which are
then matched with the full expression.  A rule with an alternative that holds no trigram (a run of hexadecimal digits) scans
every text.

Scale: the index is built from each row alone and its postings are the only rows that are grouped, by document, with map-side
combine.  Documents meet their candidate rules in one join.  Nothing depends on how many documents share a trigram.

Defined results: a null text has no spans; repeated ids share their candidate rules, and every row is verified
on its own text; an empty table gives no rows; other columns pass through (working columns have a ``_s_`` prefix).
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as kinds
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialise

#: Alternatives a derived query may have; beyond it a construct counts as unknown text.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A named expression; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


#: The rules every scan has.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further well-known credential formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE + MORE

_GAP = "\0"


def trigram_query(pattern: str) -> list[set[str]] | None:
    """Alternatives of mandatory trigrams of ``pattern``; None if some match may hold none."""
    alternatives = [{run[i : i + 3] for run in text.split(_GAP) for i in range(len(run) - 2)} for text in _texts(_parser.parse(pattern))]
    return alternatives if all(alternatives) else None


def _texts(nodes) -> list[str]:
    """Every way to write ``nodes``, lower case, with a gap for each part that is not known."""
    out = [""]
    for op, arg in nodes:
        if op is kinds.LITERAL:
            parts = [chr(arg).lower()]
        elif op is kinds.SUBPATTERN:
            parts = _texts(arg[-1])
        elif op is kinds.BRANCH:
            parts = [t for branch in arg[1] for t in _texts(branch)]
        elif op is kinds.IN and all(k is kinds.LITERAL for k, _ in arg):
            parts = sorted({chr(c).lower() for _, c in arg})
        elif op is kinds.MAX_REPEAT and arg[:2] == (0, 1):
            parts = ["", *_texts(arg[2])]
        elif op is kinds.MAX_REPEAT and arg[0] >= 1:
            once = _texts(arg[2])
            parts = once if arg[:2] == (1, 1) else [t + _GAP for t in once]
        elif op is kinds.AT:
            parts = [""]
        else:
            parts = [_GAP]
        if len(out) * len(parts) > MOST_ALTERNATIVES:
            parts = [_GAP]
        out = list(dict.fromkeys(a + b for a in out for b in parts))
    return out


def build_index(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(trigram, id)`` of the trigrams that the rules ask for, written to the shared folder."""
    wanted = sorted({t for r in rules for a in trigram_query(r.pattern) or () for t in a})
    low = F.lower(F.col(text_col))
    vocabulary = F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")
    held = F.transform(F.array(low), lambda x: F.filter(vocabulary, lambda t: F.contains(x, t)))[0]
    return materialise(docs.select(F.col(id_col).alias("id"), F.explode(held).alias("trigram")))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """``(id, _s_rules)``: names of the rules of which an alternative has all its trigrams in the document."""
    spark = index.sparkSession
    asked = [
        (r.name, n, t, len(a)) for r in rules for n, a in enumerate(trigram_query(r.pattern) or ()) for t in sorted(a)
    ]
    names = ("rule", "alternative", "trigram", "size")
    entries = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x, strict=True)]) for x in asked])
    table = spark.range(1).select(F.inline(entries)) if asked else spark.range(0).selectExpr("'' rule", "0 alternative", "'' trigram", "0 size")
    # distinct first: a document may come with several rows
    met = index.distinct().join(table, "trigram").groupBy("id", "rule", "alternative").agg(
        F.count("*").alias("n"), F.first("size").alias("size")
    )
    return met.where("n = size").groupBy("id").agg(F.collect_set("rule").alias("_s_rules"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """``(start, rank, end, kind)`` of the leftmost non-overlapping matches, in code points."""
    java = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, java, F.lit(0))
    part = F.regexp_extract_all(text, java, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), whole.alias("whole"), part.alias("part"))
    parts = F.transform(parts, lambda x: F.struct(F.length(x["before"]).alias("b"), F.length(x["whole"]).alias("w"), F.length(x["part"]).alias("p")))
    kind = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(a, x):
        start = a["at"] + x["b"]
        end = start + F.coalesce(x["w"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.name).alias("kind"))
        spans = F.when(x["p"] >= rule.least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), kind.alias("spans"))
    return F.aggregate(parts, start, step, lambda a: a["spans"])


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array of ``(start, rank, end, kind)``, by start and order of the rules; end exclusive."""
    found = candidates(build_index(docs, rules, id_col, text_col), rules).withColumnRenamed("id", "_s_id")
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("_s_id")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for rank, rule in enumerate(rules):
        on = text.rlike(rule.pattern) if trigram_query(rule.pattern) is None else F.array_contains("_s_rules", rule.name)
        parts.append(F.when(on, _spans(text, rule, rank)).otherwise(none))
    return joined.withColumn("secrets", F.sort_array(F.concat(*parts))).drop("_s_id", "_s_rules")


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span (overlapping ones as one) replaced by ``[SECRET]``."""

    def step(a, s):
        more = F.substring(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
        mark = F.when(s["start"] >= a["at"], F.lit("[SECRET]")).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["done"], more, mark).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    rest = lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
