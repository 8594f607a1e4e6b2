"""One query per operator over the whole of its table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, divergence, editcount, html, lm, neardup, preferences, quality, secrets, sigtree, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, source, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(5, i - coalesce(p, -4))) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM twice) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, source, text, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), line AS (
  SELECT doc_id, source, pos, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
), full_line AS (
  SELECT doc_id, source, pos, l, coalesce(lag(l) OVER v, '') AS before, coalesce(lead(l) OVER v, '') AS after
  FROM line WHERE l <> '' WINDOW v AS (PARTITION BY doc_id ORDER BY pos)
), places AS (
  SELECT source, l, before, after, count(DISTINCT doc_id) AS n FROM full_line GROUP BY ALL
), hosts AS (
  SELECT source, count(*) AS n FROM d GROUP BY source
), bad AS (
  SELECT f.source, f.l FROM (
    SELECT source, l, count(DISTINCT doc_id) AS n_docs FROM full_line GROUP BY source, l
  ) f JOIN (SELECT source, l, count(*) AS n_places FROM places GROUP BY source, l) p ON f.source IS NOT DISTINCT FROM p.source AND f.l = p.l
  JOIN hosts h ON h.source IS NOT DISTINCT FROM f.source
  WHERE n_docs > greatest(50, 0.02 * h.n) AND n_places > greatest(50, 0.02 * h.n)
), removed AS (
  SELECT doc_id, count(*) AS lines, sum(len(string_split(x.l, ' '))) AS words
  FROM full_line x JOIN bad b ON x.l = b.l AND x.source IS NOT DISTINCT FROM b.source GROUP BY doc_id
), judged AS (
  SELECT base.*, CAST(coalesce(lines, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(words, 0) AS BIGINT) AS n_removed_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM base LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.2 * n_words)) AS kept,
  n_removed_lines, n_removed_words
FROM judged
"""


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark, sf):
    judged = quality.apply(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_removed_words",
    )


def _secret_sql() -> str:
    """The rules as SQL: pieces between matches and the matches themselves give the places."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
          SELECT doc_id, {rank} AS rank, '{r.name}' AS kind, unnest(string_split_regex(text, '{p}')) AS b,
            unnest(regexp_extract_all(text, '{p}', 0)) AS w, unnest(regexp_extract_all(text, '{p}', {r.group})) AS p,
            {r.least} AS least, generate_subscripts(string_split_regex(text, '{p}'), 1) AS k
          FROM d WHERE regexp_matches(text, '{p}')""")
    text = "kind || ':' || s || ':' || e"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    placed AS (
      SELECT *, sum(length(b)) OVER v + coalesce(sum(length(w)) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM m WINDOW v AS (PARTITION BY doc_id, kind ORDER BY k)
    ), spans AS (
      SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + length(w) AS BIGINT) AS e
      FROM placed WHERE w IS NOT NULL AND length(p) >= least
    ), per_doc AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
        coalesce(string_agg({text}, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
        string_agg({text}, ',' ORDER BY s, rank) AS spans
      FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per_doc USING (doc_id)
    """


@query("op3_secret_scan", _secret_sql())
def op3_secret_scan(spark, sf):
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    number = lambda name: F.size(F.filter("secrets", lambda s: s["kind"] == name)).cast("long")
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("secrets")).alias("spans"),
    )


LEAK_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS t, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM phrase),
docwin AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, h.n, item_id FROM docwin h JOIN phrase p ON h.t = p.t AND h.n = p.n),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


@query("op4_decontaminate", LEAK_SQL)
def op4_decontaminate(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf):
    path, pattern = tokenizer()
    coded = bpe.decode(bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op10_minhash_dedup")
def op10_minhash_dedup(spark, sf):
    return neardup.find(table(spark, sf, "documents"))


@query("op1_lm_score")
def op1_lm_score(spark, sf):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = lm.score(table(spark, sf, "documents"), held)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_toxicity")
def op6_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf, "labels"), ~held)
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query("op5_html_extract")
def op5_html_extract(spark, sf):
    pages = table(spark, sf, "pages")
    found = html.extract(pages, html.deduce(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


PREFERENCE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT conv_id, ((conv_id % (count(*) + 1)) + count(*) + 1) % (count(*) + 1) AS cut FROM t GROUP BY conv_id),
r AS (
  SELECT t.conv_id, turn, role, text FROM t JOIN s USING (conv_id) WHERE turn < cut
  UNION ALL SELECT s.conv_id, turn, role, text FROM t JOIN s ON t.conv_id = s.conv_id + 1 WHERE turn >= cut
), o AS (
  SELECT conv_id, true AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t
  UNION ALL SELECT conv_id, false, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) FROM r
), differ AS (
  SELECT s.conv_id, coalesce(min(k) FILTER (x.n = 1), max(k) + 1) - 1 AS n
  FROM s JOIN (SELECT conv_id, k, CASE WHEN count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) THEN 0 ELSE 1 END AS n
               FROM o GROUP BY conv_id, k) x USING (conv_id) GROUP BY s.conv_id
), w AS (
  SELECT o.*, d.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line,
    CASE WHEN role = 'assistant' THEN length(text) + 11 ELSE 0 END AS loss
  FROM o JOIN differ d USING (conv_id)
)
SELECT conv_id AS pair_id, any_value(n)::INT AS n_prompt_turns,
  count(*) FILTER (c AND k > n)::INT AS n_chosen_turns, count(*) FILTER (NOT c AND k > n)::INT AS n_rejected_turns,
  sha256(coalesce(string_agg(line, '' ORDER BY k) FILTER (c AND k <= n), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(line, '' ORDER BY k) FILTER (c AND k > n), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(line, '' ORDER BY k) FILTER (NOT c AND k > n), '')) AS rejected_sha256,
  coalesce(sum(loss) FILTER (c AND k > n), 0)::BIGINT AS chosen_loss_chars, coalesce(sum(loss) FILTER (NOT c AND k > n), 0)::BIGINT AS rejected_loss_chars
FROM w GROUP BY conv_id
"""


@query("op8_preference_format", PREFERENCE_SQL)
def op8_preference_format(spark, sf):
    made = preferences.format_pairs(preferences.spliced_pairs(table(spark, sf, "conversations")))
    loss = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.select(
        "pair_id",
        "n_prompt_turns",
        "n_chosen_turns",
        "n_rejected_turns",
        *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        loss("chosen_loss").alias("chosen_loss_chars"),
        loss("rejected_loss").alias("rejected_loss_chars"),
    )


@query("op9_token_counts")
def op9_token_counts(spark, sf):
    path, pattern = tokenizer()
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("edits", editcount.own_edits(F.coalesce("text", F.lit(""))))
    trees = editcount.with_trees(docs, path, pattern).withColumn("n_tokens_before", F.get("tree.tokens", 1).cast("long"))
    return editcount.apply_edits(trees, path, pattern).select(
        "doc_id", "n_tokens_before", "n_tokens", "n_encoded", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


@query("op13_ngram_jaccard")
def op13_ngram_jaccard(spark, sf):
    return sigtree.join(table(spark, sf, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (1000000000 * (coalesce(n, 0) + 1)::HUGEINT) // (coalesce(total, 0) + v) AS BIGINT) AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN total USING (lang, source)
), q AS (
  SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 1)::HUGEINT) // (any_value(total) + any_value(v)) AS BIGINT) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12_source_divergence(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf):
    return spelling.group(table(spark, sf, "documents"))
