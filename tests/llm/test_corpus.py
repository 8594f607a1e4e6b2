"""Corpus operators against SQL, brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import html as entities
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import bpe, decontaminate, editcount, html, lm, neardup, preferences, quality, secrets, toxicity, words
from barloom.llm.queries import ORACLES, QUERIES, tokenizer
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def encoder():
    path, pattern = tokenizer()
    return bpe.Coder(bpe.read_ranks(None, path), pattern).encoder()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    ok, text = compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
    assert ok, text


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# words


def test_words_are_those_of_the_pattern():
    draw = random.Random(1)
    some = ["".join(draw.choice("aZ é\n\t東,.0") for _ in range(draw.randint(0, 40))) for _ in range(200)]
    for kind, pattern in ((words.SPACED, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, owner = words.hashed(pa.array([None, *some, ""]), kind)
        want = [re.findall(pattern, t.translate(brute.FOLD)) for t in ["", *some, ""]]
        assert np.diff(owner).tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist(), strict=True)))


# 1


def test_lm_base_is_exact_and_the_model_beats_it(spark, texts):
    want, total = brute.unigram_scores(texts)
    rows = QUERIES["op1_lm_score"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        held, n, known, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probes_return_counts():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 2**40, 20_000, dtype=np.uint64))
    counts = draw.integers(1, 5_000, len(keys))
    one = lm.Filter([lm.build_filter(keys[::2], counts[::2])])
    shard = np.zeros(len(keys), np.int64)
    got = one.levels(shard, keys)
    assert (got[::2] >= lm.level(counts[::2])).all()  # never too low
    assert (got[::2] == lm.level(counts[::2])).mean() > 0.97
    assert (got[1::2] > 0).mean() < 0.03
    assert np.abs(lm.EXPECTED[got[::2]] / counts[::2] - 1).mean() < 0.2


def test_lm_shuffled_filter_gives_the_same_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    a, b = (sorted(lm.score(docs, held, broadcast=n).select("doc_id", "score").collect()) for n in (lm.BROADCAST, 0))
    assert a == b


def test_lm_awkward(spark):
    for empty in (True, False):
        docs = brute.awkward(spark, empty)
        rows = lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()
        assert len(rows) == (0 if empty else 12)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


# 2


def test_quality_removes_frequent_lines_but_not_copies(spark):
    body = [" ".join(f"word{i}x{k}" for k in range(14)) for i in range(400)]
    rows = [(i, f"{body[i]}\nAll rights reserved by nobody\n{body[(i + 1) % 400]}", "en", "a", 0) for i in range(150)]
    rows += [(1000 + i, "\n".join(body[200:204]), "en", "a", 0) for i in range(150)]  # copies
    many = f"{body[300]}\nALL  rights reserved by nobody\n{body[301]}"
    rows += [(2000, "all rights reserved by nobody\n" * 4 + "a b c d e f g h i", "en", "a", 0), (2001, many, "en", "b", 0)]
    got = {r.doc_id: r for r in quality.apply(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert all(got[i].kept and got[i].clean_text == f"{body[i]}\n{body[(i + 1) % 400]}" for i in range(150))
    assert all(got[1000 + i].kept and got[1000 + i].n_removed_lines == 0 for i in range(150))
    assert got[2000].depleted and not got[2000].kept and got[2000].n_removed_words == 20
    assert got[2001].kept and got[2001].clean_text == many  # another host


def test_quality_counts_every_place_of_a_line(spark, tmp_path):
    body = [" ".join(f"word{i}x{k}" for k in range(14)) for i in range(100)]
    fixed = "first of all documents\nshared line\nlast of all documents"
    rows = [(i, f"{fixed}\n{body[i]}\nshared line\n{body[-i]}", "en", "a", 0) for i in range(60)]
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(f"{tmp_path}/in")
    spark.read.parquet(f"{tmp_path}/in").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, text = compare(spark, con, str(tmp_path), QUERIES["op2_quality_rules"], ORACLES["op2_quality_rules"])
    assert ok, text
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    (line,) = quality.frequent_lines(docs).join(docs.limit(1).select(F.xxhash64(F.lit("shared line")).alias("h")), "h").collect()
    assert (line.n_docs, line.n_places) == (60, 61)
    assert all(r.n_removed_lines >= 2 for r in quality.apply(docs).collect())


def test_quality_removes_whole_blocks_but_not_copies(spark):
    body = [" ".join(f"word{i}x{k}" for k in range(14)) for i in range(400)]
    block = [" ".join(f"menu{k}x{n}" for n in range(3)) for k in range(5)]
    rows = [(i, "\n".join([body[i], *block, body[i + 100]] if i % 2 else [*block, "", body[i]]), "en", "a", 0) for i in range(100)]
    rows += [(500 + i, "\n".join([*block, f"the only line of {i}"]), "en", "a", 0) for i in range(100)]  # mostly block
    rows += [(1000 + i, "\n".join(body[300:306]), "en", "a", 0) for i in range(150)]  # copies
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = {r.doc_id: r for r in quality.apply(docs, blocks=True).collect()}
    assert len(got) == 350
    assert all(got[i].kept and got[i].clean_text.strip() == (f"{body[i]}\n{body[i + 100]}" if i % 2 else body[i]) for i in range(100))
    assert all(got[500 + i].depleted and got[500 + i].n_removed_lines == 5 for i in range(100))
    assert all(got[1000 + i].kept and got[1000 + i].n_removed_lines == 0 for i in range(150))
    left = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    assert set(left) == {*range(100), *range(1000, 1150)} and not any("menu" in t for t in left.values())


def test_quality_blocks_awkward(spark):
    assert quality.apply(brute.awkward(spark, True), blocks=True).collect() == []
    assert sorted(map(str, quality.apply(brute.awkward(spark), blocks=True).collect())) == sorted(map(str, quality.apply(brute.awkward(spark)).collect()))


def test_quality_awkward(spark):
    assert quality.apply(brute.awkward(spark, True)).collect() == []
    rows = quality.apply(brute.awkward(spark)).collect()
    assert len(rows) == 12
    assert {r.doc_id for r in rows if not r.base_failed} == {None, 4, 6, 7, 8}  # 10 repeats itself
    assert [r.clean_text for r in rows if r.doc_id == 1] == [None]
    assert all(r["key"] == "x" for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_words(spark, seed):
    draw = random.Random(seed)
    lists = [[draw.choice("abc") for _ in range(draw.randint(0, 60))] for _ in range(60)] + [["x"] * 3_000]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    got = {r.i: r.n for r in rows.select("i", quality.repeated_words(F.col("w")).alias("n")).collect()}
    for i, w in enumerate(lists):
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in range(k, k + 5)} if len(w) < 100 else set(range(len(w)))
        assert got[i] == len(hit)


# 3


def test_trigram_queries():
    ask = {r.name: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert ask["hex"] is None
    assert ask["access"] == [{"aki", "kia"}]
    assert {"api", "pi_", "i_k", "_ke", "key"} in ask["assign"] and {"api", "pik", "ike", "key"} in ask["assign"]
    assert {"sec", "ecr", "cre", "ret"} in ask["assign"]
    assert secrets.trigram_query("ab?c") is None


def test_secrets_awkward(spark):
    assert secrets.scan(brute.awkward(spark, True)).collect() == []
    rows = {(r.doc_id, r.text): r for r in secrets.scan(brute.awkward(spark)).collect()}
    (nine,) = [r for (i, _), r in rows.items() if i == 9]
    assert [(s.kind, s.start, s.end) for s in nine.secrets] == [("assign", 0, 56), ("hex", 8, 56), ("access", 61, 85)]
    assert all(not r.secrets for (i, _), r in rows.items() if i != 9)


def test_dropped_matches_still_consume(spark):
    docs = spark.createDataFrame([(1, "secret:token :abcdefg é API_key = 'abcdef'"), (1, "PassWD: x"), (2, None)], "doc_id long, text string")
    got = [secrets for (secrets,) in secrets_of(docs)]
    assert sorted(got) == sorted(["", "", "assign:24:41"])


def secrets_of(docs):
    return secrets.scan(docs).select(secrets.written(F.col("secrets"))).collect()


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token = 0123456789abcdef0123456789abcdef !"), (2, "clean"), (3, None)], "doc_id long, text string")
    out = secrets.scan(docs).select("doc_id", secrets.redact(F.col("text"), F.col("secrets")).alias("t"))
    assert sorted(tuple(r) for r in out.collect() if r.t) == [(1, "é [SECRET] !"), (2, "clean")]


# 4


def test_phrases_in_blocks_give_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, sorted(r["items"]))
    one = sorted(map(key, decontaminate.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 200)
    assert sorted(map(key, decontaminate.decontaminate(docs, items).collect())) == one
    assert sum(x[2] > 0 for x in one) > 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "a x y z b c d"), (4, "a b"), (5, "c d")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A b c, d!")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near) for r in decontaminate.decontaminate(docs, items, slop=2).collect()}
    assert got == {1: ([7], [7]), 2: ([], [7]), 3: ([], []), 4: ([], []), 5: ([], [])}


def test_decontaminate_awkward(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Two three"), (3, "Two three"), (4, "w59998 w59999")], "item_id long, text string")
    assert decontaminate.decontaminate(brute.awkward(spark, True), items).collect() == []
    rows = decontaminate.decontaminate(brute.awkward(spark), items).collect()
    assert len(rows) == 12
    assert sorted((r.doc_id or 0, r.n_hit, *r["items"]) for r in rows if r.contaminated) == [(0, 2, 3), (4, 2, 4), (6, 2, 3), (7, 2, 3), (8, 2, 3)]
    none = decontaminate.decontaminate(brute.awkward(spark), items.limit(0)).collect()
    assert len(none) == 12 and not any(r.contaminated for r in none)


# 5


def test_extraction_of_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op5_html_extract"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_template_is_found_and_its_texts_go(spark):
    page = (
        '<html><body><header>Site</header><div class="menu">a</div><main><h1>T{i}</h1><div>Share this page</div>'
        '<p>body &amp; {i}<br>more {j}<p>last {j}<form>x</form><div id="comments"><p>hm {i}</p></div></main><aside>s</aside></body>'
    )
    rows = [(i, f"http://h.example/{i}", page.format(i=i, j=i * i)) for i in range(30)]
    rows += [(100, "http://one.example/", page.format(i=1, j=1)), (101, None, None), (102, "x", ""), (103, "http://h.example/a", "<p>no <b>template")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS tokens", "'x' AS host")
    template = html.deduce(pages)
    assert template.where("host = 'h.example'").count() >= 1
    got = {r.page_id: r.text for r in html.extract(pages, template).collect()}
    assert all(got[i] == f"T{i}\n\nbody & {i} more {i * i}\n\nlast {i * i}" for i in range(30))
    assert got[100] == "T1\n\nShare this page\n\nbody & 1 more 1\n\nlast 1"
    assert (got[101], got[102], got[103]) == ("", "", "no template")
    assert html.extract(pages.limit(0), html.deduce(pages.limit(0))).collect() == []


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body class="has-sidebar"><article>text</article><div class="sidebar">x</div>', "text"),
        ('<body class="sidebar"><article>text</article><div class="sidebar">x</div>', "text"),
        ('<body><div class="post no-comments"><p>text</div><div class="comments">x</div>', "text"),
        ('<body><div class="widget"><article>text</article></div><nav>x</nav>', "text"),
        ('<body><form><nav>x</nav><article>one</article></form><article>two</article>', "one two"),
        ('<body><main class="search">text</main><aside><article>x</article></aside>', "text"),
        ('<body><article>text</article><div id="comments"><article>x</article></div>', "text"),
        ('<head><title>x</title><body data-id="menu"><p>text', "text"),
        ('<article>a<svg width="1" />b<svg-icon>c</svg-icon>d<script-box>e</script-box></article>', "abcde"),
        ("<article>a<svg><text>x</text></svg>b<template>x</template>c</article>", "abc"),
        ("<article>a<math><mi>b</mi></math>c<object>d</object>e<noscript>f</noscript></article>", "abcdef"),
        ("<body><noscript>x</noscript><p>text<iframe>x</iframe><style>x</style>", "text"),
    ],
)
def test_articles_do_not_vanish(page, want):
    assert " ".join(html.text_of(page).split()) == want


def test_fixed_text_stays_in_an_article(spark):
    page = "<body><article><h1>T{i}</h1><h2>Summary</h2><p>text {i}</article><div>Imprint</div>"
    bare = "<body><div><h1>T{i}</h1><p>text {i}</div><div>Imprint</div>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i)) for i in range(30)] + [(100 + i, f"http://b.example/{i}", bare.format(i=i)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, html.deduce(pages)).collect()}
    assert got == {i: f"T{i}\n\nSummary\n\ntext {i}" for i in range(30)} | {100 + i: f"T{i}\n\ntext {i}" for i in range(30)}


# 6


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = QUERIES["op6_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8
    assert hit / sum(r.predicted for r in rows) > 0.8
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(6, 1, 1), (5, 1, 0), (None, 1, 1), (8, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    usable = F.col("doc_id") != 7
    for marks in (labels, labels.limit(0)):
        model = toxicity.fit(brute.awkward(spark), marks, usable)
        rows = toxicity.score(brute.awkward(spark), model).collect()
        assert len(rows) == 12 and len({round(r.score, 9) for r in rows if r.doc_id in (1, 2, 3)}) == 1
        assert toxicity.score(brute.awkward(spark, True), model).collect() == []


# 7


@pytest.mark.parametrize("chunk, overlap", [(65_536, 1_024), (300, 60), (40, 10)])
def test_bpe_is_that_of_the_library(spark, texts, encoder, monkeypatch, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    rows = bpe.decode(bpe.encode(spark.read.parquet(f"{SF}/documents.parquet"), *tokenizer()), *tokenizer()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == encoder.encode_ordinary(texts[r.doc_id])
        assert bytes(r.bytes).decode() == texts[r.doc_id]


def test_bpe_without_a_common_boundary(spark, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "OVERLAP", 8)
    some = ["x" * 500, "ab " + " " * 300 + "\n" * 120 + "c", "word " * 60 + "y" * 200 + " end" * 30, "a\n\n\nb" * 80]
    rows = bpe.encode(spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id int, text string"), *tokenizer()).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: encoder.encode_ordinary(t) for i, t in enumerate(some)}


def test_bpe_digest_query(spark, texts, encoder):
    for r in QUERIES["op7_byte_bpe"](spark, SF).collect():
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_awkward(spark, encoder):
    assert bpe.encode(brute.awkward(spark, True), *tokenizer()).collect() == []
    docs = brute.awkward(spark)
    rows = bpe.decode(bpe.encode(docs, *tokenizer()), *tokenizer()).collect()
    want = sorted(encoder.encode_ordinary(r.text or "") for r in docs.collect())
    assert sorted(list(r.ids) for r in rows) == want and all(r.tree == "x" for r in rows)


# 8


def test_preferences(spark):
    t = [(1, True, 0, "system", "s"), (1, True, 1, "user", "u"), (1, True, 2, "assistant", "good"), (1, True, 3, "user", None)]
    t += [(1, False, 0, "system", "s"), (1, False, 1, "user", "u"), (1, False, 2, "assistant", "bad!")]
    t += [(2, True, 0, None, "only"), (3, False, 5, "user", "a"), (4, True, 1, "user", "same"), (4, False, 9, "user", "same"), (None, True, 0, "user", "x")]
    turns = spark.createDataFrame(t, "pair_id long, chosen boolean, turn long, role string, text string").selectExpr("*", "'x' AS c", "'x' AS r")
    got = {r.pair_id: r for r in preferences.format_pairs(turns).collect()}
    one = got[1]
    assert one.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
    assert one.chosen == "<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_loss] == ["good<|im_end|>\n"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_loss] == ["bad!<|im_end|>\n"]
    assert (got[2].n_prompt_turns, got[2].chosen) == (0, "<|im_start|>unknown\nonly<|im_end|>\n")
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].n_rejected_turns) == (0, "", 1)
    assert (got[4].n_prompt_turns, got[4].chosen, got[4].rejected) == (1, "", "")
    assert set(got) == {1, 2, 3, 4}
    assert preferences.format_pairs(turns.limit(0)).collect() == []


# 9


def test_edits_equal_full_encoding(encoder, monkeypatch):
    monkeypatch.setattr(editcount, "LEAF", 4)
    pattern, count, draw = regex.compile(tokenizer()[1]), editcount.Counter(encoder), random.Random(5)
    letters = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", "1", "é", "!", " the", "\t\n ", "ß"]
    write = lambda n: "".join(draw.choice(letters) for _ in range(n))
    for _ in range(2_000):
        text = write(draw.randint(0, 120))
        pieces = pattern.findall(text)
        tree = editcount.Tree.of(np.array([len(x) for x in pieces], np.int32), np.array([count[x] for x in pieces], np.int32))
        for _ in range(4):
            start = draw.randint(0, len(text))
            end, new = min(len(text), start + draw.choice([0, 0, 1, 3, 20])), write(draw.choice([0, 0, 1, 2, 8]))
            want = text[:start] + new + text[end:]
            text, _ = editcount.edit(text, tree, start, end, new, pattern, count)
            assert (text, tree.tokens[1], tree.chars[1]) == (want, len(encoder.encode_ordinary(want)), len(want))


def test_a_small_edit_encodes_little(spark, encoder):
    text = "some words here, " * 20_000
    docs = spark.createDataFrame([(1, text, [(150_000, 150_004, "other")])], "doc_id int, text string, edits array<struct<start:int,end:int,text:string>>")
    (r,) = editcount.apply_edits(editcount.with_trees(docs, *tokenizer()), *tokenizer()).collect()
    assert r.n_tokens == len(encoder.encode_ordinary(text[:150_000] + "other" + text[150_004:])) and r.n_encoded < 1_500


def test_token_counts(spark, encoder):
    docs = brute.awkward(spark).withColumn("edits", F.when(F.col("doc_id") != 6, editcount.own_edits(F.coalesce("text", F.lit("")))))
    trees = editcount.with_trees(docs, *tokenizer())
    rows = editcount.apply_edits(trees, *tokenizer()).collect()
    assert len(rows) == 12 and all(r.n_tokens == len(encoder.encode_ordinary(r.text)) for r in rows)
    assert editcount.apply_edits(editcount.with_trees(docs.limit(0), *tokenizer()), *tokenizer()).collect() == []


def test_token_count_query(spark, texts, encoder):
    for r in QUERIES["op9_token_counts"](spark, SF).collect():
        assert r.n_tokens_before == len(encoder.encode_ordinary(texts[r.doc_id]))


# 10


def _same(rows, texts):
    of, size = brute.components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (size[i], of[i], of[i] == i) for i in texts}


def test_near_duplicates(spark, texts):
    _same(QUERIES["op10_minhash_dedup"](spark, SF).collect(), texts)


def _families(seed: int) -> dict[int, str]:
    """Large groups of near copies, chains of ever farther copies, and documents that only share a passage."""
    draw = random.Random(seed)
    write = lambda n: [f"w{draw.randint(0, 10**6)}" for _ in range(n)]
    base, passage, out = write(80), write(60), []
    for _ in range(120):
        copy = list(base)
        for k in draw.sample(range(80), draw.randint(0, 6)):
            copy[k] = write(1)[0]
        out.append(copy)
    out += [write(draw.randint(3, 40)) + passage + write(draw.randint(3, 40)) for _ in range(150)]
    chain = write(60)
    for _ in range(40):
        chain = chain[3:] + write(3)
        out.append(chain)
    out += [passage + write(2) for _ in range(30)] + [write(3) for _ in range(20)] + [["a", "b"]] * 5
    draw.shuffle(out)
    return {i: " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize(("small", "block"), [(neardup.SMALL, neardup.BLOCK), (2, neardup.BLOCK), (2, 7)])
def test_large_groups_lose_no_link(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    run = neardup._chunk_rows

    def rows(need, percent):
        def inner(batches):
            before, neardup.BLOCK = neardup.BLOCK, block
            try:
                yield from run(need, percent)(batches)
            finally:  # workers are used again
                neardup.BLOCK = before

        return inner

    monkeypatch.setattr(neardup, "_chunk_rows", rows)
    texts = _families(11)
    _same(neardup.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_posterior_bounds():
    need = neardup.least_equal(75, 1e-6)
    draw = np.random.default_rng(0)
    equal = np.cumsum((draw.random((20_000, 128)) < 0.75).reshape(20_000, -1, neardup.STEP).sum(axis=2), axis=1)
    assert (equal >= need).all(axis=1).mean() > 0.999
    far = np.cumsum((draw.random((20_000, 128)) < 0.4).reshape(20_000, -1, neardup.STEP).sum(axis=2), axis=1)
    assert (far >= need).all(axis=1).mean() < 0.01


def test_near_duplicates_awkward(spark):
    assert neardup.find(brute.awkward(spark, True)).collect() == []
    rows = neardup.find(brute.awkward(spark)).collect()
    assert len(rows) == 12
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (5, 6, 7, 8, None)} == {
        (5, 5, True), (6, 6, True), (7, 6, False), (8, 6, False), (None, None, True),
    }
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}


# pipeline


def test_pipeline_against_brute_force(spark, texts, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r.clean_text for r in quality.apply(docs).where("kept").collect()}  # checked with SQL above
    of, _ = brute.components(left)
    left = {i: t for i, t in left.items() if of[i] == i}
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.FOLD))
    leaks = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum(r.text)
        leaks |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in leaks}
    held = lambda w: any(tuple(w[i : i + n]) in leaks for n in sizes for i in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if not held(alnum(t))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    for r in rows:
        spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, left[r.doc_id], re.A) if len(m.group(rule.group)) >= rule.least)
        text, at = "", 0
        for s, e in spans:
            if s >= at:
                text += left[r.doc_id][at:s] + "[SECRET]"
            at = max(at, e)
        assert list(r.ids) == encoder.encode_ordinary(text + left[r.doc_id][at:])


def test_pipeline_awkward(spark, tmp_path):
    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    for empty in (True, False):
        at = tmp_path / str(empty)
        brute.awkward(spark, empty).select(*keep).write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, str(at)).collect()
        assert sorted(r.doc_id or 0 for r in rows) == ([] if empty else [0, 4, 6])
