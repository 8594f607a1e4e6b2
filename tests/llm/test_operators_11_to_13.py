"""Spelling variants, source divergence and the n-gram join against plain versions, and their awkward inputs."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import divergence, sigtree, spelling
from barloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# 11


def plain_variants(rows: list[tuple[int | None, str | None]]) -> dict:
    """Words and their forms, near words found by deleting a letter of each."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.FOLD)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    shorter = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for s, some in shorter.items():
        if s in n:
            some = some | {s}
        for a in some:
            for b in some:
                if a != b and (len(a) != len(b) or sum(x != y for x, y in zip(a, b, strict=True)) == 1):
                    near[a].add(b)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x))
        if n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def found_variants(frame) -> dict:
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants([(r.doc_id, r.text) for r in docs])
    got = found_variants(QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.01"))
    assert got == want and sum(v[0] is not None for v in want.values()) > 50


def _mutated(draw: random.Random, word: str) -> str:
    k = draw.randrange(len(word))
    return draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("abcÀéÿ÷z") + word[k:], word[:k] + draw.choice("xyzß") + word[k + 1 :]])


def test_variants_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 20)
    monkeypatch.setattr(spelling, "VISITS", 50)
    monkeypatch.setattr(spelling, "SAMPLE", 300)
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdeéÀ") for _ in range(draw.randint(4, 8))) for _ in range(150)]
    some = base + [_mutated(draw, w) for w in base * 4] + ["aaaaabbbbb"[k:] + "aaaaabbbbb"[:k] for k in range(10)] + ["e" * 4_000] * 3
    rows = []
    for i in range(400):
        rows.append((i, " ".join(draw.choices(some, k=60))))
    chain = [("qqqqqaa", 4), ("qqqqqab", 12), ("qqqqqbb", 40), ("qqqqqbc", 90), ("qqqqqqbc", 300)]
    rows += [(1_000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    want = plain_variants(rows)
    frame = spelling.group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found_variants(frame) == want
    assert max(v[3] for v in want.values()) > 3 and any(v[1] != v[0] for v in want.values() if v[0])


def test_tree_search_finds_all_near_words():
    draw = random.Random(2)
    for length in (1, 5, 6):
        home = sorted({"".join(draw.choice("abc") for _ in range(length)) for _ in range(400)})
        for size in (length, length - 1):
            guests = sorted({"".join(draw.choice("abc") for _ in range(size)) for _ in range(300)}) if size else []
            if not guests:
                continue
            x, y = spelling.near_pairs(spelling.letters(home), spelling.letters(guests))
            got = {(guests[i], home[j]) for i, j in zip(x, y, strict=True)}
            less = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
            same = lambda a, b: sum(p != q for p, q in zip(a, b, strict=True)) == 1
            want = {(a, b) for a in guests for b in home if (same(a, b) if len(a) == len(b) else a in less(b))}
            assert got == want and len(x) == len(got)


def test_checksum_of_runs():
    words = ["a", "word", "longer word", ""]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    seed = np.array([zlib.crc32(b"17:")] * 4, np.uint32)
    got = spelling._crc32(data, ends - [len(w) for w in words], ends, seed)
    assert got.tolist() == [zlib.crc32(f"17:{w}".encode()) for w in words]


def test_variants_of_awkward_documents(spark):
    docs = brute.awkward(spark).select("doc_id", "text", "n", "key")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_variants(spelling.group(docs)) == plain_variants(rows)
    assert spelling.group(brute.awkward(spark, empty=True)).collect() == []
    assert spelling.group(spark.createDataFrame([(1, "hello hello world")], "doc_id long, text string")).collect() == []


# 12


def plain_divergence(rows: list[tuple[str | None, str | None, str | None]]) -> set:
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.FOLD))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = sorted(t for t, k in docs[lang].items() if k >= 3)
        mine = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}

        def share(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + math.floor(Fraction(1_000_000_000 * (k + 1), total)) for t, k in c.items()}

        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:200])):
                out |= {(lang, s, part, item, -v, r + 1) for r, (v, item) in enumerate(some)}
    return out


def found_divergence(frame) -> set:
    rows = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _sources(draw: random.Random) -> list[tuple]:
    rows = []
    for _ in range(300):
        lang, source = draw.choice(["en", "de", None, ""]), draw.choice(["a", "a", "a", "b", "c", None])
        rows.append((" ".join(draw.choice(["The", "über", "x", "一二", "Zoo", "q7r", "rare" + str(draw.randint(0, 90))]) for _ in range(draw.randint(0, 30))), lang, source))
    return rows + [(None, "en", "empty"), ("12 34", "fr", "only"), ("", "fr", "other"), ("Word " * 20_000, "en", "long")]


def test_divergence_is_exact(spark):
    rows = _sources(random.Random(1))
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found_divergence(divergence.audit(frame)) == plain_divergence(rows)


def test_divergence_with_many_spills(spark, monkeypatch):
    import barloom.llm.divergence as d

    rows = _sources(random.Random(2))
    want = plain_divergence(rows)

    def small(batches):
        before, d.HELD, d.FRESH = (d.HELD, d.FRESH), 30, 30
        try:
            yield from d._in_mapper(batches)
        finally:  # workers are used again
            d.HELD, d.FRESH = before

    partial = spark.createDataFrame(rows, "text string, lang string, source string").fillna("").repartition(5)
    rows5 = partial.mapInArrow(small, d._STRIPE_DDL).collect()
    assert len(rows5) > len({(r.lang, r.term) for r in rows5})
    terms = Counter()
    for r in rows5:
        for e in r.stripe:
            terms[r.lang, r.term, e.source] += e.n
    want_terms = Counter()
    for text, lang, source in rows:
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.FOLD)):
            want_terms[lang or "", t, source or ""] += 1
    assert terms == want_terms and want


def test_pairs_of_entries_in_small_steps(monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    monkeypatch.setattr(divergence, "SUMS", 2)
    draw = np.random.default_rng(4)
    rows = [(t, g, int(draw.integers(1, 1000)), 10 + g) for t in range(30) for g in sorted(draw.choice(9, int(draw.integers(1, 8)), replace=False).tolist())]
    columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, ["tid", "gid", "p", "p0"])
    got = Counter()
    for batch in divergence._common(iter([whole.slice(k, 11) for k in range(0, len(rows), 11)])):
        for r in batch.to_pylist():
            got[r["g"], r["o"]] += r["v"]
    f = lambda a, b: (a - b) * (a - b) // b
    want = Counter()
    for t, g, p, p0 in rows:
        for t2, o, q, q0 in rows:
            if t == t2 and g != o:
                want[g, o] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    assert got == want


def test_divergence_of_awkward_documents(spark):
    docs = brute.awkward(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert found_divergence(divergence.audit(docs)) == plain_divergence(rows)
    assert divergence.audit(brute.awkward(spark, empty=True)).collect() == []


def test_divergence_sql_of_awkward_documents(spark):
    docs = brute.awkward(spark).select("doc_id", "text", "lang", "source").toPandas()
    con = duckdb.connect()
    con.register("documents", docs)
    rows = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op12_source_divergence']})").fetchall()
    assert set(rows) == plain_divergence([(None if isinstance(t, float) else t, l, s) for t, l, s in docs[["text", "lang", "source"]].itertuples(index=False)])


# 13


def plain_join(texts: dict, n: int = 4, percent: int = 85) -> dict:
    sets = {}
    for i, t in texts.items():
        w = brute.spaced(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for i, s in sets.items():
        met = Counter(j for x in s for j in lists[x] if j < i)
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def found_join(frame) -> dict:
    rows = frame.collect()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(out) == len(rows)
    return out


def test_join_of_the_table(spark, texts):
    got = found_join(QUERIES["op13_ngram_jaccard"](spark, SF))
    assert got == plain_join(texts) and any(v[1] != i for i, v in got.items())


def _copies(draw: random.Random, size: int, n: int, most: int) -> list[str]:
    """A text and copies with up to ``most`` words exchanged."""
    base = [f"w{draw.randrange(400)}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        copy = list(base)
        for _ in range(draw.randint(0, most)):
            copy[draw.randrange(n)] = f"x{draw.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("chunk", [256, 7])
def test_join_of_groups_of_copies(spark, monkeypatch, chunk):
    draw = random.Random(3)
    some = _copies(draw, 120, 60, 4) + _copies(draw, 60, 200, 9) + _copies(draw, 20, 9, 1) + _copies(draw, 20, 1_500, 60) + _copies(draw, 10, 6, 1)
    passage = " ".join(f"p{k}" for k in range(60))
    some += [passage + " " + " ".join(f"u{draw.randrange(9_999)}" for _ in range(draw.randint(20, 90))) for _ in range(60)]
    draw.shuffle(some)
    texts = dict(enumerate(some))
    run = sigtree._chunk_rows

    def small(percent):
        def inner(batches):
            before, sigtree.CHUNK = sigtree.CHUNK, chunk
            try:
                yield from run(percent)(batches)
            finally:  # workers are used again
                sigtree.CHUNK = before

        return inner

    monkeypatch.setattr(sigtree, "_chunk_rows", small)
    want = plain_join(texts)
    assert found_join(sigtree.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))) == want
    assert len({c for _, c in want.values()}) < len(texts) - 40


def test_linked_sets_share_a_key():
    draw = np.random.default_rng(9)
    linked = 0
    for _ in range(3_000):
        n = int(draw.choice([6, 7, 8, 13, 20, 33, 50, 51, 75, 76, 120, 400, 1000]) + draw.integers(0, 3))
        x = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        out, more = draw.integers(0, max(1, n // 7) + 1, 2)
        y = np.unique(np.concatenate([x[out:], draw.integers(0, 2**63, int(more), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            linked += 1
            assert np.array_equal(x, y) or len(np.intersect1d(sigtree.slice_keys(x, 85), sigtree.slice_keys(y, 85)))
    assert linked > 1_000


def test_trees_prune_only_what_cannot_link(monkeypatch):
    draw = np.random.default_rng(1)
    base = np.unique(draw.integers(0, 2**63, 90, dtype=np.uint64))
    sets = []
    for _ in range(70):
        keep = base[draw.random(len(base)) > draw.choice([0.02, 0.1, 0.4])]
        sets.append(np.unique(np.concatenate([keep, draw.integers(0, 2**63, 3, dtype=np.uint64)])))
    sets += [np.unique(draw.integers(0, 2**63, int(k), dtype=np.uint64)) for k in draw.integers(1, 120, 80)]

    def groups(pairs, n):
        parent = list(range(n))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            parent[max(root(i), root(j))] = min(root(i), root(j))
        return [root(i) for i in range(n)]

    def linked(a, b):
        both = len(np.intersect1d(a, b))
        return 100 * both >= 85 * (len(a) + len(b) - both)

    want = groups([(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])], len(sets))
    for bits in (1 << 20, 128):
        monkeypatch.setattr(sigtree, "MOST_BITS", bits)
        assert groups(sigtree.joined(sets, None, 85), len(sets)) == want
        half = sets[:9], sets[9:]
        across = groups([(i, j + 9) for i, j in sigtree.joined(*half, 85)], len(sets))
        assert across == groups([(i, j) for i in range(9) for j in range(9, len(sets)) if linked(sets[i], sets[j])], len(sets))


def test_join_of_awkward_documents(spark):
    rows = sigtree.join(brute.awkward(spark)).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows)
    long = 60_000 - 3
    assert got == [
        (0, 11, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, long, 4), (5, 1, 5), (5, 1, 5), (6, 11, 6), (7, 11, 6), (8, 12, 6), (9, 2, 9), (10, 4, 10),
    ]
    assert sigtree.join(brute.awkward(spark, empty=True)).collect() == []
    two = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in sigtree.join(two).collect()) == [(1, 1), (2, 1), (2, 1)]
