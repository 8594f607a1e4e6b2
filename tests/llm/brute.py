"""Plain single-machine versions of what SQL does not express, and documents that are awkward."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators work with.
CLASHES = ("n", "key", "ids", "h", "host", "tree", "tokens", "rep", "component", "rule", "toxic_score", "kept_at")

_SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def awkward(spark, empty: bool = False):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", None, 4),
        (4, " ".join(f"w{i}" for i in range(60_000)), "en", "s", None),
        (5, "a b c", "en", "s", 5),
        (5, "a b c", "en", "s", 5),
        (None, _SENTENCE, None, "s", 10),
        (6, _SENTENCE, "en", "s", 10),
        (7, _SENTENCE, "en", None, 10),
        (8, _SENTENCE + " Fifteen", "en", "s", 10),
        (9, "token = " + "0123456789abcdef" * 3 + " and AKIA" + "Z" * 20, "en", "s", 10),
        (10, "ÀÉ ß 東京 \U0001f600 " * 5, "xx", "s", 10),
    ]
    docs = spark.createDataFrame([] if empty else rows, SCHEMA)
    for c in CLASHES:
        docs = docs.selectExpr("*", f"'x' AS {c}")
    return docs


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def shingles(text: str | None) -> frozenset:
    w = spaced(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts: dict[int, str | None], percent: int = 75) -> tuple[dict[int, int], dict[int, int]]:
    """Least linked id and set size of every document, all links found by prefix filtering."""
    sets = {i: shingles(t) for i, t in texts.items()}
    often = Counter(x for s in sets.values() for x in s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i in sorted(sets, key=lambda i: len(sets[i])):
        s, met = sets[i], set()
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(percent * len(s) / 100) + 1] if s else []
        for x in rare:
            met.update(lists[x])
            lists[x].append(i)
        for j in met:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def unigram_scores(texts: dict[int, str | None]):
    """``(held out, tokens, known tokens, base score)`` of every document and the number of training tokens."""
    tokens = {i: [*spaced(t), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    total, size = sum(counts.values()), len(counts)
    p = lambda x: math.log10((counts[x] + 0.5) / (total + 0.5 * (size + 1)))
    return {i: (held[i], len(t), sum(counts[x] > 0 for x in t), sum(map(p, t))) for i, t in tokens.items()}, total
