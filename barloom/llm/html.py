"""Main text of web pages by equivalence-class template deduction.

*Tokens* of a page are its tags, each with its path from the root, and its text runs with their path.  A token's *occurrence
vector* says how often it occurs in each page of a host.  Tokens of one host with the same vector form a class.  A class is
*frequent* if it is in at least ``SHARE`` of the host's pages, and *valid* if its tokens stand in the same order, and
the class lies in the same gap of the same enclosing class, on all its pages.  Valid classes, nested in one another,
are the host's template; its fixed text runs are boilerplate, everything in the gaps is a slot.

*Extraction* takes the slots that hold text, leaves out those whose path leads through a menu, header, footer, sidebar,
notice, advert, form or comments (by element name, or by a whole name in class, id or role), and joins the blocks.  The page, a main
element, a form around an article and, if no article would be left, all that is around one are never left out.  With an ``article`` or ``main`` element on the page only slots inside
count.  Names of elements and classes thus choose the slots; the template only takes away its fixed texts, never inside an ``article``
element, where a subheading may be on most pages.  Fixed text is removed only on hosts with ``LEAST_PAGES`` pages, as fewer may share an article by chance.

Scale: a vector is kept as the exclusive-or of one hash per page and count, so it is summed like any other aggregate and a host
with a third of all pages is combined before it moves.  What is shuffled are hashes of tokens, never pages.  Classes are formed of
frequent tokens only, whose number is bounded by a page's own structure.  The template joins the compact token lists by
host (adaptive execution splits a hot one) and, for extraction, the pages, where only its fixed texts count.

Defined results: a null or empty page has an empty text; a null url is a host of its own; equal rows get equal texts; an
empty table gives no rows; other columns are ignored.  White space in a block is one space; character references are decoded.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.session import materialise

SHARE = 0.9
LEAST_PAGES = 20

# Elements of the HTML standard by how they are laid out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|iframe"
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
# Elements, and whole names in their class, id or role, that hold no main text unless the article is inside; of
# the second kind only outside an article.
ASIDE = set("head nav footer aside form button select option textarea label menu dialog svg canvas template".split())
ASIDE_OUTSIDE = {"header", "noscript"}
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments contentinfo cookie "
    "cookies consent disqus footer form gdpr menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promoted related replies reply respond search share sharing sidebar sidebars social sponsor sponsored subscribe "
    "toolbar widget widgets "
    "ad-banner ad-slot comment-form comment-list comment-respond comments-area cookie-banner cookie-bar cookie-consent cookie-notice "
    "left-sidebar main-menu main-nav nav-menu newsletter-signup page-footer page-header related-posts right-sidebar share-buttons "
    "side-bar side-nav site-footer site-header site-nav social-links social-share widget-area".split()
)
# End tags that may be left out; a start tag of the second kind ends an open element of the first.
ENDS = {"head": {"body"}, "p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_PART = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)""",
    re.S | re.I,
)
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class Element:
    """A start tag: its name and path, whether it lies in an article or main element (``main``) or in an article, and whether it
    is (``own``), or lies in (``aside``), an element that holds no main text."""

    __slots__ = ("name", "path", "parent", "main", "article", "own", "aside")

    def __init__(self, name, path, parent, main, own):
        self.name, self.path, self.parent, self.main, self.own = name, path, parent, main, own
        self.article = name == "article" or (parent is not None and parent.article)
        self.aside = own or (parent is not None and parent.aside)

    def line(self) -> Iterator[Element]:
        """The element and all around it."""
        e = self
        while e is not None:
            yield e
            e = e.parent


class Node:
    """A tag or text run: its element, kind, text, and a number for its block."""

    __slots__ = ("element", "kind", "text", "block")

    def __init__(self, element, kind, text, block):
        self.element, self.kind, self.text, self.block = element, kind, text, block

    path = property(lambda self: self.element.path)
    main = property(lambda self: self.element.main)
    aside = property(lambda self: self.element.aside)


def _free(elements: list[Element]) -> None:
    """No main, nor what contains one, is aside, nor a form around an article; where all articles would be, nothing around them is."""
    articles = [e for e in elements if e.name in ("article", "main")]
    if not any(a.aside for a in articles):
        return

    def settle() -> None:
        for e in elements:  # parents first
            e.aside = e.own or (e.parent is not None and e.parent.aside)

    for a in articles:
        if a.aside:
            for e in a.line():
                e.own = e.own and a.name != "main" and e.name != "form"
    settle()
    if all(a.aside for a in articles):
        for a in articles:
            for e in a.line():
                e.own = False
        settle()


def parse(page: str) -> list[Node]:
    """Tags and text runs in page order."""
    root = Element("", "", None, False, False)
    stack, elements, nodes = [root], [root], []
    block = 0
    for m in _PART.finditer(page):
        _, end, name, rest, text = m.groups()
        if text is not None:
            if not text.isspace():
                nodes.append(Node(stack[-1], "#", entities.unescape(text), block))
            elif stack[-1].path:
                nodes.append(Node(stack[-1], " ", " ", block))
            continue
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            block += 1
        elif name == "br":
            nodes.append(Node(stack[-1], " ", " ", block))
        if end:
            if any(s.name == name for s in stack[1:]):
                while stack[-1].name != name:
                    stack.pop()
                nodes.append(Node(stack.pop(), "/", "", block))
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in BLOCK or stack[k].name == "head":
                if name in ENDS.get(stack[k].name, ()):
                    del stack[k:]
                break
        top = stack[-1]
        marks = {w for x in _MARKS.findall(rest) for w in x.lower().strip("\"'").split()}
        main = top.main or name in ("article", "main")
        own = name in ASIDE or bool(marks & ASIDE_WORDS) or (name in ASIDE_OUTSIDE and not main)
        e = Element(name, f"{top.path}/{name}", top, main, own and name not in ("html", "body"))
        elements.append(e)
        nodes.append(Node(e, "<", "", block))
        if name not in VOID and not rest.endswith("/"):
            stack.append(e)
    _free(elements)
    return nodes


def _token(n: Node) -> int:
    return xxhash.xxh3_64_intdigest(f"{n.kind}{n.path}\0{' '.join(n.text.split())}") - (1 << 63)


def _host(url: str | None) -> str | None:
    return url.split("/")[2].lower() if url and url.count("/") >= 2 else None


TOKENS = "host string, tokens array<long>, keys array<long>, marks array<long>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"host": [], "tokens": [], "keys": [], "marks": []}
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            page = page.as_py() or ""
            tokens = [_token(n) for n in parse(page) if n.kind != " "]
            count = Counter(tokens)
            me = xxhash.xxh3_64_intdigest(f"{url}\0{page}")
            rows["host"].append(_host(url.as_py()))
            rows["tokens"].append(tokens)
            rows["keys"].append(list(count))
            # what this page adds to the vector of a token that it has n times
            rows["marks"].append([xxhash.xxh3_64_intdigest(f"{me}:{n}") - (1 << 63) for n in count.values()])
        kinds = [pa.string(), *[pa.list_(pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))


def _order(tokens: list[int], of: dict[int, int]) -> list[tuple[int, int]]:
    """``(class, signature)`` on one page: the order of the class's tokens and the gap of the class that encloses it."""
    found: dict[int, list[tuple[int, int]]] = {}
    for place, t in enumerate(tokens):
        if t in of:
            found.setdefault(of[t], []).append((place, t))
    out = []
    for c, mine in found.items():
        first, last = mine[0][0], mine[-1][0]
        around = [
            (other[-1][0] - other[0][0], d, sum(p < first for p, _ in other))
            for d, other in found.items()
            if d != c and other[0][0] < first and last < other[-1][0]
        ]
        _, parent, gap = min(around, default=(0, 0, 0))
        inside = not around or sum(p < last for p, _ in found[parent]) == gap
        out.append((c, xxhash.xxh3_64_intdigest(f"{[t for _, t in mine]}:{parent}:{gap}:{inside}") - (1 << 63)))
    return out


def deduce(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """Templates: ``(host, class_id, n_pages, host_pages, tokens)`` of every valid class."""
    words.batches(pages.sparkSession)
    lists = materialise(pages.select(url_col, html_col).mapInArrow(_tokens, TOKENS))
    hosts = lists.groupBy("host").agg(F.count("*").alias("host_pages"))
    entries = lists.select("host", F.explode(F.arrays_zip("keys", "marks")).alias("x")).select("host", "x.keys", "x.marks")
    vectors = entries.groupBy("host", F.col("keys").alias("token")).agg(F.count("*").alias("n_pages"), F.bit_xor("marks").alias("vector"))
    counted = vectors.alias("v").join(hosts.alias("h"), F.expr("v.host <=> h.host")).select("v.*", "host_pages")
    frequent = counted.where(F.col("n_pages") >= F.greatest(F.lit(2), F.col("host_pages") * share))
    classes = materialise(
        frequent.groupBy("host", "vector", "n_pages", "host_pages").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        .withColumn("class_id", F.xxhash64("vector", "n_pages"))
    )
    member = classes.groupBy("host").agg(
        F.map_from_entries(F.flatten(F.collect_list(F.transform("tokens", lambda t: F.struct(t, F.col("class_id")))))).alias("of")
    )
    seen = lists.select("host", "tokens").alias("l").join(member.alias("m"), F.expr("l.host <=> m.host")).select("l.host", "tokens", "of")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, cls, signature = [], [], []
            for h, t, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c, s in _order(t, dict(of)):
                    host.append(h)
                    cls.append(c)
                    signature.append(s)
            arrays = [pa.array(host, pa.string()), pa.array(cls, pa.int64()), pa.array(signature, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "class_id", "signature"])

    order = seen.mapInArrow(orders, "host string, class_id long, signature long")
    valid = order.groupBy("host", "class_id").agg(F.min("signature").alias("a"), F.max("signature").alias("b")).where("a = b")
    kept = classes.alias("c").join(valid.alias("v"), F.expr("c.host <=> v.host and c.class_id = v.class_id"), "left_semi")
    return materialise(kept.select("host", "class_id", "n_pages", "host_pages", "tokens"))


def text_of(page: str | None, fixed: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of one page whose template has the ``fixed`` tokens."""
    nodes = parse(page or "")
    inside = any(n.main and not n.aside for n in nodes)
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        cut = n.kind == "#" and fixed and not n.element.article and _token(n) in fixed
        if n.kind in "# " and not n.aside and (n.main or not inside) and not cut:
            blocks.setdefault(n.block, []).append(n.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def extract(
    pages: DataFrame, template: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """``(page_id, url, text)`` of every row."""
    fixed = materialise(
        template.where(F.col("host_pages") >= least_pages)
        .groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("fixed"))
        .select(F.col("host").alias("t_host"), "fixed")
    )
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.when(F.size(F.split("url", "/")) > 2, F.lower(F.get(F.split("url", "/"), F.lit(2))))
    joined = rows.withColumn("host", host).join(fixed, F.col("host").eqNullSafe(F.col("t_host")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(h.as_py(), set(f.as_py() or ())) for h, f in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "fixed").mapInArrow(run, "page_id long, url string, text string")
