"""Operator 4, HTML extraction: structural rules and removal of a site's template."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import urls
from quire.llm.common import Scratch, in_batches, table

#: A subtree is the site's template in more than LEAST pages and more than a SHARE of its host's.
LEAST, SHARE = 5, 0.5

# HTML's void and raw-text elements, and those that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the same group, up to the given borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never main text; a page's header is one, an article's own is not.
DROP = frozenset("head script style noscript template iframe svg canvas object nav footer aside form button select textarea input dialog menu title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words in a class or id that mark a container as something else than the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe"
    " subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist respond disqus footer masthead header topbar share sharing social"
    " related recommended popup modal overlay toolbar pagination pager widget widgets login signup skip".split()
)
#: Words that say nothing of what a container holds, and those that say that it is a part of the article.
PLAIN = frozenset("area bar block bottom box button buttons center column container content form group inner item items left links list main outer page panel right row section site slot thread top unit wrap wrapper zone".split())
OWN = frozenset("article body content entry headline main post story text title".split())
CONTAINERS = frozenset("div section ul ol dl table p span article details figure blockquote center header a".split())

#: First and last words of names that tell a state of the page, not what an element holds.
STATES = (frozenset("has no not with without is hide show wp".split()), frozenset("open opened closed status enabled disabled active inactive on off state present absent".split()))
#: Elements whose text is none that a page shows for its own sake.
UNSEEN = frozenset("head script style noscript template svg iframe select textarea title nav footer aside".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: One attribute after the other; a value's own text is never searched for names.
_ATTR = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_PART = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    """An element; ``core``: it holds what the page is about, by its ``main``, all of its articles or most of its text."""

    __slots__ = ("tag", "attrs", "kids", "key", "core")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.key, self.core = tag, attrs, [], 0, ""


def parse(page: str) -> Node:
    """The element tree of a page, by HTML's rules for implied ends as far as text needs them."""
    root = Node("#")
    stack, at = [root], 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "table") and tag not in ("body", "html", "article", "main", "table"):
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS:
            same, border = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in border:
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    weigh(root)
    return root


def weigh(tree: Node) -> None:
    """Set ``core``: "main" where an element holds a main element, or all of the page's
    outermost articles with a third of its text; else "text" where it holds more than half of that."""
    order, stack = [], [tree]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and k.tag not in UNSEEN)
    said: dict[int, tuple[int, int, int, bool]] = {}  # text, articles, their text, a main element
    for node in reversed(order):
        size = articles = told = 0
        main = node.tag == "main"
        for k in node.kids:
            if isinstance(k, str):
                size += len(k.strip())
            elif id(k) in said:
                a, b, c, d = said[id(k)]
                size, articles, told, main = size + a, articles + b, told + c, main or d
        if node.tag == "article":
            articles, told = 1, size
        said[id(node)] = (size, articles, told, main)
    size, articles, *_ = said[id(tree)]
    for node in order:
        a, b, c, main = said[id(node)]
        node.core = "main" if main or (b and b == articles and 3 * c >= size) else "text" if 2 * a > size else ""


def attributes(raw: str) -> dict[str, str]:
    """Names (lower-case) and values of a start tag's attributes; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        out.setdefault(m[1].lower(), _html.unescape(value) if "&" in value else value)
    return out


def marked(names: str, inside: bool, core: str = "") -> bool:
    """Whether a class or id says that the element is no part of the article.

    One name of it must be a word of ``MARKS``, or be made of such words and of plain
    ones. Outside an article one such word in a compound name is enough, but for names
    that also hold a word of the article's own parts, as in ``post-header``. Names that
    tell a state, as ``has-sidebar`` and ``comments-open``, say nothing. Where the page's
    main part or all of its articles lie inside (``core`` "main"), only the names of
    reader comments count that tell nothing else; where most of its text does ("text"),
    one word in a compound name doesn't.
    """
    for name in names.split():
        parts = [x for x in _PART.split(_HUMP.sub("-", name).lower()) if x and not x.isdigit()]
        marks = sum(x in MARKS for x in parts)
        if not marks or (len(parts) > 1 and (parts[0] in STATES[0] or parts[-1] in STATES[1])):
            continue
        whole = all(x in MARKS or x in PLAIN for x in parts)
        said = "comments" in parts or "comment" in parts
        if core == "main":
            if said and whole:
                return True
        elif whole or said or (not inside and OWN.isdisjoint(parts) and not (core and marks == 1)):
            return True
    return False


def dropped(node: Node, inside: bool) -> bool:
    """Whether rules alone take the element out; ``inside``: it stands in an article or main element.

    A form, a header or a container with a doubtful name stays if the page's main part is in it.
    """
    tag, core = node.tag, "" if inside else node.core
    if tag in DROP or (tag == "header" and not inside):
        if not (core and tag in ("form", "header")):
            return True
    if tag in ("html", "body", "main") or not node.attrs.strip("/ "):
        return False
    has = attributes(node.attrs)
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", has.get("style", ""), re.I):
        return True
    if has.get("role", "").lower() in ROLES and not (core and has["role"].lower() == "form"):
        return True
    return tag in CONTAINERS and any(marked(has[a], inside, core) for a in ("class", "id") if a in has)


def roots(tree: Node) -> list[Node]:
    """Where the main text is: the outermost article and main elements in page order, else the whole page."""
    found, stack = [], [tree]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            found.append(node)
            continue
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not dropped(k, False))
    return found or [tree]


def _each(tree: Node) -> Iterator[tuple[Node, list[Node]]]:
    """Every kept element below the roots, children before parents, with its kept children."""
    for top in roots(tree):
        order, stack = [], [(top, top.tag in ("article", "main"))]
        while stack:
            node, inside = stack.pop()
            kids = [k for k in node.kids if isinstance(k, Node) and not dropped(k, inside)]
            order.append((node, kids))
            stack.extend((k, inside or k.tag in ("article", "main")) for k in kids)
        yield from reversed(order)


def subtrees(page: str | None) -> list[int]:
    """The hashes of the kept element subtrees that hold text, each once."""
    return list(_hash(parse(page or ""))) if page else []


def _hash(tree: Node) -> set[int]:
    """Give each kept element the hash of its tag and content (0 if it has no text)."""
    out = set()
    for node, kids in _each(tree):
        live, said, parts = set(map(id, kids)), False, [node.tag]
        for k in node.kids:
            if isinstance(k, str):
                if t := " ".join(k.split()):
                    parts.append(t)
                    said = True
            elif id(k) in live and k.key:
                parts.append(str(k.key))
                said = True
        node.key = xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63) if said else 0
        if said:
            out.add(node.key)
    return out


def extract(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text: blocks in page order, joined by an empty line. Null or empty: empty."""
    if not page:
        return ""
    tree = parse(page)
    if template:
        _hash(tree)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    for top in roots(tree):
        stack: list = [(top, top.tag in ("article", "main"))]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
                continue
            node, inside = item
            if isinstance(node, str):
                now.append(_html.unescape(node) if "&" in node else node)
                continue
            if template and node.key in template:
                continue
            if node.tag == "br":
                now.append("\n")
            inside = inside or node.tag in ("article", "main")
            if node.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend((k, inside) for k in reversed(node.kids) if isinstance(k, str) or not dropped(k, inside))
        flush()
    return "\n\n".join(blocks)


def extract_pages(df: DataFrame, url_col: str, html_col: str, carry: list[str], least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``carry`` of every row and ``text``.

    First every page's element subtrees are hashed and, for each host, counted over its
    distinct pages (copies of one page are one page). Subtrees in more than ``least``
    pages and in more than ``share`` of the host's are its template. Then the text is taken from what
    structural rules and the template leave. Null or empty html gives an empty text; a
    null URL belongs to the host without a name. Every row gives one row, repeated rows
    alike; an empty table gives an empty result. A carried ``text`` is replaced; other
    columns of any name pass through.

    Pages are parsed twice: for their hashes, which are written once and read for every
    count, and for the text. Only hashes are shuffled, summed up per task before; a host
    with a third of all pages is dealt by (host, subtree). The pages to be changed are
    written as a small table, so that the last join's plan follows from its known size.
    """
    kept = [c for c in carry if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("string")
    base = df.select(row.alias("row"), urls.host(F.col(url_col).cast("string")).alias("host"), F.md5(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("print"), F.col(html_col).cast("string").alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(map(subtrees, b.column(2).to_pylist()), pa.list_(pa.int64()))], names=["host", "print", "keys"])

    scratch = Scratch(df.sparkSession, "templates")
    hashed = scratch.keep(base.select("host", "print", "html").transform(in_batches, hashes, "host string, print string, keys array<long>"), "hashes")
    pages = hashed.groupBy("host", "print").agg(F.first("keys").alias("keys"))
    size = pages.groupBy("host").agg(F.count("*").alias("pages"))
    trees = pages.select("host", "print", F.explode("keys").alias("key"))
    often = trees.groupBy("host", "key").agg(F.count("*").alias("in")).where(F.col("in") > least)
    often = often.join(size, "host").where(F.col("in") > share * F.col("pages")).select("host", "key")
    cuts = trees.join(often, ["host", "key"]).groupBy("host", "print").agg(F.collect_set("key").alias("cuts"))
    cuts = scratch.keep(cuts, "cuts")
    scratch.drop("hashes")

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", base.schema["row"].dataType), T.StructField("text", T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(h, frozenset(c or ())) for h, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(got, pa.string())], names=["row", "text"])

    out = base.join(cuts, ["host", "print"], "left").select("row", "html", "cuts").transform(in_batches, texts, schema)
    return out.select(*(["row.*"] if kept else []), "text")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_pages(table(spark, sf_dir, "pages"), "url", "html", ["page_id", "url"])
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
