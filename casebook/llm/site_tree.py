"""Main text of web pages: tag rules, and a style tree per site that tells repeated page parts from articles."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.store import small_batches, written

# Elements by what HTML says about them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table
    tbody td tfoot th thead tr ul caption""".split())
CLOSED_BY_SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table",
                  "option": "select", "thead": "table", "tbody": "table", "tfoot": "table"}
# Elements, roles and names that are never part of an article. Names that articles use too (legal, share,
# side, notice, related, alert, skip) count only with a word for a part of a page after them.
NOISE = frozenset("""nav footer aside form script style noscript template iframe svg button select dialog menu head title
    textarea object embed canvas audio video map datalist fieldset noembed noframes xmp""".split())
NOISE_ROLES = frozenset("""navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog
    toolbar""".split())
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|popups?|modal|overlay|"
    r"sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|foot|footer|masthead|topbar|toolbar|comments?|disqus|"
    r"reply|replies|respond|sharing|social|recommended|newsletter|subscribe|signup|login|pagination|pager|widgets?|copyright|"
    r"(?:legal|share|side|notices?|related|alerts?|skip)[_-](?:bar|box|buttons?|col|column|links?|list|area|block|items?|nav|"
    r"notices?|panel|posts?|articles?|stories|content|section|text|to|wrapper|container|icons?|tools?))(?=$|[\s_-])"
    r"|^\s*(?:share|side|notices?|related|alerts?|skip)\s*$", re.I)
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?=$|[\s_-])", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(>|$)|<[!?/][^>]*(?:>|$)", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

LEAST_PAGES = 8  # a style node is judged once so many pages of the site have it
IMPORTANCE = 0.2  # branches of less importance go
MOST_OUTSIDE = 2  # so many times the text of article and main may be outside them for these to be the article


def _noisy(tag: str, attributes: str) -> bool:
    if tag in NOISE:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in NAMES.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if (name == "hidden" or name == "aria-hidden" and value.lower() == "true"
                or name == "style" and re.search(r"display\s*:\s*none", value, re.I)
                or name == "role" and value.lower() in NOISE_ROLES
                or name in ("class", "id") and tag not in ("html", "body", "article", "main") and NOISE_NAMES.search(value)
                or name in ("class", "id") and tag == "article" and REPLIES.search(value)):
            return True
    return False


def _style(tag: str, attributes: str) -> str:
    """What a presentation node is told by: the tag and its class names without digits."""
    m = re.search(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", attributes) if "class" in attributes else None
    return f"{tag}.{re.sub(r'[0-9]+', '', m[1] or m[2] or m[3] or '')}" if m else tag


class _Node:
    __slots__ = ("tag", "style", "path", "noisy", "parent", "children", "hash")

    def __init__(self, tag: str, style: str, noisy: bool, parent):
        self.tag, self.style, self.noisy, self.parent = tag, style, noisy, parent
        self.path = zlib.crc32(style.encode("utf-8", "replace"), parent.path if parent else 0)
        self.children, self.hash = [], 0


def parse(page: str | None) -> tuple[_Node, list[tuple[_Node, str | None]]]:
    """The element tree, and the page's pieces in order: (element, text), with None for a block border."""
    page = page or ""
    root = _Node("#root", "", False, None)
    at, top, pieces, n = 0, root, [], len(page)

    def words(raw: str) -> None:
        if raw and not top.noisy:
            pieces.append((top, html.unescape(raw) if "&" in raw else raw))

    def close(until: _Node) -> _Node:
        if until.tag in BLOCKS:
            pieces.append((until.parent, None))
        return until.parent

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = top
            while node is not root and node.tag != tag:
                # an end tag does not reach through a cell or an article
                node = root if node.tag in ("td", "th", "article", "table") and tag not in BLOCKS else node.parent
            if node is not root:
                while top is not node:
                    top = close(top)
                top = close(top)
            elif tag == "br":
                words(" ")
            continue
        if not m[4]:
            continue
        if tag == "br":
            words(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                pieces.append((top, None))
            continue
        if tag in BLOCKS:
            stop = CLOSED_BY_SAME.get(tag, "").split()
            node, found = top, None
            while node is not root and node.tag not in stop:
                if node.tag == "p" or stop and node.tag in (("dt", "dd") if tag in ("dt", "dd") else ("td", "th")
                                                            if tag in ("td", "th") else (tag,)):
                    found = node
                    if node.tag != "p":
                        break
                elif node.tag in BLOCKS and not stop:
                    break
                node = node.parent
            if found is not None:
                while top is not found:
                    top = close(top)
                top = close(top)
            pieces.append((top, None))
        node = _Node(tag, _style(tag, m[3]), top.noisy or _noisy(tag, m[3]), top)
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = n if end is None else page.find(">", end.end()) + 1 or n
            continue
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        top = node
    return root, pieces


def _fill_hashes(root: _Node, pieces) -> None:
    """Each node's hash stands for the text of its branch."""
    for node, text in pieces:
        if text and not text.isspace():
            h = zlib.crc32(" ".join(text.split()).encode("utf-8", "replace"))
            while node is not None:
                node.hash = (node.hash * 31 + h) & 0xFFFFFFFF
                node = node.parent


def _main_nodes(pieces) -> tuple[set[int], set[int]]:
    """Elements in article or main that have text, and those that hold an article: article, main and all around them."""
    inside: set[int] = set()
    holders: set[int] = set()
    for node, text in pieces:
        if text is None or text.isspace():
            continue
        chain, outermost = [], 0
        while node is not None:
            chain.append(node)
            if node.tag in ("article", "main"):
                outermost = len(chain)
                holders.add(id(node))
            node = node.parent
        if outermost:
            inside.update(id(n) for n in chain[:outermost])
            holders.update(id(n) for n in chain[outermost:])
    return inside, holders


def host_of(url):
    """The host of a URL in lower case, without user, port and a leading ``www.``; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"^www\.", "")


def _branches(root: _Node) -> Iterator[_Node]:
    waiting = list(root.children)
    while waiting:
        node = waiting.pop()
        if not node.noisy:
            yield node
            waiting.extend(node.children)


def style_tree(pages: DataFrame, text: str = "html", url: str = "url") -> DataFrame:
    """(host, path, pages, importance): the merged style nodes of every site.

    Pages of a host are laid over each other; a style node is a path of tags and class names. Its presentation importance
    is the entropy of its child sequences over the pages that have it, its content importance the entropy of its texts,
    each over the logarithm of the number of pages; a node is as important as the larger of the two. Pages of a host with
    the same text count once, so copies of an article do not make it a part of the site. Counting is one aggregation on
    (host, path, page), one on (host, path, feature) and one on (host, path), so a host with any share of the pages is
    spread.
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, shapes, contents, whole = [], [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root, pieces = parse(page)
                _fill_hashes(root, pieces)
                seen = {}
                for node in _branches(root):
                    shape = zlib.crc32(",".join(c.style for c in node.children).encode("utf-8", "replace"))
                    old = seen.get(node.path, (0, 0))
                    seen[node.path] = ((old[0] * 31 + shape) & 0xFFFFFFFF, (old[1] * 31 + node.hash) & 0xFFFFFFFF)
                for path, (shape, content) in seen.items():
                    hosts.append(host)
                    paths.append(path)
                    shapes.append(shape)
                    contents.append(content)
                    whole.append(root.hash)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in (
                paths, shapes, contents, whole)]], names=["host", "path", "shape", "content", "page"])

    rows = small_batches(pages.select(host_of(F.col(url)).alias("host"), text)).mapInArrow(
        features, "host string, path long, shape long, content long, page long").distinct()
    # the two features are counted apart, as (host, path, kind, feature)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("shape").alias("feature")),
                    F.struct(F.lit(1).alias("kind"), F.col("content").alias("feature")))
    counts = rows.select("host", "path", F.explode(kinds).alias("x")).groupBy("host", "path", "x.kind", "x.feature").agg(
        F.count("*").alias("n"))
    per = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    return per.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(entropy).alias("importance"))


def _article(page: str | None, unimportant: frozenset) -> str:
    """Text of the branches that stay, a line per block."""
    root, pieces = parse(page)
    inside, holders = _main_nodes(pieces)
    if inside:
        # a teaser in an article is not the article: what is outside, but for what repeats, must not be far longer
        sizes, far = [0, 0], {}
        for node, text in pieces:
            if text is not None:
                at, dull = node, False
                if id(node) not in far:
                    while at is not None and not dull:
                        dull, at = at.path in unimportant and id(at) not in holders, at.parent
                    far[id(node)] = dull
                if not far[id(node)]:
                    sizes[id(node) in inside] += len(text.strip())
        if sizes[0] > MOST_OUTSIDE * sizes[1]:
            inside = set()

    def text_of(dull: frozenset) -> str:
        lines, now, stays = [], [], {}
        for node, text in pieces:
            if text is None:
                line = " ".join("".join(now).split())
                now = []
                if line:
                    lines.append(line)
                continue
            if id(node) not in stays:
                good, at = not inside or id(node) in inside, node
                while at is not None and good:
                    # what repeats over a site goes, but never the elements that hold an article as a whole
                    good = not (at.path in dull and id(at) not in holders)
                    at = at.parent
                stays[id(node)] = good
            if stays[id(node)]:
                now.append(text)
        line = " ".join("".join(now).split())
        return "\n".join([*lines, line] if line else lines)

    # an article that is the same on all pages is still the article
    return text_of(unimportant) or (text_of(frozenset()) if inside and unimportant else "")


def extract(pages: DataFrame, text: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page; columns other than ``out`` pass through.

    First the style trees of all sites are built, then each page loses: elements that are never article (menus, footers,
    forms, scripts and the like, told by tag, role, or class and id words), everything outside ``article`` and ``main``
    where a page has them and their text is not less than half of the rest, and everywhere, inside these too, the branches whose style node is on ``LEAST_PAGES`` different
    pages of the site or more and has an importance under ``IMPORTANCE``. The ``article`` and ``main`` elements themselves
    and what is around them are not judged, and where nothing in them would be left all of it stays. Only such nodes
    travel to the pages, as one small row per host; a host's nodes are bounded by its templates, and hosts join without a
    broadcast hint. Siblings of one tag and class are one style node: a repeated paragraph among others of its kind stays.

    Blocks come in page order, one line each; character references are decoded, runs of white space inside a block
    become one space. A null, empty or textless page gives an empty text. Pages without a host share one tree. Malformed
    markup is read to the end: unclosed elements end with their parents, an unfinished tag or comment is dropped.
    """
    tree = style_tree(pages, text, url).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < IMPORTANCE))
    names = [c for c in pages.columns if c != out]
    # columns of our own under names that no column has, whatever its case
    taken = {c.lower() for c in pages.columns}
    host_name, dull_name = (next(n for n in (f"{c}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken)
                            for c in ("_host", "_dull"))
    dull = written(tree.groupBy(F.col("host").alias(host_name)).agg(F.collect_set("path").alias(dull_name)), "dull")
    joined = pages.withColumn(host_name, host_of(F.col(url))).join(dull, host_name, "left")
    schema = pages.select(*names).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                texts = [_article(page, frozenset(dull or ())) for page, dull in zip(
                    columns[text].to_pylist(), columns[dull_name].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[columns[c] for c in names], pa.array(texts, pa.string())],
                                                 names=[*names, out])

    return small_batches(joined.select(*dict.fromkeys([*names, text]), dull_name)).mapInArrow(run, schema)
