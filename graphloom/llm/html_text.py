"""HTML extraction by consensus host paths.

Pass 1 parses every page and scores its containers: characters in text blocks, less those in
links, for the element and a discount for each level up.  The scored containers vote for their
generalised path, tags with classes and ids whose digits are dropped.  A grouped aggregation in
Spark adds up the votes by host and path; the path with the most votes wins its host.  Pass 2
parses again and extracts the elements at the host's winning path; a page that has none of them
(or whose own best container holds far more text) falls back to its own best container.  Either
way an element inside an article, or else inside main, stands for all of that article or main.

In the container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comment sections are left out, by tag or by the words of class, id and role; the header of an
article or main is the article's and stays.  Character
references are decoded, white space inside a block becomes one space, blocks are joined by \\n.

Defined results: null and empty pages give an empty text; pages without markup give their text;
unclosed and crossing tags are closed as browsers do for p, li, td and the like; a quote in a tag
that never closes is a plain character, and so are all later ones; a null url is the empty host;
repeated pages each get a row.  Parsing takes time in proportion to a page, however it nests.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import needed, salted_lookup, tune
from graphloom.llm.url_filter import host_and_path
from graphloom.store import Scratch

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")

RAW = frozenset("script style noscript template textarea iframe svg object xmp noembed noframes title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul hr".split()
)
#: Elements that are never main text.
DROP = RAW | frozenset("head nav header footer aside form button select dialog menu input label fieldset datalist output canvas audio video map annotation".split())
#: Words of class, id or role that mark what isn't main text.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer foot sidebar sidebars aside rail widget widgets cookie cookies consent notice notices gdpr alert popup modal overlay "
    "comment comments respond disqus reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login search searchbox pagination pager toolbar skip copyright tags".split()
)
#: Words of layout classes that only speak of such parts, as in has-sidebar.
LAYOUT = frozenset("with has no".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An opening tag closes an open element of these kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_SCOPE = frozenset("ul ol dl table div section article main body td th aside nav header footer form blockquote html".split())
_SENTENCE = re.compile(r"[.!?,;:]")
#: How the host's choice yields: the page's own best container must hold so many times its text.
OUTVOTED = 3


#: For each kind of element that an opening tag may close: an open paragraph, and the sets in CLOSES.
_KINDS = [frozenset({"p"}), *dict.fromkeys(map(frozenset, CLOSES.values()))]
_CLOSED_BY = {name: _KINDS.index(frozenset(kinds)) for name, kinds in CLOSES.items()}
_MARKED = _SCOPE.union(*_KINDS)


class Node:
    """An element.  What tags to come ask of the elements around them is worked out once, from its parent."""

    __slots__ = ("article", "children", "drop", "main", "name", "near", "parent", "path", "step")

    def __init__(self, name: str, parent: Node | None, step: str, drop: bool):
        self.name, self.parent, self.step, self.drop, self.children = name, parent, step, drop, []
        if parent is None:
            self.near, self.article, self.main, self.path = (None,) * len(_KINDS), None, None, b""
            return
        self.path = xxhash.xxh3_128_digest(parent.path + step.encode("utf-8", "replace"))
        self.article = parent.article or (self if name == "article" else None)
        self.main = parent.main or (self if name == "main" else None)
        self.near = parent.near
        if name in _MARKED:  # the outermost open element of each kind in this scope
            self.near = tuple((up or self) if name in kind else None if name in _SCOPE else up for kind, up in zip(_KINDS, parent.near, strict=True))


def _open(name: str, attributes: str, parent: Node) -> Node:
    kinds, drop, step = [], name in DROP, name
    if name == "header" and (parent.article or parent.main):  # of the article, not of the site
        drop = False
    if attributes.strip():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                words = _WORD.findall(entities.unescape(value))
                drop |= name not in ("html", "body", "main", "article") and not BOILER.isdisjoint(words) and LAYOUT.isdisjoint(words)
                kinds += [f"{'.' if key == 'class' else '#'}{'-'.join(_WORD.findall(v))}" for v in value.split()]
            elif key == "role":
                drop |= value in ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true" and name not in ("html", "body")) or (key == "style" and re.search(r"display\s*:\s*none", value)):
                drop = True
        step += "".join(sorted(set(kinds)))
    return Node(name, parent, step, drop)


class _Tags:
    """Tags of a page in one pass: (start, end, closing, name, attributes), name empty for comments and the like.

    A quote that never closes would swallow the page; from the first tag with one on, quotes count
    as plain characters.  So no part of a page is read more than twice.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def _end(self, at: int) -> int:
        """Where the tag that ``at`` lies in has its ">"."""
        page, i = self.page, at
        near = page.find(">", at)
        if not self.quotes or (page.find('"', at, near) < 0 and page.find("'", at, near) < 0):
            return near
        while self.quotes:
            i = _PLAIN.match(page, i).end()
            if i < len(page) and page[i] == ">":
                return i
            i = page.find(page[i], i + 1) + 1 if i < len(page) else 0
            if not i:
                self.quotes = False
        return near

    def after(self, at: int):
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!--", "<![CDATA["), start):
                close = "-->" if page.startswith("<!--", start) else "]]>"
                end = page.find(close, start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if start > self.last:
                return None
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", "", ""
            if m := _NAME.match(page, start + 1):
                end = self._end(m.end())
                return start, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at = start + 1
        return None


def parse(page: str) -> Node:
    """A forgiving tree: text and elements in page order."""
    root = node = Node("#root", None, "", False)
    tags, opened = _Tags(page), Counter()
    at, end = 0, len(page)
    while tag := tags.after(at):
        start, stop, closing, name, attributes = tag
        if start > at:
            node.children.append(page[at:start])
        at = stop
        if not name:
            continue
        if closing:
            if opened[name]:
                while node.name != name:
                    opened[node.name] -= 1
                    node = node.parent
                opened[name] -= 1
                node = node.parent
            continue
        close = None
        if name == "p" or (name in BLOCK and name not in ("td", "th", "tr", "li", "option")):  # a block closes an open paragraph
            close = node.near[0]
        if name in _CLOSED_BY:
            close = close or node.near[_CLOSED_BY[name]]
        while close is not None:
            opened[node.name] -= 1
            node, done = node.parent, node is close
            if done:
                close = node.near[_CLOSED_BY[name]] if name in _CLOSED_BY else None
        child = _open(name, attributes, node)
        node.children.append(child)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        node = child
        opened[name] += 1
    if at < end:
        node.children.append(page[at:])
    return root


def blocks(node: Node) -> list[str]:
    """Text blocks below ``node`` in page order, without what isn't main text."""
    done: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if text := _SPACE.sub(" ", entities.unescape("".join(run))).strip():
                done.append(text)
            run.clear()

    todo: list[tuple[Node | str, bool]] = [(node, False)]
    while todo:  # no recursion: trees may be deep
        item, leave = todo.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        if leave:
            close()
            continue
        if item.drop and item is not node:
            if item.name in BLOCK:
                close()
            continue
        if item.name == "br":
            run.append(" ")
            continue
        if item.name in BLOCK or item is node:
            close()
            todo.append((item, True))
        todo.extend((child, False) for child in reversed(item.children))
    close()
    return done


def path_of(node: Node) -> str:
    """A hash of the tag-class path to the node, and its last step: paths of deep trees would be long keys."""
    return f"{node.path.hex()}/{node.step}" if node.parent is not None else ""


def best_containers(root: Node) -> list[tuple[float, Node]]:
    """Containers with a score, best first.  Text counts for its nearest block container and,
    at half the weight, for the one above; link text counts against, article and main for."""
    score: Counter[Node] = Counter()
    todo: list[tuple[Node, Node, bool]] = [(root, root, False)]
    while todo:
        node, box, link = todo.pop()
        for child in node.children:
            if isinstance(child, str):
                n = len(child.strip())
                if n:
                    gain = -n if link else n + 10 * len(_SENTENCE.findall(child))
                    score[box] += gain
                    if box.parent is not None:
                        score[box.parent] += gain / 2
            elif not child.drop:
                inside = child.name in BLOCK and child.name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "tr", "dd", "dt", "figcaption", "caption", "center")
                todo.append((child, child if inside else box, link or child.name == "a"))
                if inside and child.name in ("article", "main"):
                    score[child] += 200
    return sorted(((s, n) for n, s in score.items() if s > 0), key=lambda x: -x[0])


def _widest(root: Node, found: list[Node]) -> list[Node]:
    """Without those that lie in another one, in page order."""
    kept, todo = [], [root]
    wanted = set(found)
    while todo:
        node = todo.pop()
        if node in wanted:
            kept.append(node)
            continue
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.drop)
    return kept


def vote(page: str) -> list[tuple[str, float]]:
    """The paths of all scored containers of a page with their shares of the best score."""
    ranked = best_containers(parse(page))
    top = ranked[0][0] if ranked else 1.0
    shares: dict[str, float] = {}
    for s, node in ranked:
        path = path_of(node)
        shares[path] = max(shares.get(path, 0.0), s / top)
    return list(shares.items())


def _whole(node: Node) -> Node:
    """The outermost article that holds a node, else the outermost main, else the node itself."""
    return node.article or node.main or node


def extract(page: str, path: str | None) -> str:
    """Main text of a page, by its host's path if it has elements there."""
    root = parse(page)
    ranked = best_containers(root)
    own = blocks(_whole(ranked[0][1])) if ranked else blocks(root)
    if path is None:
        return "\n".join(own)
    at, todo, key = [], [root], bytes.fromhex(path.partition("/")[0])
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node) and not child.drop:
                if child.path == key:
                    at.append(child)
                todo.append(child)
    if path == "" or not at:
        return "\n".join(own if path else blocks(root))
    chosen = [b for node in _widest(root, [_whole(n) for n in at]) for b in blocks(node)]
    if sum(map(len, own)) > OUTVOTED * sum(map(len, chosen)):
        chosen = own
    return "\n".join(chosen)


def _votes(batches):
    for batch in batches:
        rows = [(host, path, share) for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) for path, share in vote(page or "")]
        hosts, paths, shares = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], ["host", "path", "share"])


def _extracts(batches):
    for batch in batches:
        ids, urls, pages, paths = (c.to_pylist() for c in batch.columns)
        texts = [extract(page or "", path) for page, path in zip(pages, paths, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the container path that wins each host's vote (ties: the smaller path)."""
    tune(pages.sparkSession)
    host, _ = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    rows = needed(pages, url=url_col, html=html_col).select(host.alias("host"), "html")
    votes = rows.mapInArrow(_votes, "host string, path string, share double")
    # whole thousandths, so that the order of rows can't change a sum
    votes = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1000).cast("long")).alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("rank"), "path")).alias("top")).select("host", F.col("top.path").alias("path"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    spark = pages.sparkSession
    tune(spark)
    scratch = Scratch(spark, "html")
    winners = scratch.table(host_paths(pages, url_col, html_col), "winners")
    host, _ = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    rows = needed(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host)
    rows = salted_lookup(rows, winners, "host", F.xxhash64("page_id", "url")).select("page_id", "url", "html", "path")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extracts, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
