"""Main text of web pages by consensus paths of a host.

Each page's containers are scored by the running text that they hold: one whose running text lies in
several parts (children, or a child and its own) counts with all of it, one that merely wraps another with three
quarters of that. A container's path, its tags and classes from the root with numbers generalised, is the page's
vote for as much as its containers scored; Spark adds up all votes of each host, and every page is extracted again from the containers that
have the host's winning path. A page that has none of them keeps its own best container. A path is
kept as a 64-bit hash of its parent's and its own label, so that time and memory follow the length of
a page and not the depth of its elements.

Defined cases: a null or empty page gives an empty text; a url without a host votes with all
others like it; broken markup is read as browsers would, roughly: unknown ends are ignored and open
elements closed by their parents; a part without RUNNING characters outside of links is not running text
by itself, and stays where a container around it wins; of a header inside an article its headings stay, as do formulas, the text
inside an object, and labels in running text; ties go to the longer path, then to the greater hash; equal rows get equal
texts; the output is named text, with underscores behind it where pages has such a column.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import bound_batches, free_name, materialize, per_batch, per_batches

#: Hosts whose winning paths may be broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Characters of a container's own text, outside of links, that make it running text.
RUNNING = 40

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Names of elements by what they do to the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg select annotation annotation-xml".split())
_DROPPED = frozenset("nav header footer aside form button menu dialog head label fieldset".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "br", "html", "body"}
_CONTAINER = frozenset("article blockquote body center div main section td details".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_KEPT = frozenset("html body article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How an element is left out: wholly, or but for its headings (the header of an article).
_WHOLLY, _BUT_HEADINGS = 2, 1
# Parts of class names and ids of what is not the article.
_SIDE = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices alert promo promoted sponsor sponsored comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar skip".split())
# Parts that say nothing of what an element is; a name made of these and the former alone is not the article's.
_PLAIN = frozenset("area bar block body box col column container content div group holder inner item items left line links list main outer panel right row section text title top bottom unit wrap wrapper".split())
# Elements of running text, which inside an article are kept whatever their names say.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th b i em strong span a code q cite figure figcaption".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NUMBERS = re.compile(r"[0-9]+")


class _Node:
    __slots__ = ("name", "path", "depth", "own", "plain", "parts", "score", "dropped", "parent", "box", "links", "inside", "article", "p", "at")

    def __init__(self, name: str, path: int, dropped: int, parent: _Node | None, at: int) -> None:
        self.name, self.path, self.dropped, self.parent, self.at = name, path, dropped, parent, at
        #: Worth and plain characters of the text right in a container, its parts with running text, and its score.
        self.own, self.plain, self.parts, self.score, self.links = 0.0, 0.0, 0, 0.0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.inside = False
        self.article = name in ("article", "main") or parent is not None and parent.article
        #: The container around the text of this element, and where an open paragraph stands in the stack.
        self.box = self if name in _CONTAINER and not dropped else parent.box if parent else None
        self.p = at if name == "p" else -1 if parent is None or name in _CONTAINER or name in ("td", "th") else parent.p


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _left_out(name: str, attributes: dict[str, str], above: _Node) -> int:
    """How an element is left out by what it is and is called, 0 if it is not."""
    if above.dropped and not (above.dropped == _BUT_HEADINGS and name in _HEADINGS):
        if above.dropped == _WHOLLY:
            return _WHOLLY
        return _left_out_alone(name, attributes, above) or _BUT_HEADINGS
    return _left_out_alone(name, attributes, above)


def _left_out_alone(name: str, attributes: dict[str, str], above: _Node) -> int:
    if name in _KEPT:
        return 0
    if attributes.get("aria-hidden") == "true" or attributes.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert"):
        return _WHOLLY
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return _WHOLLY
    if name == "header" and above.article:
        return _BUT_HEADINGS
    if name in _DROPPED and not (name == "label" and (above.p >= 0 or above.name in _TEXT)):
        return _WHOLLY
    if above.article and name in _TEXT:
        return 0
    for key in ("class", "id"):
        for token in attributes.get(key, "").split():
            parts = {x.lower() for x in _PARTS.findall(token)}
            if parts & _SIDE and parts <= _SIDE | _PLAIN:
                return _BUT_HEADINGS if above.article and parts & _SIDE == {"header"} else _WHOLLY
    return 0


def _path(above: int, label: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), seed=above)


def read_page(html: str, wanted: int | None = None) -> tuple[list[tuple[str, _Node]], list[_Node]]:
    """The blocks of kept text with the element each is in, in page order, and all containers; elements in a container of the wanted path are marked."""
    blocks: list[tuple[str, _Node]] = []
    containers: list[_Node] = []
    root = _Node("", 0, 0, None, 0)
    stack = [root]
    opened: dict[str, int] = {}
    buffer: list[str] = []
    in_link = linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text and not stack[-1].dropped:
                blocks.append((text, stack[-1]))
                stack[-1].links += min(linked, len(text))
            buffer.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        for node in stack[k:]:
            in_link -= node.name == "a"
            opened[node.name] -= 1
        if any(node.name in _BLOCK for node in stack[k:]):
            flush()
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            piece = html[at:mark]
            if not stack[-1].dropped:
                buffer.append(piece)
                if in_link:
                    linked += len(piece)
        if mark == n:
            break
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        if html[mark + 1 : mark + 2] in ("!", "?"):
            end = html.find(">", mark)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(html, mark)
        if not tag:
            if html[mark + 1 : mark + 2].isalpha() or html[mark + 1 : mark + 2] == "/":
                end = html.find(">", mark)
                at = n if end < 0 else end + 1
            else:
                buffer.append("<")
                at = mark + 1
            continue
        at = tag.end()
        close, name, raw = tag[1], tag[2].lower(), tag[3]
        if close:
            for k in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                if stack[k].name == name:
                    pop_to(k)
                    break
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                buffer.append(" ")
                if name == "hr":
                    flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if name not in ("svg", "select", "iframe", "annotation", "annotation-xml") or end:
                at = end.end() if end else n
            continue
        if name in _CLOSES_P and stack[-1].p >= 0:
            pop_to(stack[-1].p)
        if any(opened.get(x) for x in _SAME.get(name, ())):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in _SAME[name]:
                    pop_to(k)
                    break
                if stack[k].name in ("ul", "ol", "dl", "table", "select"):
                    break
        if name in _BLOCK:
            flush()
        attributes = _attributes(raw)
        above = stack[-1]
        label = name
        if attributes.get("class"):
            label += "." + ".".join(sorted(_NUMBERS.sub("#", c) for c in set(attributes["class"].split())))
        node = _Node(name, _path(above.path, label), _left_out(name, attributes, above), above, len(stack))
        node.inside = above.inside or wanted is not None and node.path == wanted and name in _CONTAINER and not node.dropped
        if not raw.rstrip().endswith("/") or name in _BLOCK:
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
            in_link += name == "a"
        if name in _CONTAINER and not node.dropped:
            containers.append(node)
    flush()
    return blocks, containers


def _score(blocks: list[tuple[str, _Node]], containers: list[_Node]) -> None:
    """Containers by their running text. All of it counts where it lies in several parts, three quarters where one child holds it; without any, short texts count, half for the next container out."""
    chars: dict[int, int] = {}
    for text, node in blocks:
        chars[id(node)] = chars.get(id(node), 0) + len(text)
    for text, node in blocks:
        linked = node.links / (chars[id(node)] + 1)
        if node.box is not None:
            node.box.own += (1 + text.count(",") * 0.2 + min(len(text) / 100, 3) if len(text) >= 20 else 0.1) * (1 - linked)
            node.box.plain += len(text) * (1 - linked)
    whole = {id(c): c.own for c in containers}
    inner = dict.fromkeys(whole, 0.0)
    for c in reversed(containers):  # children come before what they are in
        c.parts += c.plain >= RUNNING
        c.score = whole[id(c)] if c.parts > 1 else c.own + inner[id(c)]
        outer = c.parent.box if c.parent else None
        if outer is not None:
            whole[id(outer)] += whole[id(c)]
            outer.parts += c.parts > 0
            inner[id(outer)] += c.score * (0.75 if c.parts else 0.5)


def votes_of(html: str | None) -> list[dict]:
    """The containers' paths with their shares of the page's scores."""
    blocks, containers = read_page(html or "")
    _score(blocks, containers)
    by_path: dict[int, list] = {}
    for c in containers:
        if c.score > 0:
            by_path.setdefault(c.path, [0.0, c.depth])[0] += c.score
    total = sum(score for score, _ in by_path.values())
    return [{"path": p - 2**63, "depth": depth, "score": score / total} for p, (score, depth) in by_path.items()]


def text_at(html: str | None, path: int | None) -> str:
    """The text of the containers at a path, or of the page's best one where there are none."""
    blocks, containers = read_page(html or "", None if path is None else path + 2**63)
    kept = [text for text, node in blocks if node.inside]
    if not kept and blocks:
        _score(blocks, containers)
        best = max(containers, key=lambda c: c.score, default=None)
        if best is None:
            return " ".join(text for text, _ in blocks)
        known = {id(best): True}

        def inside(node: _Node | None) -> bool:
            way = []
            while node is not None and id(node) not in known:
                way.append(id(node))
                node = node.parent
            answer = node is not None and known[id(node)]
            known.update(dict.fromkeys(way, answer))
            return answer

        kept = [text for text, node in blocks if inside(node)]
    return " ".join(kept)


_VOTES = T.ArrayType(T.StructType([T.StructField("path", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_VOTES_ARROW = pa.list_(pa.struct([("path", pa.int64()), ("depth", pa.int32()), ("score", pa.float64())]))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: host, path (the winner of its pages' votes)."""
    bound_batches(pages.sparkSession)

    def make():
        def work(xs: pa.Array) -> pa.Array:
            return pa.array([votes_of(x) for x in xs.to_pylist()], _VOTES_ARROW)

        return work

    votes = pages.select(host_of(F.col(url)).alias("host"), F.explode(per_batch(make, _VOTES)(F.col(html))).alias("v")).select("host", "v.*")
    sums = votes.groupBy("host", "path").agg(F.sum(F.round("score", 6).cast("decimal(20,6)")).alias("score"), F.max("depth").alias("depth"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("score", "depth", "path")).alias("path"))


def extract_text(pages: DataFrame, *, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text. All rows and columns stay."""
    paths = materialize(host_paths(pages, url=url, html=html), "host_paths")
    host, path = free_name(pages, "host"), free_name(pages, "path")
    paths = paths.select(F.col("host").alias(host), F.col("path").alias(path))
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    joined = pages.withColumn(host, host_of(F.col(url))).join(paths, host, "left")

    def make():
        def work(xs: pa.Array, ps: pa.Array) -> pa.Array:
            return pa.array([text_at(x, p) for x, p in zip(xs.to_pylist(), ps.to_pylist(), strict=True)], pa.string())

        return work

    out = free_name(pages, out)
    return joined.withColumn(out, per_batches(make, T.StringType())(F.col(html), F.col(path))).drop(host, path)
