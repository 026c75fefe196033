"""Main text of web pages by paths that the pages of a host agree on.

Every page is read into a tree of open elements by a scanner of tags, character data, comments and raw
text. Each container is scored: the text of the blocks right under it, less what stands in links, with
half of it passed on to its parent and a quarter to the parent of that. The best one stands for the article it is
in, or for the nearest ancestor that adds little but the heading it lacks. A container is named by its
generalised path, the tags from the root down with their classes, digits dropped. Pages vote: each gives
the weight of its best container to the path found so, and Spark adds the votes up per host. Then
every page is read again and the text of the containers at the host's winning path is taken; a page
without that path gives its own best container.

What stands in menus, headers and footers outside articles, sidebars, notices, adverts, forms, comments
of readers, scripts and styles is no text, by tag or by the words of a class, id or role. Inside an article, and
for words that name subjects too ("legal", "share"), a whole name must be that of such a box: "share-buttons" is,
"share-prices" is not. Lists of links are menus outside articles only. Character
references are decoded, white space inside a block becomes one space, and blocks are joined by one space.

Edge cases: a null or empty page, or one without any text, gives the empty text. A null url, or one
without a host, counts as the empty host. Of paths with equal votes the last by name wins. Unclosed,
stray and cut-off tags are closed where HTML would close them or at the end.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.llm.columns import sheltered
from tomeworks.operators.settle import settle

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
#: Elements whose text is never part of an article.
OUTSIDE = frozenset("head nav aside form footer button select option dialog menu svg math canvas audio video object figure-nav label fieldset".split()) | RAW
CONTAINERS = frozenset("html body div section article main td center".split())
BLOCKS = frozenset(
    "address blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main article ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes if it is open, and up to where.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS | {"form", "nav", "aside", "footer", "fieldset"}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Words of a class, id or role that say what an element is for.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors nav navbar navigation navi menu menus breadcrumb breadcrumbs "
    "pagination pager sidebar sidebars aside side rail widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies "
    "disqus discussion search searchbox complementary contentinfo skip hidden copyright legal tags".split())
#: Of those, words that name a subject as well: they count only where a whole class or id is made of such words.
SUBJECTS = frozenset(
    "ad ads alert banner comment comments discussion foot head hidden legal menu menus modal notice notices overlay pager popup promotion rail related reply "
    "replies respond search share sharing side skip social subscription tags widget widgets".split())
#: What boxes inside an article are for: advertising, readers' comments, sharing and the like.
BOXES = frozenset(
    "ad ads advert adverts advertisement advertising aside breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr hidden login menu modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination popup promo related recommended recommendations replies reply respond share sharing sidebar signup social "
    "sponsor sponsored sponsors subscribe subscription tags widget widgets".split())
#: What the name of such a box may hold besides.
PARTS = frozenset(
    "area articles bar block bottom box button buttons container content count first form global group holder icons inner item items js large left link links list main media "
    "mobile outer page panel placeholder post posts primary right row second secondary section site slot small stories sub text thread title top unit wrap wrapper".split())
#: An ancestor is taken for its heading if it adds at most this share of the text.
HEADING_SHARE = 0.5
HEADINGS = frozenset("h1 h2 h3".split())
#: Elements that hold menu entries when their text is all links.
LISTED = frozenset("li ul ol div td section".split())
#: Containers nested deeper share their parent's path.
MAX_DEPTH = 100
_WORD = re.compile(r"[a-z]+")


def _attributes(text: str) -> tuple[str, list[frozenset[str]], bool]:
    """Classes (digits dropped), the words of every class, id and role, and whether the element is hidden."""
    if not text or text.isspace():
        return "", [], False
    classes, names, hidden = "", [], False
    for m in _NAMES.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value.lower() == "true"
            continue
        names += [frozenset(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", own).lower())) for own in value.split()]
        if name == "class":
            classes = ".".join(sorted({re.sub(r"[0-9]+", "", c) for c in value.lower().split()} - {""}))
    return classes, names, hidden


class Element:
    __slots__ = ("tag", "path", "depth", "parent", "outside", "container", "score", "block", "article", "text", "heading")

    def __init__(self, tag: str, path: str, parent: Element | None, outside: bool, container: Element | None) -> None:
        self.tag, self.path, self.parent, self.outside, self.container = tag, path, parent, outside, container
        self.score, self.block, self.depth = 0.0, False, 0
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.text, self.heading = 0, False  # of a container: characters under it, and whether a heading is


def _is_outside(tag: str, names: list[frozenset[str]], hidden: bool, parent: Element) -> bool:
    if parent.outside or hidden or tag in OUTSIDE:
        return True
    if tag == "header":
        return not parent.article
    if tag in ("html", "body", "main", "article"):
        return False
    for words in names:
        found = words & (BOXES if parent.article else NOISE)
        # inside an article, and with words that may name a subject, the whole name must be that of a box
        if found and (not parent.article and found - SUBJECTS or words <= (BOXES | PARTS if parent.article else NOISE | PARTS)):
            return True
    return False


#: Elements that a start tag may close or that stop it from closing others.
_STRUCTURE = CONTAINERS | frozenset("p li dt dd tr td th option ul ol dl table".split())
#: Ends of other elements do not reach beyond these.
_BARRIERS = frozenset("td th table article main".split())
_THROUGH = frozenset("table tr body html article main".split())


def read(html: str) -> tuple[list[tuple[Element, str, bool]], list[Element]]:
    """The page's blocks, each with the container it stands in and whether it is an entry of a list of
    links, and all containers. A tag costs the same however many elements are open."""
    root = Element("html", "html", None, False, None)
    root.container, root.block = root, True
    stack, containers = [root], [root]
    blocks: list[tuple[Element, str, bool]] = []
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    structure: list[int] = []
    barriers: list[int] = []
    parts: list[str] = []
    linked = 0
    links = 0  # open ones

    def end_block() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            blocks.append((top.container, text, top.tag in LISTED and not top.article and 10 * linked >= 9 * len(text)))
            own = len(text) - linked
            top.container.text += len(text)
            if top.tag in HEADINGS:
                top.container.heading = True
            if own > 0:
                step, share = top.container, 1.0
                while step is not None and share >= 0.25:
                    step.score += own * share
                    step, share = step.parent.container if step.parent is not None else None, share / 2
        parts, linked = [], 0

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            if stack[-1].block:
                end_block()
            done = stack.pop()
            if done.tag == "a":
                links -= 1
            open_at[done.tag].pop()
            for places in (structure, barriers):
                if places and places[-1] == len(stack):
                    places.pop()

    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        data = html[at : m.start() if m else n]
        if data and not stack[-1].outside:
            text = unescape(data) if "&" in data else data
            parts.append(text)
            if links:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_at.get(tag):
                place = open_at[tag][-1]
                # a cell, a table or an article is not ended from inside by the end of what is around it
                if tag in _THROUGH or not barriers or barriers[-1] <= place:
                    close(place)
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
            if tag == "br":
                continue
        if tag in VOID or tag == "html" or tag == "body" and open_at.get(tag):
            continue
        shut, scope = CLOSES.get(tag, frozenset()), SCOPES.get(tag, frozenset())
        if any(open_at.get(t) for t in shut) or tag in CLOSES_P and open_at.get("p"):
            k = len(structure)
            while k:
                k = min(k, len(structure)) - 1  # closing shortens it
                if k < 0:
                    break
                i = structure[k]
                own = stack[i].tag
                if own in scope or own in CONTAINERS and tag not in ("tr", "td", "th") or own == "table":
                    break
                if own in shut or tag in CLOSES_P and own == "p":
                    close(i)
        parent = stack[-1]
        classes, names, hidden = _attributes(m[3])
        outside = _is_outside(tag, names, hidden, parent)
        block = tag in BLOCKS or outside and not parent.outside
        if block and not parent.outside:
            end_block()
        path = parent.path
        if tag in CONTAINERS and not outside and parent.container.depth < MAX_DEPTH:
            path = f"{parent.path}>{tag}.{classes}" if classes else f"{parent.path}>{tag}"
        element = Element(tag, path, parent, outside, parent.container)
        element.block = block and not parent.outside
        if tag in CONTAINERS and not outside:
            element.container, element.depth = element, parent.container.depth + 1
            containers.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag == "a":
            links += 1
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _STRUCTURE:
            structure.append(len(stack))
        if tag in _BARRIERS:
            barriers.append(len(stack))
        stack.append(element)
    close(1)
    end_block()
    return blocks, containers


def _around(container: Element) -> Element | None:
    return container.parent.container if container.parent is not None else None


def whole_article(containers: list[Element]) -> Element:
    """The best container, or what is around it and belongs to the same text: the article it stands in,
    else the nearest ancestor with the heading that it lacks."""
    chosen = best(containers)
    step: Element | None = chosen
    while step is not None and step.article:
        if step.tag == "article":
            return step
        step = _around(step)
    step = chosen
    while step is not None and step.article:
        if step.tag == "main":
            return step
        step = _around(step)
    # containers come after those around them, so that this adds up from the inside
    text, heading = {id(e): e.text for e in containers}, {id(e): e.heading for e in containers}
    for e in reversed(containers):
        around = _around(e)
        if around is not None:
            text[id(around)] += text[id(e)]
            heading[id(around)] |= heading[id(e)]
    step = chosen
    while not heading[id(chosen)] and (step := _around(step)) is not None:
        if text[id(step)] > (1 + HEADING_SHARE) * text[id(chosen)]:
            break
        if step.heading:
            return step
    return chosen


def best(containers: list[Element]) -> Element:
    """The container of the highest score, the innermost and first of equal ones. Articles come before
    what is around them."""
    return max(containers, key=lambda e: (e.score * (1.5 if e.tag in ("article", "main") else 1.0), e.path.count(">")))


def candidate(html: str | None) -> tuple[str, float]:
    """The path that a page votes for and the weight of its vote."""
    if not html:
        return "", 0.0
    _, containers = read(html)
    weight = best(containers).score
    return (whole_article(containers).path, weight) if weight > 0 else ("", 0.0)


def extract(html: str | None, path: str | None) -> str:
    """The text of the containers at ``path``, or of the page's best one if there is none."""
    if not html:
        return ""
    blocks, containers = read(html)
    chosen = {id(e) for e in containers if e.path == path}
    if not chosen:
        chosen = {id(whole_article(containers))}
    texts = []
    for container, text, link in blocks:
        step = container
        while step is not None and id(step) not in chosen:
            step = step.parent.container if step.parent is not None else None
        if step is not None and not link:
            texts.append(text)
    return " ".join(texts)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` without ``html`` and with ``text`` and ``n_chars``; columns of these names are replaced."""

    def vote(column: pa.Array) -> pa.Array:
        made = [candidate(h.as_py()) for h in column]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([w for _, w in made], pa.float64())], names=["path", "weight"])

    def take(column: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([extract(h.as_py(), p) for h, p in zip(column, paths.to_pylist())], pa.string())

    vote.__annotations__ = {"column": pa.Array, "return": pa.Array}
    take.__annotations__ = {"column": pa.Array, "paths": pa.Array, "return": pa.Array}
    df, (html, url), restore = sheltered(df, html, url, replaced=("text", "n_chars"))
    kept = [c for c in df.columns if c != html]
    votes = df.select(host_of(url).alias("_host"), F.arrow_udf(vote, "path string, weight double")(html).alias("_v")).where("_v.weight > 0")
    votes = votes.groupBy("_host", F.col("_v.path").alias("_path")).agg(F.sum(F.round(100 * F.log1p("_v.weight")).cast("bigint")).alias("_votes"))
    winners = settle(votes.groupBy("_host").agg(F.max_by("_path", F.struct("_votes", "_path")).alias("_path")))
    # written, so its size is known: Spark broadcasts it below its threshold and else joins by host, splitting large ones
    joined = df.withColumn("_host", host_of(url)).join(winners, "_host", "left")
    return restore(joined.select(*kept, F.arrow_udf(take, "string")(html, "_path").alias("text")).withColumn("n_chars", F.length("text").cast("bigint")))
