"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text in page order. Neighbouring blocks of one container form a node. A fixed linear
classifier over tags, class names (evidence of limited weight that fades inwards, but for names that mean one thing),
what the text says (notices, headings of reader comments or of sources), link density, length and punctuation gives each
node a cost for either label, which is its capacity to the source (content) or the sink (boilerplate). Smoothness edges join neighbours in page
order and nodes of one container; they are stronger within a container and within an article. The minimum cut gives
the labelling of least cost; nodes on the source's side are the text.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one
space. Scripts, styles and other elements that hold no prose never become blocks and split none; formulas are text.

Cases: null or empty html: empty text. Unclosed elements end with their parent, a stray end tag is ignored, an
unclosed comment or script reaches to the end. Pages of any length take time near their length. Rows pass through as
they come, so ties, repeated rows and other columns need nothing special; an empty table stays empty.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_MARKUP = re.compile(r"(<!--)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)")
#: The rest of a tag without angles in its values; it looks no further than the next angle.
_PLAIN = re.compile(r"""(?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+>""")
_STEP = re.compile(r"""[^<>"']*+""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?![\w-])""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    ("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
     "math semantics maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
     "mtable mtd mtext mtr munder munderover").split()
)
#: Their content is no markup and reaches to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Their content is markup that is not shown. It ends with them or their parent; without any end tag they hold nothing.
HIDDEN = frozenset("template svg object video audio canvas select noscript annotation annotation-xml".split())
#: What may stand in a select, and what ends a drawing; an article ends any of them but a template or noscript.
IN_SELECT = frozenset("option optgroup hr button".split())
ENDS_SVG = frozenset("article aside blockquote body center dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button head".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main body td".split())
BOILER_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar
    menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus replies reply respond share sharing social related
    recommended recommendations subscribe subscription newsletter signup login popup modal overlay widget toolbar pagination pager skip copyright disclaimer
    warning alert""".split()
)
#: Of these, names that mean one thing, and words that say so of cookies.
SURE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored disqus comments gdpr newsletter breadcrumb breadcrumbs pagination pager navbar".split())
COOKIES, COOKIE_WORDS = frozenset({"cookie", "cookies"}), frozenset("consent notice banner popup policy overlay bar warning law".split())
CONTENT_NAMES = frozenset("article post entry story content main body text".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

#: Classifier weights, for content above zero. Fixed by hand on what the features mean.
HINT_BOILER, HINT_NAME, HINT_MIXED, HINT_ARTICLE, PER_LENGTH, LINKS, SENTENCE, HEADING, BIAS = -40.0, -6.0, -2.0, 4.0, 1.5, -6.0, 1.0, 1.0, -1.0
HINT_SURE, HINT_NOTICE, HINT_SOURCES = -10.0, -7.0, 6.0
#: A container passes this part of the weight of names on to those inside it.
NAME_DECAY = 0.5
#: Flags of elements: a form or names that an article clears, tags and roles that main clears, not shown.
SHOWN, FORM, BOILER, UNSEEN = range(4)
#: The rest of such a name says what the page has or lacks, not what the element is.
ABOUT_PAGE = frozenset("no not has have with without".split())
#: Smoothness between neighbours: in one container, in one article, elsewhere.
SMOOTH_CONTAINER, SMOOTH_ARTICLE, SMOOTH_PAGE = 1.0, 0.7, 0.2


#: Short blocks that say what a page always says. Inside an article they are the article's own words.
_NOTICE = re.compile(
    r"^(?:©|\(c\)|copyright\b)[^.]{0,20}\b[12][0-9]{3}\b|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b"
    r"|\b(?:we|this (?:web)?site|this page|our partners|wir|nous|utilizamos|usamos)\b.{0,60}\bcookies?\b",
    re.I | re.S,
)
NOTICE_LENGTH = 300
#: Headings of what readers wrote: with a number anywhere, alone where the container is not the article itself.
_COUNTED = re.compile(
    r"(?:(?:[0-9][0-9.,]*|one|no) (?:comments?|repl(?:y|ies)|responses?|thoughts? on|kommentare?|antwort(?:en)?|commentaires?|réponses?|comentarios?|respuestas?)\b.{0,120}"
    r"|(?:comments|replies|responses|kommentare|antworten|commentaires|réponses|comentarios|respuestas) ?[(:]? ?[0-9]+\)?|(?:leave|post|add|write) a (?:reply|comment).{0,40})",
    re.I | re.S,
)
_READERS = re.compile(r"(?:reader )?(?:comments|replies|responses|discussion|kommentare|commentaires|comentarios):?", re.I)
_SOURCES = re.compile(r"(?:sources?|references|bibliography|further reading|footnotes|notes|quellen|literatur|références|bibliographie|fuentes|referencias|bibliografía):?", re.I)


class Tags:
    """Where the tags of a page end. No stretch is read again from tag to tag in search of an end outside of quotes."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        self.endless: set[int] = set()  # places outside of quotes from where no end is reached

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Start and end of the next piece of markup, "/" for an end tag, its name and what follows; start is -1 after the last."""
        page = self.page
        m = _MARKUP.search(page, at, self.last + 1) if at <= self.last else None
        if not m or m[1]:
            start = m.start() if m else page.find("<!--", max(at, self.last + 1))
            end = page.find("-->", start + 4) if start >= 0 else 0
            return start, end + 3 if end >= 0 else len(page), "", "", ""
        if not m[3]:
            return m.start(), m.end(), "", "", ""
        plain = _PLAIN.match(page, m.end())
        end = plain.end() if plain else self.end(m.end())
        return m.start(), end, m[2], m[3].lower(), page[m.end() : end - 1]

    def end(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``: the first ">" outside of quotes, if there is none the first of all."""
        page, seen, here = self.page, [], at
        while (here := _STEP.match(page, here).end()) < len(page) and here not in self.endless:
            sign = page[here]
            if sign == ">":
                return here + 1
            seen.append(here)
            if sign != "<" and (here := page.find(sign, here + 1)) < 0:
                break
            here += 1
        self.endless.update(seen)
        return page.index(">", at) + 1


class Node:
    """Neighbouring blocks of one container."""

    __slots__ = ("article", "boiler", "chars", "container", "heading", "linked", "names", "notice", "sentences", "sources", "texts")

    def __init__(self, container: int, boiler: bool, article: bool, heading: bool, names: float, notice: bool, sources: bool) -> None:
        self.container, self.boiler, self.article, self.heading, self.names = container, boiler, article, heading, names
        self.notice, self.sources = notice, sources
        self.texts: list[str] = []
        self.chars = self.linked = self.sentences = 0

    def score(self) -> float:
        if self.boiler:
            return HINT_BOILER
        mean = self.chars / len(self.texts)
        return (
            BIAS + HINT_ARTICLE * self.article + PER_LENGTH * min(2.0, mean / 60) + LINKS * self.linked / max(1, self.chars)
            + SENTENCE * (self.sentences > 0) + HEADING * self.heading + self.names + HINT_NOTICE * self.notice + HINT_SOURCES * self.sources
        )


def name_weight(value: str) -> float:
    """What the names of a class or id say: below zero for boilerplate."""
    least = 0.0
    for word in value.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(word)]
        parts = set(parts[: next((i for i, p in enumerate(parts) if p in ABOUT_PAGE), len(parts))])
        found = parts & BOILER_NAMES
        if "cookies" in found and not parts & COOKIE_WORDS:  # what the page may be about
            found -= {"cookies"}
        if found and not (found <= {"header", "alert", "notice"} and parts & CONTENT_NAMES):
            sure = found & SURE_NAMES or found & COOKIES and parts & COOKIE_WORDS
            least = min(least, HINT_MIXED if parts & CONTENT_NAMES else HINT_SURE if sure else HINT_NAME)
    return least


def hints(tag: str, attributes: str, in_article: bool) -> tuple[int, float]:
    """The flag of an element and the weight of its names."""
    flag, names = SHOWN, 0.0
    if tag in BOILER_TAGS or tag == "header" and not in_article:
        flag = FORM if tag == "form" else BOILER
    if not attributes or attributes.isspace():
        return flag, names
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return UNSEEN, names
        if name == "role" and value.lower() in BOILER_ROLES:
            flag = max(flag, FORM if value.lower() == "form" else BOILER)
        if name in ("class", "id") and tag not in ("html", "body"):
            names = min(names, name_weight(value))
    return flag, names


def blocks(page: str) -> list[Node]:
    """The nodes of a page in order."""
    out: list[Node] = []
    # (tag, flag, article, heading, container, weight of names)
    stack: list[tuple[str, int, bool, bool, int, float]] = [("", SHOWN, False, False, 0, 0.0)]
    open_at: dict[str, list[int]] = {}  # places of each tag in the stack
    scopes: list[int] = []
    holders = [0]  # places of what is no heading
    muted = 0  # the depth of the outermost hidden element
    last_ends: dict[str, int] = {}
    made, linked, in_link, at = 0, 0, 0, 0
    sources = -1  # the place of what holds a heading of sources, until the next heading
    buffer: list[str] = []

    def put(entry: tuple[str, int, bool, bool, int, float]) -> None:
        open_at.setdefault(entry[0], []).append(len(stack))
        if entry[0] in SCOPES:
            scopes.append(len(stack))
        if entry[0] not in HEADINGS:
            holders.append(len(stack))
        stack.append(entry)

    def cut(depth: int) -> None:
        nonlocal sources
        while len(stack) > depth:
            tag = stack.pop()[0]
            open_at[tag].pop()
            if tag in SCOPES:
                scopes.pop()
            if tag not in HEADINGS:
                holders.pop()
        if sources >= len(stack):
            sources = -1

    def place(tag: str) -> int:
        """The innermost place of an open element, 0 if there is none."""
        return open_at[tag][-1] if open_at.get(tag) else 0

    def heading_says(text: str) -> None:
        """A heading of reader comments makes the rest of what holds it boilerplate; one of sources keeps their links."""
        nonlocal sources
        holder = holders[-1]
        tag, flag, article, *_ = stack[holder]
        if holder and flag < BOILER and len(text) < 160 and (_COUNTED.fullmatch(text) or tag not in ("article", "main", "body", "html") and _READERS.fullmatch(text)):
            stack[holder:] = [(t, max(f, BOILER), *rest) for t, f, *rest in stack[holder:]]
        sources = holder if article and _SOURCES.fullmatch(text) else -1

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                if stack[-1][3]:
                    heading_says(text)
                _, flag, article, heading, container, names = stack[-1]
                notice = not article and len(text) <= NOTICE_LENGTH and _NOTICE.search(text) is not None
                kind = (container, flag > SHOWN, article, heading, names, notice, sources >= 0)
                if not out or (out[-1].container, out[-1].boiler, out[-1].heading, out[-1].names, out[-1].notice, out[-1].sources) != (*kind[:2], *kind[3:]):
                    out.append(Node(*kind))
                node = out[-1]
                node.texts.append(text)
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.sentences += text[-1] in ".!?…\"'”»:" or len(text) > 200
            buffer.clear()
        linked = 0

    def ends_after(tag: str, at: int) -> bool:
        if tag not in last_ends:
            last_ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}[\s/>]", page, re.I)), default=-1)
        return last_ends[tag] >= at

    tags = Tags(page)
    while True:
        start, end, closing, tag, attributes = tags.next(at)
        piece = page[at : start if start >= 0 else len(page)]
        if piece and not muted:
            buffer.append(piece)
            if in_link:
                linked += len(piece.strip())
        if start < 0:
            break
        at = end
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if muted and closing:
            if tag == "math" and stack[muted][0].startswith("annotation"):
                cut(muted)
                muted = 0
            if depth := place(tag):
                if depth < muted:
                    flush()
                cut(depth)
                muted = muted if depth > muted else 0
            continue
        if muted:
            around = stack[muted][0]
            if tag in ("article", "main") and around not in ("template", "noscript") or around == "svg" and tag in ENDS_SVG and stack[-1][0] != "foreignobject":
                cut(muted)
                muted = 0
            elif around == "select" and tag not in IN_SELECT and tag not in INLINE and tag not in VOID and tag not in HIDDEN:
                cut(muted)
                muted = 0
            elif tag in INLINE or tag in VOID or attributes.endswith("/"):
                continue
            else:
                put((tag, *stack[-1][1:]))
                continue
        if tag in HIDDEN:
            if not closing and not attributes.endswith("/") and ends_after(tag, at):
                muted = len(stack)
                put((tag, *stack[-1][1:]))
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            continue
        flush()
        if closing:
            if depth := place(tag):
                cut(depth)
                in_link = 0
            continue
        if tag in VOID:
            continue
        if stack[-1][0] == "p":  # any block ends a paragraph
            cut(len(stack) - 1)
        if tag in CLOSES:
            near = [depth for t in CLOSES[tag] if (depth := place(t)) and depth >= (scopes[-1] if scopes else 0)]
            if near:
                cut(max(near))
        _, flag, article, heading, container, names = stack[-1]
        own, said = hints(tag, attributes, article)
        if tag in ("article", "main"):
            if flag <= (FORM if tag == "article" else BOILER):
                flag = SHOWN
            comment = said < 0 and names <= HINT_NAME  # names in its own and around it: a comment, not the article
            names, said = (names, said) if comment else (0.0, 0.0)
            article = article or not comment
        flag = max(flag, own)
        heading = heading or tag in HEADINGS
        if tag not in HEADINGS and tag not in ("p", "blockquote", "pre", "br"):
            made += 1
            container = made
            names *= NAME_DECAY if names > HINT_SURE else 1.0
        put((tag, flag, article, heading, container, max(HINT_SURE if min(names, said) <= HINT_SURE else HINT_NAME, names + said)))
        in_link = 0
    flush()
    return out


def min_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the source for each node, by augmenting along shortest paths level by level."""
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        left.append(there)
        at[b].append(len(to))
        to.append(a)
        left.append(back)

    for i in range(n):
        through = min(content[i], boiler[i])
        if content[i] > through:
            join(source, i, content[i] - through, 0.0)
        if boiler[i] > through:
            join(i, sink, boiler[i] - through, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                path, a = [], source
                continue
            while following[a] < len(at[a]):
                e = at[a][following[a]]
                if left[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            if following[a] < len(at[a]):
                path.append(at[a][following[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                following[a] += 1
            else:
                break


def labelled(nodes: list[Node]) -> list[bool]:
    scores = [x.score() for x in nodes]
    edges = []
    last: dict[int, int] = {}
    for i, x in enumerate(nodes):
        if i:
            y = nodes[i - 1]
            same = SMOOTH_CONTAINER if x.container == y.container else SMOOTH_ARTICLE if x.article and y.article else SMOOTH_PAGE
            edges.append((i - 1, i, same))
        if (before := last.get(x.container, i - 1)) < i - 1:
            edges.append((before, i, SMOOTH_CONTAINER))
        last[x.container] = i
    return min_cut([max(0.0, s) for s in scores], [max(0.0, -s) for s in scores], edges)


def main_text(page: str | None) -> str:
    nodes = blocks(page or "")
    return " ".join(t for node, content in zip(nodes, labelled(nodes)) if content for t in node.texts) if nodes else ""


def extract_text(df: DataFrame, *, html: str = "html") -> DataFrame:
    """``df`` with the main text of ``html`` in a column text in place of ``html``."""
    kept = [c for c in df.columns if c not in (html, "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], [*kept, "text"])

    return df.select(*kept, html).mapInArrow(run, schema)
