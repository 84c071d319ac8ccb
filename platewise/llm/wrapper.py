"""HTML main text by wrappers: union-free regular expressions inferred for each host.

A page's tags form a token stream with nesting. A wrapper is a union-free expression over such
streams: a label (tag and classes), a text slot that is constant or varies, and a sequence of
children that may each be optional ``?`` or repeated ``+``. :func:`merge` aligns two of them: equal
labels are merged inside, runs of one label become a repeated group, what only one side has becomes
an optional group, and differing texts become a slot. Folding all pages of a host through it gives
the host's wrapper (:func:`show` writes it out).

The wrapper decides what is content (:class:`Fit`). Every page is fitted to its host's wrapper by
the alignment that merged it, and the part is sought that holds most of the text which varies over
the host's pages, links apart, counted over the slots that the page has: so one page's long advert
does not outweigh the host's articles. Inside that part go constant slots and, behind the text,
repeated groups of records (a short slot, then a longer one), which are comments. Names only break
ties: where a host has a single page or nothing varies, or no part holds the most, an ``article``,
``main`` or part with a class word of content is taken if there is one; elements that HTML sets apart (``nav``, ``footer``, ``form``
and the like) and class words of chrome are left out, the words only where the part does not hold
most of the text that varies. ``names=False`` turns all of that off.

Each task folds its own pages by host; the partial wrappers of a host, whose size is that of its
template and not of its pages, are then folded as a stream. A part with over ``MAX_CHILDREN`` children
in sequence becomes one repeated group of its labels, and elements nested deeper than ``MAX_DEPTH`` lie
side by side at that depth, in page order, so wrappers stay small and no text is lost. Pages meet
their wrappers by a plain join on host, which Spark broadcasts only below its own threshold.

Defined results: a null or empty page has an empty text; a page whose URL is null or has no host
belongs to the host ""; of a page without any content (only chrome) the text is empty; truncated
markup is read as far as it goes; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import keep, table
from platewise.llm.url_filter import host_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!?/?[a-zA-Z][^>]*>?|<\?[^>]*>|<![^>]*>|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d{3,}")
_LETTERS = re.compile(r"[a-z]+")

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form button select menu dialog head input".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner banners cookie cookies consent gdpr notice notices alert sidebar aside menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar comment comments commentlist reply replies respond discussion disqus related recommended discuss discussions responses commentaires comentarios kommentare share sharing social promo promotion sponsor "
    "sponsored newsletter subscribe subscription signup popup modal overlay widget widgets toolbar pagination pager login search skip hidden".split()
)
OTHERS = frozenset("comment comments commentlist reply replies respond discuss discussion discussions responses disqus commentaires comentarios kommentare related recommended".split())  # texts that vary and are not the page's
MAIN_WORDS = frozenset("main content article post entry story maincontent articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("p ul ol dl table blockquote pre li dt dd tr td th".split()) | HEADINGS  # hold text, not content
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MEMO = 4096
MAX_DEPTH = 64
MAX_CHILDREN = 48
MOST = 0.5  # of the varying text, that the content holds
MOST_OF_ALL = 0.7  # of all text, where nothing varies

VARIES = "*"


class Node:
    """A piece of a page or of a wrapper.

    ``text`` is None, the digest of a constant text, or VARIES; ``parts`` of a page's node are its
    texts and nodes in page order, and ``fit`` the wrapper's node it meets; ``weight`` counts text
    characters directly inside without links, ``linked`` those of links, ``seen`` pages and ``count``
    elements of pages that were merged.
    """

    __slots__ = ("label", "optional", "repeated", "text", "weight", "linked", "seen", "count", "children", "parts", "fit")

    def __init__(self, label, optional=False, repeated=False, text=None, weight=0, linked=0, children=None, seen=1, count=1):
        self.label, self.optional, self.repeated, self.text = label, optional, repeated, text
        self.weight, self.linked, self.seen, self.count = weight, linked, seen, count
        self.children, self.parts, self.fit = children or [], [], None

    @property
    def tag(self) -> str:
        return self.label.partition(".")[0]

    def pack(self):
        return [self.label, int(self.optional), int(self.repeated), self.text, self.weight, self.linked, [c.pack() for c in self.children], self.seen, self.count]

    @classmethod
    def unpack(cls, x):
        return cls(x[0], bool(x[1]), bool(x[2]), x[3], x[4], x[5], [cls.unpack(c) for c in x[6]], x[7], x[8])


def label_of(tag: str, attrs: str) -> str:
    """Tag and classes (numbers of three digits and more are one), and words of id and role that mean something here."""
    words = []
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if name.lower() == "class":
            words += sorted(_NUMBER.sub("#", w) for w in value.replace(".", "-").split())
        else:
            words += [w for w in _LETTERS.findall(value) if w in CHROME_WORDS or w in MAIN_WORDS]
    return ".".join([tag, *dict.fromkeys(words)])


def tree(page: str | None) -> Node:
    """The page's token stream with nesting; inline tags vanish and ``br`` is white space."""
    root = Node("page")
    stack, open_tags, in_link = [root], Counter(), False

    def push(label: str) -> Node:
        # below MAX_DEPTH elements lie side by side; what is inside chrome stays chrome
        if len(stack) > MAX_DEPTH and stack[-1].tag in CHROME_TAGS:
            label = f"{stack[-1].tag}.{label.partition('.')[2]}"
        node, parent = Node(label), stack[min(len(stack), MAX_DEPTH) - 1]
        parent.children.append(node)
        parent.parts.append(node)
        return node

    def pop() -> None:
        open_tags[tags.pop()] -= 1
        stack.pop()
        if len(stack) > MAX_DEPTH:  # the rest of the element lies behind what was in it
            stack[-1] = push(stack[-1].label)

    tags: list[str] = []
    for m in _TOKEN.finditer(page or ""):
        token = m[0]
        if token[0] != "<" or token == "<":
            stack[-1].parts.append(token)
            if in_link:
                stack[-1].linked += len(token)
            continue
        if m[1] is not None:
            continue
        t = _TAG.match(token)
        if not t:
            continue
        closing, tag = t[1], t[2].lower()
        if tag == "br":
            stack[-1].parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = not closing
        elif closing:
            if open_tags[tag]:
                in_link = False
                while tags[-1] != tag:
                    pop()
                pop()
        else:
            in_link = False
            # a start tag ends what cannot hold it
            if tags and tag in CLOSES_P and tags[-1] == "p":
                pop()
            if tags and tag in SIBLINGS and tags[-1] in SIBLINGS[tag]:
                pop()
            node = push(label_of(tag, t[3]))
            if tag not in VOID and not token.endswith("/>"):
                stack.append(node)
                tags.append(tag)
                open_tags[tag] += 1
    return root


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def _short(children: list[Node], one_page: bool) -> list[Node]:
    """The children; where they are too many, one repeated group of their labels, or else of their tags."""
    for name in (lambda c: c.label, lambda c: c.tag):
        if len(children) <= MAX_CHILDREN:
            break
        groups: dict[str, Node] = {}
        for c in children:
            c.label = name(c)
            if c.label in groups:
                groups[c.label] = merge(groups[c.label], c, one_page)
                groups[c.label].repeated = True
            else:
                groups[c.label] = c
        children = list(groups.values())
    return children


def skeleton(page: Node) -> Node:
    """A page as the wrapper that fits it alone; runs of one label are one repeated group."""
    text = _SPACE.sub(" ", "".join(p for p in page.parts if isinstance(p, str))).strip()
    linked = min(page.linked, len(text))
    out = Node(page.label, text=_digest(text) if text else None, weight=len(text) - linked, linked=linked)
    for child in page.children:
        s = skeleton(child)
        if out.children and out.children[-1].label == s.label:
            out.children[-1] = merge(out.children[-1], s, one_page=True)
            out.children[-1].repeated = True
        else:
            out.children.append(s)
    out.children = _short(out.children, one_page=True)
    return out


def _align(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Longest common subsequence of labels; ends that agree are taken off first."""
    head = 0
    while head < min(len(a), len(b)) and a[head].label == b[head].label:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail].label == b[-1 - tail].label:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].label == y[j].label else max(best[i + 1][j], best[i][j + 1])
    middle, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].label == y[j].label:
            middle.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            middle.append((x[i], None))
            i += 1
        else:
            middle.append((None, y[j]))
            j += 1
    return list(zip(a[:head], b[:head])) + middle + (list(zip(a[-tail:], b[-tail:])) if tail else [])


def merge(a: Node, b: Node, one_page: bool = False) -> Node:
    """The least wrapper here that fits what either fits; the labels are equal.

    Differing texts in a run on one page are a constant of their own: only pages show what varies.
    """
    text = a.text if a.text == b.text else VARIES
    if one_page and text == VARIES:
        text = _digest(f"{a.text} {b.text}")
    out = Node(a.label, a.optional or b.optional, a.repeated or b.repeated, text, a.weight + b.weight, a.linked + b.linked)
    out.seen, out.count = 1 if one_page else a.seen + b.seen, a.count + b.count
    for x, y in _align(a.children, b.children):
        if x and y:
            out.children.append(merge(x, y, one_page))
        else:
            only = Node.unpack((x or y).pack())
            only.optional = True
            last = out.children[-1] if out.children else None
            if last is not None and last.label == only.label:
                out.children[-1] = merge(last, only, one_page)
                out.children[-1].repeated = True
            else:
                out.children.append(only)
    out.children = _short(out.children, one_page)
    return out


def show(node: Node) -> str:
    """The wrapper as an expression: ``#`` is a slot, ``"..."`` a constant text."""
    inner = {None: "", VARIES: "#"}.get(node.text, f'"{node.text}"') + "".join(map(show, node.children))
    s = f"<{node.label}>{inner}</{node.label}>"
    marks = "+" * node.repeated + "?" * node.optional
    return f"({s}){marks}" if marks else s


def _words(label: str) -> set[str]:
    return set(_LETTERS.findall(label.partition(".")[2]))


def _is_chrome(label: str, inside: bool) -> bool:
    tag = label.partition(".")[0]
    return tag in CHROME_TAGS or (tag == "header" and not inside)


def _chrome_words(label: str, inside: bool = False) -> set[str]:
    """Class words of chrome; inside content ``header`` is none, as the tag is none there."""
    if "." not in label or label.partition(".")[0] in ("html", "body"):
        return set()
    return {w for w in _words(label) if w in CHROME_WORDS and not (inside and w == "header")}


def _is_article(label: str) -> bool:
    return label.partition(".")[0] == "article"


def _is_main(label: str) -> bool:
    return label.partition(".")[0] == "main" or ("." in label and not MAIN_WORDS.isdisjoint(_words(label)))


class Host:
    """What a host's wrapper says about its parts."""

    def __init__(self, root: Node, names: bool = True):
        self.root, self.names = root, names
        self.mass: dict[int, int] = {}  # own characters that vary, without links, by part
        for every in (False, True):
            # where nothing varies all texts count
            self.known = root.seen > 1 and not every
            self._weigh(root, False)
            if self.known and any(self.mass.values()):
                break
        self.records: set[int] = set()
        self._find_records(root, 0)
        self.outside: set[int] = set()
        if self.known:
            self._find_outside(root)

    def _weigh(self, fit: Node, shut: bool) -> None:
        if self.names and not shut:
            words = _chrome_words(fit.label)
            shut = _is_chrome(fit.label, False) or bool(words & OTHERS if self.known else words)
        counts = not self.known or fit.text == VARIES or fit.seen == 1
        self.mass[id(fit)] = fit.weight if counts and not shut else 0
        for c in fit.children:
            self._weigh(c, shut)

    def _all(self, fit: Node) -> int:
        return fit.weight + fit.linked + sum(map(self._all, fit.children))

    def _find_outside(self, fit: Node) -> int:
        """Marks constant parts before and behind the run of parts that vary, where that is most of the text; returns what varies."""
        varies = list(map(self._find_outside, fit.children))
        run = [i for i, v in enumerate(varies) if v]
        if run and sum(varies) > MOST * self._all(fit):
            self.outside |= {id(c) for i, c in enumerate(fit.children) if not run[0] <= i <= run[-1] and self.is_constant(c)}
        return self.mass[id(fit)] + sum(varies)

    def _first_slot(self, fit: Node) -> Node | None:
        if fit.text is not None:
            return fit
        return next((s for s in map(self._first_slot, fit.children) if s is not None), None)

    def _longest(self, fit: Node) -> float:
        return max([fit.weight / fit.count, *map(self._longest, fit.children)])

    def _find_records(self, fit: Node, before: int) -> int:
        """Marks repeated records behind other text; returns the text up to the end of the part."""
        before += self.mass[id(fit)]
        if self.known and before and fit.repeated and fit.tag not in BLOCKS and fit.children:
            first = self._first_slot(fit)
            if first is not None and first.tag not in HEADINGS and first is not fit:
                size = (first.weight + first.linked) / first.count
                if 0 < size < 40 and self._longest(fit) > 1.5 * size:
                    self.records.add(id(fit))
                    return before
        for c in fit.children:
            before = self._find_records(c, before)
        return before

    def is_constant(self, fit: Node) -> bool:
        """The same on all pages that have it, more than one, with nothing below it that varies; headings may agree."""
        if fit.seen < 2 or fit.tag in HEADINGS or fit.text == VARIES:
            return False
        return all(map(self.is_constant, fit.children))

    def is_menu(self, fit: Node) -> bool:
        """A constant part whose text is in links for the most part."""
        return self.is_constant(fit) and 2 * self._linked(fit) > self._all(fit)

    def _linked(self, fit: Node) -> int:
        return fit.linked + sum(map(self._linked, fit.children))


class Fit:
    """A page fitted to its host's wrapper: which of its parts are content."""

    def __init__(self, page: Node, host: Host | Node, names: bool = True):
        self.host = host if isinstance(host, Host) else Host(host, names)
        self.page, self.names = page, self.host.names
        self.members: dict[int, list[Node]] = {}
        self.total: dict[int, int] = {}
        self._fit(page, self.host.root)
        self._sum(self.host.root)
        self.open = self._overruled(self.host.root)

    def _fit(self, node: Node, fit: Node) -> None:
        node.fit = fit
        self.members.setdefault(id(fit), []).append(node)
        runs: list[list[Node]] = []
        known = {c.label: c for c in fit.children}
        if len(known) < len(fit.children) or len(node.children) <= MAX_CHILDREN:
            for part in node.children:
                if runs and runs[-1][0].label == part.label:
                    runs[-1].append(part)
                else:
                    runs.append([part])
        if runs and len(runs) <= MAX_CHILDREN:
            # as the wrapper was merged: runs of one label meet one part of it
            rest = iter(runs)
            for x, y in _align(fit.children, [r[0] for r in runs]):
                if y is not None:
                    for part in next(rest):
                        if x is not None:
                            self._fit(part, x)
        left = [c for c in node.children if c.fit is None]
        for part in left:  # groups of labels, and what stands elsewhere on this page
            x = known.get(part.label) or known.get(part.tag)
            if x is not None:
                self._fit(part, x)

    def _sum(self, fit: Node) -> int:
        """Characters that vary in those slots of a part that this page has."""
        if id(fit) not in self.members or id(fit) in self.host.records:
            return 0
        n = self.total[id(fit)] = self.host.mass[id(fit)] + sum(map(self._sum, fit.children))
        return n

    def _mass(self, fit: Node | None) -> int:
        return self.total.get(id(fit), 0)

    def _overruled(self, top: Node) -> set[int]:
        """Parts with class words of chrome that hold most of the text that varies."""
        out, todo, total = set(), [top], self._mass(top)
        while todo and total and self.host.known:
            fit = todo.pop()
            if 2 * self._mass(fit) > total:
                if _chrome_words(fit.label):
                    out.add(id(fit))
                todo.extend(fit.children)
        return out

    def _is_shut(self, node: Node, inside: bool, loose: bool, article: bool = False) -> bool:
        fit = node.fit
        if fit is not None and id(fit) in self.host.records:
            return True
        if inside and fit is not None and self.host.known and (id(fit) in self.host.outside and not (article and self.names) or self.host.is_menu(fit)):
            return True
        if not self.names:
            return False
        words = _chrome_words(node.label, inside)
        if _is_chrome(node.label, inside) or words & OTHERS:
            return True
        return bool(words) and not loose and (fit is None or id(fit) not in self.open)

    def _find(self, node: Node, test, loose: bool = False) -> list[Node]:
        """The topmost parts that pass; parts inside chrome do not count."""
        if self._is_shut(node, False, loose):
            return []
        if test(node.label):
            return [node]
        return [x for c in node.children for x in self._find(c, test, loose)]

    def _characters(self, node: Node) -> int:
        if self.names and _is_chrome(node.label, False):
            return 0
        return sum(len(p.strip()) if isinstance(p, str) else self._characters(p) for p in node.parts)

    def inferred(self) -> tuple[list[Node], bool]:
        """The part with most of the text that varies, with the titles before it; tells whether it is one."""
        fit, total, titles = self.host.root, self._mass(self.host.root), []
        most = MOST if self.host.known else MOST_OF_ALL
        while total:
            heavy = max((c for c in fit.children), key=self._mass, default=None)
            if heavy is None or self._mass(heavy) <= most * total:
                break
            if heavy.repeated or heavy.tag in BLOCKS or (self.names and self.host.root is not fit and _is_article(fit.label)):
                break
            for c in fit.children:
                if c is heavy:
                    break
                if c.tag in HEADINGS and (c.text == VARIES or not self.host.known) and fit.tag not in ("html", "body", "page"):
                    titles += self.members.get(id(c), [])
            fit = heavy
        sure = self.host.known and fit.tag not in ("html", "body", "page") and total > 0
        return titles + self.members[id(fit)], sure

    def named(self) -> list[Node]:
        """The page's articles; where it has none, its main parts."""
        for test in (_is_article, _is_main):
            found = self._find(self.page, test)
            if found:
                return found
        found = self._find(self.page, _is_article, loose=True)
        return found if len(found) == 1 or 2 * sum(map(self._characters, found)) > self._characters(self.page) else []

    def text(self) -> str:
        nodes, sure = self.inferred()
        choices = [(nodes, False)]
        if self.names and not sure:
            choices.insert(0, (self.named(), True))
        elif self.names and not any(_is_article(n.label) for n in nodes):
            inside = [x for n in nodes for x in self._find(n, _is_article)]
            if len(inside) == 1:  # an article in the part that was found
                choices.insert(0, (inside, True))
        for found, loose in ((f, x) for f, named in choices for x in ((False, True) if named or sure else (False,))):
            self.open |= set() if not self.host.known else {i for n in found if n.fit is not None for i in self._overruled(n.fit)}
            blocks: list[str] = []
            for node in found:
                self._walk(node, loose, _is_article(node.label), blocks)
            if blocks:
                return "\n".join(blocks)
        return ""

    def _walk(self, node: Node, loose: bool, article: bool, blocks: list[str]) -> None:
        run: list[str] = []

        def flush():
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                blocks.append(text)
            run.clear()

        for part in node.parts:
            if isinstance(part, str):
                run.append(part)
                continue
            flush()
            article_below = not article and bool(_chrome_words(part.label, True)) and bool(self._find(part, _is_article, loose=True))
            if not self._is_shut(part, True, loose or article_below, article):
                self._walk(part, loose, article, blocks)
        flush()


def infer(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, pages, wrapper): one wrapper a host from all its pages. ``pages`` has a column host."""
    schema = "host string, pages bigint, wrapper string"

    def rows(found):
        return pd.DataFrame([(h, n, json.dumps(w.pack())) for h, (n, w) in found], columns=["host", "pages", "wrapper"])

    def fold_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, tuple[int, Node]] = {}
        for pdf in batches:
            for host, page in zip(pdf.host, pdf.html):
                s = skeleton(tree(page))
                n, w = got.get(host, (0, None))
                got[host] = (n + 1, s if w is None else merge(w, s))
            if len(got) > MEMO:
                yield rows(got.items())
                got = {}
        yield rows(got.items())

    def fold_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, n, w = None, 0, None
        for pdf in batches:
            done = []
            for h, k, packed in zip(pdf.host, pdf.pages, pdf.wrapper):
                part = Node.unpack(json.loads(packed))
                if h != host:
                    if w is not None:
                        done.append((host, (n, w)))
                    host, n, w = h, k, part
                else:
                    n, w = n + k, merge(w, part)
            yield rows(done)
        if w is not None:
            yield rows([(host, (n, w))])

    parts = pages.select("host", F.col(html).alias("html")).mapInPandas(fold_pages, schema)
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(fold_parts, schema)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url and the main text."""
    hosted = pages.select(F.col(key), F.col(url), F.coalesce(html, F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    wrappers, _ = keep(infer(hosted), "wrappers")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Host] = {}
        for pages_, wrapper in batches:
            out = []
            for page, packed in zip(pages_, wrapper):
                w = known.get(packed)
                if w is None:
                    if len(known) >= MEMO:
                        known.clear()
                    w = known[packed] = Host(Node.unpack(json.loads(packed)))
                out.append(Fit(tree(page), w).text())
            yield pd.Series(out, dtype=object)

    joined = hosted.join(wrappers, "host")
    return joined.select(key, url, run("html", "wrapper").alias("text"))


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
