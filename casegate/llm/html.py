"""Main text of web pages by tree scoring.

A page is read into a flat tree (elements in page order with their parents).  Every block with text
of its own passes points for its length and its commas to its ancestors, less with each step; a
container's points are discounted by the share of its text that stands in links.  The container of
most points is kept, as the whole ``article`` or ``main`` it lies in; of its siblings, articles and
blocks that score a fifth of its points are kept too.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out by their elements, roles and class
or id tokens, before scoring and from what is kept.

A token tells a part by its last word or by a word like ``comments``; tokens that tell a state
(``with-ads``, ``comments-open``) do not count, and an ``article`` goes only inside another.  What a
token or a form would leave out stays where it holds most of the page: half of its text for a token, three
quarters for a form (half where an ``article`` or ``main`` is in it).  Of a form that stays its controls go.

Defined results: a null or empty page, and one without text, has the empty text; broken mark-up is
read as far as it goes (an unfinished tag at the end is dropped); null ids and repeated rows are each
returned; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from casegate.llm.common import parts

# Element names of HTML and words that pages use for their parts.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary".split())
LEFT_OUT = frozenset("nav footer aside button select option label menu dialog head object canvas audio video annotation annotation-xml".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ALWAYS_OUT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus respond cookie cookies "
    "consent gdpr newsletter".split()
)
OFTEN_OUT = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside banner notice alert "
    "promo promotion related recommended share sharing social subscribe subscription signup login popup modal overlay "
    "widget widgets pagination pager toolbar copyright replies".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text page".split())
SITE_WORDS = frozenset("main page".split())
STATES_BEFORE = frozenset("with without has have no not is hide hides show shows enable disable".split())
STATES_AFTER = frozenset("open opened closed enabled disabled on off allowed active inactive free supported ready present".split())
CLOSED_BY = {  # a start tag ends open elements of these names, up to one of the second
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

#: What may stand between a tag's name and its end.  Quotes hold a value together directly after ``=``
#: alone; elsewhere they are characters like others, and ``>`` ends the tag.
ATTRIBUTES = r"""(?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?)?)*"""
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMAS = re.compile("[,،、，]")
SHARES = (1.0, 0.5, 1 / 3, 0.25, 0.2)
SIBLING_SHARE = 0.2
#: Why an element is left out: for itself, by a token of the first or second set of words, as a form.
FIRM, ALWAYS, OFTEN, FORM = 1, 2, 3, 4
#: Shares of the page's text with which it stays all the same.
MOST_OF_TOKEN, MOST_OF_FORM = 0.5, 0.75
MOST_LINKED = 0.4


class Page:
    """Elements in page order; ``pieces`` are texts with their elements, None where blocks break."""

    def __init__(self, source: str):
        self.tags, self.parents, self.why = ["html"], [-1], [0]
        self.inside_article = [False]
        self.last = [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._open = [0]
        self._blocks = [0]  # places in ``_open`` of the blocks
        self._head = 0  # the place of an open head, or 0
        self._read(source)
        while self._open:
            self._pop()
        self.out = self._outs()

    def _pop(self) -> None:
        node = self._open.pop()
        self.last[node] = len(self.tags) - 1
        if self._head == len(self._open):
            self._head = 0
        if self._blocks and self._blocks[-1] == len(self._open):
            self._blocks.pop()
            self.pieces.append((node, None))

    def _pop_to(self, place: int) -> None:
        while len(self._open) > place:
            self._pop()

    def _reason(self, tag: str, attributes: str, parent: int) -> int:
        """Why an element is left out, 0 if it is not."""
        if tag in LEFT_OUT:
            return FIRM
        if tag == "header" and not self.inside_article[parent]:
            return FIRM
        reason = FORM if tag == "form" else 0
        if not attributes or tag in ("html", "body", "main"):
            return reason
        tokens: list[str] = []
        for name, *values in _NAMED.findall(attributes):
            value = "".join(values)
            if name.lower() != "role":
                tokens += value.split()
            elif value.strip().lower() in ROLES:
                if value.strip().lower() != "form":
                    return FIRM
                reason = FORM
        if _HIDDEN.search(attributes):
            return FIRM
        named = {self._part(token, parent) for token in tokens}
        if tag == "article":
            return ALWAYS if ALWAYS in named and self.inside_article[parent] else reason
        return min(named - {0}, default=reason)

    def _part(self, token: str, parent: int) -> int:
        """Which set of words tells the part that a class or id token names, if any."""
        words = [w.lower() for w in _WORDS.findall(token)]
        if not words or words[0] in STATES_BEFORE or words[-1] in STATES_AFTER:
            return 0
        if not ALWAYS_OUT.isdisjoint(words):
            return ALWAYS
        if OFTEN_OUT.isdisjoint(words):
            return 0
        if MAIN_WORDS.isdisjoint(words):
            return OFTEN
        if words[-1] == "header":  # the head of an article, or of the site
            return OFTEN if words[0] in SITE_WORDS and not self.inside_article[parent] else 0
        return OFTEN if words[-1] in OFTEN_OUT else 0

    def _outs(self) -> list[bool]:
        """Which elements are left out, with all that is in them."""
        count = len(self.tags)
        firm = [self.why[0] == FIRM] * count
        for node in range(1, count):
            firm[node] = firm[self.parents[node]] or self.why[node] == FIRM
        size, main = [0] * count, [False] * count
        for node, text in self.pieces:
            if text is not None and not firm[node]:
                size[node] += len(text.strip())
        for node in range(count - 1, 0, -1):
            size[self.parents[node]] += size[node]
            main[node] = main[node] or (self.tags[node] in ("article", "main") and not firm[node])
            main[self.parents[node]] = main[self.parents[node]] or main[node]
        out = list(firm)
        for node in range(1, count):
            share, why = size[node] / size[0] if size[0] else 0, self.why[node]
            stays = why == 0
            if why == ALWAYS:
                stays = main[node] and self.tags[node] != "article" and share >= MOST_OF_TOKEN
            elif why == OFTEN:
                stays = share >= MOST_OF_TOKEN
            elif why == FORM:
                stays = share >= (MOST_OF_TOKEN if main[node] else MOST_OF_FORM)
            out[node] = out[self.parents[node]] or not stays
        return out

    def _end_head(self) -> None:
        """What cannot stand in a head ends it: its end tag is optional."""
        if self._head:
            self._pop_to(self._head)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "head" and self._head:
            return
        if tag in ("html", "body") and len(self._open) > 1 and tag in (self.tags[n] for n in self._open[:2]):
            return
        if tag in BLOCKS or tag == "hr":
            top = self._blocks[-1]
            if self.tags[self._open[top]] == "p":
                self._pop_to(top)
        if tag in CLOSED_BY:
            ended, limits = CLOSED_BY[tag]
            for place in reversed(self._blocks):
                name = self.tags[self._open[place]]
                if name in limits or len(self._blocks) == 0:
                    break
                if name in ended:
                    self._pop_to(place)
                    break
        if tag in VOID:
            if tag in ("br", "hr"):
                self.pieces.append((self._open[-1], None))
            return
        parent = self._open[-1]
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.why.append(self._reason(tag, attributes, parent))
        self.inside_article.append(self.inside_article[parent] or tag in ("article", "main"))
        self.last.append(node)
        if tag in BLOCKS:
            self._blocks.append(len(self._open))
            self.pieces.append((node, None))
        if tag == "head":
            self._head = len(self._open)
        self._open.append(node)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            for place in reversed(self._blocks[1:]):
                name = self.tags[self._open[place]]
                if name == tag:
                    self._pop_to(place)
                    return
                if name in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "article", "main", "body", "html"):
                    return
        else:  # an inline element ends inside its block
            for place in range(len(self._open) - 1, self._blocks[-1], -1):
                if self.tags[self._open[place]] == tag:
                    self._pop_to(place)
                    return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TAG.search(source, at)
            text = source[at : found.start() if found else end]
            if text:
                if self._head and text.strip(" \t\n\f\r"):
                    self._end_head()
                self.pieces.append((self._open[-1], html.unescape(text)))
            if not found:
                return
            at = found.end()
            closing, tag, attributes, finished = found.groups()
            if tag is None or not finished:
                continue
            tag = tag.lower()
            if not closing and tag not in IN_HEAD:
                self._end_head()
            if closing:
                self._end(tag)
            elif tag in RAW:
                at = self._raw_end(source, at, tag, attributes.endswith("/"))
            else:
                self._start(tag, attributes)

    @staticmethod
    def _raw_end(source: str, at: int, tag: str, slashed: bool) -> int:
        """Where the content of a raw element ends.  A slash does not close it, except where no end tag
        follows before the next such element."""
        close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
        if slashed and (tag == "svg" or not close or re.compile(f"<{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at, close.start())):
            return at
        return close.end() if close else len(source)

    def block_of(self) -> list[int]:
        """The nearest block of each element, itself included."""
        nearest: list[int] = []
        for node, tag in enumerate(self.tags):
            nearest.append(node if tag in BLOCKS or node == 0 else nearest[self.parents[node]])
        return nearest

    def chosen(self) -> list[int]:
        """The elements to keep, in page order."""
        count = len(self.tags)
        block = self.block_of()
        linked = [False] * count
        for node in range(1, count):
            linked[node] = linked[self.parents[node]] or self.tags[node] == "a"
        own, commas, total, links = [0] * count, [0] * count, [0] * count, [0] * count
        for node, text in self.pieces:
            if text is None or self.out[node]:
                continue
            size = len(text.strip())
            total[node] += size
            own[block[node]] += size
            commas[block[node]] += len(_COMMAS.findall(text))
            if linked[node]:
                links[node] += size
        for node in range(count - 1, 0, -1):
            total[self.parents[node]] += total[node]
            links[self.parents[node]] += links[node]
        points = [0.0] * count
        for node in range(count):
            if not own[node] or self.out[node]:
                continue
            given = 1 + commas[node] + own[node] / 100
            to = block[self.parents[node]] if self.tags[node] in PARAGRAPHS and node else node
            for share in SHARES:
                points[to] += given * share
                if to == 0:
                    break
                to = block[self.parents[to]]
        density = [links[n] / total[n] if total[n] else 1.0 for n in range(count)]
        scores = [points[n] * (1 - density[n]) for n in range(count)]
        best = max(range(count), key=lambda n: (scores[n], n))
        if scores[best] <= 0:
            return [0] if total[0] else []
        least, container = scores[best] * SIBLING_SHARE, best
        for names in ({"article"}, {"main"}):
            node, around = best, -1
            while node >= 0:
                around = node if self.tags[node] in names else around
                node = self.parents[node]
            if around >= 0:
                container = around
                break
        if container == 0:
            return [0]
        whole = self.tags[container] in ("article", "main")
        kept = []
        for node in range(1, count):
            if self.parents[node] != self.parents[container] or self.out[node]:
                continue
            if node == container or (self.tags[node] == "article" and scores[node] >= least):
                kept.append(node)
            elif not whole and density[node] <= MOST_LINKED and (
                scores[node] >= least or (self.tags[node] in PARAGRAPHS and own[node] >= 80) or (self.tags[node] == "h1" and node < container)
            ):
                kept.append(node)
        return kept

    def text(self) -> str:
        kept = self.chosen()
        spans = iter([(n, self.last[n]) for n in kept])
        inside = [False] * len(self.tags)
        for begin, end in spans:
            for node in range(begin, end + 1):
                inside[node] = not self.out[node]
        return " ".join("".join(" " if t is None else t for n, t in self.pieces if inside[n]).split())


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` per page."""
    read = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in read.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "html"):
            found = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.record_batch(
                [batch["id"], batch["url"], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return read.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
