"""HTML extraction: parser events, text-to-tag ratios per line, smoothing and clustering.

The standard library's streaming parser feeds events to a small state machine.  A line
is the text between two block boundaries together with the number of tags seen in it
and the container (article, main, section, division, ...) that holds it.  Text below
elements that are furniture by their name, role, class or id (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, comment sections) never becomes a line.

A role, class or id that names furniture is only a hint: it never holds for what contains
an ``article`` or ``main``, or most of the text of its article (of the page, where none is
marked) unless it names what readers wrote, nor for a heading or a section named by its id
inside an article whose text reads as prose.

Each line's text-to-tag ratio is smoothed with a Gaussian over its neighbours and the
lines are split into two clusters at a threshold of the ratios' spread.  The content
region is the innermost container that holds all text in the high cluster; explicit
``article`` and ``main`` elements with such text bound it.  The lines of the region are
clustered again: what is in the low cluster and mostly links is furniture.  All other
lines of the region are content, however short, so paragraphs are never dropped or capped.

The work is a narrow map over the rows (no shuffle), linear in the page.  Null and
empty pages give an empty text; unclosed and stray tags are tolerated, and a tag or comment
that is never finished hides what follows it, as in a browser; repeated rows give
repeated results, and other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input label menu nav noscript object option "
    "optgroup script select style svg template textarea title video audio map".split()
)
#: These hold the page itself; their classes describe the layout around them.
WHOLE = frozenset("html body main article".split())
CONTAINERS = frozenset("article body center div main section td".split())
#: An open element of the key's kind ends when one of these starts.
CLOSED_BY = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Words of class, id or role that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "reply replies respond disqus cookie cookies consent gdpr notice notices alert footer header masthead menu nav "
    "navbar navigation navi newsletter subscribe signup login promo promos promoted promotion popup modal overlay "
    "related recommended share sharing social sidebar side sponsor sponsored sponsors toolbar topbar widget widgets "
    "search searchbox form complementary contentinfo dialog discussion feedback pagination pager paywall".split()
)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words for what readers wrote, which may be longer than the article.
READER_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Before a furniture word of the same token these say that the layout around it has or lacks it.
LAYOUT_WORDS = frozenset("has have with without no not hide show".split())
#: Furniture words that as an id may say what a section is about.
TOPIC_WORDS = frozenset("alert dialog discussion feedback form notice notices promotion related search sharing side social".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A whole start tag; a quote opens a value only behind "=", as browsers read it.
_TAG = re.compile(r"""<[A-Za-z][^\s/>]*+(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+>""")
#: What closes markup other than tags, by how it begins; everything else up to the next ">".
_COMMENT = re.compile(r"--\s*>")
_RAW = re.compile("<(script|style)(?![^\\s/>])", re.I)
SIGMA = 1.0
#: More than this share of a text in links, or of a page in one container, decides about it.
MAJORITY = 0.5


def _hint(attrs: list[tuple[str, str | None]]) -> str:
    """What the attributes say: "hidden", "furniture", "reader" for readers' words, "topic" where only an id may name a subject as well, or nothing."""
    named = ""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "hidden"
        if name in ("class", "id", "role") and value:
            for token in value.split():
                words = _WORD.findall(_CAMEL.sub(" ", token).lower())
                at = next((i for i, word in enumerate(words) if word in FURNITURE_WORDS), None)
                if at is not None and not LAYOUT_WORDS.intersection(words[:at]):
                    kind = "topic" if name == "id" and words[at] in TOPIC_WORDS else "reader" if words[at] in READER_WORDS else "furniture"
                    named = kind if named in ("", kind) else "reader" if "reader" in (named, kind) else "furniture"
    return named


class _Lines(HTMLParser):
    """Collects (text, tags, innermost container, characters in links) for every block outside furniture elements; 0 is the page itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.kinds, self.parents, self.hints = [""], [0], [""]  # by container, in the order in which they open
        self._open: list[tuple[str, bool, int]] = []  # name, furniture, container or 0
        self._names: Counter[str] = Counter()  # of open elements
        self._blocks: list[int] = []  # where open blocks lie in _open
        self._within = 0
        self._shut = 0  # open furniture elements
        self._text: list[str] = []
        self._tags = 0
        self._linked = 0

    def flush(self) -> None:
        if text := " ".join("".join(self._text).split()):
            self.lines.append((text, self._tags, self._within, self._linked))
        self._text, self._tags, self._linked = [], 0, 0

    def _pop(self) -> None:
        name, furniture, container = self._open.pop()
        self._names[name] -= 1
        if name in BLOCKS or furniture or container:
            self.flush()
        if name in BLOCKS:
            self._blocks.pop()
        self._shut -= furniture
        if container:
            self._within = self.parents[container]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self._open and tag in CLOSED_BY.get(self._open[-1][0], ()):
            self._pop()
        # inline elements left open inside a paragraph do not keep it open
        while tag in BLOCKS and self._blocks and tag in CLOSED_BY.get(self._open[self._blocks[-1]][0], ()):
            depth = self._blocks[-1]
            while len(self._open) > depth:
                self._pop()
        hint = _hint(attrs) if tag not in WHOLE and tag not in FURNITURE else ""
        furniture = tag in FURNITURE or hint == "hidden"
        if tag in BLOCKS or furniture or hint:
            self.flush()
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        container = 0
        if (tag in CONTAINERS or hint) and not self._shut and not furniture:
            container = len(self.kinds)
            self.kinds.append(tag)
            self.parents.append(self._within)
            self.hints.append(hint)
            self._within = container
        self._shut += furniture
        self._names[tag] += 1
        if tag in BLOCKS:
            self._blocks.append(len(self._open))
        self._open.append((tag, furniture, container))

    def parse_html_declaration(self, i: int) -> int:
        """A marked section is a comment in HTML; the library refuses its name, or reads on for its own end."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._open and self._open[-1][0] == tag and tag in ("svg", "path", "iframe"):
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in VOID or not self._names[tag]:
            return
        while self._open[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if not self._shut:
            self._text.append(data)
            if self._names["a"]:
                self._linked += len(data.strip())


def _closed(html: str) -> str:
    """The page up to the first tag or comment that never ends, which hides all behind it.

    The parser would look for that end again at every later tag, so a page of broken tags would take quadratic time.
    """
    at = html.find("<")
    while at >= 0:
        after = html[at + 1 : at + 2]
        if after.isascii() and after.isalpha():
            tag = _TAG.match(html, at)
            if not tag:
                return html[:at]
            end = tag.end()
            if raw := _RAW.match(html, at):
                close = re.compile(f"</{raw[1]}", re.I).search(html, end)
                if not close:
                    return html[:end]
                end = close.start()
        elif html.startswith("<!--", at):
            close = _COMMENT.search(html, at + 4)
            if not close:
                return html[:at]
            end = close.end()
        elif after in ("/", "!", "?") and after:
            end = html.find(">", at) + 1
            if not end:
                return html[:at]
        else:
            end = at + 1
        at = html.find("<", end)
    return html


def _smoothed(ratios: list[float]) -> list[float]:
    reach = math.ceil(2 * SIGMA)
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(weights[j - i + reach], ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def _high(ratios: list[float]) -> list[bool]:
    """Two clusters: at or above the spread of the smoothed ratios, or below."""
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= min(spread, mean) for r in ratios]


def _shut(page: _Lines) -> list[bool]:
    """Which containers are furniture by their hints, or lie in such."""
    kinds, parents, hints = page.kinds, page.parents, page.hints
    size, linked, whole = [0] * len(kinds), [0] * len(kinds), [k in ("article", "main") for k in kinds]
    for text, _, container, links in page.lines:
        size[container] += len(text)
        linked[container] += links
    for c in range(len(kinds) - 1, 0, -1):  # containers open after those around them
        size[parents[c]] += size[c]
        linked[parents[c]] += linked[c]
        whole[parents[c]] = whole[parents[c]] or whole[c]
    marked = any(whole)
    shut, inside, base = [False] * len(kinds), [False] * len(kinds), [0] * len(kinds)
    for c in range(1, len(kinds)):
        around = parents[c]
        bound = kinds[c] in ("article", "main")
        inside[c] = inside[around] or bound
        base[c] = c if bound else base[around]
        prose = linked[c] <= MAJORITY * size[c]
        # an article's own heading, or a section of it that is named for what it is about
        own = inside[around] and (kinds[c] in HEADINGS or (kinds[c] == "section" and hints[c] == "topic" and prose))
        # most of the text of its article, or of a page that marks none
        most = (inside[around] or not marked) and hints[c] != "reader" and prose and size[c] > MAJORITY * size[base[around]]
        shut[c] = shut[around] or (hints[c] != "" and not (whole[c] or own or most))
    return shut


def _region(lines: list[tuple[str, int, int, int]], kinds: list[str], parents: list[int]) -> list[bool]:
    """Which lines are content."""
    ratios = _smoothed([len(text) / (tags + 1) for text, tags, _, _ in lines])
    weight = [0] * len(kinds)
    for (text, _, container, _), high in zip(lines, _high(ratios), strict=True):
        weight[container] += len(text) * high
    for container in range(len(kinds) - 1, 0, -1):
        weight[parents[container]] += weight[container]
    chosen = {c for c, k in enumerate(kinds) if k in ("article", "main") and weight[c]}
    if not chosen:
        chosen = {max(c for c, w in enumerate(weight) if w == weight[0])}
    held = [c in chosen for c in range(len(kinds))]
    for container in range(1, len(kinds)):
        held[container] = held[container] or held[parents[container]]
    content = [held[container] for _, _, container, _ in lines]
    within = [i for i, x in enumerate(content) if x]
    for i, high in zip(within, _high([ratios[i] for i in within]), strict=True):
        text, _, _, linked = lines[i]
        content[i] = high or linked <= MAJORITY * len(text)
    return content


def extract(html: str | None) -> str:
    """The main text: blocks in page order, one per line."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(_closed(html))
    parser.close()
    parser.flush()
    shut = _shut(parser)
    lines = [x for x in parser.lines if not shut[x[2]]]
    if not lines:
        return ""
    content = _region(lines, parser.kinds, parser.parents)
    return "\n".join(x[0] for x, held in zip(lines, content, strict=True) if held)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(h) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    narrow = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, "page_id bigint, url string, text string")
