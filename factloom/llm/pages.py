"""Main text of web pages by composite text density.

Every node of the page's tree gets the characters and tags below it, and how many of them belong to links. Its density
is its characters for each tag, weighed down the more of them are links. The node whose children's densities have the
largest sum holds the article; the least density on the way from it to the body is the threshold above which other parts
of the page count as content too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.shared import text_batches

# Element names of HTML, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold others and so can hold an article.
HOLDERS = frozenset("html body main article section div td blockquote center details figure dl ul ol table tbody tr form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are text of their own and not a part of the page's layout.
FLOW = HEADINGS | frozenset("p pre blockquote ul ol dl table figure details address dir listing plaintext".split())
#: Elements that are never article text.
APART = frozenset("head nav aside footer form script style textarea noscript iframe template svg math button select dialog object canvas audio video title noembed noframes xmp menu".split())
#: Words in class, id or role that mark parts apart from the article.
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside comment comments commentlist respond disqus discussion replies"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations"
    " breadcrumb breadcrumbs menu nav navbar navigation navi pagination pager footer masthead topbar toolbar widget widgets complementary contentinfo search opinions reactions feedback".split()
)
#: Words that say where or how such a part stands, or who made it; a name with any other word is another kind of part.
PLACES = frozenset(
    "main site page pages global top bottom left right upper lower mid middle inner outer first last primary secondary tertiary header box boxes block blocks container wrap wrapper holder area zone region section"
    " panel pane bar rail column col row list lists item items group content contents body text links link icons icon buttons button btn form field input slot unit space frame card cards grid stack tile tiles module modules component part"
    " post posts entry entries article articles story stories news blog thread threads meta info data author reader readers user users visitor visitors guest by on in of the and for to at more"
    " trail path list-item toggle trigger close open modal dialog message messages msg tab tabs dropdown drop sub mega mobile desktop sticky fixed floating skip js react wp google dfp gpt id count counter number title titles heading headline label name".split()
)
_NEVER = ("has", "no", "with", "without", "not")
#: Start tags that end an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an end doesn't pass.
SCOPE = frozenset("html body table ul ol dl div section article main td th blockquote select".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.S)
_HINTED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


def _named_apart(name: str, in_article: bool) -> bool:
    """Whether one name of a class, id or role marks its part as none of the article: one of its words does and all others say where it stands."""
    words = _WORD.findall(name)
    if not words or words[0] in _NEVER:
        return False
    marks = [w in HINTS or (w == "header" and not in_article) for w in words]
    return any(marks) and all(m or w in PLACES or len(w) < 2 for m, w in zip(marks, words))


def _apart(tag: str, attrs: str, in_article: bool, hints: bool) -> bool:
    if tag in APART:
        return True
    if tag == "header":
        return not in_article
    if not attrs or not hints or tag in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attrs):
        return True
    if in_article and tag in FLOW and tag not in ("ul", "ol", "dl", "table", "details"):
        return False  # headings, paragraphs and code of the article, whatever they are called
    return any(_named_apart(name, in_article) for m in _HINTED.finditer(attrs) for name in (m[2] or m[3] or m[4] or "").lower().split())


class Tree:
    """A page's nodes in page order, each after its parent, and its text in pieces; ``None`` parts two blocks."""

    def __init__(self, page: str, hints: bool = True):
        self.tag, self.parent, self.apart, self.end = ["html"], [-1], [False], [0]
        open_: dict[str, int] = {}
        self.attrs = [""]
        self.pieces: list[tuple[int, str] | None] = []
        stack, inside, at, n = [0], 0, 0, len(page)

        def close(k: int) -> None:
            nonlocal inside
            while len(stack) > k:
                node = stack.pop()
                self.end[node] = len(self.tag)
                open_[self.tag[node]] -= 1
                inside -= self.tag[node] in ("article", "main")
                if self.tag[node] in BLOCK:
                    self.pieces.append(None)

        while at < n:
            m = _TAG.search(page, at)
            text = page[at : m.start()] if m else page[at:]
            if text:
                self.pieces.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in ("html", "body") and open_.get(tag):
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            close(k)
                            break
                        if self.tag[stack[k]] in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") and tag not in BLOCK:
                            break
                continue
            if tag in ("html", "head", "body") and tag == "html":
                continue
            if tag == "body":
                close(1)
            if tag in BLOCK:
                self.pieces.append(None)
                if open_.get("p"):
                    self._end_of(stack, {"p"}, close)
            if tag in CLOSES and any(open_.get(kind) for kind in CLOSES[tag]):
                self._end_of(stack, CLOSES[tag], close)
            if tag == "br":
                self.pieces.append((stack[-1], " "))
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.attrs.append(m[3])
            self.apart.append(_apart(tag, m[3], inside > 0, hints))
            self.end.append(node + 1)
            if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
                continue
            if tag in RAW:
                stop = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
                at = stop.start() if stop else n
                if stop:
                    at = page.find(">", stop.start())
                    at = n if at < 0 else at + 1
                continue
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
            inside += tag in ("article", "main")
        open_["html"] = 1
        close(0)
        self._keep_headers()
        for i in range(1, len(self.tag)):
            self.apart[i] = self.apart[i] or self.apart[self.parent[i]]

    def _keep_headers(self) -> None:
        """A header that stands beside paragraphs, in a part below the body, has the title of what they say."""
        prose = {self.parent[i] for i in range(len(self.tag)) if self.tag[i] == "p" and not self.apart[i]}
        for i in range(1, len(self.tag)):
            if self.tag[i] == "header" and self.parent[i] in prose and self.tag[self.parent[i]] not in ("html", "body"):
                self.apart[i] = False

    def _end_of(self, stack: list[int], kinds: set[str], close) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in kinds:
                close(k)
                return
            if self.tag[stack[k]] in SCOPE:
                return

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Density of each node, sum of its children's densities, characters below it, and those of them in links."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        link = [False] * n
        for i in range(1, n):
            link[i] = link[self.parent[i]] or self.tag[i] == "a"
        for piece in self.pieces:
            if piece and not self.apart[piece[0]]:
                k = len(piece[1].strip())
                chars[piece[0]] += k
                if link[piece[0]]:
                    link_chars[piece[0]] += k
        for i in range(n - 1, 0, -1):
            if self.apart[i]:
                continue
            p = self.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = link_chars[body] / max(1, chars[body])
        density = [0.0] * n
        for i in range(n):
            c, lc = chars[i], max(1, link_chars[i])
            if c and not self.apart[i]:
                t, lt = max(1, tags[i]), max(1, link_tags[i])
                base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
                weight = math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1 + 1e-9 else math.log(max(1.0, c / lc * t / lt)) + 1
                density[i] = c / t * weight
        sums = [0.0] * n
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        return density, sums, chars, link_chars

    def selected(self) -> list[tuple[int, int]]:
        """Ranges of nodes that are content."""
        density, sums, chars, link_chars = self.densities()
        n = len(self.tag)
        holders = [i for i in range(n) if self.tag[i] in HOLDERS and not self.apart[i] and chars[i]]
        if not holders:
            return []
        best = max(holders, key=lambda i: (sums[i], density[i], -i))
        # the whole article or main part, if the subtree lies in one
        home, node, least = best, best, density[best]
        while node > 0:
            if self.tag[node] in ("article", "main") and home == best:
                home = node
            if density[node] > 0:
                least = min(least, density[node])
            if self.tag[node] == "body":
                break
            node = self.parent[node]
        if self.tag[home] not in ("article", "main"):
            return [(best, self.end[best]), *self._beside(best, least, density, chars, link_chars)]
        ranges = [(home, self.end[home])]
        # parts beside it that are as dense as the least on its way to the body
        for i in holders:
            if not any(a <= i < b for a, b in ranges) and not (i < home < self.end[i]) and density[i] > max(least, 0.5 * density[best]) and sums[i] > 0.25 * sums[best]:
                ranges.append((i, self.end[i]))
        return ranges

    def _beside(self, best: int, least: float, density: list[float], chars: list[int], link_chars: list[int]) -> list[tuple[int, int]]:
        """Ranges outside ``best`` that are content too: along its way to the body, headings, paragraphs and bare text; parts
        of the same kind as the one on the way, if they are prose; and everywhere below the body what is dense enough."""
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.tag)):
            children.setdefault(self.parent[i], []).append(i)
        prose = lambda i: chars[i] > 0 and 2 * link_chars[i] < chars[i]
        ranges, node = [], best
        while self.tag[node] not in ("body", "html"):
            above, kind = self.parent[node], self._kind(node)
            inside = self.tag[above] not in ("body", "html")
            if inside:
                ranges.append((above, above + 1))  # its bare text
            todo = []
            for i in children[above]:
                if i == node or self.apart[i] or not chars[i]:
                    continue
                if prose(i) and (self.tag[i] in FLOW or inside and (self.tag[i] not in BLOCK or self._kind(i) == kind)):
                    ranges.append((i, self.end[i]))
                else:
                    todo.append(i)
            while todo:
                i = todo.pop()
                if (self.tag[i] in HOLDERS or self.tag[i] in FLOW) and prose(i) and density[i] >= least:
                    ranges.append((i, self.end[i]))
                else:
                    todo += [c for c in children.get(i, ()) if chars[c] and not self.apart[c]]
            node = above
        return ranges

    def _kind(self, node: int) -> tuple[str, str]:
        """Element and class."""
        named = [m for m in _HINTED.finditer(self.attrs[node]) if m[1].lower() == "class"]
        return self.tag[node], " ".join((m[2] or m[3] or m[4] or "") for m in named)

    def text(self) -> str:
        inside = bytearray(len(self.tag))
        for a, b in self.selected():
            inside[a:b] = b"\1" * (b - a)
        blocks, now = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if now and (block := " ".join(html.unescape("".join(now)).split())):
                    blocks.append(block)
                now = []
            elif not self.apart[piece[0]] and inside[piece[0]]:
                now.append(piece[1])
        return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    """The article of a page, blocks parted by two line ends; empty if there is none."""
    if not page:
        return ""
    # hints may take away everything where a page's names mean something else
    return Tree(page).text() or Tree(page, hints=False).text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    A null or empty page, and one without text outside menus and the like, has an empty text. Repeated rows stay, other
    columns are not read, an empty table gives none. Markup that never ends is closed where the page ends.
    """
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
