"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing and clustering.

The standard library's parser streams a page's events.  A line is what stands between two block borders, with
the tags met in it.  Menus, adverts, comments and the like are known by their element or by words of their
class, id and role; their lines stay in the row of ratios with a ratio of zero.  Within an article only whole names
of adverts and comments say enough; any other such name of a block counts if its lines are low or mostly links, and
no word of a heading's or a slug's does.  The ratios of characters to tags
are smoothed with a Gaussian kernel, and lines above a threshold, the spread of the smoothed ratios, are the
seeds of content.  Every article with a seed is a content region; if none has one, the lowest block that holds all
seeds and articles is.  A run of lines that are nearly all links, with smoothed ratios below the threshold, is no
content, in an article either; a region's other lines, short ones too, are the text.  The threshold alone does not
decide on those: on pages whose text is known it takes four lines in ten for boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.workers import map_batches

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never content.
DROPPED = frozenset(
    "annotation annotation-xml aside audio button canvas datalist dialog embed fieldset footer form head iframe input map menu nav "
    "noframes noscript object option script select style svg template textarea title video".split()
)
#: Words of a class, id or role that say the same of any element.
HINTS = frozenset(
    "ad ads adsbygoogle adsense advert adverts advertisement advertising alert breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer footers form gdpr "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager "
    "pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
    "sidebars signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
#: The same, but not inside an article, whose own heading they may hold.
OUTER_HINTS = frozenset(["banner", "header", "headers", "topbar"])
REMARKS = frozenset(["comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"])
#: What may make an article of its own a thing beside the main one; other hints do not drop an article.
BESIDE = REMARKS | frozenset("ad ads advert advertisement promo promoted recommended related sponsored".split())
#: What says enough within an article: whole names of a class, roles, and whole ids.
CERTAIN = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts comment commentlist comments disqus outbrain promo promoted "
    "replies sponsor sponsored taboola".split()
)
ROLES = frozenset("complementary contentinfo dialog menu menubar navigation search".split())
IDS = frozenset("comment commentlist comments disqus replies respond".split())
#: Words that may stand beside such a word in a name and say nothing of their own.
FRAME = frozenset(
    "area bar block body box button buttons container content form group icon icons inner item items link links list module "
    "outer panel post posts section slot stories text thread title tools unit wrap wrapper".split()
)
#: Share of characters in links from which such a name counts within an article.
MOSTLY_LINKED = 0.5
#: Blocks that are one of several, so that what stands beside them belongs to them.
PARTS = frozenset("blockquote dd dt figcaption li section summary tbody tfoot thead tr".split())
#: Blocks that do not say whether they hold text or what is around it.
LOOSE = frozenset("address center dir div table".split())
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A run of lines is a list of links with so many links, and so large a share of each line's characters in them.
LINKS, LINKED = 3, 0.8
_WORD = re.compile(r"[a-z]+")
#: A box that says so only tells of another one in it.
_TELLS = re.compile(r"\b(?:has|no|with)[-_]\w+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Characters fed to the parser at once.
FEED = 1 << 16


def _named(names: str | None, words: frozenset[str]) -> bool:
    """Whether one of the names has one of the words, and no other that says something."""
    for name in _TELLS.sub("", (names or "").lower()).split():
        found = set(_WORD.findall(name))
        if found & words and found <= words | FRAME:
            return True
    return False


class _Page(HTMLParser):
    """Lines of one page: text that may be content, tags, the article and box it stands in, links and linked share,
    and the innermost block of a doubtful name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, float, int]] = []
        #: Tag, article, box, where dropping began, remark, doubt.
        self.stack: list[tuple[str, int, int, int, bool, int]] = []
        self.places: dict[str, list[int]] = {}
        self.text: list[str] = []
        self.tags = 0
        self.links = 0
        self.linked: list[str] = []
        self.boxes = 0
        self.parent = [0]
        self.kinds = [""]
        self.doubts = [0]  # of each, the one it stands in

    def _line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            _, article, box, _, _, doubt = self.stack[-1] if self.stack else ("", 0, 0, 0, False, 0)
            share = 0.0  # of a heading, a link or not, too
            if self.linked and text and not any(self.places.get(h) for h in HEADS):
                share = sum(len(x) for x in "".join(self.linked).split()) / sum(len(x) for x in text.split())
            self.lines.append((text, self.tags, article, box, self.links, share, doubt))
        self.text, self.tags, self.links, self.linked = [], 0, 0, []

    def _pop(self, at: int) -> None:
        """Close the element at this place of the stack and all in it."""
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        said = dict(attrs)
        names = [said.get(k) or "" for k in ("class", "role", "id")]
        if tag in HEADS or tag in ("article", "section"):
            names.pop()  # a slug of what stands in it
        words = set(_WORD.findall(_TELLS.sub("", " ".join(names).lower())))
        remarks = tag not in HEADS and _named(said.get("id"), IDS)
        if tag in BLOCKS:
            self._close_implied(tag)
        if tag in ("article", "main") and self.stack and self.stack[-1][3] and not (words & BESIDE or remarks):
            if not self.stack[-1][4]:  # an advert or menu that was never closed ends where an article begins
                self._pop(self.stack[-1][3] - 1)
        if tag == "a" and self.places.get("a"):  # a link ends the link before it
            self._pop(self.places["a"][-1])
        _, article, box, dropped, remark, doubt = self.stack[-1] if self.stack else ("", 0, 0, 0, False, 0)
        if tag == "a" and not dropped:
            self.links += 1
        if not dropped:
            outer = not article and (tag == "header" or words & OUTER_HINTS)
            hidden = "hidden" in said or _HIDDEN.search(said.get("style") or "")
            if tag in ("html", "body", "main") or article and tag in HEADS:
                hinted = False
            elif article:
                role = (said.get("role") or "").lower()
                hinted = remarks or role in ROLES or _named(said.get("class"), CERTAIN)
                if not hinted and tag in BLOCKS and any(_named(x, HINTS) for x in names):
                    self.doubts.append(doubt)
                    doubt = len(self.doubts) - 1
            else:
                hinted = remarks or words & (BESIDE if tag == "article" else HINTS)
            if tag in DROPPED or outer or hidden or hinted:
                dropped, remark = len(self.stack) + 1, remarks or bool(words & REMARKS)
        if tag in BLOCKS and tag != "p" and not re.match(r"h\d$", tag):
            self.boxes += 1
            self.parent.append(box)
            self.kinds.append(tag)
            box = self.boxes
        if tag in ("article", "main") and not article and not dropped:
            article = self.boxes
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, article, box, dropped, remark, doubt))

    def _close_implied(self, tag: str) -> None:
        """A block ends the paragraph it starts in, and an item the item before it."""
        for open_tag, until in (("p", BLOCKS - {"p"}), ("li", frozenset(["ul", "ol", "menu"]))):
            if open_tag == "li" and tag != "li" or not self.places.get(open_tag):
                continue
            at = self.places[open_tag][-1]
            if not any(self.places.get(t) and self.places[t][-1] > at for t in until):
                self._pop(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if self.places.get(tag):
            self._pop(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][3]):
            self.text.append(data)
            if self.places.get("a"):
                self.linked.append(data)


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios under a Gaussian kernel that ends after three sigmas; at the borders it is cut off."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of a page: its blocks in page order, white space within them single, joined by line ends."""
    page = _Page()
    for at in range(0, len(html or ""), FEED):
        page.feed(html[at : at + FEED])
    page.close()
    page._line()
    lines = page.lines
    if not any(x[0] for x in lines):
        return ""
    chars = np.array([len(x[0]) for x in lines], float)
    ratio = chars / np.maximum([x[1] for x in lines], 1)
    smoothed = smooth(ratio, sigma)
    articles = np.array([x[2] for x in lines])
    boxes = np.array([x[3] for x in lines])
    said = (chars > 0) & ~_doubtful(page, chars, ratio, smoothed.std())
    if not said.any():
        said = chars > 0
    said &= ~_link_lists(page, articles, chars * said, smoothed)
    seed = said & (smoothed >= smoothed.std())
    if not seed.any():
        seed = said
    within = (articles > 0) & said
    if (within & seed).any():
        held = within & np.isin(articles, articles[within & seed])
    else:
        held = _spanned(page, boxes, said, seed | within)
    return "\n".join(lines[k][0] for k in np.flatnonzero(held))


def _doubtful(page: _Page, chars: np.ndarray, ratio: np.ndarray, least: float) -> np.ndarray:
    """Which lines stand in blocks of a doubtful name that are mostly links or, by character, of a low ratio.

    The ratios are the lines' own: smoothed, a short block would take over those of the paragraphs around it.
    """
    n = len(page.doubts)
    if n == 1:
        return np.zeros(len(chars), bool)
    of = np.array([x[6] for x in page.lines])
    share = np.array([x[5] for x in page.lines])
    text, linked, mass = (np.bincount(of, x, minlength=n).tolist() for x in (chars, chars * share, chars * ratio))
    for k in range(n - 1, 0, -1):  # a block has a greater number than the one it stands in
        if page.doubts[k]:
            for sums in (text, linked, mass):
                sums[page.doubts[k]] += sums[k]
    out = [False] * n
    for k in range(1, n):
        out[k] = out[page.doubts[k]] or linked[k] >= MOSTLY_LINKED * text[k] or mass[k] < least * text[k]
    return np.array(out)[of]


def _link_lists(page: _Page, articles: np.ndarray, chars: np.ndarray, smoothed: np.ndarray) -> np.ndarray:
    """Which lines stand in runs that are nearly all links and whose smoothed ratios are below the threshold.

    A cell with one link or two is data, and lists that are half of an article's text are what it is about.
    """
    out = np.zeros(len(chars), bool)
    if not any(x[4] for x in page.lines):
        return out
    run: list[int] = []
    for k in [*np.flatnonzero(chars).tolist(), None]:
        if k is not None:
            _, _, _, box, links, share, _ = page.lines[k]
            if share >= LINKED and (links >= LINKS or page.kinds[box] not in ("td", "th")):
                run.append(k)
                continue
        if run and sum(page.lines[i][4] for i in run) >= LINKS and smoothed[run].mean() < smoothed.std():
            out[run] = True
        run = []
    whole = np.bincount(articles, chars)
    return out & (np.bincount(articles, chars * out) < whole / 2)[articles]


def _spanned(page: _Page, boxes: np.ndarray, said: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Which lines of text stand in the lowest box that holds all seeds.

    Of the body these are the lines from its first child with a seed to its last one, and what goes on before and
    after them in no box of its own, or in one that is made for text.
    """
    parent = page.parent
    count = np.bincount(boxes[seed], minlength=len(parent)).tolist()
    for b in range(len(parent) - 1, 0, -1):  # a box has a greater number than the one it stands in
        count[parent[b]] += count[b]
    box = max(b for b, n in enumerate(count) if n == count[0])
    while page.kinds[box] in PARTS:
        box = parent[box]
    child = [-1] * len(parent)
    child[box] = box
    for b in range(box + 1, len(parent)):
        child[b] = b if child[parent[b]] == box else child[parent[b]]
    part = np.array(child)[boxes]
    held = said & (part >= 0)
    if page.kinds[box] not in ("", "html", "body"):
        return held
    at = np.flatnonzero(held)
    own = part[at] == box
    goes_on = own | np.array([page.kinds[b] not in LOOSE for b in part[at]])
    core = np.flatnonzero(seed[at] | ~own & np.isin(part[at], part[at][seed[at]]))
    first, last = core[0], core[-1]
    while first > 0 and goes_on[first - 1]:
        first -= 1
    while last + 1 < len(at) and goes_on[last + 1]:
        last += 1
    held[at[:first]] = False
    held[at[last + 1 :]] = False
    return held


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    A null or empty html, or one without content, gives an empty text; n_chars counts its code points.  Repeated
    rows are read each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, sizes], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(read, run, "page_id bigint, url string, text string, n_chars bigint")
