"""Main text of web pages by consensus of a host's pages.

Every page's containers are scored by the prose in them. A page votes for the
generalised path (tags with classes, digits folded) of its best container; votes
are added up per host in Spark, and pages are read again with their host's
winning path. A page that lacks it keeps its own best container.

Menus, footers, scripts and the like are no article's whatever they hold. An
element whose class, id or role merely reads like a sidebar, advert or comment
list is judged by what it holds, when the page has been read: it stays if the
article is in it. Reading takes time and memory in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.llm.scratch import materialize, small
from wavecrate.shipping import ship

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|([a-zA-Z/!?])[^>]*+(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.IGNORECASE) for t in "script style textarea title xmp iframe noembed noframes noscript template".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
#: Opening one of these ends an open element of the right-hand kinds, up to the barrier.
ENDS = {t: ({"p"}, {"button", "table", "td", "th"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never part of an article, whatever they hold.
DROPPED = frozenset("head nav footer aside script style button select label legend object svg math canvas audio video menu dialog map datalist".split()) | frozenset(RAW)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup comment comments disqus reply replies respond discussion share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager toolbar masthead login searchform".split()
)
#: Of these, compound names are as telling as the word alone.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: Names that begin or end so tell what a page has or lacks, not what an element is.
STATES = frozenset("has no not with without is show hide hides enable enabled disable disabled free open closed off".split())
GOOD_WORDS = frozenset("article post entry story content main body text".split())
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
DIGITS = re.compile(r"\d+")
#: What a container passes on of its score to the one around it.
PASSED_ON = 0.75
#: How surely an element is no part of the article: by a compound name or for hiding, or by its plain name or role.
WEAK, STRONG = 1, 2


@dataclass(slots=True)
class Box:
    """A container: its path, the container around it, what its prose scores, and where its blocks are."""

    path: str
    good: float
    parent: int
    score: float = 0.0
    first: int = 0
    last: int = -1


@dataclass(slots=True)
class Part:
    """An article or a doubtful element: the part around it, and the prose in it."""

    parent: int
    doubt: int
    article: bool
    prose: int = 0
    #: Prose of the largest article in it that is not doubtful itself.
    best: int = 0


@dataclass(slots=True)
class Page:
    blocks: list[str] = field(default_factory=list)
    #: By block: prose (code points outside links), container, part.
    prose: list[int] = field(default_factory=list)
    box_of: list[int] = field(default_factory=list)
    part_of: list[int] = field(default_factory=list)
    boxes: list[Box] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    kept: list[bool] = field(default_factory=list)

    def judge(self) -> None:
        """Decide which doubtful elements stay, then score the containers."""
        parts = self.parts
        for n, i in zip(self.prose, self.part_of):
            parts[i].prose += n
        own = [x.prose for x in parts]
        for i in range(len(parts) - 1, 0, -1):  # parts come before what they hold
            x, up = parts[i], parts[parts[i].parent]
            up.prose += x.prose
            up.best = max(up.best, x.best, x.prose if x.article and not x.doubt else 0)
        gone = [x.doubt == STRONG and 2 * x.best <= parts[0].prose for x in parts]
        # Against what is left, those less surely doubtful.
        left, articles = own, [0] * len(parts)
        for i in range(len(parts) - 1, 0, -1):
            if not gone[i]:
                x = parts[i]
                left[x.parent] += left[i]
                articles[x.parent] += left[i] if x.article and not x.doubt else articles[i]
        scope = [0] * len(parts)
        for i, x in enumerate(parts[1:], 1):
            around = scope[x.parent]
            scope[i] = i if x.article else around
            if x.doubt == WEAK:
                gone[i] = 2 * left[i] <= left[around] or (around == 0 and articles[0] > articles[i])
            gone[i] |= gone[x.parent]
        self.kept = [not gone[i] for i in self.part_of]
        for n, i, kept in zip(self.prose, self.box_of, self.kept):
            if kept:
                self.boxes[i].score += n
        for b in reversed(self.boxes[1:]):
            self.boxes[b.parent].score += PASSED_ON * b.score

    def best(self) -> Box | None:
        return max(self.boxes, key=lambda b: (b.score * b.good, -b.first), default=None)

    def held(self, box: Box) -> list[str]:
        return [self.blocks[i] for i in range(box.first, box.last) if self.kept[i]]

    def text(self, path: str | None) -> str:
        """The text of the containers on ``path``, or of the best container if they have none."""
        own, end = [], 0
        for b in self.boxes:
            if b.path == path and b.first >= end:
                own += self.held(b)
                end = b.last
        if not own and (b := self.best()):
            own = self.held(b)
        return " ".join(own)


def _names(name: str) -> tuple[int, bool]:
    """How doubtful a class or id makes an element, and whether it sounds like an article."""
    words = [w.lower() for w in NAME.findall(name)]
    good = any(w in GOOD_WORDS for w in words)
    if not words or words[0] in STATES or words[-1] in STATES:
        return 0, good
    telling = [w for w in words if w in DROPPED_WORDS]
    if not telling or (good and len(words) > 1 and telling == ["header"]):  # an article's own header
        return 0, good
    return (STRONG if len(words) == 1 or any(w in COMMENT_WORDS for w in telling) else WEAK), good


def _attributes(raw: str) -> tuple[list[str], int, bool]:
    """Classes, how doubtful the element is, and whether it sounds like an article."""
    if not raw.strip(" /\n\t"):
        return [], 0, False
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(raw)}
    doubt, good = 0, False
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
        doubt = WEAK
    if DROPPED_ROLES & set(found.get("role", "").lower().split()):
        doubt = STRONG
    classes = found.get("class", "").split()
    for name in (*classes, found.get("id", "")):
        d, g = _names(name)
        doubt, good = max(doubt, d), good or g
    return classes, doubt, good


def parse(source: str | None) -> Page:
    """Blocks of text that may be an article's, and the containers that hold them."""
    page = Page(boxes=[Box("", 1.0, 0)], parts=[Part(0, 0, False)])
    if not source:
        return page
    part: list[str] = []
    # An open element: tag, path, box, part, dropped, headings only, in an article, in a heading.
    stack = [("", "", 0, 0, False, False, False, False)]
    opened: Counter[str] = Counter()
    linked = 0

    def flush() -> None:
        nonlocal part, linked
        if part:
            block = " ".join("".join(part).split())
            if block:
                top = stack[-1]
                page.blocks.append(block)
                page.prose.append(max(0, len(block) - linked))
                page.box_of.append(top[2])
                page.part_of.append(top[3])
            part, linked = [], 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            opened[gone[0]] -= 1
            if gone[2] != stack[-1][2]:
                page.boxes[gone[2]].last = len(page.blocks)

    at, n = 0, len(source)
    while at < n:
        m = TAG.search(source, at)
        stop = m.start() if m else n
        if stop > at:
            top = stack[-1]
            if not top[4] and (not top[5] or top[7]):
                raw = source[at:stop]
                text = html.unescape(raw) if "&" in raw else raw
                part.append(text)
                if opened["a"]:
                    linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            if opened[tag]:
                if stack[-1][0] not in INLINE:
                    flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
            continue
        if tag in ENDS:
            kinds, barrier = ENDS[tag]
            if any(opened[k] for k in kinds):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in kinds:
                        close(depth)
                        break
                    if stack[depth][0] in barrier or stack[depth][0] in CONTAINERS and "p" in kinds:
                        break
        if tag in VOID:
            continue
        _, path, box, around, dropped, headings, inside, heading = stack[-1]
        if tag in RAW:
            end = RAW[tag].search(source, at)
            at = end.end() if end else n
            continue
        classes, doubt, good = _attributes(m[3])
        article = tag in ("article", "main")
        if tag in ("html", "body"):
            doubt = 0
        elif tag == "form":
            doubt = max(doubt, WEAK)
        if tag in DROPPED or (doubt and tag in INLINE):
            dropped = True
        elif tag == "header":
            headings, dropped, doubt = inside, dropped or not inside, 0
        if (doubt or article) and not dropped:
            page.parts.append(Part(around, doubt, article))
            around = len(page.parts) - 1
        inside = inside or article
        own = ".".join([tag, *sorted({DIGITS.sub("N", c) for c in classes})])
        path = xxhash.xxh3_128_hexdigest(f"{path}>{own}".encode("utf-8", "surrogatepass"))
        if tag in CONTAINERS and not dropped:
            page.boxes.append(Box(path, 2.0 if article else 1.25 if good else 1.0, box, first=len(page.blocks)))
            box = len(page.boxes) - 1
        if tag != "html":
            opened[tag] += 1
            stack.append((tag, path, box, around, dropped, headings, inside, heading or tag in HEADINGS))
    flush()
    close(1)
    page.boxes[0].last = len(page.blocks)
    page.judge()
    return page


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [parse(h.as_py()).best() for h in batch.column(1)]
        rows = [(k, b.path, b.score) for k, b in zip(batch.column(0), best) if b and b.score > 0]
        yield pa.record_batch([pa.array([r[0].as_py() for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [parse(h.as_py()).text(p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


#: Parts that the pages of a host are dealt to where winners are too many to broadcast.
SALTS = 64


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages): the path that most of a host's pages vote for; ties go to the higher score, then the path in order."""
    ship(pages.sparkSession)
    votes = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host <> ''").mapInArrow(_votes, "host string, path string, score double")
    tally = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("pages"), F.desc("score"), "path")
    return tally.withColumn("n", F.row_number().over(order)).filter("n = 1").select("host", "path", "pages")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of text).

    Null and empty pages give the empty string; a page with a null or hostless url
    uses its own best container. Repeated rows give repeated results; whole pages
    are read however long. An empty table gives an empty result. Only the named
    columns are read.
    """
    ship(pages.sparkSession)
    winners = materialize(winning_paths(pages, url_col, html_col).select("host", "path"), "host-paths")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    if small(winners):
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
