"""Main text of HTML pages by two-pass block rules.

A page is scanned once, by HTML's rules for tags and attributes, and cut into blocks at block-level tags.  Pass one
decides each block from its length, its density of stop words and its density of links, and from the elements around
it (navigation, headers, footers, sidebars, forms, adverts, notices and comments are never text, by element, role or
name).  Pass two gives each undecided block the label of its nearest decided neighbour; where there is none it is text.

What a tag says is weighed by the text in it.  Articles and main elements compete by mass (characters outside links and
of elements that are never text): those with LARGE of the largest one's are the page, if they have HALF of all; else
any block may be text and the other articles' short blocks aren't.  Forms, headers, footers and elements of which a
part of the name tells against them stay out unless they hold HALF of the page's mass, as a form round a page does, or
ALL but a little of it.
Stop words decide only where most of the page's long text has them, and only for blocks in Latin letters.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm._spark import small_batches
from cairn.llm._text import pieces

#: Function words of the languages that the density of stop words is measured with.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which who will with would you
    aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas pour que qui sa se ses son sur un une vous
    al como con de del desde donde el ella en era es esta este esto fue ha hay la las le lo los más me mi muy no nos o para pero por que se sin sobre su sus también un una uno y ya
    """.split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside, up to the closing tag, isn't looked at; those that end a word are replaced by a space.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select datalist canvas object audio video".split())
#: Blocks that are never text, and controls: a block of their words alone is none either.
NEVER = frozenset("aside dialog head menu nav search".split())
#: Those that are text if they hold most of the page.
SELDOM = frozenset("fieldset footer form header".split())
CONTROL = frozenset("button label option output meter progress".split())
MAIN = frozenset("article main".split())
#: A name tells that an element isn't text if it is one of these, or made of these and fillers alone.
BAD_PARTS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr
    masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended recommendations related replies reply respond responses share sharing
    sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets""".split()
)
#: Parts that tell in any name, unless its last part tells of a page's text or its first one of a page's form.
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr menu modal nav navbar newsletter overlay pagination popup promo rail related sidebar sponsor sponsored subscribe subscription teaser teasers".split()
)
TEXTUAL = frozenset("article body content entry main page story text wrapper".split())
FORMAL = frozenset("has is no not with without".split())
LABELS = frozenset("advertisement advertisements ad sponsored promoted anzeige werbung publicité publicidad".split())
FILLERS = frozenset(
    """and area article articles author aux bar block bottom box btn button buttons by center col column container content count div entries entry fixed form global group header holder icon icons
    inner item items label left link links list main mobile module more news outer page panel post posts primary right row secondary section site slot small sticky stories story text
    the thread title top unit up us wrap wrapper you""".split()
)
BAD_ROLE = frozenset("banner navigation complementary contentinfo search dialog alert alertdialog menu menubar form".split())
#: Elements whose ids are made from their text.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
NOTICE = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)

#: Blocks of at least LONG characters are long; densities are shares of words and of characters.
LONG, STOP_HIGH, STOP_LOW, LINKS = 70, 0.25, 0.08, 0.5
#: Shares of mass, and how deep elements that are seldom text are told apart; deeper ones are never text.
LARGE, HALF, ALL, DEPTH = 0.4, 0.5, 0.9, 8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"[^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_COMMENT_END = re.compile(r"--!?>")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def tag(page: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """(name, attributes, self-closing, place after it) of the tag whose name begins at ``at``.

    As HTML has it: a quote counts only where a value begins, so ``class=it's`` and a lone ``'`` are plain; a value whose
    quote is never closed takes the rest of the page.  The first of attributes of one name holds.
    """
    m = _NAME.match(page, at)
    name, attrs, at, n = m.group().lower(), {}, m.end(), len(page)
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= n:
            return name, attrs, False, n
        if page[at] == ">":
            return name, attrs, gap.group().endswith("/"), at + 1
        m = _KEY.match(page, at)
        key, value, at = m.group().lower(), "", m.end()
        if eq := _EQUALS.match(page, at):
            at = eq.end()
            if page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                value, at = (page[at + 1 : end], end + 1) if end >= 0 else (page[at + 1 :], n)
            else:
                m = _BARE.match(page, at)
                value, at = m.group(), m.end()
        attrs.setdefault(key, value)


def bad_name(value: str, header: bool) -> bool:
    """Whether one of the names says that an element isn't text; ``header``: so does a header's."""
    for name in value.split():
        parts = [p for p in re.split(r"[-_\d]+", _CAMEL.sub(r"\1-\2", name).lower()) if p]
        bad = any(p in BAD_PARTS or (header and p == "header") for p in parts)
        if bad and all(p in BAD_PARTS or p in FILLERS for p in parts):
            return True
    return False


def telling(value: str) -> bool:
    """Whether a part of one of the names speaks against an element."""
    for name in value.split():
        parts = [p for p in re.split(r"[-_\d]+", _CAMEL.sub(r"\1-\2", name).lower()) if p]
        if any(p in TELLING for p in parts) and parts[-1] not in TEXTUAL and parts[0] not in FORMAL:
            return True
    return False


def named_bad(name: str, attrs: dict[str, str], main: int) -> bool:
    """Whether an element's names, role or style say that it isn't text."""
    if bad_name(attrs.get("class", ""), not main) or (name not in TITLED and bad_name(attrs.get("id", ""), not main)):
        return True
    if attrs.get("role", "").lower() in BAD_ROLE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I) is not None


class Block:
    """bad: never text; seldom: the numbers, negative for headers and footers, of the elements around it that are text only if they are most of the page; tag: the innermost block element."""

    __slots__ = ("bad", "main", "text", "links", "label", "seldom", "tag")

    def __init__(self, text: str, links: float, bad: bool, main: int, seldom: tuple = (), tag: str = ""):
        self.text, self.links, self.bad, self.main, self.label, self.seldom, self.tag = text, links, bad, main, None, seldom, tag

    @property
    def mass(self) -> float:
        return 0.0 if self.bad else len(self.text) * (1 - self.links)


class _Page:
    """The blocks of a page as its tags come."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[tuple[str, bool]] = []  # name, whether inline
        self.around: list[tuple[bool, int, tuple, str]] = []  # bad, main, seldom and tag of each open block
        self.open: dict[str, int] = {}
        self.texts: list[str] = []
        self.linked = self.controls = self.mains = self.muted = self.in_control = self.seldoms = 0
        self.link_depth = -1  # of the stack, where an open link began

    def add(self, piece: str) -> None:
        if piece and not self.muted:
            piece = entities.unescape(piece)
            self.texts.append(piece)
            size = len(piece.strip())
            self.linked += size if self.link_depth >= 0 else 0
            self.controls += size if self.in_control else 0

    def context(self) -> tuple[bool, int, tuple, str]:
        """(bad, main, seldom, tag) of the block around."""
        return self.around[-1] if self.around else (False, 0, (), "")

    def flush(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text:
                bad, main, seldom, tag_ = self.context()
                self.out.append(Block(text, min(1.0, self.linked / len(text)), bad or self.controls >= 0.9 * len(text.replace(" ", "")), main, seldom, tag_))
            self.texts.clear()
        self.linked = self.controls = 0

    def push(self, name: str, block: tuple[bool, int, tuple, str] | None) -> None:
        """Opens a block, or an inline element whose words go."""
        self.stack.append((name, block is None))
        self.open[name] = self.open.get(name, 0) + 1
        if block is None:
            self.muted += 1
        else:
            self.around.append(block)

    def pop(self) -> None:
        name, inline = self.stack.pop()
        self.open[name] -= 1
        if inline:
            self.muted -= 1
        else:
            self.around.pop()
        if len(self.stack) < self.link_depth:
            self.link_depth = -1

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        if name == "br":
            self.add(" ")
        elif name == "a":
            self.link_depth = len(self.stack) if "href" in attrs else -1
        elif name in CONTROL:
            self.in_control += not closed
        elif name in BLOCK:
            self.flush()
            if name in VOID:
                return
            # an open paragraph ends where a block begins; an item where the next begins
            while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][1] or self.stack[-1][0] == name and name in ("li", "dt", "dd", "td", "th", "tr")):
                self.pop()
            bad, main, seldom, _ = self.context()
            plain = name in ("html", "body")
            bad = bad or (not plain and named_bad(name, attrs, main)) or name in NEVER
            if name in MAIN and not main and not bad:
                self.mains += 1
                main = self.mains
            names = (attrs.get("class", ""), "" if name in TITLED else attrs.get("id", ""))
            if not bad and not plain and (name in SELDOM and not (name == "header" and main) or telling(names[0]) or telling(names[1])):
                self.seldoms += 1
                bad, seldom = len(seldom) >= DEPTH, (*seldom, -self.seldoms if name in ("header", "footer") else self.seldoms)
            self.push(name, (bad, main, seldom, name))
        elif name not in VOID and not closed and attrs and named_bad(name, attrs, self.context()[1]):
            self.push(name, None)  # its words go, the block around it isn't cut

    def end(self, name: str) -> None:
        if name == "a":
            self.link_depth = -1
        elif name in CONTROL:
            self.in_control = max(0, self.in_control - 1)
        elif name in BLOCK or self.open.get(name):
            if name in BLOCK:
                self.flush()
            if self.open.get(name):
                while self.stack[-1][0] != name:
                    self.pop()
                self.pop()


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order; ``main`` numbers the article or main element around a block, 0: none."""
    p, at, n = _Page(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            p.add(page[at:])
            break
        p.add(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt.isascii() and nxt.isalpha():
            name, attrs, closed, at = tag(page, lt + 1)
            if name in RAW:
                if not (closed and name in ("svg", "math")):
                    end = _ENDS[name].search(page, at)
                    at = end.end() if end else n
                p.add(" " if name not in ("script", "style", "template") else "")
            else:
                p.start(name, attrs, closed)
        elif nxt == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha():
            name, _, _, at = tag(page, lt + 2)
            p.end(name)
        elif page.startswith("<!--", lt):
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
            else:
                end = _COMMENT_END.search(page, lt + 4)
                at = end.end() if end else n
        elif nxt in ("!", "?", "/") and nxt:
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
        else:
            p.add("&lt;")
            at = lt + 1
    p.flush()
    return p.out


def _latin(text: str) -> bool:
    """Whether at least half of the letters are Latin ones."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" for c in letters) >= len(letters)


def _weigh(found: list[Block]) -> set[int]:
    """Judges the elements that are seldom text, and tells which articles and main elements are the page; none if the page's text is elsewhere."""
    total, named, inside, named_inside = 0.0, 0.0, {}, {}
    for b in found:
        total += b.mass
        named += b.mass if b.main else 0.0
        for r in b.seldom:
            inside[r] = inside.get(r, 0.0) + b.mass
            named_inside[r] = named_inside.get(r, 0.0) + (b.mass if b.main else 0.0)

    def holds(r: int) -> bool:
        """Most of the page; nearly all of it in a header or footer (negative numbers), or beside an article, which a header or footer never is."""
        beside = named > named_inside[r]
        return inside[r] >= (ALL if beside or r < 0 else HALF) * total and not (beside and r < 0)

    headed = any(b.tag == "h1" and not b.bad and not b.seldom for b in found)
    for b in found:
        lost = [r for r in b.seldom if not holds(r)]
        # a page's only headline may stand in its header
        b.bad = b.bad or bool(lost) and not (b.tag == "h1" and not headed and len(lost) == 1 and b.links <= LINKS)
    mass = {}
    for b in found:
        mass[b.main] = mass.get(b.main, 0.0) + b.mass
    whole, most = sum(mass.values()), max((m for k, m in mass.items() if k), default=0.0)
    page = {k for k, m in mass.items() if k and m >= LARGE * most}
    return page if sum(mass[k] for k in page) >= HALF * whole else set()


def classify(found: list[Block]) -> list[Block]:
    """Sets ``label`` of each block: True for text."""
    only = _weigh(found)
    stops, counts = [], []
    for b in found:
        words = b.text.lower().split()
        stops.append(sum(map(STOP_WORDS.__contains__, words)))
        counts.append(len(words))

    def listed(b: Block) -> bool:
        """More links than text; a heading or paragraph of the page's main part isn't a list."""
        return b.links > LINKS and not (b.main in only and (b.tag == "p" or b.tag in HEADINGS))

    own = [k for k, b in enumerate(found) if not (b.bad or (only and b.main not in only) or listed(b) or b.text.lower() in LABELS)]
    long = [k for k in own if len(found[k].text) >= LONG]
    # else the page's language isn't one of the stop words'
    speaks = 2 * sum(len(found[k].text) for k in long if stops[k] >= STOP_LOW * counts[k]) >= sum(len(found[k].text) for k in long) and any(stops[k] for k in own)
    for k in own:
        b, stop = found[k], stops[k] / counts[k]
        told = speaks and (stop >= STOP_LOW or _latin(b.text))
        if len(b.text) >= LONG and (stop >= STOP_HIGH or b.main in only or not told):
            b.label = True
        elif len(b.text) >= LONG and stop < STOP_LOW or (b.main not in only and len(b.text) < 3 * LONG and NOTICE.match(b.text)) or (b.main and not only and len(b.text) < LONG):
            b.label = False
    decided = [b.label is not None for b in found]
    near: list[list[tuple[int, bool]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, int] = {}
        for k in order:
            if decided[k]:
                last[found[k].main] = k
            elif found[k].main in last:
                near[k].append((abs(k - last[found[k].main]), not found[last[found[k].main]].label))
    for k in own:
        if not decided[k]:  # the nearest's label; of two at one distance that of text; text where nothing is decided
            found[k].label = not min(near[k])[1] if near[k] else True
    for b in found:
        b.label = bool(b.label)
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null, empty and textless pages give an empty text.  Ids and URLs pass as they are."""

    def run(parts):
        for part in pieces(parts):
            texts = [main_text(t) for t in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
