"""HTML extraction by tag-path ratios.

A page is read as a run of blocks (stretches of text between block tags), each with its
root-to-leaf path of tags, classes and ids.  Over the page, text length, punctuation and
link text are summed per path; length and punctuation are divided by the path's blocks,
smoothed along the page (between blocks of one container or of a container and its
parent), and fused with the share of text outside links into one value a path.  Paths at
or over a share of the page's best value are content.  Short blocks, such as headings and
lists, that stand in a container right beside content paths belong to it, and so does all
that an article holds whose own text is content.  Where the text has no title of its own, the
one before it in a wrapper around both is its title, with what stands between, such as a byline.

Containers of other matter (menu, form, advert, ...) tell themselves by tag, role, class
or id.  This is a prior only: first the page is read as the containers claim, then every
claim is set against the container's share of the page's sentences (punctuated text
outside links).  A name that holds nearly all of them, or most of them and the page's
heading, is no longer believed, and what either reading selects is the text.

Null or empty html, or a page without content: the empty text.  Rows are read by
themselves, so repeated rows give equal texts; an empty table gives no rows, and other
columns stay as they are.  Reading takes time in proportion to the page, however
malformed it is: a tag that never ends is dropped, a quote that never ends is no quote.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)\s*+")
_VALUE = re.compile(r"=\s*+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、！？；：]")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.IGNORECASE)
#: Longer lines that begin so are text.
COPYRIGHT_MOST = 200

# Fixed values of HTML.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video map noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these closes an open p.
ENDS_P = BLOCK - {"option", "body", "html"}
#: An open element of the first kind is closed by the start of one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSERS = frozenset().union(*CLOSES.values())
#: Never text of an article.
HARD_TAGS = frozenset("head title button select textarea input datalist".split())
#: Containers of other matter, by tag, role, and words of class and id; the first two kinds of words by how sure they are.
OTHER_TAGS = frozenset("nav footer aside menu header".split())
FORM_TAGS = frozenset("form fieldset label dialog".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead topbar cookie cookies consent gdpr popup modal newsletter subscribe signup login comment comments commentlist reply replies respond disqus pagination pager".split()
)
UNSURE_WORDS = frozenset("toolbar notice notices alert overlay dialog search share sharing social discussion related recommended recommendations widget widgets skip copyright legal disclaimer".split())
OTHER_WORDS = SURE_WORDS | UNSURE_WORDS
#: Words that an id may have beside such words and still name such a container as a whole, as in footer-wrapper.
LAYOUT = frozenset("wrapper wrap container area section block box bar list inner outer left right top bottom main site page form link links button primary secondary header panel".split())
#: Such words that also head a section of an article: not heeded as the id of one.
TITLES = frozenset("discussion search legal disclaimer notice notices copyright share social sharing related recommended recommendations reply replies promotion advertising navigation".split())
#: Within an article or the page's main part names are heeded on these only.
NAMED = frozenset("div section aside ul".split())
#: Words that turn such a word around, as in has-sidebar or ad-free.
TURNED = frozenset("has with no without free".split())
#: Containers that announce content.
CONTENT_TAGS = frozenset({"article", "main"})
#: Blocks that join the content paths beside them.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figcaption caption td th address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their ids are anchors of the text and never heeded.
ANCHORS = HEADINGS | {"p", "pre", "table"}
LISTS = frozenset("ul ol dl table tbody thead tfoot tr figure hgroup details".split())

#: Text in which a reader's comments follow, where no article or main part tells what is content.
COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader\s+)?(?:comments?|replies|responses|kommentare?|comentarios?|commentaires?)(?:\s*\(\d+\))?:?", re.IGNORECASE)

#: Of the page's best path that a content path reaches, and the smoothing weights along the page.
SHARE, KERNEL = 0.3, (0.25, 0.5, 0.25)
#: What standing in an article or the page's main part multiplies a path's value by, and what remains of a value that is links alone.
CONTENT, LINKS = 8, 0.05
#: A claimed container is not believed if it holds MOST of the page's sentences and its heading or main part, or if
#: its name is unsure and what stands outside all such containers is at most a REST of what it holds.
MOST, REST = 0.5, 0.1
#: Wrappers within one another that are doubted, at most.
ROUNDS = 16


class Element:
    """An open element.  ``claim``: which claim to hold other matter it stands in, the innermost."""

    __slots__ = ("tag", "path", "parent", "hard", "claim", "content", "article", "container", "above", "holder", "link")

    def __init__(self, tag: str, parent: Element | None):
        self.tag = tag
        self.path = 0
        self.parent = parent
        self.hard = self.content = self.article = self.link = False
        self.claim: int | None = None
        self.container, self.above, self.holder = self, None, self
        if parent is not None:
            self.hard, self.content, self.article, self.claim = parent.hard, parent.content, parent.article, parent.claim
            self.link = parent.link or tag == "a"


class Block:
    __slots__ = ("text", "element", "linked", "marks")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element = text, element
        self.linked = min(linked, len(text))
        self.marks = len(_PUNCTUATION.findall(text))


def named(tag: str, classes: list[str], ids: list[str], content: bool) -> set[str]:
    """The words by which its class (by one word) or id (as a whole) claims other matter; ``content``: within an article."""
    if tag in ("html", "body", "article", "main") or content and tag not in NAMED or not TURNED.isdisjoint(classes + ids):
        return set()
    if not OTHER_WORDS.isdisjoint(classes):
        return OTHER_WORDS.intersection(classes)
    if tag in ANCHORS or content and tag == "section" and not TITLES.isdisjoint(ids):
        return set()
    found = OTHER_WORDS.intersection(ids)
    return found if found and all(w in OTHER_WORDS or w in LAYOUT for w in ids) else set()


class Page:
    """The blocks of a page, and its claims in the order in which they open: whether they are sure, and the claim around each."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.claims: list[tuple[bool, int | None]] = []
        self.heads: set[int] = set()  # claims right around an h1 or a main part
        self.paths: dict[tuple[int, str], int] = {}
        self.read(page)

    def outermost(self, lifted: set[int]) -> dict[int | None, int | None]:
        """For each claim the outermost one around it, or itself, that is not lifted."""
        out: dict[int | None, int | None] = {None: None}
        for k, (_, around) in enumerate(self.claims):
            outer = out[around]
            out[k] = outer if outer is not None else None if k in lifted else k
        return out

    def claim(self, e: Element, sure: bool) -> None:
        self.claims.append((sure, e.claim))
        e.claim = len(self.claims) - 1

    def element(self, tag: str, parent: Element, attributes: list[tuple[str, str]]) -> Element:
        e = Element(tag, parent)
        words: list[str] = []
        classes: list[str] = []
        ids: list[str] = []
        role, hidden = "", False
        for name, value in attributes:
            if name == "role":
                role = value.strip().lower()
            elif name in ("class", "id"):
                own = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]
                words += own
                (ids if name == "id" else classes).extend(own)
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDDEN.search(value):
                hidden = True
        e.path = self.paths.setdefault((parent.path, f"{tag}.{'.'.join(words)}"), len(self.paths) + 1)
        if tag in HARD_TAGS:
            e.hard = True
        if tag in OTHER_TAGS and not (tag == "header" and parent.content) or role in OTHER_ROLES or hidden:
            self.claim(e, True)
        elif tag in FORM_TAGS:
            self.claim(e, False)
        elif found := named(tag, classes, ids, parent.content):
            self.claim(e, not found.isdisjoint(SURE_WORDS))
        if tag in CONTENT_TAGS or role in ("main", "article"):
            e.content = True
            e.article = e.article or tag == "article" or role == "article"
        if e.claim is not None and (tag in ("h1", "main") or role == "main"):
            self.heads.add(e.claim)
        # The nearest element above that is more than a wrapper of list items, cells or headings, and the one above that.
        if tag in BESIDE or tag in LISTS or tag not in BLOCK:
            e.container, e.above = parent.container, parent.above
        else:
            e.above = parent.container
        # The element that a text right in this one belongs to.
        if tag not in BLOCK and e.claim == parent.claim and e.hard == parent.hard:
            e.holder = parent.holder
        return e

    def read(self, page: str) -> None:
        root = Element("", None)
        stack = [root]
        scopes: list[dict[str, int]] = [{}]  # open inline elements by tag, for each open block element
        blocks_open: list[int] = []  # places in the stack of open block elements
        opened: dict[str, int] = {}
        text: list[str] = []
        holder, linked = root, 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined:
                    self.blocks.append(Block(joined, holder, linked))
                text.clear()
            linked = 0

        def push(e: Element) -> None:
            stack.append(e)
            opened[e.tag] = opened.get(e.tag, 0) + 1
            if e.tag in BLOCK:
                blocks_open.append(len(stack) - 1)
                scopes.append({})
            else:
                scopes[-1][e.tag] = scopes[-1].get(e.tag, 0) + 1

        def cut(at: int) -> None:
            while len(stack) > at:
                e = stack.pop()
                opened[e.tag] -= 1
                if e.tag in BLOCK:
                    blocks_open.pop()
                    scopes.pop()
                else:
                    scopes[-1][e.tag] -= 1

        at, size = 0, len(page)
        last = {c: page.rfind(c) for c in ">\"'"}
        while at < size:
            open_ = page.find("<", at)
            # A bracket that begins no tag is text.
            while 0 <= open_ < size - 1 and not (page[open_ + 1] in "!?" or _NAME.match(page, open_)) and page[open_ + 1] != "/":
                open_ = page.find("<", open_ + 1)
            if open_ < 0 or open_ == size - 1:
                open_ = size
            if open_ > at:
                piece = page[at:open_]
                if not text:
                    holder = stack[-1].holder
                text.append(piece)
                if stack[-1].link:
                    linked += len(piece.strip())
            if open_ == size:
                break
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 2)
                at = end + 3 if end >= 0 else size
                continue
            if page.startswith("<![CDATA[", open_):
                end = page.find("]]>", open_)
                at = end + 3 if end >= 0 else size
                continue
            m = _NAME.match(page, open_)
            if m is None or open_ > last[">"]:  # a declaration, an end tag without a name, or a tag that never ends
                at = page.find(">", open_) + 1 if open_ <= last[">"] else size
                continue
            tag = m.group(1).lower()
            at, attributes, closed = self.attributes(page, m.end(), last)
            if page[open_ + 1] == "/":  # an end tag: of the nearest such element, and what is open within
                if tag in BLOCK:
                    flush()
                    if opened.get(tag):
                        k = next(k for k in reversed(blocks_open) if stack[k].tag == tag)
                        cut(k)
                elif scopes[-1].get(tag):
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                    if stack[k].holder is stack[k]:
                        flush()
                    cut(k)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                at = at or size
                continue
            if tag in VOID:
                if tag == "br" and text:
                    text.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in BLOCK:
                flush()
            if tag in ENDS_P and blocks_open and stack[blocks_open[-1]].tag == "p":
                cut(blocks_open[-1])
            if tag == "body" and opened.get("head"):
                cut(next(k for k, e in enumerate(stack) if e.tag == "head"))
            for k in reversed(blocks_open) if tag in CLOSERS else ():
                own = stack[k].tag
                if tag in CLOSES.get(own, ()):
                    cut(k)
                    break
                if own not in CLOSES and own != "p":
                    break
            e = self.element(tag, stack[-1], attributes)
            if e.holder is e and tag not in BLOCK:
                flush()
            if not closed:
                push(e)
        flush()

    @staticmethod
    def attributes(page: str, at: int, last: dict[str, int]) -> tuple[int, list[tuple[str, str]], bool]:
        """Where the tag ends whose attributes begin at ``at``, these, and whether it closes itself.  Some ``>`` follows."""
        out: list[tuple[str, str]] = []
        if page[at] == ">":
            return at + 1, out, False
        while m := _ATTRIBUTE.match(page, at):
            name, value, at = m.group(1).lower(), "", m.end()
            if v := _VALUE.match(page, at):
                at = v.end()
                quote = page[at : at + 1]
                if quote in ("'", '"') and at < last[quote]:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    u = _UNQUOTED.match(page, at)
                    value, at = u.group(), u.end()
            out.append((name, value))
        end = page.find(">", at)
        return (end + 1 if end >= 0 else len(page)), out, end > 0 and page[end - 1] == "/"


def related(a: Element, b: Element) -> bool:
    """Of one container, or of one and that above it."""
    return a.container is b.container or a.above is b.container or b.above is a.container


def smoothed(values: list[float], near: list[bool]) -> list[float]:
    """Weighted by the neighbours along the page; ``near[i]``: i and i + 1 lend each other.  A missing neighbour is the block itself."""
    n, (a, b, c) = len(values), KERNEL
    return [a * values[i - 1 if i and near[i - 1] else i] + b * values[i] + c * values[i + 1 if i + 1 < n and near[i] else i] for i in range(n)]


def path_values(found: list[Block]) -> dict[int, float]:
    """The fused value of every path of these blocks."""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.element.path, [0, 0, 0, 0])
        for k, v in enumerate((len(b.text), b.marks, b.linked, 1)):
            s[k] += v
    near = [related(x.element, y.element) for x, y in zip(found, found[1:])]
    own = [sums[b.element.path] for b in found]
    lengths = smoothed([s[0] / s[3] for s in own], near)
    marks = smoothed([s[1] / s[3] for s in own], near)
    value: dict[int, float] = {}
    for b, s, length, mark in zip(found, own, lengths, marks):
        free = max(LINKS, 1 - s[2] / s[0])
        v = math.sqrt(length * (1 + mark)) * free * (CONTENT if b.element.content else 1)
        value[b.element.path] = value.get(b.element.path, 0.0) + v / s[3]
    return value


def selected(page: Page, outermost: dict[int | None, int | None]) -> list[int]:
    """The places of the main text's blocks, claims being believed that are not lifted."""
    left = [(i, b) for i, b in enumerate(page.blocks) if not b.element.hard and outermost[b.element.claim] is None]
    left = [(i, b) for i, b in left if b.element.content or len(b.text) > COPYRIGHT_MOST or not _COPYRIGHT.match(b.text)]
    skipped: set[int] = set()
    place, level, whole = None, 0, any(b.element.content for _, b in left)
    for i, b in left if not whole else ():
        tag = b.element.tag
        if place is not None and (b.element.container is not place and b.element.above is not place or tag in HEADINGS and int(tag[1]) <= level):
            place = None
        if tag in HEADINGS and COMMENTS.fullmatch(b.text):
            place, level = b.element.container, int(tag[1])
        if place is not None:
            skipped.add(i)
    left = [(i, b) for i, b in left if i not in skipped]
    if not left:
        return []
    value = path_values([b for _, b in left])
    threshold = SHARE * max(value.values())
    chosen = {path for path, v in value.items() if v >= threshold}
    beside = {b.element.container.path for _, b in left if b.element.path in chosen}
    articles = any(b.element.article for _, b in left if b.element.path in chosen)
    linked = lambda b: 2 * b.linked >= len(b.text) and b.element.tag not in HEADINGS and not b.element.article
    return [i for i, b in left if b.element.path in chosen or b.element.article and articles or b.element.tag in BESIDE and b.element.container.path in beside and not linked(b)]


def meeting(a: Element, b: Element) -> Element | None:
    """The innermost element around both."""
    around = set()
    x: Element | None = a
    while x is not None:
        around.add(id(x))
        x = x.parent
    y: Element | None = b
    while y is not None and id(y) not in around:
        y = y.parent
    return y


def headed(page: Page, kept: list[int], outermost: dict[int | None, int | None]) -> list[int]:
    """The places of the title before the text and of what stands between them, such as a byline.

    The title is the nearest h1 before the text or, where there is none, the nearest heading above the text's own; it
    stands with the text in some element, mostly the wrapper around both.  Where that is the page's body, a menu in
    between tells that the title is another part's.
    """
    if not kept or any(page.blocks[i].element.tag == "h1" for i in kept):
        return []
    own = lambda b: not b.element.hard and outermost[b.element.claim] is None
    links = lambda b: 2 * b.linked >= len(b.text)
    top = min((int(page.blocks[i].element.tag[1]) for i in kept if page.blocks[i].element.tag in HEADINGS), default=7)
    before = [i for i in range(kept[0]) if own(page.blocks[i])]
    heads = [i for i in before if page.blocks[i].element.tag in HEADINGS and not links(page.blocks[i])]
    title = next((i for i in reversed(heads) if page.blocks[i].element.tag == "h1"), None)
    if title is None:
        title = next((i for i in reversed(heads) if int(page.blocks[i].element.tag[1]) < top), None)
    if title is None:
        return []
    between = [i for i in before if i > title]
    text = meeting(page.blocks[kept[0]].element, page.blocks[kept[-1]].element)
    wrapper = meeting(text, page.blocks[title].element) if text is not None else None
    if (wrapper is None or wrapper.tag in ("", "html", "body")) and any(links(page.blocks[i]) for i in between):
        return []
    return [title, *(i for i in between if not links(page.blocks[i]))]


def doubted(page: Page, outermost: dict[int | None, int | None]) -> set[int]:
    """Claims that what they hold speaks against."""
    held: dict[int | None, float] = {}
    for b in page.blocks:
        if not b.element.hard and b.marks:
            claim = outermost[b.element.claim]
            held[claim] = held.get(claim, 0.0) + len(b.text) - b.linked
    total, rest = sum(held.values()), held.pop(None, 0.0)
    heads = {outermost[claim] for claim in page.heads}
    return {claim for claim, own in held.items() if own and own >= MOST * total and (claim in heads or not page.claims[claim][0] and rest <= REST * own)}


def extract(html: str | None) -> str:
    """The main text: what the page's claims leave, and what is left once the doubted ones are lifted."""
    page = Page(html or "")
    kept: set[int] = set()
    lifted: set[int] = set()
    for _ in range(ROUNDS):
        outermost = page.outermost(lifted)
        found = selected(page, outermost)
        kept.update(found)
        kept.update(headed(page, found, outermost))
        doubt = doubted(page, outermost)
        if not doubt:
            break
        lifted |= doubt
    return "\n\n".join(page.blocks[i].text for i in sorted(kept))


def main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Append the main text of every page and its length in code points (``n_chars``); columns of these names are replaced."""
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, "n_chars")])
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.as_py()) for t in batch.column(batch.schema.get_field_index(html))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, out, "n_chars"])

    return base.mapInArrow(run, schema)
