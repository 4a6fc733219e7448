"""HTML extraction: unusual and broken pages, and the ratio step against a plain version over the standard library's parser."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from ragloom.llm import html_text

LONG = ("Some long text, with marks; it goes on. " * 5).strip()
ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>Short one.</p><ul><li>point a</li><li>point b</li></ul><p>{LONG}</p>"
WANTED = ["Title", LONG, "Short one.", "point a", "point b", LONG]
LINKS = "<ul><li><a>Home</a></li><li><a>World</a></li><li><a>Sport</a></li></ul>"
REMARKS = "<p>Nice article, thanks.</p><p>I liked it.</p><p>Me too!</p>"


def parts(page):
    text = html_text.extract(page)
    return text.split("\n\n") if text else []


@pytest.mark.parametrize("page", [
    f"<body><div class='widget-page search-results'>{ARTICLE}</div><footer><p>Foot, text. All rights.</p></footer></body>",
    f"<body><div class='widget-page search-results'><article>{ARTICLE}</article></div><footer><p>Foot, text.</p></footer></body>",
    f"<body><div>{LINKS}</div><div class='x'>{ARTICLE}</div><div class='y'>{REMARKS}</div><div class='z'>© 2024 Foo Inc. All rights reserved.</div></body>",
    f"<body>{LINKS}<div>{ARTICLE}</div><div class='q'>{REMARKS}</div><p>© 2024 Foo Inc. All rights reserved.</p></body>",
    f"<body>{LINKS}{ARTICLE}<h2>Comments (3)</h2>{REMARKS}<div>Copyright 2024 Foo Inc., all of it.</div></body>",
    f"<body><form action='/'><nav>{LINKS}</nav><div>{ARTICLE}</div><footer>Foot, all.</footer></form></body>",
    f"<form id='aspnetForm'><nav>{LINKS}</nav><div class='main'>{ARTICLE}</div><div class='sidebar'><p>{LONG}</p></div></form>",
    f"<body><article>{ARTICLE}</article><section id=comments>{('<article><p>' + LONG + '</p></article>') * 10}</section></body>",
    f"<body><header><h1>Site</h1></header><main>{LINKS}{ARTICLE}</main><aside><p>{LONG * 3}</p></aside></body>",
    f"<body><div role=alert><p>{LONG}</p></div><div style='display: none'><p>{LONG}</p></div><article>{ARTICLE}</article><div class=modal><p>{LONG}</p></div></body>",
    f"<body><div class='search-box'><form><label>Search, all.</label><input></form></div><article>{ARTICLE}<div class='newsletter'><p>{LONG}</p></div></article></body>",
    f"<body><article>{ARTICLE.replace('<h1>', '<h1 title=' + chr(34) + '>')}</article></body>",
])
def test_article_of_unusual_pages(page):
    assert parts(page) == WANTED


def test_pages_without_or_with_little_text():
    assert parts(f"<body><nav>{LINKS}</nav><div class='cookie'>We use cookies, yes. Accept?</div><footer>All, rights.</footer></body>") == []
    assert parts(f"<body><article><h1>T</h1><p>Hi.</p></article><footer><p>{LONG}</p></footer></body>") == ["T", "Hi."]
    assert parts(f"<body><div class=post><h1>T</h1><p>{LONG}</p></div><div class='comments'>{('<p>' + LONG + '</p>') * 10}</div></body>") == ["T", LONG]
    assert parts(f"<body><div class=intro><p>Welcome here, all.</p></div><div class='search-results'>{ARTICLE}</div></body>") == ["Welcome here, all.", *WANTED]
    assert parts(f"<body><article><div class=byline>By Someone</div>{ARTICLE}</article></body>") == ["By Someone", *WANTED]
    assert parts("plain text, no tags: 1 < 2 &amp; 3 <4") == ["plain text, no tags: 1 < 2 & 3 <4"]
    assert parts("<p>a &#x41;&nbsp;&eacute; b</p><p>text <b") == ["a A é b", "text"]


@pytest.mark.parametrize("page", [
    "<p" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "x", "<b>" * 50_000 + "<td></td>" * 50_000, "<td><div>" + "<b>" * 50_000 + "<td></td>" * 50_000,
    '<a x="><a ' * 50_000, "<p title='" * 50_000 + ">", "<form>" * 20_000 + "text, is here.", "<!--" * 100_000, "<script>" * 100_000, "<" * 200_000, "< <" * 100_000 + ">",
    "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, '<p "' * 50_000 + ">", "<li><p>" * 50_000, "<div class='ad'>" * 20_000 + "x, y.",
])
def test_broken_pages_take_time_in_proportion(page):
    begin = time.monotonic()
    html_text.extract(page)
    assert time.monotonic() - begin < 10  # about a second; what grows with the square takes minutes


class Plain(HTMLParser):
    """Blocks of a well-formed page without claims: (text, path, container, container above, link characters)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.linked, self.blocks, self.count, self.owner = [("", 0)], "", 0, [], 0, None
        self.feed(page)
        self.cut()

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            path = tuple(t for t, _ in self.owner)
            holders = [n for t, n in self.owner if t not in html_text.BESIDE and t not in html_text.LISTS]
            self.blocks.append((text, path, tuple(holders[-1:]), tuple(holders[-2:-1]), self.linked, tuple(t for t, n in self.owner if n <= holders[-1]), list(self.owner)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attributes):
        if tag in html_text.BLOCK:
            self.cut()
        self.count += 1
        name = tag + "." + dict(attributes).get("class", "") if tag in html_text.BLOCK else tag
        self.stack.append((name if "." in name and not name.endswith(".") else tag, self.count))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.cut()
        self.stack.pop()

    def handle_data(self, data):
        if not self.text:
            self.owner = [e for e in self.stack if e[0].split(".")[0] in html_text.BLOCK or not e[0]]
        self.text += data
        if any(t == "a" for t, _ in self.stack):
            self.linked += len(data.strip())


def chosen_by_force(page):
    blocks = Plain(page).blocks
    n = len(blocks)
    mean = lambda path, of: sum(of(b) for b in blocks if b[1] == path) / sum(b[1] == path for b in blocks)
    marks_of = lambda b: sum(c in ".,;:!?" for c in b[0])
    lend = lambda x, y: x[2] == y[2] or x[3] == y[2] or y[3] == x[2]

    def smooth(i, of):
        before = i - 1 if i and lend(blocks[i - 1], blocks[i]) else i
        after = i + 1 if i + 1 < n and lend(blocks[i], blocks[i + 1]) else i
        return 0.25 * mean(blocks[before][1], of) + 0.5 * mean(blocks[i][1], of) + 0.25 * mean(blocks[after][1], of)

    def value(path):
        own = [i for i in range(n) if blocks[i][1] == path]
        links = sum(blocks[i][4] for i in own) / sum(len(blocks[i][0]) for i in own)
        return sum(math.sqrt(smooth(i, lambda b: len(b[0])) * (1 + smooth(i, marks_of))) * max(0.05, 1 - links) for i in own) / len(own)

    values = {b[1]: value(b[1]) for b in blocks}
    good = {p for p, v in values.items() if v >= 0.3 * max(values.values())}
    beside = {b[5] for b in blocks if b[1] in good}
    kind = lambda b: b[1][-1].split(".")[0]
    kept = [i for i, b in enumerate(blocks) if b[1] in good or kind(b) in html_text.BESIDE and b[5] in beside and (kind(b)[0] == "h" or 2 * b[4] < len(b[0]))]
    return [blocks[i][0] for i in sorted({*kept, *title_by_force(blocks, kept, kind)})]


def title_by_force(blocks, kept, kind):
    """The nearest h1 before the text, or heading above its own, with what stands between; none over a menu in the body."""
    level = lambda i: int(kind(blocks[i])[1]) if kind(blocks[i]) in html_text.HEADINGS else None
    menu = lambda i: 2 * blocks[i][4] >= len(blocks[i][0])
    levels = [level(i) for i in kept if level(i)]
    if 1 in levels:
        return []
    before = [i for i in range(kept[0]) if level(i) and not menu(i)]
    fits = [i for i in before if level(i) == 1] or [i for i in before if level(i) < min(levels, default=7)]
    if not fits:
        return []
    around = [e for e in blocks[fits[-1]][6] if e in blocks[kept[0]][6] and e in blocks[kept[-1]][6]]
    between = range(fits[-1] + 1, kept[0])
    if around[-1][0] in ("", "html", "body") and any(map(menu, between)):
        return []
    return [fits[-1], *(i for i in between if not menu(i))]


def test_ratios_equal_force():
    draw = random.Random(9)

    def words(most):
        return " ".join(draw.choice(["word", "other,", "third.", "long-one;", "x"]) for _ in range(draw.randint(1, most)))

    def part(depth):
        kind = draw.randint(0, 8 if depth < 4 else 5)
        if kind <= 2:
            return f"<p>{words(draw.choice([3, 10, 60]))}</p>"
        if kind == 3:
            level = draw.choice("1223")
            return f"<h{level}>{words(4)}</h{level}>"
        if kind == 4:
            return f"<p><a>{words(5)}</a></p>" if draw.random() < 0.5 else f"<p>{words(9)} <a>{words(3)}</a> {words(9)}</p>"
        if kind == 5:
            return "<ul>" + "".join(f"<li>{words(5)}</li>" for _ in range(draw.randint(1, 4))) + "</ul>"
        inner = "".join(part(depth + 1) for _ in range(draw.randint(1, 4)))
        return f"<div class='{draw.choice(['one', 'two', 'three'])}'>{inner}</div>"

    differing = 0
    for _ in range(300):
        page = f"<html><body>{''.join(part(0) for _ in range(draw.randint(1, 8)))}</body></html>"
        expected = chosen_by_force(page)
        assert parts(page) == expected, page
        differing += len(expected) < len(Plain(page).blocks)
    assert differing > 100


def test_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, f"<p>{LONG}</p>", "old", 9), (1, f"<p>{LONG}</p>", "old", 9), (None, None, None, None)], "page_id long, html string, text string, n_chars int")
    found = html_text.main_text(df)
    assert found.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found.collect()) == [(0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG))]


TEXT = f"<p>{LONG}</p><h2>Part</h2><p>{LONG}</p>"


@pytest.mark.parametrize("page, wanted", [
    (f"<div class=story><h1>T</h1><div class=byline>By Ann Lee</div><div class=txt>{TEXT}</div></div>", ["T", "By Ann Lee", LONG, "Part", LONG]),
    (f"<body>{LINKS}<div class=page><div class=header><h1>T</h1></div><div class=entry>{TEXT}</div></div><footer>Foot, all.</footer></body>", ["T", LONG, "Part", LONG]),
    (f"<body><div class=header><h1>T</h1></div><div class=entry>{TEXT}</div></body>", ["T", LONG, "Part", LONG]),
    (f"<body><main><h1>T</h1><div><span>By Ann</span><a>Share</a></div><div class=txt>{TEXT}</div></main></body>", ["T", "By AnnShare", LONG, "Part", LONG]),
    (f"<body><h1>Site</h1><div>{LINKS}</div><div class=entry>{TEXT}</div></body>", [LONG, "Part", LONG]),
    (f"<body><div class=w><h3>Title</h3><p class=lead>In short, this.</p><div class=entry><p>{LONG}</p><h4>Part</h4><p>{LONG}</p></div></div></body>", ["Title", "In short, this.", LONG, "Part", LONG]),
    (f"<body><nav><h1>Menu</h1></nav><div class=entry><h1>Own</h1>{TEXT}</div></body>", ["Own", LONG, "Part", LONG]),
])
def test_titles_and_bylines_of_wrappers(page, wanted):
    assert parts(page) == wanted
