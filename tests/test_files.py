"""Element readers against what generated files were made of, and the file sources."""

import html as markup
import io
import os
import random
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from ragloom.operators import chunking
from ragloom.sources import elements as el
from ragloom.sources import files, readers

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
WORDS = "alpha beta Gamma délta epsilon zeta Eta theta iota kappa".split()


def spec(seed, n=40):
    """Random (kind, text, level, rows): what a file is made of, and what has to be read from it."""
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 12)))
    out = []
    depth = -1
    for _ in range(n):
        kind = rng.choice(["Title", "NarrativeText", "NarrativeText", "ListItem", "ListItem", "Table", "Code"])
        if kind == "ListItem":
            depth = rng.randint(0, min(depth + 1, 3))
            out.append((kind, f"item {sentence()}", depth, None))
            continue
        depth = -1
        if kind == "Table":
            rows = [[sentence() for _ in range(3)] for _ in range(rng.randint(1, 4))]
            out.append((kind, "\n".join(" | ".join(r) for r in rows), 0, rows))
        elif kind == "Title":
            out.append((kind, sentence().capitalize(), rng.randint(1, 4), None))
        elif kind == "Code":
            out.append((kind, f"x = {rng.randint(0, 9)}\n\nif x:\n    y()", 0, None))
        else:
            out.append((kind, sentence().capitalize() + ".", 0, None))
    return out


def read(found):
    return [(e.kind, e.text, e.level, e.rows) for e in found]


def as_markdown(parts):
    out, numbers = [], [0] * 9
    for kind, text, level, rows in parts:
        if kind == "Title":
            out += ["", text, "==="] if level == 1 and len(text) % 2 else ["", "#" * level + " " + text + (" ##" if len(text) % 3 == 0 else "")]
        elif kind == "ListItem":
            numbers[level] += 1
            words = text.split(" ")
            out += ["    " * level + "- " + " ".join(words[:3])] + (["    " * level + "  " + " ".join(words[3:])] if words[3:] else [])
        elif kind == "Table":
            out += ["", "| " + " | ".join(rows[0]) + " |", "|---|:-:|--:|", *("| " + " | ".join(r) + " |" for r in rows[1:]), ""]
        elif kind == "Code":
            out += ["", "```py", text, "```", ""]
        else:
            first, _, rest = text.partition(" ")
            out += ["", f"**{first}**", rest, ""]
    return "\n".join(out)


def as_html(parts):
    out, depth = [], -1
    for kind, text, level, rows in parts:
        level_now = level if kind == "ListItem" else -1
        while depth > level_now:
            out.append("</ul>")
            depth -= 1
        while depth < level_now:
            out.append("<ul>")
            depth += 1
        if kind == "Title":
            out.append(f"<h{level}>{markup.escape(text)}</h{level}>")
        elif kind == "ListItem":
            out.append(f"<li>{text}")
        elif kind == "Table":
            out.append("<table>" + "".join("<tr>" + "".join(f"<td><b>{c}</b>" for c in r) for r in rows) + "</table>")
        elif kind == "Code":
            out.append(f"<pre><code>{text}</code></pre>")
        else:
            out.append(f"<p>{text}")
    return "<html><head><title>no</title></head><body>" + "\n".join(out) + "</body></html>"


def zipped(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


def rels(*targets):
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="r{i}" Type="{R}/{kind}" Target="{t}"/>' for i, (kind, t) in enumerate(targets)) + "</Relationships>"


STYLES = f"""<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="N"/></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/></w:style>
<w:style w:type="paragraph" w:styleId="My3"><w:name w:val="My own"/><w:basedOn w:val="H3"/></w:style><w:style w:type="paragraph" w:styleId="H3"><w:name w:val="heading 3"/></w:style>
<w:style w:type="paragraph" w:styleId="C"><w:name w:val="Source Code"/></w:style><w:style w:type="paragraph" w:styleId="B"><w:name w:val="Bullets"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="LB2"><w:name w:val="List Bullet 2"/></w:style><w:style w:type="paragraph" w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>"""
NUMBERING = f"""<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="7">{"".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="bullet"/></w:lvl>' for i in range(4))}</w:abstractNum>
<w:abstractNum w:abstractNumId="8"><w:lvl w:ilvl="0"><w:numFmt w:val="none"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>"""


def w_paragraph(text, properties="", runs=None):
    return f"<w:p><w:pPr>{properties}</w:pPr>{runs or ''.join(f'<w:r><w:t xml:space=&quot;preserve&quot;>{escape(x)}</w:t></w:r>'.replace('&quot;', chr(34)) for x in (text[:3], text[3:]))}</w:p>"


def w_style(name):
    return f'<w:pStyle w:val="{name}"/>'


def as_docx(parts, before="", after=""):
    body = []
    for kind, text, level, rows in parts:
        if kind == "Title":
            body.append(w_paragraph(text, w_style({1: "H1", 2: "H2", 3: "My3"}[level]) if level < 4 else '<w:outlineLvl w:val="3"/>'))
        elif kind == "ListItem":
            body.append(w_paragraph(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>' if level else w_style("B")))
        elif kind == "Table":
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{w_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>")
        elif kind == "Code":
            body.append(w_paragraph("", w_style("C"), "".join(f'<w:r><w:t xml:space="preserve">{x}</w:t><w:br/></w:r>' for x in text.split("\n"))))
        else:
            body.append(w_paragraph(text))
    document = f'<w:document xmlns:w="{W}" xmlns:wp="urn:wp" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{before}{"".join(body)}{after}<w:sectPr/></w:body></w:document>'
    head = f'<w:hdr xmlns:w="{W}">{w_paragraph("The header")}</w:hdr>'
    foot = f'<w:ftr xmlns:w="{W}">{w_paragraph("The footer")}</w:ftr>'
    return zipped({"_rels/.rels": rels(("officeDocument", "word/main.xml")), "word/main.xml": document, "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING, "word/h.xml": head, "word/f.xml": foot,
                   "word/_rels/main.xml.rels": rels(("styles", "styles.xml"), ("numbering", "/word/numbering.xml"), ("header", "h.xml"), ("footer", "f.xml"))})


def slide(shapes):
    return f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'


def shape(kind, *paragraphs):
    holder = f'<p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>' if kind else "<p:nvSpPr/>"
    return f"<p:sp>{holder}<p:txBody>" + "".join(f'<a:p><a:pPr lvl="{lvl}">{extra}</a:pPr><a:r><a:t>{escape(text)}</a:t></a:r></a:p>' for text, lvl, extra in paragraphs) + "</p:txBody></p:sp>"


def as_pptx(slides):
    """Slides stand in the presentation in reverse of their file names."""
    n = len(slides)
    parts = {f"ppt/slides/slide{n - i}.xml": s for i, s in enumerate(slides)}
    order = "".join(f'<p:sldId id="{256 + i}" r:id="r{i}"/>' for i in range(n))
    return zipped({**parts, "_rels/.rels": rels(("officeDocument", "ppt/presentation.xml")), "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst>{order}</p:sldIdLst></p:presentation>',
                   "ppt/_rels/presentation.xml.rels": rels(*(("slide", f"slides/slide{n - i}.xml") for i in range(n)))})


@pytest.mark.parametrize("seed", range(8))
def test_generated_files_of_each_kind(seed):
    parts = spec(seed)
    assert read(el.markdown_elements(io.StringIO(as_markdown(parts)))) == parts
    assert read(el.html_elements(as_html(parts))) == parts
    found = list(el.docx_elements(io.BytesIO(as_docx(parts))))
    assert read(found[1:-1]) == parts and [(e.kind, e.text) for e in (found[0], found[-1])] == [("Header", "The header"), ("Footer", "The footer")]
    flat = [p for p in parts if p[0] in ("Title", "NarrativeText", "ListItem")]
    text = "\n\n".join(("7) " if kind == "ListItem" else "") + t for kind, t, _, _ in flat)
    assert read(el.text_elements(io.StringIO(text))) == [(k, t, int(k == "Title"), None) for k, t, _, _ in flat]


@pytest.mark.parametrize("seed", range(4))
def test_generated_slides(seed):
    rng = random.Random(seed)
    slides, expected = [], []
    for page in range(1, 12):
        if page > 1:
            expected.append(("PageBreak", "", 0, page - 1, None))
        title, items = f"Title {page} & more", [(f"item {k}", rng.randint(0, 3)) for k in range(rng.randint(0, 5))]
        cells = [[f"c{r}{c}" for c in range(2)] for r in range(2)]
        frame = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in cells) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
        body = shape("body", *[(t, lvl, "") for t, lvl in items], ("plain", 0, "<a:buNone/>"))
        group = f"<p:grpSp>{shape(None, ('boxed', 0, ''), ('dotted', 1, '<a:buChar char=.•./>'.replace('.', chr(34))))}</p:grpSp>"
        picture = '<p:pic><p:nvPicPr><p:cNvPr id="4" name="x" descr="a  picture"/></p:nvPicPr></p:pic>'
        slides.append(slide(body + shape("title", (title, 0, "")) + frame + group + picture + shape("sldNum", ("7", 0, "")) + shape("ftr", ("foot", 0, ""))))
        expected += [("Title", title, 1, page, None), *[("ListItem", t, lvl, page, None) for t, lvl in items], ("NarrativeText", "plain", 0, page, None), ("Table", "c00 | c01\nc10 | c11", 0, page, cells)]
        expected += [("NarrativeText", "boxed", 0, page, None), ("ListItem", "dotted", 1, page, None), ("Image", "a picture", 0, page, None), ("Footer", "foot", 0, page, None)]
    assert [tuple(e) for e in el.pptx_elements(io.BytesIO(as_pptx(slides)))] == expected


def test_word_details():
    inner = f"<w:tbl><w:tr><w:tc>{w_paragraph('deep')}</w:tc></w:tr></w:tbl>"
    merged = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{w_paragraph("wide")}{w_paragraph("second")}{inner}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{w_paragraph("hidden")}</w:tc><w:sdt><w:sdtContent><w:tc>{w_paragraph("b")}</w:tc></w:sdtContent></w:sdt></w:tr></w:tbl>'
    runs = '<w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:t>old</w:t></w:r></w:del><w:r><w:tab/><w:t>x</w:t><w:br w:type="page"/><w:t>next</w:t></w:r>'
    box = f'<w:r><mc:AlternateContent><mc:Choice><w:drawing><wp:docPr descr="a  box"/><w:txbxContent>{w_paragraph("in box")}</w:txbxContent></w:drawing></mc:Choice><mc:Fallback><w:txbxContent>{w_paragraph("in box")}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r>'
    body = w_paragraph("T", w_style("T")) + f"<w:sdt><w:sdtContent>{w_paragraph('controlled')}</w:sdtContent></w:sdt>" + merged + w_paragraph("", "", runs) + w_paragraph("", "<w:pageBreakBefore/>", "<w:r><w:t>three</w:t></w:r>" + box)
    body += w_paragraph("lb", w_style("LB2")) + w_paragraph("none", '<w:numPr><w:numId w:val="2"/></w:numPr>') + w_paragraph("off", w_style("B") + '<w:numPr><w:numId w:val="0"/></w:numPr>') + w_paragraph("  ")
    found = [tuple(e) for e in el.docx_elements(io.BytesIO(as_docx([], body)))][1:-1]
    assert found == [
        ("Title", "T", 0, 1, None), ("NarrativeText", "controlled", 0, 1, None), ("Table", "wide\nsecond | \n | b", 0, 1, [["wide\nsecond", ""], ["", "b"]]), ("Table", "deep", 1, 1, [["deep"]]),
        ("NarrativeText", "new xnext", 0, 1, None), ("NarrativeText", "three", 0, 3, None), ("Image", "a box", 0, 3, None), ("NarrativeText", "in box", 0, 3, None),
        ("ListItem", "lb", 1, 3, None), ("NarrativeText", "none", 0, 3, None), ("NarrativeText", "off", 0, 3, None),
    ]


def test_markdown_details():
    text = "Intro [a](u) `x*y*` \\*no\\* <b>bold</b>\n***\n> quoted\n> 1. one\n\n- outer\n\n  more\n\n      code in it\n- ![alt](p.png)\n\n![pic](x.png)\n\n| a | b |\n|---|---|\n| 1 \\| 2 |\n\n<!-- hidden\nstill -->\n\n    indented\n\n    more\n\nno | table\nEnd\n---\n~~~\nopen"
    assert read(el.markdown_elements(text.split("\n"))) == [
        ("NarrativeText", "Intro a x*y* *no* bold", 0, None), ("NarrativeText", "quoted", 0, None), ("ListItem", "one", 0, None), ("ListItem", "outer", 0, None), ("NarrativeText", "more", 0, None),
        ("NarrativeText", "code in it", 0, None), ("ListItem", "alt", 0, None), ("Image", "pic", 0, None), ("Table", "a | b\n1 | 2 | ", 0, [["a", "b"], ["1 | 2", ""]]), ("Code", "indented\n\nmore", 0, None),
        ("Title", "no | table End", 2, None), ("Code", "open", 0, None),
    ]


def test_html_details():
    text = "<h1>A<br>b</h1>loose<p>x<div>y</div></p><table><caption>cap</caption><tr><th>h<td>1<table><tr><td>n</table>2</tr><tr></tr></table><ul><li>a<ol><li>b<p>c</ol><li>d</ul></td><script><p>no</p></script><pre> p\n  q</pre><img alt='i&amp;j'><dl><dt>t<dd>d</dl>&nbsp;"
    assert read(el.html_elements(text)) == [
        ("Title", "A b", 1, None), ("NarrativeText", "loose", 0, None), ("NarrativeText", "x", 0, None), ("NarrativeText", "y", 0, None), ("Table", "h | 1 2", 0, [["h", "1 2"]]), ("Table", "n", 1, [["n"]]),
        ("ListItem", "a", 0, None), ("ListItem", "b", 1, None), ("ListItem", "c", 1, None), ("ListItem", "d", 0, None), ("Code", " p\n  q", 0, None), ("Image", "i&j", 0, None), ("NarrativeText", "t", 0, None), ("NarrativeText", "d", 0, None),
    ]
    assert el.html_elements("") == [] and el.html_elements("<" * 50) != [] and len(el.html_elements("<div>" * 20000 + "x")) == 1


@pytest.fixture
def folder(tmp_path):
    parts = spec(3)
    os.makedirs(tmp_path / "in" / "deep")
    for name, data in {
        "a.md": as_markdown(parts).encode(), "deep/b.docx": as_docx(parts), "deep/c.pptx": as_pptx([slide(shape("title", ("One", 0, ""))), slide("")]), "d.txt": "Só texto.\n\n- item".encode(), "e.html": as_html(parts).encode(),
        "empty.txt": b"", "broken.docx": as_docx(parts)[:-100], "odd.exe": b"MZ", "noname": b"x", "bad.pptx": zipped({"a": "b"}), "_hidden.txt": b"x",
    }.items():
        (tmp_path / "in" / name).write_bytes(data)
    return str(tmp_path / "in")


def test_source_reads_a_folder_and_rejects_single_files(spark, folder):
    found = files.read_elements(spark, folder)
    assert found.columns == ["path", "size", "at", "kind", "text", "level", "page", "rows", "error"]
    rows = {}
    for r in found.collect():
        rows.setdefault(r.path.rpartition("/in/")[2], []).append(r)
    assert sorted(rows) == ["a.md", "bad.pptx", "broken.docx", "d.txt", "deep/b.docx", "deep/c.pptx", "e.html", "noname", "odd.exe"]
    parts = spec(3)
    for name in ("a.md", "e.html"):
        own = sorted(rows[name], key=lambda r: r.at)
        assert [(r.kind, r.text, r.level, r.rows) for r in own] == parts and {r.error for r in own} == {None}
    assert [r.error.split(":")[0] for n in ("bad.pptx", "broken.docx", "noname", "odd.exe") for r in rows[n]] == ["KeyError", "BadZipFile", "ValueError", "ValueError"]
    assert [r.kind for r in rows["deep/c.pptx"]] == ["Title", "PageBreak"]
    assert files.read_elements(spark, folder, extensions="md,txt").select("path").distinct().count() == 2
    assert files.read_elements(spark, folder, recursive="false").where("path like '%deep%'").count() == 0


def test_partitions_follow_sizes(spark, folder):
    assert files.read_elements(spark, folder).rdd.getNumPartitions() == 1
    assert files.read_elements(spark, folder, partitionBytes=1).rdd.getNumPartitions() == 9  # the empty file shares one
    sizes = [(f"{i}.md", 10, 0) for i in range(10)] + [("z.txt", 95, 0)]
    plan = files.planned(sizes, 30, 20, ("txt",))
    assert [[s.path for s in p.slices] for p in plan[:3]] == [["0.md", "1.md", "2.md"], ["3.md", "4.md", "5.md"], ["6.md", "7.md", "8.md"]]
    assert [(s.start, s.end) for p in plan for s in p.slices if s.path == "z.txt"] == [(0, 20), (20, 40), (40, 60), (60, 80), (80, 95)]


@pytest.mark.parametrize("split", [1, 7, 64, 1000])
def test_parts_of_a_text_file_give_each_paragraph_once(spark, tmp_path, split):
    rng = random.Random(split)
    text = "".join(rng.choice(["word é ", "Line\n", "\n", "\n\n", "- item\n", "  \n"]) for _ in range(400))
    (tmp_path / "t.txt").write_bytes(text.encode())
    whole = list(el.text_elements(io.StringIO(text, newline="\n")))
    found = files.read_elements(spark, str(tmp_path), splitBytes=split, partitionBytes=max(split, 200)).orderBy("at").collect()
    assert [(r.kind, r.text) for r in found] == [(e.kind, e.text) for e in whole] and len({r.at for r in found}) == len(found)


def test_columns_and_filters_reach_the_reader(spark, folder):
    files.register(spark)
    narrow = spark.read.format("file_elements").schema("kind string, path string").load(folder)
    assert narrow.columns == ["kind", "path"] and narrow.where("path like '%a.md'").count() == len(spec(3))
    tables = files.read_elements(spark, folder).where("kind = 'Table' and path like '%.md'")
    assert {r.kind for r in tables.collect()} == {"Table"}
    assert tables.rdd.getNumPartitions() == 1 and files.read_elements(spark, folder, partitionBytes=1).where(F.col("path").endswith(".md")).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="no column"):
        spark.read.format("file_elements").schema("colour string").load(folder).count()


def test_pages(spark, folder):
    found = {}
    for r in files.read_pages(spark, folder).orderBy("path", "page").collect():
        found.setdefault(r.path.rpartition("/in/")[2], []).append((r.page, r.text, r.error and r.error.split(":")[0]))
    assert found["d.txt"] == [(1, "Só texto.\n\n- item", None)] and found["deep/c.pptx"] == [(1, "One", None), (2, "", None)][: len(found["deep/c.pptx"])]
    assert found["odd.exe"] == [(None, None, "ValueError")] and "empty.txt" not in found
    assert found["deep/b.docx"][0][1].split("\n")[0] == spec(3)[0][1].split("\n")[0]


def test_stream_takes_new_files_only(spark, tmp_path):
    files.register(spark)
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.txt").write_text("First one.")
    stream = spark.readStream.format("file_elements").load(str(tmp_path / "in"))

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["First one."]
    (tmp_path / "in" / "b.md").write_text("# Second\n")
    os.utime(tmp_path / "in" / "b.md", (2_000_000_000, 2_000_000_000))
    assert run() == ["First one.", "Second"]
    assert run() == ["First one.", "Second"]


def test_elements_go_on_to_chunks(spark, folder):
    chunks = chunking.element_chunks(files.packable(files.read_elements(spark, folder, extensions="md,docx")), "path").collect()
    whole = "\n".join(c.text for c in chunks)
    assert all(t in whole for k, t, _, _ in spec(3) if k == "NarrativeText")


def test_trees_of_a_table(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (2, None, "y"), (None, "<h2>c", None), (1, "<p>a<p>b", "x")], "page_id int, html string, text string")
    found = sorted(((r.page_id, r.at, r.kind, r.text) for r in readers.tree_elements(pages).collect()), key=str)
    assert found == sorted([(1, 0, "NarrativeText", "a"), (1, 1, "NarrativeText", "b")] * 2 + [(None, 0, "Title", "c")], key=str)
    assert readers.tree_elements(pages.limit(0)).collect() == []


def test_references_without_a_semicolon_are_text(spark):
    html = "<h1>a&&&amp</h1><p>x &amp;lt; &lt b &copy=1 &notit; &eacute;&#65;&#x42; &#67 &unknown; &"
    assert read(el.html_elements(html)) == [("Title", "a&&&amp", 1, None), ("NarrativeText", "x &lt; &lt b &copy=1 &notit; éAB &#67 &unknown; &", 0, None)]
    pages = spark.createDataFrame([(1, html.replace("&eacute;&#65;&#x42;", ""))], "page_id int, html string")
    flat = [(r.at, r.kind, r.text) for r in readers.html_elements(pages).collect()]
    assert [(r.at, r.kind, r.text) for r in readers.tree_elements(pages).collect()] == flat
