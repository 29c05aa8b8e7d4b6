"""Extractors, layout, folders and settings."""

import importlib.machinery
import io
import sys
import types
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestack.sources import extract, folder, layout


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def texts(sections):
    return [s.text for s in sections]


def test_markdown():
    body = b"intro\r\n# One\r\ntext\n```\n# not a heading\n```\n  ## Two\n#not\n### Three\n"
    assert texts(extract.extract("a.MD", body)) == ["intro", "# One\ntext\n```\n# not a heading\n```", "## Two\n#not", "### Three"]


def test_html():
    body = b"""<html><head><title>t</title><script>var x = "<p>";</script></head><body>intro  <b>bold</b>
    text<p>next<h1>One</h1><p>a&amp;b<br>c</p><noscript>no</noscript><style>p{}</style><h2>Two</h2>last</body></html>"""
    assert texts(extract.extract("a.html", body)) == ["intro bold text\n\nnext", "One\n\na&b\n\nc", "Two\n\nlast"]


def test_html_open_head():
    assert texts(extract.html(b"<head><title>t<body>seen")) == ["seen"]
    assert extract.html(b"") == []


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def p(text, style=None):
        return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'

    body = f"<w:document {w}><w:body>{p('before')}{p('Name', 'Title')}{p('body')}{p('Part', 'Heading1')}<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>"
    assert texts(extract.extract("x.docx", archive(word__document_xml=body).replace(b"word/document_xml", b"word/document.xml"))) == ["before", "Name\n\nbody", "Part\n\na b"]


def test_pptx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in ((10, "ten"), (2, ""), (1, "one")):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<sld xmlns:a="x"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", "<r/>")
    assert [(s.text, s.page) for s in extract.extract("x.pptx", out.getvalue())] == [("one", 1), ("ten", 3)]


def test_mbox():
    body = (
        b"From a@x Mon\nSubject: =?utf-8?B?R3LDvMOfZQ==?=\nFrom: a@x\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n\nbody\n>From quoted\n>>From twice\n"
        b"From b@x Tue\nSubject: two\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nca=66=C3=A9\n"
        b"--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\nContent-Transfer-Encoding: base64\n\nc2VjcmV0\n--B--\n"
        b"From c@x Wed\nContent-Type: text/html\n\n<style>p{}</style><p>only <b>html</b></p>\n"
    )
    found = extract.extract("m.mbox", body)
    assert [s.page for s in found] == [1, 2, 3]
    assert "Subject: Grüße" in found[0].text
    assert "\nFrom quoted\n>From twice" in found[0].text
    assert "café" in found[1].text
    assert "secret" not in found[1].text and "c2Vj" not in found[1].text
    assert found[2].text == "only html"
    with pytest.raises(extract.ExtractError):
        extract.mbox(b"hello")


def test_pdf_pages():
    pages = lambda data: [("one", False), ("", True), ("", False)]

    def unavailable(data, page):
        raise LookupError

    def broken(data, page):
        raise OSError

    assert [(s.text, s.page, s.scan_skipped, s.scan_failed) for s in extract.pdf(b"", pages)] == [("one", 1, False, False), ("", 2, True, False), ("", 3, False, False)]
    assert extract.pdf(b"", pages, unavailable)[1].scan_skipped
    assert extract.pdf(b"", pages, broken)[1].scan_failed
    assert extract.pdf(b"", pages, lambda d, p: " ")[1].scan_failed
    assert extract.pdf(b"", pages, lambda d, p: "read")[1].text == "read"


@pytest.mark.parametrize("name", ["x.docx", "x.pptx", "x.mbox", "x.jpg", "x", "x.zip"])
def test_broken_files(name):
    with pytest.raises(extract.ExtractError):
        extract.extract(name, b"garbage")


def test_junk():
    assert texts(extract.extract("a.txt", "a\tb\nc\x00\x9f�d".encode())) == ["a\tb\ncd"]


def run(text, left, right, top, bottom, size=10.0, font="Sans"):
    return layout.Run(text, float(left), float(right), float(top), float(bottom), size, font)


def assemble(spark, *pages):
    df = spark.createDataFrame([(n, p) for n, p in enumerate(pages)], f"n int, runs {layout.RUNS}")
    return [r["text"] for r in df.orderBy("n").select(layout.page_text(F.col("runs")).alias("text")).collect()]


def test_layout(spark):
    rows = [
        run("world", 30, 50, 100, 90), run("hello", 0, 20, 100, 90), run("next", 0, 20, 89, 79),
        run("far", 0, 20, 50, 40), run("• item", 0, 20, 39, 29), run("x", 0, 5, 39, 29, font="FontAwesome5"), run("Big", 0, 20, 28, 10, 18.0), run("column", 60, 90, 100, 90),
    ]
    assert assemble(spark, rows, [], [run("  ", 0, 5, 10, 0)], None) == ["hello world\nnext\n\nfar\n\n• item\n\nBig\n\ncolumn", "", "", None]


def test_layout_rules(spark):
    """Each limit on both sides: overlap, blanks, gap, rise, font size, marks of items; odd boxes and missing values."""
    a = run("a", 0, 5, 100, 90)
    cases = [
        ([a, run("b", 6, 9, 95, 85)], "a\nb"),  # half of the box isn't enough for a line, nor for a rise
        ([a, run("b", 6, 9, 96, 86)], "ab"),
        ([a, run("b", 6.1, 9, 100, 90)], "a b"),
        ([a, run(" b", 8, 9, 100, 90)], "a b"),
        ([a, run("b", 0, 5, 82, 72)], "a\nb"),
        ([a, run("b", 0, 5, 81, 71)], "a\n\nb"),
        ([a, run("b", 0, 5, 200, 190)], "a\n\nb"),
        ([a, run("b", 0, 5, 89, 79, 11.5)], "a\nb"),
        ([a, run("b", 0, 5, 89, 79, 11.6)], "a\n\nb"),
        ([a, run("b", 0, 5, 89, 79, 8.6)], "a\n\nb"),
        ([a, run("b", 0, 5, 89, 79, 0.0)], "a\nb"),
        ([a, run("- b", 0, 5, 89, 79)], "a\n\n- b"),
        ([a, run("-b", 0, 5, 89, 79)], "a\n-b"),
        ([a, run("b", 0, 5, 90, 90)], "a\nb"),
        ([run("b", 3, 4, 50, 50), run("a", 3, 4, 50, 50)], "b\na"),  # boxes without a height
        ([run("tie", 0, 1, 9, 0), run("d", 0, 1, 9, 0, font=None)], "tied"),
    ]
    got = assemble(spark, *[c for c, _ in cases])
    assert [(n, g) for n, g in enumerate(got)] == [(n, w) for n, (_, w) in enumerate(cases)]


def test_layout_of_a_full_page(spark):
    """Three thousand lines of two runs each, and one line of three thousand runs."""
    tall = [run(f"{w}{n}", 10 * k, 10 * k + 5, -11 * n, -11 * n - 10) for n in range(3000) for k, w in enumerate("ab")]
    wide = [run(f"w{n}", 10 * n, 10 * n + 5, 10, 0) for n in reversed(range(3000))]
    assert assemble(spark, tall, wide) == ["\n".join(f"a{n} b{n}" for n in range(3000)), " ".join(f"w{n}" for n in range(3000))]


def test_layout_frames(spark):
    rows = [("a", 1, n, t, 0.0, 20.0, 100.0 - 11 * n, 90.0 - 11 * n, 10.0, "Sans") for n, t in enumerate(["one", "two"])]
    df = spark.createDataFrame(rows, "path string, page int, n int, text string, left double, right double, top double, bottom double, font_size double, font_name string")
    assert [tuple(r) for r in layout.assemble_pages(df).collect()] == [("a", 1, "one\ntwo")]


def test_settings(tmp_path):
    assert folder.load_config(str(tmp_path)) == folder.Config()
    config = folder.Config("work", ["*.log", "dir/**"])
    folder.save_config(str(tmp_path), config)
    assert folder.load_config(str(tmp_path)) == config
    assert folder.parse_config("exclude: [a, 'b']\ntag: x # y").exclude == ["a", "b"]
    for bad in ("tag: [", "exclude: ['[a']", "what: 1", "exclude: a", 'tag: "x'):
        with pytest.raises(ValueError):
            folder.parse_config(bad)


def test_markdown_frames(spark):
    texts_ = ["intro\n# One\nx\n```\n# no\n```\n## Two", "", "plain", "# a\r\nb\n\n  # c"]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = {}
    for r in extract.markdown_sections(df).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: w for i, t in enumerate(texts_) if (w := [s.text for s in extract.markdown(t.encode())])}


def test_pdf_runs_become_lines(monkeypatch, spark):
    """pypdf's runs, as its visitor hands them over, are put together by their places; pictures are transcribed."""
    font = {"/BaseFont": "/Body"}

    class Page:
        def __init__(self, runs, images=(), flat="flat"):
            self.runs, self.images, self.flat = runs, images, flat

        def extract_text(self, visitor_text=None):
            for x, y, text in self.runs:
                visitor_text(text, [1, 0, 0, 1, 0, 0], [1, 0, 0, 1, x, y], font, 10)
            return self.flat

    body = Page([(50, 700, "world"), (10, 700, "Hello"), (10, 688, "again"), (10, 600, "Next part")])
    pages = [body, Page([], ["picture"], ""), Page([])]
    module = types.ModuleType("pypdf")
    module.__spec__ = importlib.machinery.ModuleSpec("pypdf", None)
    module.PdfReader = lambda f: types.SimpleNamespace(pages=pages)
    monkeypatch.setitem(sys.modules, "pypdf", module)
    read = extract.pypdf_backend()(b"")
    file = spark.createDataFrame([("a.pdf", b"x")], "path string, content binary")
    (row,) = extract.extract_files(file, backend=lambda data: read, transcribe=lambda data, page: f"seen on {page}").collect()
    assert [(s["text"], s["page"]) for s in row["sections"]] == [("Hello world\nagain\n\nNext part", 1), ("seen on 2", 2), ("flat", 3)]

    files = spark.createDataFrame([("a.pdf", b"x"), ("b.txt", b"plain")], "path string, content binary")
    rows = extract.extract_files(files, backend=lambda data: [("", True), ("text", False)], transcribe=lambda data, page: "picture").collect()
    assert {r["path"]: [s["text"] for s in r["sections"]] for r in rows} == {"a.pdf": ["picture", "text"], "b.txt": ["plain"]}


def test_comments_in_settings():
    config = folder.parse_config("tag: 'it # is' # mine\nexclude: # these\n  - \"a #b/**\"\n  - c#d.txt # e\n")
    assert (config.tag, config.exclude) == ("it # is", ["a #b/**", "c#d.txt"])
    assert folder.parse_config("tag: don't # say").tag == "don't"


def test_mailboxes_by_ranges(spark, tmp_path):
    """Conversations as one mailbox, read in some fifty ranges: the whole-file reader's messages."""
    from lodestack.sources import mailbox

    from .conftest import SF

    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").limit(600).collect()
    mails = [f"From {r['role']} now\nSubject: {r['conv_id']}/{r['turn']}\nFrom: {r['role']}\n\n{r['text'] or ''}\n>From here\n" + ("line\n" * 2000 if n % 97 == 0 else "") for n, r in enumerate(turns)]
    data = "".join(mails).encode() + b"From \xff\nContent-Type: text/plain\n\n\xe9 last, without an end"
    (tmp_path / "a.mbox").write_bytes(data)
    (tmp_path / "b.mbox").write_bytes(b"From x\n\nonly one")
    (tmp_path / "c.mbox").write_bytes(b"no message\nFrom x\n\ny")
    (tmp_path / "d.mbox").write_bytes(b"From x\n\n" + b"z" * (extract.MAIL_LINE + 1) + b"\nFrom y\n\nw")
    (tmp_path / "e.mbox").write_bytes(b"")
    got = mailbox.messages(spark, f"{tmp_path}/[bcde].mbox").collect()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(data) // 50))
        got += mailbox.messages(spark, str(tmp_path / "a.mbox")).collect()
        assert mailbox.fragments(spark, str(tmp_path / "a.mbox")).where("body is null").count() >= 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    of = lambda name: sorted((r["page"], r["text"]) for r in got if r["path"].endswith(name) and not r["error"])
    assert of("a.mbox") == [(s.page, s.text) for s in extract.mbox(data)]
    assert of("b.mbox") == [(1, "only one")]
    assert {r["path"][-6]: r["error"] for r in got if r["error"]} == {"c": "the first line doesn't begin a message", "d": "a line is too long"}
    for name in "cd":
        with pytest.raises(extract.ExtractError):
            extract.mbox((tmp_path / f"{name}.mbox").read_bytes())
    assert of("c.mbox") == of("d.mbox") == of("e.mbox") == []
