"""From a file's bytes to sections of text, by format.

Every extractor takes bytes and returns sections; a section has its text and a
page, which is 0 where the format has none. Archives are read with a bound on
what they inflate to.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import FORMATS
from ..functions.text import PY_SPACE, strip_junk, trim_space
from .layout import RUNS, Run, page_text

#: Most bytes that a part of an archive may inflate to.
PART_BYTES = 512 << 20
_JUNK = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f-�\U000f0000-\U000ffffd\U00100000-\U0010fffd]")


@dataclass(frozen=True)
class Section:
    text: str
    page: int = 0
    scan_skipped: bool = False
    scan_failed: bool = False
    runs: Sequence[Run] = ()


class ExtractError(ValueError):
    """A file that can't be read as what its name says."""


def _kept(texts) -> list[Section]:
    return [Section(t) for t in (x.strip(PY_SPACE) for x in texts) if t]


def plain_text(data: bytes) -> list[Section]:
    return _kept([data.decode("utf-8", "replace")])


def markdown(data: bytes) -> list[Section]:
    """Sections begin at headings outside fenced blocks."""
    sections, fenced = [[]], False
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        bare = line.lstrip(" ")
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and re.match(r"#{1,6} ", bare):
            sections.append([])
        sections[-1].append(line)
    return _kept("\n".join(s) for s in sections)


#: Elements whose text is left out, and elements at whose edges a paragraph ends. Fixed values.
DROPPED = ("script", "style", "head", "noscript", "template")
BLOCKS = (
    "p", "div", "br", "hr", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "section", "article", "header", "footer", "main", "aside", "nav", "figure", "figcaption", "address", "table", "tr", "td", "th", "caption",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class _Page(HTMLParser):
    """Visible text as sections of paragraphs. A body, or anything that can't be in a head, ends an open head."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[list[str]] = [[]]
        self.words: list[str] = []
        self.open: list[str] = []

    def end_paragraph(self):
        if text := " ".join("".join(self.words).split()):
            self.sections[-1].append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag == "body" and "head" in self.open:
            self.open = self.open[: self.open.index("head")]
        if tag in DROPPED:
            self.open.append(tag)
        elif not self.open and (tag in BLOCKS or tag in HEADINGS):
            self.end_paragraph()
            if tag in HEADINGS:
                self.sections.append([])

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        elif not self.open and (tag in BLOCKS or tag in HEADINGS):
            self.end_paragraph()

    def handle_data(self, data):
        if not self.open:
            self.words.append(data)


def html(data: bytes) -> list[Section]:
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    page.end_paragraph()
    return _kept("\n\n".join(s) for s in page.sections)


def _part(archive: zipfile.ZipFile, name: str) -> bytes:
    with archive.open(name) as f:
        data = f.read(PART_BYTES + 1)
    if len(data) > PART_BYTES:
        raise ExtractError(f"{name} inflates to over {PART_BYTES} bytes")
    return data


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExtractError(str(e)) from e


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx(data: bytes) -> list[Section]:
    """Paragraphs by line; a heading or title style begins a section."""
    archive = _archive(data)
    if "word/document.xml" not in archive.namelist():
        raise ExtractError("no word/document.xml")
    sections, line, heads = [[]], [], False
    try:
        for event, node in ElementTree.iterparse(io.BytesIO(_part(archive, "word/document.xml")), ("start", "end")):
            name = _local(node.tag)
            if event == "start":
                if name == "p":
                    line, heads = [], False
                continue
            if name == "pStyle":
                style = next((v for k, v in node.attrib.items() if _local(k) == "val"), "").lower()
                heads = style.startswith("heading") or style == "title"
            elif name == "t":
                line.append(node.text or "")
            elif name == "tab":
                line.append(" ")
            elif name in ("br", "cr"):
                line.append("\n")
            elif name == "p":
                text = "".join(line).strip(PY_SPACE)
                if text:
                    if heads:
                        sections.append([])
                    sections[-1].append(text)
                line, heads = [], False
                node.clear()
    except ElementTree.ParseError as e:
        raise ExtractError(str(e)) from e
    return _kept("\n\n".join(s) for s in sections)


def pptx(data: bytes) -> list[Section]:
    """A section for each slide that isn't blank; its page is the slide's place."""
    archive = _archive(data)
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if not slides:
        raise ExtractError("no slides")
    out = []
    for place, (_, name) in enumerate(slides, 1):
        lines = []
        try:
            root = ElementTree.fromstring(_part(archive, name))
        except ElementTree.ParseError as e:
            raise ExtractError(str(e)) from e
        for p in root.iter():
            if _local(p.tag) == "p":
                words = [(n.text or "") if _local(n.tag) == "t" else " " if _local(n.tag) == "tab" else "\n" if _local(n.tag) == "br" else "" for n in p.iter()]
                lines.append("".join(words).strip(PY_SPACE))
        if text := "\n".join(x for x in lines if x):
            out.append(Section(text, place))
    return out


def _visible(markup: str) -> str:
    page, texts = _Page(), []
    page.handle_data = lambda d: texts.append(d) if not page.open else None
    page.feed(markup)
    page.close()
    return " ".join(x for x in (" ".join(t.split()) for t in texts) if x)


def _body(message) -> str:
    if message.is_multipart():
        plain, rich = [], []
        for part in message.iter_parts() if hasattr(message, "iter_parts") else message.get_payload():
            if (part.get_content_disposition() or "").startswith("attachment"):
                continue
            text = _body(part)
            if text:
                (rich if part.get_content_type() == "text/html" else plain).append(text)
        return "\n\n".join(plain or rich)
    kind = message.get_content_type()
    if kind not in ("text/plain", "text/html"):
        return ""
    data = message.get_payload(decode=True) or b""
    text = data.decode("utf-8", "replace") if kind else ""
    return _visible(text) if kind == "text/html" else text.replace("\r\n", "\n").strip(PY_SPACE)


#: Longest line of a mailbox, in bytes.
MAIL_LINE = 8 << 20


def message_text(raw: bytes) -> str:
    """Subject, sender and date of a message, then its body; a message that can't be parsed as it is."""
    try:
        message = email.message_from_bytes(raw, policy=email.policy.default)
        head = [f"{name}: {message[name]}" for name in ("Subject", "From", "Date") if message[name]]
        text = "\n".join(head) + "\n\n" + _body(message)
    except Exception:
        text = raw.decode("utf-8", "replace")
    return text.strip(PY_SPACE)


def mbox(data: bytes) -> list[Section]:
    """A section for each message, its place as page: subject, sender and date, then the body."""
    if not data.startswith(b"From "):
        raise ExtractError("the first line doesn't begin a message")
    messages: list[list[bytes]] = []
    for line in data.split(b"\n"):
        if len(line) > MAIL_LINE:
            raise ExtractError("a line is too long")
        if line.startswith(b"From "):
            messages.append([])
        else:
            messages[-1].append(re.sub(rb"^>(>*From )", rb"\1", line))
    texts = ((place, message_text(b"\n".join(lines))) for place, lines in enumerate(messages, 1))
    return [Section(text, place) for place, text in texts if text]


class Page(NamedTuple):
    """A PDF page: its flat text, whether it has an image, and its positioned runs if they are known."""

    text: str
    image: bool = False
    runs: Sequence[Run] = ()


#: What reads PDF pages: (bytes) -> pages, or (text, image) pairs; None where no library is installed.
PdfBackend = Callable[[bytes], list[Page | tuple[str, bool]]]
#: What reads the text of a page's picture: (bytes, page) -> text. LookupError: none is at hand.
Transcriber = Callable[[bytes, int], str]


def pypdf_page(page) -> Page:
    """A pypdf page with its runs."""
    runs: list[Run] = []

    def visit(text, cm, tm, font, size):
        x, y = tm[4] * cm[0] + tm[5] * cm[2] + cm[4], tm[4] * cm[1] + tm[5] * cm[3] + cm[5]
        height = abs(size * tm[3] * cm[3]) or size or 1.0
        for n, part in enumerate(text.split("\n")):
            # Widths aren't given; half the height a character is the usual one.
            top = y - n * height * 1.2
            runs.append(Run(part, x, x + 0.5 * height * len(part), top + 0.8 * height, top - 0.2 * height, height, str((font or {}).get("/BaseFont", ""))))

    flat = page.extract_text(visitor_text=visit) or ""
    return Page(flat, bool(len(page.images)), runs)


def pypdf_backend() -> PdfBackend | None:
    """Pages by pypdf, where it is installed."""
    import importlib.util

    if importlib.util.find_spec("pypdf") is None:
        return None

    def pages(data: bytes) -> list[tuple[str, bool]]:
        import pypdf

        return [pypdf_page(p) for p in pypdf.PdfReader(io.BytesIO(data)).pages]

    return pages


def pdf(data: bytes, backend: PdfBackend | None = None, transcribe: Transcriber | None = None) -> list[Section]:
    """A section for every page, blank ones too, with the page's runs; extract_files() puts them together. A page that is a picture is transcribed, or marked skipped or failed."""
    backend = backend or pypdf_backend()
    if backend is None:
        raise ExtractError("no PDF backend is installed")
    out = []
    try:
        pages = backend(data)
    except Exception as e:
        raise ExtractError(f"not a readable PDF: {e}") from e
    for place, page in enumerate((Page(*p) for p in pages), 1):
        section = Section(page.text.strip(PY_SPACE), place, runs=page.runs)
        if page.image and not section.text and not any(r.text.strip(PY_SPACE) for r in page.runs):
            try:
                seen = transcribe(data, place).strip(PY_SPACE) if transcribe else None
                section = Section(seen or "", place, scan_skipped=seen is None, scan_failed=seen == "")
            except LookupError:
                section = replace(section, scan_skipped=True)
            except Exception:
                section = replace(section, scan_failed=True)
        out.append(section)
    return out


READERS = {".md": markdown, ".markdown": markdown, ".txt": plain_text, ".docx": docx, ".pdf": pdf, ".pptx": pptx, ".html": html, ".htm": html, ".mbox": mbox}
assert set(READERS) == set(FORMATS)


def extract(path: str, data: bytes, backend: PdfBackend | None = None, transcribe: Transcriber | None = None) -> list[Section]:
    """The sections of a file, without junk characters. ExtractError for unsupported or broken files."""
    m = re.search(r"\.[^./]*$", path)
    reader = READERS.get(m[0].lower() if m else "")
    if reader is None:
        raise ExtractError(f"unsupported format: {path}")
    found = reader(data, backend, transcribe) if reader is pdf else reader(data)
    return [replace(s, text=_JUNK.sub("", s.text)) for s in found]


SECTIONS = "array<struct<text: string, page: int, scan_skipped: boolean, scan_failed: boolean>>"


def extract_files(files: DataFrame, key: str = "path", content: str = "content", name: str | None = None, backend: PdfBackend | None = None, transcribe: Transcriber | None = None) -> DataFrame:
    """(key, sections, error) of files (key, content): a broken file has an error and no sections, and stops nothing.

    name: the column with the file's name, if it isn't the key. backend,
    transcribe: what reads PDF pages and their pictures; sent to the tasks.
    """
    kind, name = dict(files.dtypes)[key], name or key
    run = pa.struct([(c, pa.string() if c in ("text", "font_name") else pa.float64()) for c in Run._fields])
    item = pa.struct([("text", pa.string()), ("page", pa.int32()), ("scan_skipped", pa.bool_()), ("scan_failed", pa.bool_()), ("runs", pa.list_(run))])

    def work(batches):
        for batch in batches:
            sections, errors = [], []
            for path, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    found = extract(str(path), data.as_py() or b"", backend, transcribe)
                    sections.append([vars(s) | {"runs": [r._asdict() for r in s.runs]} for s in found])
                    errors.append(None)
                except ExtractError as e:
                    sections.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sections, pa.list_(item)), pa.array(errors, pa.string())], names=[key, "sections", "error"])

    rows = files.select(F.col(key).alias("_key"), F.col(name).cast("string").alias("_name"), F.col(content).cast("binary").alias("_content"))
    found = rows.mapInArrow(work, f"{key} {kind}, sections {SECTIONS[:-2]}, runs: {RUNS}>>, error string")

    def text(s: Column) -> Column:
        built = strip_junk(trim_space(page_text(s["runs"])))
        return F.when(F.size(s["runs"]) == 0, s["text"]).otherwise(F.coalesce(F.nullif(built, F.lit("")), s["text"]))

    section = lambda s: F.struct(text(s).alias("text"), *[s[c].alias(c) for c in ("page", "scan_skipped", "scan_failed")])
    return found.select(key, F.transform("sections", section).alias("sections"), "error")


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, text) of markdown texts, by window functions only: as markdown(), for many small files.

    Lines are numbered, fences counted up to each line, headings counted
    outside open fences, and the lines of each count joined again.
    """
    from pyspark.sql.window import Window

    lines = docs.select(F.col(key), F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")).alias("n", "line"))
    bare = F.regexp_replace("line", r"^ +", "")
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith(bare, F.lit("```")) | F.startswith(bare, F.lit("~~~"))
    lines = lines.withColumn("fence", fence.cast("int")).withColumn("fences", F.sum("fence").over(so_far))
    heading = (F.col("fence") == 0) & (F.col("fences") % 2 == 0) & bare.rlike(r"^#{1,6} ")
    lines = lines.withColumn("part", F.sum(heading.cast("int")).over(so_far))
    joined = lines.groupBy(key, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("_text"))
    cleaned = joined.withColumn("text", trim_space(F.col("_text"))).where("text <> ''")
    return cleaned.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1).alias("section"), "text")
