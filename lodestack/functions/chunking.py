"""Splitting sections into overlapping chunks, by bytes of UTF-8."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import PY_SPACE

#: Most bytes of a chunk, and most bytes that the next chunk repeats.
BUDGET, OVERLAP = 2000, 250
SCHEMA = "seq int, page int, text string"


def rune_floor(data: bytes, at: int) -> int:
    """The last place not after `at` where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def tail(text: str) -> str:
    """What the next chunk repeats of a chunk: its end from a word on; nothing of a short one."""
    data = text.strip(PY_SPACE).encode()
    if len(data) <= OVERLAP:
        return ""
    end = data[rune_floor(data, len(data) - OVERLAP) :].decode()
    return end[end.find(" ") + 1 :].strip(PY_SPACE)


def _after_space(data: bytes, at: int) -> int:
    """The first place from `at` on where white space ends."""
    while at < len(data):
        ahead = data[at : rune_floor(data, at + 256)].decode()
        blank = len(ahead) - len(ahead.lstrip(PY_SPACE))
        at += len(ahead[:blank].encode())
        if blank < len(ahead):
            break
    return at


def cut_long(text: str) -> list[str]:
    """Pieces of a text without breaks: cut at the last blank that fits, each after the first led by an overlap.

    The text is encoded once and an offset moves over it: the time is linear.
    """
    data, out, lead, at = text.encode(), [], b"", 0
    while len(lead) + len(data) - at > BUDGET:
        ahead = lead + data[at : at + BUDGET + 4]
        cut = ahead[:BUDGET].rfind(b" ")
        # A lead over OVERLAP, to a whole character, would be its own tail for ever: it isn't a piece by itself.
        if cut <= 0 or OVERLAP < cut < len(lead):
            cut = rune_floor(ahead, BUDGET)
        if not out:
            data = data.decode().rstrip(PY_SPACE).encode()
        out.append(ahead[:cut].decode())
        # A lead ends with a blank, so a cut never falls before that.
        at = _after_space(data, at + max(0, cut - len(lead)))
        repeated = tail(out[-1])
        lead = f"{repeated} ".encode() if repeated else b""
    rest = (lead + data[at:]).decode()
    return [*out, rest] if rest.strip(PY_SPACE) else out


def line_pieces(paragraph: str) -> list[str]:
    """A paragraph over the budget as trimmed pieces of whole lines; a longer line is cut. Blank pieces are left out."""
    out, held, size = [], [], 0

    def close() -> None:
        if piece := "\n".join(held).strip(PY_SPACE):
            out.append(piece)
        held.clear()

    for line in paragraph.split("\n"):
        n = len(line.encode())
        if size + n + 1 > BUDGET:
            close()
            size = 0
        if n > BUDGET:
            out += cut_long(line)
        else:
            held.append(line)
            size += n + 1
    close()
    return out


def split_section(text: str) -> list[str]:
    """The chunks of one section: paragraphs packed up to the budget, each chunk led by the last one's tail if it fits."""
    paragraphs = (p.strip(PY_SPACE) for p in text.replace("\r\n", "\n").split("\n\n"))
    pieces = [x for p in paragraphs if p for x in (line_pieces(p) if len(p.encode()) > BUDGET else [p])]
    out, buffer, size = [], [], 0
    for piece in pieces:
        n = len(piece.encode())
        if buffer and size + n + 2 > BUDGET:
            whole = "\n\n".join(buffer)
            out.append(whole)
            lead = tail(whole)
            fits = bool(lead) and len(lead.encode()) + n + 2 <= BUDGET
            buffer, size = ([lead], len(lead.encode()) + 2) if fits else ([], 0)
        buffer.append(piece)
        size += n + 2
    out.append("\n\n".join(buffer))
    return [c for c in (x.strip(PY_SPACE) for x in out) if c]


def split_sections(sections: list[tuple[str, int]]) -> list[tuple[int, int, str]]:
    """(seq, page, text) of a file's (text, page) sections; a chunk never crosses a section."""
    found = [(page, chunk) for text, page in sections for chunk in split_section(text)]
    return [(seq, page, chunk) for seq, (page, chunk) in enumerate(found)]


def chunk_files(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, seq, page, text) from files (key, sections array<struct<text, page>>), by Arrow batches."""
    kind = dict(files.dtypes)[key]

    def work(batches):
        for batch in batches:
            keys, rows = batch.column(0), []
            for i, sections in enumerate(batch.column(1).to_pylist()):
                rows += [(i, *c) for c in split_sections([(s["text"] or "", s["page"] or 0) for s in sections or []])]
            if rows:
                at, seq, page, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(seq, pa.int32()), pa.array(page, pa.int32()), pa.array(text)], names=[key, "seq", "page", "text"])

    return files.select(key, "sections").mapInArrow(work, f"{key} {kind}, {SCHEMA}")
