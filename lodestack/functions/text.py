"""Text as column expressions: cleaning, folding, tokens, citations, renderings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as a regular expression's class body.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: C0 controls but tab and newline, DEL and C1, private use, the replacement character.
JUNK = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Co}\x{FFFD}]"
#: Characters of index terms, after folding.
TERM = r"[\p{L}\p{N}\p{Co}]+"

PY_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def trim_space(c: Column) -> Column:
    """Without Unicode white space at either end (trim() takes blanks only)."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_junk(c: Column) -> Column:
    return F.regexp_replace(c, JUNK, "")


def one_line(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


@lru_cache(1)
def fold_tables() -> tuple[str, str]:
    """Lower-case letters that decompose into one base letter and one mark, and their base letters; final sigma as sigma."""
    marked, plain = ["ς"], ["σ"]
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn" and chr(code).lower() == chr(code):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fold(c: Column) -> Column:
    """Lower case without diacritics: the form in which terms are indexed and looked up."""
    marked, plain = fold_tables()
    low = F.lower(c)
    return F.when(is_ascii(low), low).otherwise(F.translate(F.regexp_replace(low, r"\p{Mn}", ""), marked, plain))


def terms(c: Column) -> Column:
    """The index terms of a text, in order. Plain ASCII, the common case, has simpler rules to the same end."""
    low = F.lower(c)
    return F.when(is_ascii(low), F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))).otherwise(F.regexp_extract_all(fold(c), F.lit(f"({TERM})"), F.lit(1)))


_MARKS, _TERM = regex.compile(r"\p{Mn}+"), regex.compile(TERM)


@lru_cache(1)
def _fold_map() -> dict[int, str]:
    return dict(zip(map(ord, fold_tables()[0]), fold_tables()[1], strict=True))


@lru_cache(1 << 14)
def py_fold(text: str) -> str:
    """fold() for a query or a token in Python."""
    return _MARKS.sub("", text.lower()).translate(_fold_map())


def py_terms(text: str) -> list[str]:
    """terms() in Python."""
    return _TERM.findall(py_fold(text))


def py_words(query: str) -> list[str]:
    """A query's words: parts between white space."""
    return [w for w in re.split(f"[{re.escape(PY_SPACE)}]+", query) if w]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def citation(path: Column, page: Column, seq: Column) -> Column:
    """path (page N), or path (chunk N) where there are no pages."""
    return F.when(page > 0, F.format_string("%s (page %d)", path, page)).otherwise(F.format_string("%s (chunk %d)", path, seq + 1))


def prompt_label(path: Column, page: Column, seq: Column) -> Column:
    """file name, page N, or file name, section N where there are no pages."""
    return F.when(page > 0, F.format_string("%s, page %d", base_name(path), page)).otherwise(F.format_string("%s, section %d", base_name(path), seq + 1))


def numbered(position: Column, label: Column, passage: Column) -> Column:
    """[i] label, then the passage: one entry of a rendered list."""
    return F.format_string("[%d] %s\n%s\n\n", position, label, passage)


def short_count(n: Column) -> Column:
    """6221 as it is, 12345 as 12.3k."""
    return F.when(n < 10000, n.cast("string")).otherwise(F.format_string("%.1fk", n / 1000.0))


def eta_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 10, F.lit("almost done"))
        .when(seconds < 90, F.format_string("~%ds left", F.floor(seconds / 5) * 5))
        .otherwise(F.format_string("~%dm left", F.floor(seconds / 60 + 0.5)))
    )


#: Layout labels that transcription models write before a block's box. Fixed values.
LAYOUT_LABELS = (
    "title", "sub_title", "text", "paragraph", "table", "figure", "image", "chart", "formula", "equation", "caption", "footnote", "header", "footer", "list", "page_number", "reference",
)


def strip_layout(c: Column) -> Column:
    """A transcription without layout labels and boxes; text without any is left alone."""
    marker = "(?:" + "|".join(LAYOUT_LABELS) + r") \[\d{1,4}(?:, ?\d{1,4}){3}\]"
    # Fixed patterns: blanks at line ends and more than one blank line go.
    out = F.regexp_replace(c, marker, "\n\n")
    out = F.regexp_replace(out, r"[ \t]+\n|\n[ \t]+", "\n")
    out = trim_space(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    return F.when(c.rlike(marker), out).otherwise(c)


def highlight_terms(query: str) -> list[str]:
    """The words of a query that a result list marks: at least three characters between punctuation."""
    out = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in query.lower().split()]
    return [w for w in out if len(w) >= 3]


def highlighted(c: Column, words: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with every occurrence of the words marked, in any case."""
    if not words:
        return c
    pattern = "(?i)(" + "|".join(re.escape(w) for w in words) + ")"
    return F.regexp_replace(c, pattern, before + "$1" + after)


def progress_line(phase: Column, done: Column, total: Column, unit: str, width: int = 10) -> Column:
    """One line for a pass: phase, bar, percent, counts; just the phase while the total isn't known."""
    pct = F.floor(done * 100 / total)
    filled = F.least(F.floor(pct * width / 100), F.lit(width)).cast("int")
    bar = F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("·"), width - filled), F.lit("]"))
    line = F.format_string(f"%-10s %s %3d%% · %s/%s {unit}", phase, bar, pct, short_count(done), short_count(total))
    return F.when(total > 0, line).otherwise(F.concat(phase, F.lit("…")))
