"""Paths as column expressions: formats, exclusion, globs, prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that can be read. Fixed values.
FORMATS = (".md", ".markdown", ".txt", ".docx", ".pdf", ".pptx", ".html", ".htm", ".mbox")
#: Directories of machine-made files, left out at any depth. Fixed values.
MACHINE_DIRS = ("node_modules", "vendor", "venv", "__pycache__", "target", "dist", "build", "coverage", "Pods", "DerivedData")


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*FORMATS)


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression of a glob: ** crosses separators, * and ? don't, [..] and {a,b} as usual.

    Raises ValueError for a pattern that isn't well formed.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("(?:/.*)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"bad glob: {pattern}")
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            out.append("[" + ("^/" if negated else "") + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"bad glob: {pattern}")
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    if depth:
        raise ValueError(f"bad glob: {pattern}")
    return "^" + "".join(out) + "$"


def matches_glob(rel: Column, pattern: str) -> Column:
    """Whether a relative path fits; a pattern without a separator is also tried on the file's name."""
    fits = rel.rlike(glob_to_regex(pattern))
    return fits if "/" in pattern else fits | F.element_at(F.split(rel, "/"), -1).rlike(glob_to_regex(pattern))


def excluded(rel: Column, patterns: list[str]) -> Column:
    """Whether a directory of machine-made files or one of the patterns leaves a file out. A file named like such a directory stays."""
    segments = F.split(rel, "/")
    out = F.arrays_overlap(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(*map(F.lit, MACHINE_DIRS)))
    for p in patterns:
        out = out | matches_glob(rel, p)
    return out


def in_hidden_dir(rel: Column) -> Column:
    """Whether a directory of a relative path begins with a dot; the file's own name doesn't count."""
    segments = F.split(rel, "/")
    return F.exists(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: F.startswith(s, F.lit(".")))


def eligible(rel: Column, patterns: list[str]) -> Column:
    """Whether a folder walk reads the file."""
    return supported(rel) & ~in_hidden_dir(rel) & ~excluded(rel, patterns)


def under(path: Column, root: Column) -> Column:
    """Whether path is root or lies below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))
