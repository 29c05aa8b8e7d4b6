"""Folders and single files as tables of (path, rel, size, mtime, content), and their settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

CONFIG_NAME = ".lodestack.yml"


@dataclass
class Config:
    """A folder's settings: a tag, and globs of files to leave out."""

    tag: str = ""
    exclude: list[str] = field(default_factory=list)


def parse_config(text: str) -> Config:
    """Settings from YAML of the two known keys. ValueError for anything malformed, a bad glob included."""
    out, key = Config(), None
    for number, raw in enumerate(text.splitlines(), 1):
        line = _without_comment(raw)
        if not line.strip():
            continue
        if line.lstrip().startswith("- ") and key == "exclude":
            out.exclude.append(_scalar(line.lstrip()[2:], number))
            continue
        name, colon, value = line.partition(":")
        if not colon or name != name.strip() or name not in ("tag", "exclude"):
            raise ValueError(f"line {number} of the settings can't be read")
        key, value = name, value.strip()
        if name == "tag":
            out.tag = _scalar(value, number)
        elif value.startswith("[") and value.endswith("]"):
            out.exclude = [_scalar(x, number) for x in value[1:-1].split(",") if x.strip()]
        elif value:
            raise ValueError(f"line {number}: exclude is a list")
    for pattern in out.exclude:
        paths.glob_to_regex(pattern)
    return out


def _without_comment(line: str) -> str:
    """A line up to a # that begins it or follows a blank, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and line[:i].rstrip()[-1:] in (":", "-", "[", ","):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(value: str, number: int) -> str:
    value = value.strip()
    if value[:1] in "\"'" and value[:1]:
        if len(value) < 2 or value[-1] != value[0]:
            raise ValueError(f"line {number}: an open quote")
        return value[1:-1]
    if value[:1] in ("[", "{", "&", "*", "!", "|", ">", "%", "@"):
        if value[0] != "*":
            raise ValueError(f"line {number}: only plain values")
    return value


def load_config(root: str) -> Config:
    """The settings in a folder; without a file, none."""
    try:
        with open(os.path.join(root, CONFIG_NAME), encoding="utf-8") as f:
            return parse_config(f.read())
    except (FileNotFoundError, NotADirectoryError):
        return Config()


def save_config(root: str, config: Config) -> None:
    lines = ["# Settings of this folder's index.", f'tag: "{config.tag}"']
    if config.exclude:
        lines += ["exclude:", *[f'  - "{p}"' for p in config.exclude]]
    with open(os.path.join(root, CONFIG_NAME), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def canonical(path: str) -> str:
    """An absolute path, with ~ expanded and dots resolved."""
    return os.path.abspath(os.path.expanduser(path))


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, content: bool = True) -> DataFrame:
    """The files of a root (a folder or one file) as (path, rel, size, mtime, content).

    Files are listed and read by Spark. In a folder, files of other formats and
    excluded ones are passed over; a single file of another format is a ValueError.
    """
    root = canonical(root) if "://" not in root else root.rstrip("/")
    single = "://" not in root and os.path.isfile(root)
    if single and os.path.splitext(root)[1].lower() not in paths.FORMATS:
        raise ValueError(f"unsupported format: {root}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), *(["content"] if content else []))
    if single:
        return out.withColumn("rel", paths.extension(F.col("path")))
    at = root.rstrip("/") + "/"
    start = F.locate(at, F.col("path"))
    out = out.withColumn("rel", F.substr("path", start + len(at)))
    return out.where(paths.eligible(F.col("rel"), exclude or []))


def scan_files(spark: SparkSession, root: str, files: list[str], exclude: list[str] | None = None) -> DataFrame:
    """scan() of a folder for some of its files; files that aren't there any more are left out."""
    at = root.rstrip("/") + "/"
    there = [f for f in files if "://" in f or os.path.isfile(f)]
    if not there:
        return spark.createDataFrame([], "path string, size long, mtime long, content binary, rel string")
    rows = spark.read.format("binaryFile").load(there)
    path = F.regexp_replace("path", r"^file:/+", "/")
    out = rows.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    out = out.withColumn("rel", F.substr("path", F.locate(at, F.col("path")) + len(at)))
    return out.where(paths.eligible(F.col("rel"), exclude or []))


def browse(path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what can be added in a folder: folders and readable files without hidden ones, by name in any case."""
    found = [(e.name, e.is_dir()) for e in os.scandir(path) if not e.name.startswith(".")]
    return sorted((x for x in found if x[1] or os.path.splitext(x[0])[1].lower() in paths.FORMATS), key=lambda x: x[0].lower())
