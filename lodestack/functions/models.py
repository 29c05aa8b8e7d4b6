"""Which model and endpoint to talk to: pure functions over names and settings."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of names of models that embed, and of those that see, best first. Fixed values.
EMBEDS = ("embed", "minilm")
SEES = ("ocr", "-vl", "vl-", "vision", "llava", "bakllava", "minicpm-v", "moondream", "pixtral")


def chat_model(models: DataFrame, *by: str) -> DataFrame:
    """Of (by..., pos, id), the first model that neither embeds nor sees, else the first that doesn't embed: one row or none for each endpoint, told by the columns `by`."""
    name = F.lower("id")
    kind = F.when(name.rlike("|".join(EMBEDS)), None).when(name.rlike("|".join(SEES)), 1).otherwise(0)
    return models.withColumn("_kind", kind).where("_kind is not null").groupBy(*by).agg(F.min_by("id", F.struct("_kind", "pos")).alias("id")).where("id is not null")


def vision_model(models: DataFrame, *by: str) -> DataFrame:
    """Of (by..., pos, id), the model of the best hint, then the first: one row or none for each endpoint."""
    hint = F.coalesce(*[F.when(F.contains(F.lower("id"), F.lit(h)), F.lit(n)) for n, h in enumerate(SEES)])
    best = models.withColumn("_hint", hint).where("_hint is not null")
    return best.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_hint", "pos"))).where("_n = 1").select(*by, "id")


def is_local(url: str) -> bool:
    host = urlparse(url).hostname or ""
    return host in ("localhost", "::1") or host.startswith("127.")


def endpoint(flag: str, environment: str, key: str, candidates: list[str], alive: Callable[[str], bool]) -> str | None:
    """The endpoint given by a flag, else by the environment, else the first candidate that answers.

    A key isn't sent in the clear to another machine: ValueError.
    """
    found = flag or environment or next((c for c in candidates if alive(c)), None)
    if found and key and found.startswith("http://") and not is_local(found):
        raise ValueError("a key over plain http to another machine")
    return found
