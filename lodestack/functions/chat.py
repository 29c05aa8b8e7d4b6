"""A client of the common chat calls, used only where an endpoint is given: answers, streams, transcriptions."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator

from .models import endpoint, is_local

#: Bytes of an error's body that are shown.
SHOWN = 512


def deltas(lines: Iterable[bytes]) -> Iterator[str]:
    """The pieces of text of an event stream, up to its end mark."""
    for line in lines:
        line = line.strip()
        if not line.startswith(b"data:"):
            continue
        body = line[5:].strip()
        if body == b"[DONE]":
            return
        for choice in json.loads(body).get("choices", []):
            if piece := (choice.get("delta") or {}).get("content"):
                yield piece


class Chat:
    """base: the endpoint's address up to its version; key is sent with every call."""

    def __init__(self, base: str, model: str = "", key: str = "", timeout: float = 300):
        if key and base.startswith("http://") and not is_local(base):
            raise ValueError("a key over plain http to another machine")
        self.base, self.model, self.key, self.timeout = base.rstrip("/"), model, key, timeout

    def _open(self, path: str, body: dict | None = None):
        request = urllib.request.Request(f"{self.base}/{path}", None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        if self.key:
            request.add_header("Authorization", f"Bearer {self.key}")
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise OSError(f"{e.code}: {e.read(SHOWN).decode('utf-8', 'replace')}") from e

    def models(self) -> list[str]:
        with self._open("models") as answer:
            return [m["id"] for m in json.load(answer)["data"]]

    def _messages(self, system: str, prompt: str, stream: bool) -> dict:
        return {"model": self.model, "stream": stream, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}

    def __call__(self, system: str, prompt: str) -> str:
        with self._open("chat/completions", self._messages(system, prompt, False)) as answer:
            choices = json.load(answer)["choices"]
        if not choices:
            raise OSError("an answer without choices")
        return choices[0]["message"]["content"].strip()

    def stream(self, system: str, prompt: str) -> Iterator[str]:
        with self._open("chat/completions", self._messages(system, prompt, True)) as answer:
            yield from deltas(answer)


class Transcriber:
    """Text of page pictures by a model that sees. After a refused call it is unavailable for good; other errors are tried once more."""

    def __init__(self, chat: Chat, picture):
        """picture: (file's bytes, page) -> PNG bytes."""
        self.chat, self.picture, self.off = chat, picture, False

    def __call__(self, data: bytes, page: int) -> str:
        if self.off:
            raise LookupError("no transcription")
        url = "data:image/png;base64," + base64.b64encode(self.picture(data, page)).decode()
        body = {"model": self.chat.model, "messages": [{"role": "user", "content": [{"type": "text", "text": "Transcribe this page as plain text, with blank lines between paragraphs."}, {"type": "image_url", "image_url": {"url": url}}]}]}
        for attempt in range(2):
            try:
                with self.chat._open("chat/completions", body) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"].strip()
            except OSError as e:
                if str(e)[:1] == "4":
                    self.off = True
                    raise LookupError(str(e)) from e
                if attempt:
                    raise
        raise AssertionError


__all__ = ["Chat", "Transcriber", "deltas", "endpoint"]
