"""A model behind an HTTP interface for chat completions, as a callable from a prompt to a text.

The callable is made on the driver and sent to the tasks as plain settings; the key is read from the environment of
whoever calls, never stored in a plan and never given a default.
"""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass

#: Patience with a model, the length of its answer and its temperature.
TIMEOUT, MOST_TOKENS, TEMPERATURE = 120, 500, 0.0


@dataclass(frozen=True)
class Chat:
    """``Chat(url, model)(prompt)`` is the answer's text. A prompt is a text or a pair (system, human)."""

    url: str
    model: str
    key_variable: str | None = None
    timeout: float = TIMEOUT
    most_tokens: int = MOST_TOKENS
    temperature: float = TEMPERATURE

    def __call__(self, prompt: str | tuple[str, str]) -> str:
        said = [("user", prompt)] if isinstance(prompt, str) else list(zip(("system", "user"), prompt))
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.most_tokens, "messages": [{"role": r, "content": t} for r, t in said]}
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)  # noqa: S310 - the caller's own address
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)["choices"][0]["message"]["content"]


def from_environment(prefix: str = "TRIBUNA_CHAT") -> Chat:
    """The model named by ``<prefix>_URL`` and ``<prefix>_MODEL``, with the key in ``<prefix>_KEY`` if that is set."""
    key = f"{prefix}_KEY"
    return Chat(os.environ[f"{prefix}_URL"], os.environ[f"{prefix}_MODEL"], key if key in os.environ else None)
