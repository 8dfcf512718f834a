"""A language model behind a chat interface, as a callable from text to text for ``extract(provider=...)``. Nothing is sent unless a profile asks."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.request import Request, urlopen

ORDERS = {"remove_noise": "- Drop what is left of menus, boilerplate and footers, and lone lines that belong to nothing."}
FRAME = "You clean Markdown that was made from HTML. Answer with the Markdown only. Where you aren't sure that text is noise, keep it."


@dataclass(frozen=True)
class Provider:
    """Picklable; the key is read from the environment where it runs."""

    endpoint: str = "http://localhost:11434/v1"
    model: str = "qwen2.5"
    key_env: str = ""
    tasks: tuple[str, ...] = ("remove_noise",)
    max_tokens: int = 4096
    timeout: float = 60
    most: int = 26_214_400

    @classmethod
    def of(cls, config: Mapping) -> Provider:
        names = {"endpoint": "endpoint", "model": "model", "api_key_env": "key_env", "max_tokens": "max_tokens", "timeout": "timeout", "max_response_bytes": "most"}
        return cls(**{mine: config[theirs] for theirs, mine in names.items() if config.get(theirs)}, tasks=tuple(config.get("tasks") or ("remove_noise",)))

    def __call__(self, text: str) -> str:
        prompt = "\n".join([FRAME, *(ORDERS[t] for t in self.tasks if t in ORDERS), f"\n---\n{text}"])
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": 0}
        headers = {"Content-Type": "application/json"}
        if self.key_env:
            if not os.environ.get(self.key_env):
                raise ValueError(f"llm_refine.api_key_env names {self.key_env}, which isn't set")
            headers["Authorization"] = f"Bearer {os.environ[self.key_env]}"
        if not self.endpoint.startswith(("http://", "https://")):
            raise ValueError("llm_refine.endpoint must be http(s)")
        request = Request(self.endpoint.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        with urlopen(request, timeout=self.timeout) as answer:
            raw = answer.read(self.most + 1)
        if len(raw) > self.most:
            raise ValueError(f"more than {self.most} bytes")
        return json.loads(raw)["choices"][0]["message"]["content"]
