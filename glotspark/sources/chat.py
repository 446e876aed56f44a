"""A chat-completions endpoint as translator and as generator of keys."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Any

from glotspark.operators import aikeys, translate


@dataclass(frozen=True)
class ChatClient:
    """provider: the ai_provider settings. It is sent to executors with the tasks that call."""

    provider: dict[str, Any]
    timeout: float = 120.0

    def body(self, messages: list[dict[str, str]], **over: Any) -> dict[str, Any]:
        """The request: settings, then the provider's own additions, then those of the call."""
        p = self.provider
        return {"model": p["model"], "messages": messages, "temperature": p["temperature"], "max_tokens": p["max_tokens"]} | (p.get("body") or {}) | over

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json", "Authorization": f"Bearer {self.provider['api_key']}"} | (self.provider.get("headers") or {})

    def chat(self, messages: list[dict[str, str]], **over: Any) -> str:
        """The reply's text. RateLimited where the endpoint says so, RuntimeError for other failures and empty replies."""
        request = urllib.request.Request(self.provider["api_url"], json.dumps(self.body(messages, **over)).encode(), self.headers(), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                said = json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if e.code == 429:
                wait = e.headers.get("Retry-After") or ""
                raise translate.RateLimited(float(wait) if wait.isdigit() else 60.0) from e
            raise RuntimeError(f"the provider answered {e.code}: {e.read()[:500].decode(errors='replace')}") from e
        if said.get("error"):
            raise RuntimeError(f"the provider answered with an error: {said['error']}")
        content = ((said.get("choices") or [{}])[0].get("message") or {}).get("content")
        if not content:
            raise RuntimeError(f"the provider's answer is empty: {json.dumps(said)[:500]}")
        return content


@dataclass(frozen=True)
class ChatTranslator:
    """A translate.Translator."""

    client: ChatClient
    source: str
    names: dict[str, str]
    max_tokens: int

    def __call__(self, lang: str, entries: dict[str, str]) -> str:
        name = lambda code: self.names.get(code, code)
        return self.client.chat(translate.prompt(name(self.source), name(lang), entries), max_tokens=self.max_tokens)


@dataclass(frozen=True)
class ChatGenerator:
    """An aikeys.Generator."""

    client: ChatClient

    def __call__(self, items: list[dict]) -> str:
        return self.client.chat(aikeys.prompt(items))


def translator_of(config) -> ChatTranslator:
    names = {code: config.language_name(code) for code in config["languages"]["map"]}
    return ChatTranslator(ChatClient(config["ai_provider"]), config["languages"]["source"], names, config["translation"]["max_tokens_per_request"])


def generator_of(config) -> ChatGenerator:
    return ChatGenerator(ChatClient(config["ai_provider"]))
