"""Providers that ask a model over HTTP. They run on the executors; keys and addresses are parameters."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.plans.provider import Message, Reply


def post(url: str, headers: dict[str, str], body: dict, seconds: float) -> dict:
    """The JSON that a service replies with; its errors carry the status, so that retries can tell them apart."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=seconds) as r:
            return json.loads(r.read())
    except urllib.error.HTTPError as e:
        wait = e.headers.get("retry-after") if e.headers else None
        raise RuntimeError(f"{e.code} {e.read().decode(errors='replace')[:500]}" + (f" retry-after: {wait}" if wait else "")) from e


@dataclass(frozen=True)
class Chat:
    """A service that takes messages and replies with one.

    form: what a service's request and reply look like, one of FORMS. send: how a request is sent, for tests.
    """

    url: str
    model: str
    form: str = "choices"
    key: str = ""
    temperature: float = 0.0
    max_tokens: int = 4096
    seconds: float = 120.0
    send: Callable[[str, dict[str, str], dict, float], dict] = field(default=post, repr=False)

    def __call__(self, prompt: str, history: list[Message] | None = None) -> Reply:
        messages = [{"role": m.role, "content": m.content} for m in history or ()] + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages}
        headers, text, stopped = FORMS[self.form](self, body)
        reply = self.send(self.url, headers, body, self.seconds)
        return Reply(text(reply), "length" if stopped(reply) else "stop")


def _choices(chat: Chat, body: dict):
    """A list of choices; a bearer key."""
    body |= {"temperature": chat.temperature}
    return {"authorization": f"Bearer {chat.key}"} if chat.key else {}, lambda r: r["choices"][0]["message"]["content"], lambda r: r["choices"][0].get("finish_reason") == "length"


def _content(chat: Chat, body: dict):
    """A list of content parts; system messages apart, a limit of tokens, a key of its own."""
    system = "\n\n".join(m["content"] for m in body["messages"] if m["role"] == "system")
    body["messages"] = [m for m in body["messages"] if m["role"] != "system"]
    body |= {"max_tokens": chat.max_tokens, "temperature": chat.temperature} | ({"system": system} if system else {})
    text = lambda r: "".join(p.get("text", "") for p in r["content"] if p.get("type") == "text")
    return {"x-api-key": chat.key, "anthropic-version": "2023-06-01"}, text, lambda r: r.get("stop_reason") == "max_tokens"


def _message(chat: Chat, body: dict):
    """One message; a server of one's own, without streaming."""
    body |= {"stream": False, "options": {"temperature": chat.temperature}}
    return {}, lambda r: r["message"]["content"], lambda r: r.get("done_reason") == "length"


FORMS = {"choices": _choices, "content": _content, "message": _message}
