"""Providers answer prompts. Scripted, replaying and recording ones; a network one may implement the same protocol."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    dollars: float = 0.0


class Provider(Protocol):
    """Answers prompts. One with a true attribute ``portable`` can be sent to the executors and asked there."""

    def complete(self, alias: str, prompt: str) -> Reply: ...


def tokens_of(text: str) -> int:
    return -(-len(text) // 4)


class Scripted:
    """Rules from prompt substrings to replies, in order, and a default. A rule's reply may be a function of the prompt."""

    def __init__(self, rules: list[tuple[str, str | Callable[[str], str]]] = (), default: str | Callable[[str], str] = "") -> None:
        self.rules, self.default = list(rules), default
        self.prompts: list[tuple[str, str]] = []
        self._lock = threading.Lock()

    @property
    def calls(self) -> int:
        return len(self.prompts)

    def complete(self, alias: str, prompt: str) -> Reply:
        with self._lock:
            self.prompts.append((alias, prompt))
        reply = next((r for part, r in self.rules if part in prompt), self.default)
        text = reply(prompt) if callable(reply) else reply
        return Reply(text, tokens_of(prompt), tokens_of(text))


class Ruled(Scripted):
    """Answers prompt functions by a pure rule of their arguments: name -> function of a dict of arguments.

    Understands batched prompts, so that counts of calls can be tested with batching on.
    """

    def __init__(self, rules: dict[str, Callable[[dict], object]]) -> None:
        super().__init__()
        self.by_name = rules

    def complete(self, alias: str, prompt: str) -> Reply:
        with self._lock:
            self.prompts.append((alias, prompt))
        head, _, body = prompt.partition("\n")
        name = head.removeprefix("function: ")
        items = json.loads(body[body.index("items: ") + 7 :])
        answers = [{"item": i["item"], "answer": self.by_name[name](i["args"])} for i in items]
        text = json.dumps({"answers": answers})
        return Reply(text, tokens_of(prompt), tokens_of(text))


def fingerprint(alias: str, prompt: str) -> str:
    return hashlib.sha256(json.dumps([alias, prompt]).encode()).hexdigest()


class Recording:
    """Passes calls on and keeps what came back."""

    def __init__(self, inner: Provider) -> None:
        self.inner, self.tape = inner, {}

    def complete(self, alias: str, prompt: str) -> Reply:
        reply = self.inner.complete(alias, prompt)
        self.tape[fingerprint(alias, prompt)] = reply
        return reply


class Replay:
    """Answers from a recorded tape only."""

    def __init__(self, tape: dict[str, Reply]) -> None:
        self.tape = tape

    def complete(self, alias: str, prompt: str) -> Reply:
        key = fingerprint(alias, prompt)
        if key not in self.tape:
            raise LookupError(f"no recorded reply for this prompt to {alias}")
        return self.tape[key]


class Router:
    """Aliases to candidate providers: the next one answers when one fails; one that fails often rests for a while.

    prices: dollars for a million input and output tokens, by alias; a reply that names no price gets its alias'.
    """

    def __init__(self, routes: dict[str, list[Provider]], trips: int = 3, rest: int = 10, prices: dict[str, tuple[float, float]] | None = None) -> None:
        self.routes, self.trips, self.rest, self.prices = routes, trips, rest, prices or {}
        self.failed: dict[int, int] = {}
        self.resting: dict[int, int] = {}

    def complete(self, alias: str, prompt: str) -> Reply:
        candidates = self.routes.get(alias) or self.routes.get("worker") or []
        last: Exception | None = None
        for p in candidates:
            k = id(p)
            if self.resting.get(k, 0) > 0:
                self.resting[k] -= 1
                continue
            try:
                reply = p.complete(alias, prompt)
            except Exception as e:  # noqa: BLE001  the next candidate is asked
                last = e
                self.failed[k] = self.failed.get(k, 0) + 1
                if self.failed[k] >= self.trips:
                    self.resting[k], self.failed[k] = self.rest, 0
            else:
                self.failed[k] = 0
                if not reply.dollars and alias in self.prices:
                    a, b = self.prices[alias]
                    reply = replace(reply, dollars=(reply.input_tokens * a + reply.output_tokens * b) / 1e6)
                return reply
        raise LookupError(f"no provider for {alias} answered") from last
