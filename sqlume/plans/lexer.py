"""Tokens of the dialect, and the split of scripts into statements."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sqlume.errors import SqlError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
    |(?P<estr>[eE]'(?:[^'\\]|\\.|'')*')
    |(?P<str>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<name>[^\W\d]\w*)
    |(?P<op><=|>=|<>|!=|\|\||::|->>|->|[-+*/%=<>(),.;\[\]{}:?@!~^&|$])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, str, num, op, end
    text: str
    at: int
    value: object = None

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"cannot read {sql[at : at + 20]!r}")
        kind, text = m.lastgroup, m[0]
        if m["dollar"] is not None:
            cut = len(m["tag"]) + 2
            out.append(Token("str", text, at, text[cut:-cut]))
        elif kind == "estr":
            body = text[2:-1].replace("''", "'")
            out.append(Token("str", text, at, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), body, flags=re.S)))
        elif kind == "str":
            out.append(Token("str", text, at, text[1:-1].replace("''", "'")))
        elif kind == "quoted":
            out.append(Token("quoted", text, at, text[1:-1].replace('""', '"')))
        elif kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "", at))
    return out


def statements(script: str) -> list[str]:
    """The statements of a script, split at semicolons outside quotes, comments and brackets of any kind."""
    out, start = [], 0
    for t in tokens(script):
        if t.kind == "end" or t.kind == "op" and t.text == ";":
            part = script[start : t.at]
            if len(tokens(part)) > 1:
                out.append(part.strip())
            start = t.at + 1
    return out
