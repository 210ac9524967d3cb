"""Tables, functions and proxies of a session."""

from __future__ import annotations

from dataclasses import dataclass, field

RANK = {"immutable": 0, "stable": 1, "volatile": 2}


@dataclass(frozen=True)
class FunctionDef:
    """A function. kind: pure, scalar (a model call), table (a model call that yields rows), tool or recursive."""

    name: str
    args: tuple  # (name, type)
    returns: object  # a type, or a tuple of (column, type) for a table
    kind: str = "pure"
    volatility: str = "immutable"
    alias: str = "worker"
    batch: int = 1
    least: int | None = None
    body: str = ""
    form: str = ""  # prompt, sql, shell, builtin, source, tool
    query: object = None

    @property
    def is_table(self) -> bool:
        return isinstance(self.returns, tuple)


@dataclass(frozen=True)
class Proxy:
    """A cheap scorer of a predicate: below low it is false, from high on it is true, in between the predicate is asked."""

    function: str
    low: float = 0.2
    high: float = 0.8


@dataclass
class Catalog:
    tables: dict[str, tuple] = field(default_factory=dict)  # name -> fields
    functions: dict[str, FunctionDef] = field(default_factory=dict)
    proxies: dict[str, Proxy] = field(default_factory=dict)
    agents: dict[str, object] = field(default_factory=dict)

    def without(self, withheld: set[str]) -> Catalog:
        """The same catalog without some tools."""
        return Catalog(dict(self.tables), {k: f for k, f in self.functions.items() if k not in withheld}, dict(self.proxies), dict(self.agents))


def builtin_functions() -> dict[str, FunctionDef]:
    t, n = "TEXT", "BIGINT"
    out = [
        FunctionDef("llm", (("prompt", t), ("alias", t), ("effort", t)), t, "scalar", least=1, form="builtin"),
        FunctionDef("llm_bool", (("prompt", t),), "BOOLEAN", "scalar", form="builtin"),
        FunctionDef("llm_json", (("prompt", t), ("schema", t)), "JSON", "scalar", form="builtin"),
        FunctionDef("expand", (("prompt", t), ("n", n)), (("item", t),), "table", form="builtin"),
        FunctionDef("rlm", (("question", t), ("context", t)), (("answer", t), ("detail", "JSON")), "recursive", "stable", "root", least=1, form="builtin"),
        FunctionDef("spawn", (("agent", t), ("task", t), ("context", t)), (("answer", t), ("detail", "JSON"), ("session", t)), "recursive", "stable", "root", least=2, form="builtin"),
        FunctionDef("spawn_async", (("agent", t), ("task", t), ("context", t)), (("handle", t), ("session", t)), "recursive", "stable", "root", least=2, form="builtin"),
        FunctionDef("await", (("handle", t),), (("answer", t), ("detail", "JSON"), ("session", t)), "recursive", "stable", "root", form="builtin"),
        FunctionDef("inbox", (), (("from_session", t), ("ts", t), ("text", t)), "tool", "stable", form="tool"),
        FunctionDef("generate_series", (("start", n), ("stop", n), ("step", n)), (("generate_series", n),), least=2, form="series"),
        FunctionDef("chunks", (("text", t), ("size", n), ("overlap", n)), (("ordinal", n), ("text", t), ("tokens", n)), least=2, form="chunks"),
        FunctionDef("files", (("glob", t),), (("path", t), ("size", n), ("mtime", n), ("kind", t)), "tool", "stable", form="source"),
        FunctionDef("lines", (("path", t), ("from", n), ("to", n)), (("lineno", n), ("text", t)), "tool", "stable", least=1, form="source"),
        FunctionDef("read", (("path", t),), (("text", t),), "tool", "stable", form="source"),
        FunctionDef("read_csv", (("path", t),), (("row", n), ("record", "JSON")), "tool", "stable", form="source"),
        FunctionDef("read_json", (("path", t),), (("row", n), ("record", "JSON")), "tool", "stable", form="source"),
        FunctionDef("grep", (("pattern", t), ("glob", t)), (("path", t), ("lineno", n), ("text", t)), "tool", "stable", least=1, form="source"),
        FunctionDef("search", (("query", t), ("glob", t), ("n", n)), (("path", t), ("score", "DOUBLE"), ("lineno", n), ("snippet", t)), "tool", "stable", least=1, form="source"),
        FunctionDef("env", (("name", t),), (("value", t),), "tool", "stable", form="source"),
        FunctionDef("git_log", (("n", n),), (("sha", t), ("author", t), ("date", t), ("message", t)), "tool", "stable", least=0, form="source"),
        FunctionDef("git_diff", (("ref", t),), (("path", t), ("diff", t)), "tool", "stable", least=0, form="source"),
        FunctionDef("git_blame", (("path", t),), (("lineno", n), ("sha", t), ("author", t), ("text", t)), "tool", "stable", form="source"),
        FunctionDef("skill", (("name", t),), (("name", t), ("source", t), ("text", t)), "tool", "stable", form="source"),
    ]
    return {f.name: f for f in out}
