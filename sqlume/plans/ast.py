"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object  # None, bool, int, float or str


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Op:
    """An operator over expressions: NOT, NEG, AND, OR, = <> < <= > >= + - * / % || LIKE ILIKE, IS NULL, IS TRUE, IS FALSE."""

    name: str
    args: tuple


@dataclass(frozen=True)
class InList:
    arg: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    arg: object
    query: object
    negated: bool


@dataclass(frozen=True)
class Exists:
    query: object


@dataclass(frozen=True)
class Scalar:
    query: object


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: object | None


@dataclass(frozen=True)
class Cast:
    arg: object
    type: str


@dataclass(frozen=True)
class Order:
    expr: object
    desc: bool
    nulls_first: bool


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple
    distinct: bool = False
    order: tuple = ()
    star: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str | None
    columns: tuple = ()


@dataclass(frozen=True)
class TableFunc:
    name: str
    args: tuple
    alias: str | None = None
    columns: tuple = ()
    lateral: bool = False


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, cross
    left: object
    right: object
    on: object | None = None


@dataclass(frozen=True)
class Select:
    items: tuple  # (expression, alias or None)
    source: object | None
    where: object | None = None
    group: tuple = ()
    having: object | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Values:
    rows: tuple


@dataclass(frozen=True)
class Union:
    inputs: tuple
    all: bool


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple
    query: object


@dataclass(frozen=True)
class Query:
    body: object  # Select, Values, Union or Query
    ctes: tuple = ()
    recursive: bool = False
    order: tuple = ()
    limit: int | None = None
    offset: int = 0


# statements


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple  # (name, type, nullable)
    query: Query | None
    if_not_exists: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple
    query: Query


@dataclass(frozen=True)
class Drop:
    name: str
    if_exists: bool


@dataclass(frozen=True)
class Explain:
    statement: object
    analyze: bool
    text: str = ""


@dataclass(frozen=True)
class Set:
    key: str
    value: object


@dataclass(frozen=True)
class Final:
    query: Query


@dataclass(frozen=True)
class CallTool:
    tool: str
    args: tuple
    source: Query | None


@dataclass(frozen=True)
class CreateFunction:
    name: str
    args: tuple  # (name, type)
    returns: str
    kind: str  # prompt, sql, shell
    body: str
    model: str = "worker"
    batch: int = 20
    volatility: str = ""
    proxy: str | None = None
    thresholds: tuple | None = None
    replace: bool = False
    query: object | None = None


@dataclass(frozen=True)
class CreateAgent:
    name: str
    model: str = "root"
    effort: str | None = None
    tools: tuple | None = None
    budget: tuple = ()
    prompt: str = ""
    replace: bool = False


@dataclass(frozen=True)
class Calibrate:
    name: str
    query: Query
    sample: int = 20
    recall: float = 0.9
    precision: float = 0.9


@dataclass
class Scope:
    """Names visible to expressions: (table alias, column, type) by position."""

    columns: list = field(default_factory=list)
