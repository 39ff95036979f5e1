"""Syntax trees: expressions, queries and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass
class Lit(Expr):
    value: Any


@dataclass
class Param(Expr):
    key: Any  # number from 0, or a name


@dataclass
class Col(Expr):
    table: str | None
    name: str


@dataclass
class Star(Expr):
    table: str | None = None


@dataclass
class Un(Expr):
    op: str
    x: Expr


@dataclass
class Bin(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass
class Is(Expr):
    a: Expr
    b: Expr
    negated: bool


@dataclass
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass
class In(Expr):
    x: Expr
    items: Any  # list of expressions, or a query
    negated: bool


@dataclass
class Match(Expr):
    kind: str  # LIKE or GLOB
    x: Expr
    pattern: Expr
    escape: Expr | None
    negated: bool


@dataclass
class Case(Expr):
    base: Expr | None
    whens: list[tuple[Expr, Expr]]
    other: Expr | None


@dataclass
class Cast(Expr):
    x: Expr
    type: TypeName


@dataclass
class Func(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False
    over: Over | None = None


@dataclass
class Over:
    partition: list[Expr]
    order: list[tuple[Expr, bool]]


@dataclass
class Exists(Expr):
    query: Query
    negated: bool = False


@dataclass
class Scalar(Expr):
    query: Query


@dataclass
class TypeName:
    name: str
    args: list[int] = field(default_factory=list)


@dataclass
class Source:
    name: str | None
    query: Query | None = None
    alias: str | None = None
    as_of: Expr | None = None


@dataclass
class Join:
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS
    source: Source
    on: Expr | None = None
    using: list[str] = field(default_factory=list)
    natural: bool = False


@dataclass
class Select:
    items: list[tuple[Expr, str | None]]
    source: Source | None = None
    joins: list[Join] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    distinct: bool = False


@dataclass
class Cte:
    name: str
    columns: list[str]
    query: Query


@dataclass
class Query:
    first: Select
    more: list[tuple[str, Select]] = field(default_factory=list)  # UNION, UNION ALL, INTERSECT, EXCEPT: from left to right
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: Expr | None = None
    offset: Expr | None = None
    ctes: list[Cte] = field(default_factory=list)
    recursive: bool = False


@dataclass
class ColumnDef:
    name: str
    type: TypeName
    primary: bool = False
    not_null: bool = False
    unique: bool = False
    default: str | None = None  # SQL text
    check: str | None = None
    generated: str | None = None
    collation: str | None = None


@dataclass
class Statement:
    """Any statement but a query: its kind and what belongs to it."""

    kind: str
    parts: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None
