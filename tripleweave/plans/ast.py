"""Query trees. Text is parsed into them, and they can be built by hand."""

from __future__ import annotations

from dataclasses import dataclass, field

from tripleweave.functions.terms import RDFNode


@dataclass(frozen=True)
class Var:
    name: str


Term = RDFNode | Var


class GraphPattern:
    """An element of a group."""


class FilterExpression:
    """An expression inside FILTER."""


@dataclass(frozen=True)
class VarExpr(FilterExpression):
    name: str


@dataclass(frozen=True)
class LiteralExpr(FilterExpression):
    value: RDFNode


@dataclass(frozen=True)
class ComparisonExpr(FilterExpression):
    op: str
    left: FilterExpression
    right: FilterExpression


@dataclass(frozen=True)
class LogicalExpr(FilterExpression):
    op: str
    args: tuple


@dataclass(frozen=True)
class FunctionExpr(FilterExpression):
    name: str
    args: tuple


@dataclass(frozen=True)
class ArithmeticExpr(FilterExpression):
    op: str
    left: FilterExpression
    right: FilterExpression


@dataclass(frozen=True)
class TriplePattern(GraphPattern):
    subject: Term
    predicate: Term
    object: Term


@dataclass(frozen=True)
class FilterPattern(GraphPattern):
    expression: FilterExpression


@dataclass(frozen=True)
class OptionalPattern(GraphPattern):
    patterns: tuple


@dataclass(frozen=True)
class UnionPattern(GraphPattern):
    branches: tuple


@dataclass(frozen=True)
class GroupPattern(GraphPattern):
    patterns: tuple


@dataclass(frozen=True)
class OrderKey:
    name: str
    descending: bool = False


@dataclass(frozen=True)
class QueryModifiers:
    limit: int | None = None
    offset: int | None = None
    order_by: tuple = ()


class SPARQLQuery:
    """A query of any form."""


@dataclass(frozen=True)
class SelectQuery(SPARQLQuery):
    """``variables`` empty: all of them."""

    variables: tuple
    where: tuple
    modifiers: QueryModifiers = field(default_factory=QueryModifiers)
    distinct: bool = False


@dataclass(frozen=True)
class ConstructQuery(SPARQLQuery):
    template: tuple
    where: tuple
    modifiers: QueryModifiers = field(default_factory=QueryModifiers)


@dataclass(frozen=True)
class AskQuery(SPARQLQuery):
    where: tuple


@dataclass(frozen=True)
class DescribeQuery(SPARQLQuery):
    resources: tuple
    where: tuple = ()
    modifiers: QueryModifiers = field(default_factory=QueryModifiers)


def is_variable(term) -> bool:
    return isinstance(term, Var | VarExpr)


def is_bound(solution: dict, name: str) -> bool:
    return solution.get(name) is not None


def get_variables(item) -> list[str]:
    """Names of all variables of a pattern, expression, query or list of them, by first appearance."""
    found: dict[str, None] = {}

    def walk(x) -> None:
        if isinstance(x, Var | VarExpr):
            found[x.name] = None
        elif isinstance(x, list | tuple):
            for y in x:
                walk(y)
        elif isinstance(x, TriplePattern):
            walk((x.subject, x.predicate, x.object))
        elif isinstance(x, FilterPattern):
            walk(x.expression)
        elif isinstance(x, OptionalPattern | GroupPattern):
            walk(x.patterns)
        elif isinstance(x, UnionPattern):
            walk(x.branches)
        elif isinstance(x, ComparisonExpr | ArithmeticExpr):
            walk((x.left, x.right))
        elif isinstance(x, LogicalExpr | FunctionExpr):
            walk(x.args)
        elif isinstance(x, SelectQuery):
            walk((x.variables, x.where))
        elif isinstance(x, ConstructQuery):
            walk((x.template, x.where))
        elif isinstance(x, AskQuery):
            walk(x.where)
        elif isinstance(x, DescribeQuery):
            walk((x.resources, x.where))

    walk(item)
    return list(found)


def variables(*names: str) -> tuple[Var, ...]:
    return tuple(Var(n) for n in names)


