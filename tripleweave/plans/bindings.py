"""How a variable is held in the columns of a plan.

A variable stays in the raw columns of its source as long as it can: an IRI made from a template keeps
its key columns, a literal its native column. So joins compare keys, filters reach the scan, and IRI
strings are only built for the result. Where sources disagree the variable becomes a term struct.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.functions.terms import IRI, BlankNode, Literal, RDFNode, bnode_term, iri_term, literal_term, number, term_literal
from tripleweave.functions.vocab import XSD

INTEGERS = ("int", "bigint", "smallint", "tinyint")
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


@dataclass(frozen=True)
class Bound:
    """``form``: term, iri, bnode or literal. ``cols``: the columns that hold it. ``maybe``: may be NULL.

    ``prefix`` belongs to templates: IRI = prefix + keys joined by '_'. ``native``: Spark type of a literal column.
    """

    form: str
    cols: tuple
    prefix: str = ""
    datatype: str | None = None
    lang: str | None = None
    native: str = ""
    maybe: bool = False

    @property
    def shape(self) -> tuple:
        native = "" if self.form != "literal" else "int" if self.native in INTEGERS else self.native
        return (self.form, self.prefix, self.datatype, native, bool(self.lang), len(self.cols))

    def bound(self) -> Column:
        return F.col(self.cols[0]).isNotNull()

    def lexical(self) -> Column:
        """Value of the term: IRI text, blank node label or lexical form."""
        if self.form == "term":
            return F.col(self.cols[0])["value"]
        if self.form == "literal":
            return lexical(F.col(self.cols[0]), self.native)
        return F.concat(F.lit(self.prefix), *_spaced([F.col(c).cast("string") for c in self.cols]))

    def term(self) -> Column:
        if self.form == "term":
            return F.col(self.cols[0])
        if self.form == "iri":
            return iri_term(self.lexical())
        if self.form == "bnode":
            return bnode_term(self.lexical())
        return literal_term(self.lexical(), self.datatype, F.col(self.lang) if self.lang else None)

    def kind(self) -> Column:
        return F.col(self.cols[0])["kind"] if self.form == "term" else F.when(self.bound(), self.form)

    def number(self) -> Column:
        if self.form == "term":
            term = F.col(self.cols[0])
            return F.when(term["kind"] == "literal", number(term["value"]))
        if self.form != "literal":
            return F.lit(None).cast("double")
        return F.col(self.cols[0]).cast("double") if self.native in NUMERIC else number(self.lexical())

    def plain(self) -> Column:
        """For results: numbers as they are, everything else as text."""
        if self.form == "literal" and self.native in (*NUMERIC, "boolean"):
            return F.col(self.cols[0])
        return self.lexical()

    def columns(self) -> list[str]:
        return [*self.cols, *([self.lang] if self.lang else [])]


def _spaced(parts: list[Column]) -> list[Column]:
    out: list[Column] = []
    for p in parts:
        out += [F.lit("_"), p] if out else [p]
    return out


def lexical(column: Column, native: str) -> Column:
    if native.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return column.cast("string")


def datatype_of(native: str) -> str | None:
    if native in ("int", "bigint", "smallint", "tinyint"):
        return XSD.integer.value
    if native in ("double", "float"):
        return XSD.double.value
    if native.startswith("timestamp"):
        return XSD.dateTime.value
    return {"boolean": XSD.boolean.value, "date": XSD.date.value}.get(native)


def matches(b: Bound, node: RDFNode, guard: bool = True) -> Column:
    """Condition that a binding equals a constant; constants are inverted to keys where that is exact.

    With ``guard`` it is never NULL; without, it may be where NULL counts as false (and so reaches the scan).
    """
    test = _matches(b, node)
    if test is None:
        return F.lit(False)
    return F.coalesce(test, F.lit(False)) if guard else test


def _matches(b: Bound, node: RDFNode) -> Column | None:
    if b.form == "term":
        return F.col(b.cols[0]) == term_literal(node)
    if b.form in ("iri", "bnode"):
        text = node.value if isinstance(node, IRI) else node.label if isinstance(node, BlankNode) else None
        if text is None or isinstance(node, IRI) != (b.form == "iri") or not text.startswith(b.prefix):
            return None
        rest = text[len(b.prefix) :]
        if len(b.cols) > 1:
            return b.lexical() == text
        if b.native in ("int", "bigint"):
            if not (rest.isdigit() and str(int(rest)) == rest and int(rest) < 1 << (31 if b.native == "int" else 63)):
                return None
            return F.col(b.cols[0]) == F.lit(int(rest))
        return F.col(b.cols[0]).cast("string") == rest
    if not isinstance(node, Literal) or (node.datatype.value if node.datatype else None) != b.datatype:
        return None
    if b.lang:
        return (F.col(b.cols[0]) == node.value) & (F.lower(F.col(b.lang)) == F.lit(node.lang)) if node.lang else None
    if node.lang:
        return None
    if b.native in ("int", "bigint"):
        return F.col(b.cols[0]) == int(node.value) if re.fullmatch("0|-?[1-9][0-9]{0,17}", node.value) else None
    return b.lexical() == node.value


@dataclass(frozen=True)
class Relation:
    """A plan with the bindings of its variables. ``trivial``: the one empty solution."""

    df: DataFrame
    vars: dict
    trivial: bool = False

    def as_term(self, name: str) -> Relation:
        b = self.vars[name]
        if b.form == "term":
            return self
        column = fresh(name)
        return self.with_column(column, b.term(), name, Bound("term", (column,), maybe=b.maybe))

    def with_column(self, column: str, value: Column, name: str, bound: Bound) -> Relation:
        return Relation(self.df.withColumn(column, value), self.vars | {name: bound}).pruned()

    def pruned(self) -> Relation:
        return Relation(self.df.select(*dict.fromkeys(c for b in self.vars.values() for c in b.columns())), self.vars)

    def renamed(self) -> Relation:
        """Fresh column names, so that a relation can be joined with a copy of itself."""
        names = {c: fresh(c.split("__")[0]) for c in dict.fromkeys(c for b in self.vars.values() for c in b.columns())}
        found = {v: replace(b, cols=tuple(names[c] for c in b.cols), lang=names.get(b.lang)) for v, b in self.vars.items()}
        return Relation(self.df.select(*(F.col(c).alias(n) for c, n in names.items())), found)

    def where(self, condition: Column) -> Relation:
        return Relation(self.df.where(condition), self.vars, False)


_COUNT = [0]


def fresh(name: str) -> str:
    _COUNT[0] += 1
    return f"{name}__{_COUNT[0]}"


def aligned(left: Relation, right: Relation, names: list[str]) -> tuple[Relation, Relation, bool]:
    """Both sides with the same form for the given variables; False if they can never be equal."""
    for name in names:
        a, b = left.vars[name], right.vars[name]
        if a.shape != b.shape:
            apart = a.form != "term" and b.form != "term" and (a.form != b.form or a.form != "literal" and a.prefix != b.prefix and not (a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix)) or a.form == "literal" and a.datatype != b.datatype)
            if apart and not a.maybe and not b.maybe:
                return left, right, False
            left, right = left.as_term(name), right.as_term(name)
    return left, right, True


def equal(a: Bound, b: Bound) -> Column:
    same = [F.col(x) == F.col(y) for x, y in zip(a.cols, b.cols, strict=True)]
    if a.lang and b.lang:
        same.append(F.lower(F.col(a.lang)) == F.lower(F.col(b.lang)))
    return reduce(lambda x, y: x & y, same)


def merged(a: Bound, b: Bound) -> tuple[list[Column], Bound]:
    """Columns of a variable after a join in which either side may be unbound."""
    names = [fresh("m") for _ in a.cols]
    lang = fresh("m") if a.lang else None
    cols = [F.coalesce(F.col(x), F.col(y)).alias(n) for x, y, n in zip(a.cols, b.cols, names, strict=True)]
    if lang:
        cols.append(F.coalesce(F.col(a.lang), F.col(b.lang)).alias(lang))
    return cols, replace(a, cols=tuple(names), lang=lang, maybe=a.maybe and b.maybe)


def _split(rel: Relation, name: str) -> tuple[Relation, Relation]:
    """The rows in which a variable is bound, and the others without it."""
    b = rel.vars[name]
    rest = Relation(rel.df.where(~b.bound()), {v: x for v, x in rel.vars.items() if v != name})
    return Relation(rel.df.where(b.bound()), rel.vars | {name: replace(b, maybe=False)}), rest.pruned() if rest.vars else Relation(rest.df.select(), {})


def unmatched(left: Relation, right: Relation) -> Relation:
    """Rows of ``left``, whose shared variables are bound, without a compatible row in ``right``."""
    right = right.renamed() if right.vars else right
    shared = [v for v in left.vars if v in right.vars]
    left, right, possible = aligned(left, right, shared)
    if not possible:
        return left
    maybe = next((v for v in shared if right.vars[v].maybe), None)
    if maybe is not None:
        rows, rest = _split(right, maybe)
        return unmatched(unmatched(left, rows), rest)
    if not shared:  # any row at all is a partner
        return Relation(left.df.join(right.df.limit(1), F.lit(True), "left_anti"), left.vars)
    on = reduce(lambda x, y: x & y, (equal(left.vars[v], right.vars[v]) for v in shared))
    return Relation(left.df.join(right.df, on, "left_anti"), left.vars)


def join(left: Relation, right: Relation, outer: bool = False) -> Relation:
    """Join of compatible solutions; ``outer`` keeps left rows without a partner (OPTIONAL).

    Definitely bound variables join by equality. Where a variable may be unbound on one side, that side is
    split into its bound and unbound rows, so that each part is an equality join again.
    """
    if left.trivial and not outer:
        return right
    if right.trivial:
        return left
    right = right.renamed()
    shared = [v for v in left.vars if v in right.vars]
    left, right, possible = aligned(left, right, shared)
    maybe_left = next((v for v in shared if left.vars[v].maybe), None)
    maybe_right = next((v for v in shared if right.vars[v].maybe), None)
    if possible and maybe_left is not None:
        rows, rest = _split(left, maybe_left)
        return union([join(rows, right, outer), join(rest, right, outer)])
    if possible and maybe_right is not None:
        rows, rest = _split(right, maybe_right)
        parts = [join(left, rows), join(left, rest)]
        return union([*parts, unmatched(unmatched(left, rows), rest)] if outer else parts)
    tests = [F.lit(False)] if not possible else []
    for v in shared:
        if possible:
            tests.append(equal(left.vars[v], right.vars[v]))
    how = "left" if outer else "inner"
    if tests:
        df = left.df.join(right.df, reduce(lambda x, y: x & y, tests), how)
    elif outer:
        df = left.df.join(right.df, F.lit(True), "left")
    else:
        df = left.df.crossJoin(right.df)
    found, extra = dict(left.vars), []
    for v, b in right.vars.items():
        if v not in found:
            found[v] = replace(b, maybe=b.maybe or outer)
        elif found[v].maybe and possible:
            cols, bound = merged(found[v], b)
            extra += cols
            found[v] = bound
    out = df.select("*", *extra) if extra else df
    return Relation(out, found).pruned() if found else Relation(out.select(), {})


def union(parts: list[Relation]) -> Relation:
    """All rows of the parts; variables that a part lacks are unbound there."""
    names = list(dict.fromkeys(v for p in parts for v in p.vars))
    found: dict[str, Bound] = {}
    for v in names:
        own = [p.vars[v] for p in parts if v in p.vars]
        if len({b.shape for b in own}) > 1:
            parts = [p.as_term(v) if v in p.vars else p for p in parts]
            own = [p.vars[v] for p in parts if v in p.vars]
        maybe = len(own) < len(parts) or any(b.maybe for b in own)
        lang = fresh(v) if own[0].lang else None
        found[v] = replace(own[0], cols=tuple(fresh(v) for _ in own[0].cols), lang=lang, maybe=maybe)
    frames = []
    for p in parts:
        cols = [F.col(c).alias(n) for v, b in found.items() if v in p.vars for c, n in zip(p.vars[v].columns(), b.columns(), strict=True)]
        frames.append(p.df.select(*cols))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return Relation(df, found)
