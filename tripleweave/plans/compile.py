"""From query trees to Spark plans.

A group becomes: its triple patterns, cut into stars (patterns about one subject that a source can answer
from one scan), joined most selective and connected first; then OPTIONAL, UNION and groups in order; then
all its filters. Catalyst does the rest: pushdown, pruning, join strategies, limits.
"""

from __future__ import annotations

import warnings

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.functions.terms import TERM, Literal, number, row_of, term_literal
from tripleweave.plans import ast as A
from tripleweave.plans.bindings import INTEGERS, Bound, Relation, equal, join, matches, union




class Compiler:
    """Plans over a graph that offers ``star`` and ``spark``."""

    def __init__(self, graph, extensions: bool = False, numeric_order: bool = False):
        self.graph, self.extensions, self.numeric_order = graph, extensions, numeric_order

    # patterns
    def group(self, patterns) -> Relation:
        current = Relation(self.graph.spark.range(1).select(), {}, True)
        triples: list[A.TriplePattern] = []
        filters: list[A.FilterExpression] = []
        for p in patterns:
            if isinstance(p, A.FilterPattern):
                filters.append(p.expression)
                continue
            if isinstance(p, A.TriplePattern):
                triples.append(p)
                continue
            if isinstance(p, A.OptionalPattern) and triples:
                # a scan that the star reads anyway also gives optional properties of its subject
                inner = [q for q in p.patterns if isinstance(q, A.TriplePattern)]
                if len(inner) == len(p.patterns) == 1 and (wide := self.graph.widened(triples, inner[0])):
                    current, triples = join(current, wide), []
                    continue
            current = join(current, self.basic(triples)) if triples else current
            triples = []
            if isinstance(p, A.OptionalPattern):
                inner_rel = self.group(p.patterns)
                current = self.left(current, inner_rel)
            elif isinstance(p, A.UnionPattern):
                branches = union([_filled(self.group(b)) for b in p.branches])
                current = distinct(join(current, branches))
            elif isinstance(p, A.GroupPattern):
                current = join(current, self.group(p.patterns))
            else:
                raise TypeError(f"not a pattern: {p!r}")
        if triples:
            current = join(current, self.basic(triples))
        for f in filters:
            current = current.where(self.condition(f, current, guard=False))
        return current

    def left(self, current: Relation, inner: Relation) -> Relation:
        if current.trivial and not inner.vars:
            return current
        return join(current, inner, outer=True)

    def basic(self, patterns: list[A.TriplePattern]) -> Relation:
        """A conjunction of triple patterns."""
        stars = self.graph.stars(patterns)
        done = stars.pop(min(range(len(stars)), key=lambda i: stars[i][0]))
        rel = done[1]()
        while stars:
            linked = [i for i, (_, _, names) in enumerate(stars) if names & set(rel.vars)]
            pick = min(linked or range(len(stars)), key=lambda i: stars[i][0])
            rel = join(rel, stars.pop(pick)[1]())
        return rel

    # expressions
    def condition(self, e: A.FilterExpression, rel: Relation, guard: bool = True) -> Column:
        """A two-valued condition. Under ``guard`` it is never NULL; at the top of a filter NULL is false
        anyway, and without a guard the condition can be pushed into the scan."""
        no = F.lit(False)
        if isinstance(e, A.VarExpr):
            return rel.vars[e.name].bound() if e.name in rel.vars else no
        if isinstance(e, A.LiteralExpr):
            return F.lit(True)
        if isinstance(e, A.LogicalExpr):
            args = [self.condition(a, rel, guard or e.op == "not") for a in e.args]
            if e.op == "not":
                return ~args[0]
            return reduce(lambda a, b: a & b if e.op == "and" else a | b, args)
        if isinstance(e, A.ComparisonExpr):
            return self.comparison(e, rel, guard)
        if isinstance(e, A.FunctionExpr):
            name = e.name.lower()
            if name in ("bound", "isiri", "isuri", "isliteral", "isblank") and len(e.args) == 1:
                arg = e.args[0]
                if isinstance(arg, A.LiteralExpr):
                    kind = row_of(arg.value)[0]
                    return F.lit(name != "bound" and kind == KINDS[name])
                if not isinstance(arg, A.VarExpr) or arg.name not in rel.vars:
                    return no
                b = rel.vars[arg.name]
                return b.bound() if name == "bound" else F.coalesce(b.kind() == KINDS[name], no)
            if self.extensions and name == "regex" and len(e.args) >= 2 and isinstance(e.args[1], A.LiteralExpr):
                text = self.text(e.args[0], rel)
                flags = e.args[2].value.value if len(e.args) > 2 else ""
                return F.coalesce(text.rlike((f"(?{flags})" if flags else "") + e.args[1].value.value), no) if text is not None else no
            warnings.warn(f"unknown filter function {e.name}; it is false", stacklevel=2)
            return no
        if self.extensions and isinstance(e, A.ArithmeticExpr):
            return F.coalesce(self.value(e, rel) != 0, no)
        warnings.warn("arithmetic is no condition; it is false", stacklevel=2)
        return no

    def text(self, e, rel: Relation) -> Column | None:
        if isinstance(e, A.LiteralExpr):
            return F.lit(e.value.value)
        if isinstance(e, A.VarExpr) and e.name in rel.vars:
            b = rel.vars[e.name]
            return F.when(b.kind() == "literal", b.lexical())
        if isinstance(e, A.FunctionExpr) and e.name.lower() == "str" and len(e.args) == 1 and isinstance(e.args[0], A.VarExpr) and e.args[0].name in rel.vars:
            return rel.vars[e.args[0].name].lexical()
        return None

    def value(self, e, rel: Relation) -> Column:
        """Number of an expression, else NULL."""
        none = F.lit(None).cast("double")
        if isinstance(e, A.VarExpr):
            return rel.vars[e.name].number() if e.name in rel.vars else none
        if isinstance(e, A.LiteralExpr):
            if not isinstance(e.value, Literal):
                return none
            try:
                return F.lit(float(e.value.value))
            except ValueError:
                return number(F.lit(e.value.value))
        if isinstance(e, A.ArithmeticExpr) and self.extensions:
            a, b = self.value(e.left, rel), self.value(e.right, rel)
            return {"add": a + b, "sub": a - b, "mul": a * b, "div": a / F.when(b != 0, b)}[e.op]
        return none

    def comparison(self, e: A.ComparisonExpr, rel: Relation, guard: bool = True) -> Column:
        no = F.lit(False)
        if e.op in ("=", "!="):
            sides = [e.left, e.right]
            if self.extensions and any(isinstance(s, A.ArithmeticExpr) for s in sides):
                a, b = (self.value(s, rel) for s in sides)
                return F.coalesce(a == b if e.op == "=" else a != b, no)
            found = [rel.vars.get(s.name) if isinstance(s, A.VarExpr) else s.value if isinstance(s, A.LiteralExpr) else None for s in sides]
            if any(f is None for f in found):
                return no
            a, b = found
            if not isinstance(a, Bound) and not isinstance(b, Bound):
                return F.lit((a == b) == (e.op == "="))
            if isinstance(a, Bound) and isinstance(b, Bound):
                same = equal(a, b) if a.shape == b.shape else a.term() == b.term()
                both = a.bound() & b.bound()
            else:
                bound, node = (a, b) if isinstance(a, Bound) else (b, a)
                same, both = matches(bound, node, guard or e.op != "="), bound.bound()
            if guard or e.op != "=":
                same = F.coalesce(same, no)
            return same if e.op == "=" else both & ~same
        a, b = self.value(e.left, rel), self.value(e.right, rel)
        test = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
        for side, column in ((e.left, a), (e.right, b)):
            whole = isinstance(side, A.VarExpr) and side.name in rel.vars and rel.vars[side.name].native in INTEGERS
            if not whole and not isinstance(side, A.LiteralExpr):
                test = test & ~F.isnan(column)
        return F.coalesce(test, no) if guard else test

    # forms
    def ordered(self, df: DataFrame, keys, cols: dict[str, Bound]) -> DataFrame:
        by: list[Column] = []
        for k in keys:
            if k.name not in cols:
                continue
            b = cols[k.name]
            rank = F.when(b.kind() == "iri", 1).when(b.kind() == "bnode", 2).when(b.kind() == "literal", 3)
            parts = ([rank] if b.form == "term" else []) + ([b.number()] if self.numeric_order else []) + [b.lexical()]
            by += [p.desc_nulls_last() if k.descending else p.asc_nulls_first() for p in parts]
        return df.orderBy(*by) if by else df

    def sliced(self, df: DataFrame, m: A.QueryModifiers) -> DataFrame:
        df = df.offset(m.offset) if m.offset else df
        return df.limit(m.limit) if m.limit is not None else df

    def select(self, q: A.SelectQuery) -> tuple[Relation, list[str]]:
        rel = self.group(q.where)
        names = [v.name if isinstance(v, A.Var) else v for v in q.variables] or A.get_variables(q.where)
        shown = [v for v in names if v in rel.vars]
        m = q.modifiers
        if q.distinct:
            hidden = [k for k in m.order_by if k.name in rel.vars and k.name not in shown]
            kept = Relation(rel.df, {v: rel.vars[v] for v in shown})
            cols = list(dict.fromkeys(c for b in kept.vars.values() for c in b.columns()))
            if hidden:
                # a value that is not shown orders its group by its first occurrence
                keys = {}
                aggs = []
                for i, k in enumerate(hidden):
                    b = rel.vars[k.name]
                    column = f"__k{i}"
                    aggs.append((F.max if k.descending else F.min)(b.lexical()).alias(column))
                    keys[k.name] = Bound("literal", (column,), native="string", maybe=True)
                df = kept.df.groupBy(*cols).agg(*aggs)
                df = self.sliced(self.ordered(df, m.order_by, kept.vars | keys), m)
                return Relation(df.select(*cols), kept.vars), shown
            rel = Relation(kept.df.select(*cols).distinct() if cols else kept.df.limit(1), kept.vars)
        df = self.sliced(self.ordered(rel.df, m.order_by, rel.vars), m)
        return Relation(df, {v: rel.vars[v] for v in shown}), shown

    def construct(self, q: A.ConstructQuery) -> DataFrame:
        rel = self.group(q.where)
        rel = Relation(self.sliced(self.ordered(rel.df, q.modifiers.order_by, rel.vars), q.modifiers), rel.vars)
        none = F.lit(None).cast(TERM)

        def part(t) -> Column:
            if isinstance(t, A.Var):
                return rel.vars[t.name].term() if t.name in rel.vars else none
            return term_literal(t)

        made = [F.struct(part(t.subject).alias("s"), part(t.predicate).alias("p"), part(t.object).alias("o")) for t in q.template]
        if not made:
            return self.graph.empty()
        df = rel.df.select(F.explode(F.array(*made)).alias("t")).select("t.*")
        df = df.where((F.col("s.kind") != "literal") & (F.col("p.kind") == "iri") & F.col("o").isNotNull())
        return df.select("s", F.col("p.value").alias("p"), "o").distinct()

    def ask(self, q: A.AskQuery) -> DataFrame:
        return self.group(q.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def describe(self, q: A.DescribeQuery) -> DataFrame:
        constants = [r for r in q.resources if not isinstance(r, A.Var)]
        names = [r.name for r in q.resources if isinstance(r, A.Var)]
        parts: list[Relation] = []
        if q.where:
            rel = self.group(q.where)
            rel = Relation(self.sliced(self.ordered(rel.df, q.modifiers.order_by, rel.vars), q.modifiers), rel.vars)
            parts = [distinct(Relation(rel.df.where(rel.vars[v].bound()), {v: rel.vars[v]})) for v in names if v in rel.vars]
            if constants:
                some = rel.df.limit(1).select(F.explode(F.array(*map(term_literal, constants))).alias("r"))
                parts.append(Relation(some, {"r": Bound("term", ("r",))}))
        elif constants:
            # constants are scanned for directly: their keys reach the sources
            found = [self.graph.triples(subject=c) for c in constants if not isinstance(c, Literal)] + [self.graph.triples(object=c) for c in constants]
            return reduce(lambda a, b: a.union(b), found).distinct()
        if not parts:
            return self.graph.empty()
        found = [f(p, next(iter(p.vars))) for p in parts for f in (self.graph.triples_of, self.graph.triples_to)]
        return reduce(lambda a, b: a.union(b), found).distinct()


KINDS = {"isiri": "iri", "isuri": "iri", "isliteral": "literal", "isblank": "bnode"}


def _filled(rel: Relation) -> Relation:
    return Relation(rel.df, rel.vars)


def distinct(rel: Relation) -> Relation:
    return Relation(rel.pruned().df.distinct(), rel.vars) if rel.vars else Relation(rel.df.limit(1), {})


def pattern_relation(df: DataFrame, pattern: A.TriplePattern) -> Relation:
    """A scan of ``(s, p, o)`` with a pattern's variables bound; a variable used twice is an equality."""
    spots = [(pattern.subject, "s"), (pattern.predicate, "p"), (pattern.object, "o")]
    df = df.select("s", F.struct(F.lit("iri").alias("kind"), F.col("p").alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")).alias("p"), "o")
    found: dict[str, Bound] = {}
    cols = []
    for t, c in spots:
        if isinstance(t, A.Var):
            if t.name in found:
                df = df.where(F.col(found[t.name].cols[0]) == F.col(c))
            else:
                found[t.name] = Bound("term", (c,))
                cols.append(c)
    rel = Relation(df.select(*cols), found)
    return rel.renamed() if found else rel


def results(rel: Relation, names: list[str], flat: bool) -> DataFrame:
    """One column a variable: term structs, or plain values."""
    cols = [(rel.vars[v].plain() if flat else rel.vars[v].term()).alias(v) for v in names]
    return rel.df.select(*cols)


