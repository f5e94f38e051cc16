"""SHACL: shapes as values, and validation as set-based queries.

The focus nodes of a shape and their values of a path are one relation, planned like any query. Constraints
that look at single values are tested together in one pass over it; counting constraints aggregate it by
focus node (or not at all where the source gives one value at most); class and pair constraints are joins.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.functions.terms import IRI, TERM, Literal, RDFNode, node_of, number, term_literal
from tripleweave.functions.vocab import RDF
from tripleweave.plans import ast as A
from tripleweave.plans.bindings import Bound, Relation, aligned, equal, join, matches, union, unmatched
from tripleweave.plans.compile import Compiler, distinct


class Constraint:
    """A condition on the values of a property or on a node."""

    @property
    def name(self) -> str:
        return type(self).__name__


class Target:
    """What nodes a shape is about."""


class Shape:
    """A node or property shape."""


@dataclass(frozen=True)
class TargetClass(Target):
    class_iri: IRI


@dataclass(frozen=True)
class TargetNode(Target):
    node: RDFNode


@dataclass(frozen=True)
class TargetSubjectsOf(Target):
    property: IRI


@dataclass(frozen=True)
class TargetObjectsOf(Target):
    property: IRI


@dataclass(frozen=True)
class MinCount(Constraint):
    value: int


@dataclass(frozen=True)
class MaxCount(Constraint):
    value: int


@dataclass(frozen=True)
class Datatype(Constraint):
    datatype: IRI


@dataclass(frozen=True)
class Class(Constraint):
    class_iri: IRI


@dataclass(frozen=True)
class NodeKind(Constraint):
    kind: str


@dataclass(frozen=True)
class MinLength(Constraint):
    value: int


@dataclass(frozen=True)
class MaxLength(Constraint):
    value: int


@dataclass(frozen=True)
class Pattern(Constraint):
    pattern: str
    flags: str | None = None


@dataclass(frozen=True)
class LanguageIn(Constraint):
    languages: tuple


@dataclass(frozen=True)
class HasValue(Constraint):
    value: RDFNode


@dataclass(frozen=True)
class In(Constraint):
    values: tuple


@dataclass(frozen=True)
class MinInclusive(Constraint):
    value: object


@dataclass(frozen=True)
class MaxInclusive(Constraint):
    value: object


@dataclass(frozen=True)
class MinExclusive(Constraint):
    value: object


@dataclass(frozen=True)
class MaxExclusive(Constraint):
    value: object


@dataclass(frozen=True)
class Equals(Constraint):
    property: IRI


@dataclass(frozen=True)
class Disjoint(Constraint):
    property: IRI


@dataclass(frozen=True)
class LessThan(Constraint):
    property: IRI


@dataclass(frozen=True)
class LessThanOrEquals(Constraint):
    property: IRI


@dataclass(frozen=True)
class And(Constraint):
    shapes: tuple


@dataclass(frozen=True)
class Or(Constraint):
    shapes: tuple


@dataclass(frozen=True)
class Xone(Constraint):
    shapes: tuple


@dataclass(frozen=True)
class Not(Constraint):
    shape: Shape


@dataclass(frozen=True)
class Closed(Constraint):
    closed: bool = True
    ignored_properties: tuple = ()


@dataclass(frozen=True)
class UniqueLang(Constraint):
    unique_lang: bool = True


@dataclass(frozen=True)
class PropertyShape(Shape):
    path: IRI
    constraints: tuple = ()
    id: IRI | None = None
    message: str | None = None
    severity: str = "Violation"
    name: str | None = None


@dataclass(frozen=True)
class NodeShape(Shape):
    id: IRI
    targets: tuple = ()
    constraints: tuple = ()
    property_shapes: tuple = ()
    message: str | None = None
    severity: str = "Violation"
    deactivated: bool = False


@dataclass
class ValidationResult:
    focus_node: RDFNode
    result_path: IRI | None
    value: RDFNode | None
    source_constraint: str
    source_shape: str
    message: str
    severity: str
    detail: str | None = None


@dataclass
class ValidationReport:
    """``df``: one row a violation; ``conforms``: none of them has severity Violation."""

    df: DataFrame
    _conforms: bool | None = field(default=None, repr=False)

    @property
    def conforms(self) -> bool:
        if self._conforms is None:
            self._conforms = self.df.where(F.col("severity") == "Violation").isEmpty()
        return self._conforms

    @property
    def results(self) -> list[ValidationResult]:
        return [ValidationResult(node_of(r["focus_node"]), IRI(r["result_path"]) if r["result_path"] else None, node_of(r["value"]), *r[3:]) for r in self.df.collect()]


COLUMNS = ["focus_node", "result_path", "value", "source_constraint", "source_shape", "message", "severity", "detail"]
# The messages of results; braces are filled in their order.
MESSAGES = {
    "MinCount": "Property has {} values but requires at least {}",
    "MaxCount": "Property has {} values but allows at most {}",
    "Datatype": "Value must have datatype {}",
    "Class": "Value must be an instance of class {}",
    "NodeKind": "Value must be of node kind {}",
    "MinLength": "String length {} is less than minimum {}",
    "MaxLength": "String length {} exceeds maximum {}",
    "Pattern": "Value does not match pattern {}",
    "LanguageIn": "Language tag {} not in allowed languages",
    "HasValue": "Required value {} not found",
    "In": "Value not in allowed list",
    "MinInclusive": "Value must be >= {}",
    "MaxInclusive": "Value must be <= {}",
    "MinExclusive": "Value must be > {}",
    "MaxExclusive": "Value must be < {}",
    "Equals": "Property values must equal values of {}",
    "Disjoint": "Property values must be disjoint from {}",
    "LessThan": "Value must be less than values of {}",
    "LessThanOrEquals": "Value must be less than values of {}",
    "Not": "Node must NOT satisfy the constraint",
    "Or": "Node must satisfy at least one of the OR constraints",
    "Xone": "Node must satisfy exactly one of the XONE constraints",
    "Closed": "Property not allowed: {}",
    "UniqueLang": "Language tags must be unique",
}
BOUNDS = {"MinInclusive": ">=", "MaxInclusive": "<=", "MinExclusive": ">", "MaxExclusive": "<"}
NODE_KINDS = {
    "IRI": ("iri",),
    "Literal": ("literal",),
    "BlankNode": ("bnode",),
    "BlankNodeOrIRI": ("bnode", "iri"),
    "BlankNodeOrLiteral": ("bnode", "literal"),
    "IRIOrLiteral": ("iri", "literal"),
}


def message(c: Constraint, *parts) -> Column:
    """The message of a constraint, filled with columns or values."""
    first, *others = MESSAGES[c.name].split("{}")
    filled = [x for part, text in zip(parts, others, strict=True) for x in (part.cast("string") if isinstance(part, Column) else F.lit(str(part)), F.lit(text))]
    return F.concat(F.lit(first), *filled)


def _shown(value) -> str:
    return value.value if isinstance(value, IRI | Literal) else value.id if isinstance(value, RDFNode) else str(value)


class Validator:
    def __init__(self, graph, extensions: bool = False):
        self.graph, self.extensions, self.plan = graph, extensions, Compiler(graph)

    # focus nodes
    def focus(self, shape: NodeShape) -> tuple[Relation | None, list[A.TriplePattern] | None]:
        """Focus nodes as variable ``f``, and the patterns that give them if those alone do."""
        parts, patterns = [], None
        for t in shape.targets:
            if isinstance(t, TargetNode):
                df = self.graph.spark.range(1).select(term_literal(t.node).alias("f"))
                parts.append(Relation(df, {"f": Bound("term", ("f",))}))
                continue
            f, x = A.Var("f"), A.Var("x")
            if isinstance(t, TargetClass):
                patterns = [A.TriplePattern(f, RDF.type, t.class_iri)]
            elif isinstance(t, TargetSubjectsOf):
                patterns = [A.TriplePattern(f, t.property, x)]
            else:
                patterns = [A.TriplePattern(x, t.property, f)]
            rel = self.plan.basic(patterns)
            rel = Relation(rel.df, {"f": rel.vars["f"]}).pruned()
            parts.append(rel if isinstance(t, TargetClass) else distinct(rel))
        if not parts:
            return None, None
        if len(parts) > 1:
            return distinct(union(parts)), None
        return parts[0], patterns if isinstance(shape.targets[0], TargetClass) else None

    def values(self, focus: Relation, patterns, path: IRI) -> tuple[Relation, bool]:
        """Focus nodes with their values ``v`` (unbound where there are none); whether there is one at most."""
        want = A.TriplePattern(A.Var("f"), path, A.Var("v"))
        if patterns and (wide := self.graph.widened(patterns, want)):
            return wide, self.graph.functional(patterns[0].object, path)
        return join(focus, self.plan.basic([want]), outer=True), False

    # results
    def rows(self, df: DataFrame, focus: Column, constraint: Constraint, shape_id: str, message: Column, path: str | None, severity: str, value: Column | None = None) -> DataFrame:
        none = F.lit(None)
        return df.select(
            focus.alias("focus_node"),
            F.lit(path).cast("string").alias("result_path"),
            (none.cast(TERM) if value is None else value).alias("value"),
            F.lit(constraint.name).alias("source_constraint"),
            F.lit(shape_id).alias("source_shape"),
            message.alias("message"),
            F.lit(severity).alias("severity"),
            none.cast("string").alias("detail"),
        )

    def node_shape(self, shape: NodeShape, focus: Relation, patterns=None) -> list[DataFrame]:
        out = [d for c in shape.constraints for d in self.node_constraint(c, shape, focus)]
        return out + [d for p in shape.property_shapes for d in self.property_shape(p, shape, focus, patterns)]

    def property_shape(self, shape: PropertyShape, owner: NodeShape, focus: Relation, patterns) -> list[DataFrame]:
        rel, single = self.values(focus, patterns, shape.path)
        f, v = rel.vars["f"], rel.vars["v"]
        shape_id = shape.id.value if shape.id else owner.id.value
        path, severity = shape.path.value, shape.severity

        def said(text: Column) -> Column:
            return F.lit(shape.message) if shape.message is not None else text

        out: list[DataFrame] = []
        counting = [c for c in shape.constraints if isinstance(c, MinCount | MaxCount | HasValue)]
        if counting:
            wanted = [c for c in counting if isinstance(c, HasValue)]
            if single:
                n = F.when(v.bound(), 1).otherwise(0).cast("long")
                per = rel.df.select(*f.columns(), n.alias("__n"), *(matches(v, c.value).alias(f"__h{i}") for i, c in enumerate(wanted)))
            else:
                per = rel.df.groupBy(*f.columns()).agg(F.count(v.cols[0]).alias("__n"), *(F.max(matches(v, c.value)).alias(f"__h{i}") for i, c in enumerate(wanted)))
            for c in counting:
                if isinstance(c, HasValue):
                    test, text = ~F.col(f"__h{wanted.index(c)}"), message(c, _shown(c.value))
                else:
                    low = isinstance(c, MinCount)
                    test = F.col("__n") < c.value if low else F.col("__n") > c.value
                    text = message(c, F.col("__n"), c.value)
                out.append(self.rows(per.where(test), f.term(), c, shape_id, said(text), path, severity))
        tests = []
        for c in shape.constraints:
            if (found := self.value_test(c, v)) is not None:
                test, text = found
                tests.append(F.when(test, F.struct(F.lit(c.name).alias("c"), said(text).alias("m"))))
        if tests:
            bad = F.filter(F.array(*tests), lambda x: x.isNotNull())
            hit = rel.df.where(v.bound()).select(f.term().alias("f"), v.term().alias("v"), F.explode(bad).alias("b"))
            none = F.lit(None).cast("string")
            out.append(hit.select(F.col("f").alias("focus_node"), F.lit(path).alias("result_path"), F.col("v").alias("value"), F.col("b.c").alias("source_constraint"), F.lit(shape_id).alias("source_shape"), F.col("b.m").alias("message"), F.lit(severity).alias("severity"), none.alias("detail")))
        known = (*VALUE_CONSTRAINTS, MinCount, MaxCount, HasValue)
        for c in shape.constraints:
            if isinstance(c, known):
                continue
            if isinstance(c, Class):
                bound = Relation(rel.df.where(v.bound()), rel.vars)
                typed = self.plan.basic([A.TriplePattern(A.Var("v"), RDF.type, c.class_iri)])
                a, b, possible = aligned(bound, typed.renamed(), ["v"])
                on = equal(a.vars["v"], b.vars["v"]) if possible else F.lit(False)
                bad = a.df.join(b.df, on, "left_anti")
                out.append(self.rows(bad, a.vars["f"].term(), c, shape_id, said(message(c, c.class_iri.value)), path, severity, a.vars["v"].term()))
            elif isinstance(c, Equals):
                text = said(message(c, c.property.value))
                out.append(self.rows(self.unequal(focus, rel, c.property), F.col("f"), c, shape_id, text, path, severity))
            elif isinstance(c, Disjoint):
                other = self.plan.basic([A.TriplePattern(A.Var("f"), c.property, A.Var("v"))])
                both = join(Relation(rel.df.where(v.bound()), rel.vars | {"v": _sure(v)}), other)
                out.append(self.rows(both.df, both.vars["f"].term(), c, shape_id, said(message(c, c.property.value)), path, severity))
            elif isinstance(c, And | Or | Not | Xone):
                out += self.logical(c, shape_id, focus, path, severity, shape.message)
            elif self.extensions and isinstance(c, LessThan | LessThanOrEquals):
                other = self.plan.basic([A.TriplePattern(A.Var("f"), c.property, A.Var("w"))])
                both = join(Relation(rel.df.where(v.bound()), rel.vars | {"v": _sure(v)}), other)
                a, b = both.vars["v"].number(), both.vars["w"].number()
                fine = F.coalesce(a < b if isinstance(c, LessThan) else a <= b, F.lit(False))
                out.append(self.rows(both.df.where(~fine), both.vars["f"].term(), c, shape_id, said(message(c, c.property.value)), path, severity, both.vars["v"].term()))
            elif self.extensions and isinstance(c, UniqueLang):
                tagged = rel.df.where(v.bound()).select(f.term().alias("f"), v.term()["lang"].alias("l")).where("l is not null")
                twice = tagged.groupBy("f", "l").count().where("count > 1").select("f").distinct()
                out.append(self.rows(twice, F.col("f"), c, shape_id, said(message(c)), path, severity))
            else:
                warnings.warn(f"constraint {c.name} is not enforced", stacklevel=2)
        return out

    def unequal(self, focus: Relation, rel: Relation, other: IRI) -> DataFrame:
        """Focus nodes that have a value of one of two properties that is none of the other."""
        v = rel.vars["v"]
        mine = Relation(rel.df.where(v.bound()), {"f": rel.vars["f"], "v": _sure(v)})
        theirs = join(focus, self.plan.basic([A.TriplePattern(A.Var("f"), other, A.Var("v"))]))
        odd = [unmatched(mine, theirs), unmatched(theirs, mine)]
        return reduce(lambda a, b: a.union(b), (r.df.select(r.vars["f"].term().alias("f")) for r in odd)).distinct()

    def value_test(self, c: Constraint, v: Bound) -> tuple[Column, Column] | None:
        """Violation condition and message for constraints on a single value."""
        no = F.lit(False)
        literal = F.coalesce(v.kind() == "literal", no)
        text = v.lexical()
        if isinstance(c, Datatype):
            own = v.term()["datatype"] if v.form == "term" else F.lit(v.datatype).cast("string")
            return ~(literal & F.coalesce(own == c.datatype.value, no)), message(c, c.datatype.value)
        if isinstance(c, NodeKind):
            kinds = NODE_KINDS.get(c.kind, ())
            return (~F.coalesce(v.kind().isin(*kinds), no) if kinds else F.lit(True)), message(c, c.kind)
        if isinstance(c, MinLength):
            return literal & (F.length(text) < c.value), message(c, F.length(text), c.value)
        if isinstance(c, MaxLength):
            return literal & (F.length(text) > c.value), message(c, F.length(text), c.value)
        if isinstance(c, Pattern):
            pattern = (f"(?{c.flags})" if c.flags else "") + c.pattern
            if not self.sound(pattern):
                return None
            return literal & ~text.rlike(pattern), message(c, c.pattern)
        if isinstance(c, LanguageIn):
            lang = v.term()["lang"]
            return literal & lang.isNotNull() & ~lang.isin(*c.languages), message(c, F.coalesce(lang, F.lit("")))
        if isinstance(c, In):
            return ~reduce(lambda a, b: a | b, (matches(v, x) for x in c.values), no), message(c)
        if c.name in BOUNDS:
            bound = F.lit(float(c.value)) if not isinstance(c.value, str) else number(F.lit(c.value))
            n, op = v.number(), BOUNDS[c.name]
            fine = {">=": n >= bound, "<=": n <= bound, ">": n > bound, "<": n < bound}[op]
            return ~F.coalesce(fine & ~F.isnan(n), no), message(c, c.value)
        return None

    def sound(self, pattern: str) -> bool:
        """Whether the engine takes a pattern; if not, the constraint is reported and gives no results."""
        try:
            self.graph.spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
            return True
        except (Py4JJavaError, PySparkException):
            warnings.warn(f"invalid pattern {pattern!r}; the constraint gives no results", stacklevel=2)
            return False

    def node_constraint(self, c: Constraint, shape: NodeShape, focus: Relation) -> list[DataFrame]:
        """Constraints of a node shape itself: they see no values, only the node."""
        f, shape_id = focus.vars["f"], shape.id.value
        if isinstance(c, MinCount) and c.value > 0:
            return [self.rows(focus.df, f.term(), c, shape_id, message(c, 0, c.value), None, "Violation")]
        if isinstance(c, HasValue):
            return [self.rows(focus.df, f.term(), c, shape_id, message(c, _shown(c.value)), None, "Violation")]
        if isinstance(c, Equals):
            other = self.plan.basic([A.TriplePattern(A.Var("f"), c.property, A.Var("v"))])
            found = join(focus, other)
            found = distinct(Relation(found.df, {"f": found.vars["f"]}))
            return [self.rows(found.df, found.vars["f"].term(), c, shape_id, message(c, c.property.value), None, "Violation")]
        if isinstance(c, And | Or | Not | Xone):
            return self.logical(c, shape_id, focus, None, "Violation", None)
        if self.extensions and isinstance(c, Closed):
            return self.closed(c, shape, focus)
        if isinstance(c, LessThan | LessThanOrEquals | UniqueLang | Closed):
            warnings.warn(f"constraint {c.name} is not enforced", stacklevel=2)
        return []

    def closed(self, c: Closed, shape: NodeShape, focus: Relation) -> list[DataFrame]:
        allowed = [p.path.value for p in shape.property_shapes] + [p.value for p in c.ignored_properties]
        f = focus.vars["f"]
        nodes = distinct(Relation(focus.df, {"f": f}))
        bad = self.graph.triples_of(nodes, "f").where(~F.col("p").isin(*allowed) if allowed else F.lit(True))
        return [self.rows(bad, F.col("s"), c, shape.id.value, message(c, F.col("p")), None, "Violation", F.col("o"))] if c.closed else []

    def violators(self, shape: Shape, focus: Relation) -> DataFrame | None:
        """Distinct focus nodes with any result under a node shape; None: it has none for certain."""
        found = self.node_shape(shape, focus) if isinstance(shape, NodeShape) else []
        return reduce(lambda a, b: a.union(b), (d.select("focus_node") for d in found)).distinct() if found else None

    def logical(self, c: Constraint, shape_id: str, focus: Relation, path: str | None, severity: str, own: str | None) -> list[DataFrame]:
        nodes = focus.df.select(focus.vars["f"].term().alias("focus_node"))
        if isinstance(c, And):
            return [d for s in c.shapes if isinstance(s, NodeShape) for d in self.node_shape(s, focus)]
        if isinstance(c, Not):
            if not isinstance(c.shape, NodeShape):
                return []
            bad = self.violators(c.shape, focus)
            held = nodes if bad is None else nodes.join(bad, "focus_node", "left_anti")
        elif isinstance(c, Or):
            held = nodes
            for s in c.shapes:
                if isinstance(s, NodeShape):
                    bad = self.violators(s, focus)
                    if bad is None:
                        return []
                    held = held.join(bad, "focus_node", "left_semi")
        elif self.extensions:
            held = nodes.withColumn("__ok", F.lit(0))
            for s in c.shapes:
                if isinstance(s, NodeShape):
                    bad = self.violators(s, focus)
                    flag = F.lit(1)
                    if bad is not None:
                        held, flag = held.join(bad.withColumn("__bad", F.lit(1)), "focus_node", "left"), F.when(F.col("__bad").isNull(), 1).otherwise(0)
                    held = held.select("focus_node", (F.col("__ok") + flag).alias("__ok"))
            held = held.where("__ok <> 1")
        else:
            warnings.warn(f"constraint {c.name} is not enforced", stacklevel=2)
            return []
        return [self.rows(held.distinct(), F.col("focus_node"), c, shape_id, F.lit(own) if own else message(c), path, severity)]


VALUE_CONSTRAINTS = (Datatype, NodeKind, MinLength, MaxLength, Pattern, LanguageIn, In, MinInclusive, MaxInclusive, MinExclusive, MaxExclusive)


def _sure(b: Bound) -> Bound:
    return replace(b, maybe=False)


def validate(graph, shapes, extensions: bool = False) -> ValidationReport:
    """Report on all active node shapes. ``extensions`` also enforces LessThan(OrEquals), Xone, Closed and UniqueLang."""
    if not isinstance(shapes, list | tuple):
        raise NotImplementedError("shapes are given as a list; reading them from a graph is not supported")
    check, out = Validator(graph, extensions), []
    for shape in shapes:
        if isinstance(shape, NodeShape) and not shape.deactivated:
            focus, patterns = check.focus(shape)
            if focus is not None:
                out += check.node_shape(shape, focus, patterns)
    if not out:
        empty = graph.spark.range(0).select(*(F.lit(None).cast(TERM if c in ("focus_node", "value") else "string").alias(c) for c in COLUMNS))
        return ValidationReport(empty)
    return ValidationReport(reduce(lambda a, b: a.unionByName(b), out))


def target_nodes(graph, shape: NodeShape) -> DataFrame:
    focus, _ = Validator(graph).focus(shape)
    return focus.df.select(focus.vars["f"].term().alias("focus_node")) if focus else graph.spark.range(0).select(F.lit(None).cast(TERM).alias("focus_node"))


def property_values(graph, node: RDFNode, path: IRI) -> DataFrame:
    return graph.triples(node, path).select("o")


def is_instance_of(graph, node: RDFNode, class_iri: IRI) -> bool:
    return not graph.triples(node, RDF.type, class_iri).isEmpty()
