"""Relational tables as a virtual graph.

Each row is a subject, each mapped column a property. Nothing is materialised: patterns about one subject
become one scan of the table with the columns that they name, constants become predicates on key columns,
and joins compare keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.functions.terms import IRI, BlankNode, Literal, RDFNode, iri_term
from tripleweave.functions.vocab import RDF
from tripleweave.operators.graph import Graph
from tripleweave.plans import ast as A
from tripleweave.plans.bindings import Bound, Relation, datatype_of, equal, fresh, matches


@dataclass(frozen=True)
class Property:
    """An object from one column: a literal, or an IRI with ``prefix``. ``lang``: the column of the language."""

    predicate: str
    column: str
    prefix: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class TableMap:
    """``keys`` identify a row; ``nullable``: columns that may hold NULL (they are then no triple).

    ``source`` may be a function, so that only the tables of a query are opened.
    """

    name: str
    source: DataFrame | Callable[[], DataFrame]
    prefix: str
    keys: tuple
    rdf_class: str
    properties: tuple
    form: str = "iri"
    nullable: frozenset = frozenset()
    weight: float = 1e6

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source

    @cached_property
    def types(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def type_of(self, column: str) -> str:
        return self.types[column]

    def subject(self) -> Bound:
        native = self.type_of(self.keys[0]) if len(self.keys) == 1 else ""
        return Bound(self.form, self.keys, prefix=self.prefix, native=native)

    def object(self, p: Property) -> Bound:
        native = self.type_of(p.column)
        if p.prefix is not None:
            return Bound("iri", (p.column,), prefix=p.prefix, native=native)
        return Bound("literal", (p.column,), datatype=None if p.lang else datatype_of(native), lang=p.lang, native=native)


def could_be(b: Bound, node: RDFNode) -> bool:
    """Whether a constant may come from a binding at all."""
    if b.form == "literal":
        return isinstance(node, Literal) and (node.datatype.value if node.datatype else None) == b.datatype and bool(node.lang) == bool(b.lang)
    text = node.value if isinstance(node, IRI) and b.form == "iri" else node.label if isinstance(node, BlankNode) and b.form == "bnode" else None
    return text is not None and text.startswith(b.prefix)


@dataclass
class _Star:
    table: TableMap
    subject: object
    patterns: list = field(default_factory=list)


class VirtualGraph(Graph):
    def __init__(self, spark: SparkSession, tables: list[TableMap], namespaces: dict[str, str] | None = None):
        super().__init__(spark, namespaces)
        self.tables = tables

    def _sources(self, pattern: A.TriplePattern) -> list[TableMap]:
        """Tables that can answer a pattern with a constant predicate."""
        p = pattern.predicate
        if p == RDF.type:
            found = [t for t in self.tables if isinstance(pattern.object, A.Var) or pattern.object == IRI(t.rdf_class)]
        else:
            found = [t for t in self.tables if any(x.predicate == p.value for x in t.properties)]
        if not isinstance(pattern.subject, A.Var):
            found = [t for t in found if could_be(Bound(t.form, t.keys, prefix=t.prefix), pattern.subject)]
        return found

    # plain scans
    def triples(self, subject: RDFNode | None = None, predicate: IRI | None = None, object: RDFNode | None = None) -> DataFrame:
        parts = []
        for t in self.tables:
            if subject is not None and not could_be(Bound(t.form, t.keys, prefix=t.prefix), subject):
                continue
            wanted = [p for p in t.properties if predicate in (None, IRI(p.predicate))]
            if not wanted and predicate != RDF.type:
                continue
            if object is not None and not self._may_hold(t, wanted, object, predicate):
                continue
            own = t.subject()
            df = t.df.where(matches(own, subject, guard=False)) if subject is not None else t.df
            made: list[tuple[Column, Column, Column]] = []
            if predicate in (None, RDF.type) and object in (None, IRI(t.rdf_class)):
                made.append((F.lit(RDF.type.value), iri_term(F.lit(t.rdf_class)), F.lit(True)))
            for p in wanted:
                b = t.object(p)
                if object is not None and not could_be(b, object):
                    continue
                test = F.col(p.column).isNotNull() if p.column in t.nullable else F.lit(True)
                made.append((F.lit(p.predicate), b.term(), test & matches(b, object) if object is not None else test))
            if not made:
                continue
            if len(made) == 1:
                p, o, test = made[0]
                parts.append(df.where(test).select(own.term().alias("s"), p.alias("p"), o.alias("o")))
            else:
                pairs = F.array(*(F.when(test, F.struct(p.alias("p"), o.alias("o"))) for p, o, test in made))
                df = df.where(reduce(lambda a, b: a | b, (m[2] for m in made))) if object is not None else df
                parts.append(df.select(own.term().alias("s"), F.explode(pairs).alias("t")).where("t is not null").select("s", "t.p", "t.o"))
        return reduce(lambda a, b: a.union(b), parts) if parts else self.empty()

    @staticmethod
    def _may_hold(t: TableMap, wanted: list[Property], node: RDFNode, predicate: IRI | None) -> bool:
        """Whether an object can come from a table, judged without opening it."""
        if isinstance(node, Literal):
            return any(p.prefix is None for p in wanted)
        if isinstance(node, IRI):
            return predicate in (None, RDF.type) and node.value == t.rdf_class or any(p.prefix is not None and node.value.startswith(p.prefix) for p in wanted)
        return False

    def _reached(self, rel: Relation, name: str, bounds) -> list[tuple[TableMap, DataFrame]]:
        """Tables, and their rows, of which one of ``bounds(table)`` has a value of a variable; told by keys, not by terms."""
        own, found = rel.vars[name], []
        for t in self.tables:
            for b, part in bounds(t):
                if own.form == "term":
                    found.append((part, t.df.join(rel.df, b.term() == own.term(), "left_semi")))
                elif b.form == own.form and b.prefix == own.prefix and len(b.cols) == len(own.cols):
                    keys = rel.df.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(own.cols)))
                    same = reduce(lambda x, y: x & y, (t.df[c] == keys[f"__k{i}"] for i, c in enumerate(b.cols)))
                    found.append((part, t.df.join(keys, same, "left_semi")))
                elif b.form == own.form and (b.prefix.startswith(own.prefix) or own.prefix.startswith(b.prefix)):
                    found.append((part, t.df.join(rel.df, b.lexical() == own.lexical(), "left_semi")))
        return found

    def triples_of(self, rel: Relation, name: str) -> DataFrame:
        parts = self._reached(rel, name, lambda t: [(t.subject(), t)])
        return VirtualGraph(self.spark, [replace(t, source=df) for t, df in parts]).triples()

    def triples_to(self, rel: Relation, name: str) -> DataFrame:
        own = rel.vars[name]
        if own.form not in ("iri", "bnode"):
            return super().triples_to(rel, name)

        def links(t: TableMap) -> list:
            return [(t.object(p), replace(t, properties=(p,))) for p in t.properties if p.prefix is not None]

        parts = [VirtualGraph(self.spark, [replace(t, source=df)]).triples(predicate=IRI(t.properties[0].predicate)) for t, df in self._reached(rel, name, links)]
        if own.form == "iri" and any(t.rdf_class.startswith(own.prefix) for t in self.tables):  # a class may be a value too
            wanted = rel.df.select(own.term().alias("__wanted"))
            parts.append(self.triples(predicate=RDF.type).join(wanted, F.col("o") == F.col("__wanted"), "left_semi"))
        return reduce(lambda a, b: a.union(b), parts) if parts else self.empty()

    # stars
    def stars(self, patterns: list[A.TriplePattern]) -> list[tuple]:
        found: list[_Star] = []
        rest = []
        for p in patterns:
            sources = self._sources(p) if isinstance(p.predicate, IRI) else []
            if len(sources) != 1 or p.predicate == RDF.type and isinstance(p.object, A.Var):
                rest.append(p)
                continue
            star = next((s for s in found if s.subject == p.subject and s.table is sources[0]), None)
            if star is None:
                found.append(star := _Star(sources[0], p.subject))
            star.patterns.append(p)
        out = []
        for s in found:
            given = sum(not isinstance(p.object, A.Var) and p.predicate != RDF.type for p in s.patterns) + 2 * (not isinstance(s.subject, A.Var))
            out.append((s.table.weight / 1000**given, lambda s=s: self.star(s), set(A.get_variables(s.patterns))))
        return out + [(1e12, lambda p=p: self.scan(p), set(A.get_variables(p))) for p in rest]

    def widened(self, patterns: list[A.TriplePattern], optional: A.TriplePattern) -> Relation | None:
        sources = [self._sources(p) if isinstance(p.predicate, IRI) else [] for p in [*patterns, optional]]
        same = all(len(s) == 1 and s[0] is sources[0][0] for s in sources) and len({p.subject for p in [*patterns, optional]}) == 1
        named = isinstance(optional.object, A.Var) and optional.object.name not in A.get_variables(patterns)
        if not same or not named or not isinstance(optional.subject, A.Var) or RDF.type in (optional.predicate,):
            return None
        return self.star(_Star(sources[0][0], optional.subject, list(patterns)), optional)

    def star(self, star: _Star, optional: A.TriplePattern | None = None) -> Relation:
        """One scan that answers all patterns about one subject."""
        t, tests, held = star.table, [], {}
        own = t.subject()
        if isinstance(star.subject, A.Var):
            held[star.subject.name] = own
        else:
            tests.append(matches(own, star.subject, guard=False))
        spots = [(p, False) for p in star.patterns] + ([(optional, True)] if optional else [])
        for p, may in spots:
            if p.predicate == RDF.type:
                continue
            prop = next(x for x in t.properties if x.predicate == p.predicate.value)
            b = replace(t.object(prop), maybe=may and prop.column in t.nullable)
            if prop.column in t.nullable and not may:
                tests.append(F.col(prop.column).isNotNull())
            if not isinstance(p.object, A.Var):
                tests.append(matches(b, p.object, guard=False))
            elif p.object.name in held:
                other = held[p.object.name]
                tests.append(equal(other, b) if other.shape == b.shape else other.term() == b.term())
            else:
                held[p.object.name] = b
        df = reduce(lambda d, c: d.where(c), tests, t.df)
        cols, out = [], {}
        for v, b in held.items():
            names = tuple(fresh(v) for _ in b.cols)
            lang = fresh(v) if b.lang else None
            cols += [F.col(c).alias(n) for c, n in zip(b.cols, names, strict=True)]
            if lang:
                cols.append(F.col(b.lang).alias(lang))
            out[v] = replace(b, cols=names, lang=lang)
        return Relation(df.select(*cols), out)

    def functional(self, rdf_class: IRI, path: IRI) -> bool:
        """Whether instances of a class have one value of a property at most."""
        homes = [t for t in self.tables if t.rdf_class == rdf_class.value]
        users = [t for t in self.tables if any(p.predicate == path.value for p in t.properties)]
        return len(homes) == 1 and users == homes and sum(p.predicate == path.value for p in homes[0].properties) == 1


BASE = "http://example.org/tpch/"


def sample_graph(spark: SparkSession, sf_dir: str) -> VirtualGraph:
    """The graph of the benchmark's tables."""

    def read(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def table(name: str, keys: str, literals: str = "", links: str = "", weight: float = 1e6, source: Callable[[], DataFrame] | None = None, prefix: str | None = None, form: str = "iri", lang: dict | None = None) -> TableMap:
        props = [Property(BASE + c, c, lang=(lang or {}).get(c)) for c in literals.split()]
        for link in links.split():
            column, target = link.split(">")
            predicate, _, column = column.rpartition("=")
            props.append(Property(BASE + (predicate or column), column, prefix=f"{BASE}{target}/"))
        return TableMap(name, source or read(name), prefix if prefix is not None else f"{BASE}{name}/", tuple(keys.split()), BASE + name.capitalize(), tuple(props), form, weight=weight)

    tables = [
        table("region", "r_regionkey", "r_name", weight=5),
        table("nation", "n_nationkey", "n_name", "n_regionkey>region", 25),
        table("customer", "c_custkey", "c_name c_acctbal c_mktsegment", "c_nationkey>nation", 1.5e5),
        table("supplier", "s_suppkey", "s_name s_acctbal", "s_nationkey>nation", 1e4),
        table("part", "p_partkey", "p_name p_brand p_type p_size p_retailprice", weight=2e5),
        table("orders", "o_orderkey", "o_orderstatus o_totalprice o_orderdate o_orderpriority", "o_custkey>customer", 1.5e6),
        table(
            "lineitem",
            "l_orderkey l_linenumber l_partkey l_suppkey l_count",
            "l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
            "l_orderkey>orders l_partkey>part l_suppkey>supplier",
            6e6,
            lambda: read("lineitem")().withColumn("l_count", F.col("l_quantity").cast("bigint")),
        ),
        table("events", "event_id", "ts event_type value props", "user_id>customer", 1e6),
        table("documents", "doc_id", "text source n_chars", weight=1e5, lang={"text": "lang"}),
        table("labels", "doc_id", "quality toxic", "label_of=doc_id>documents", 4e4),
        table("conversations", "conv_id turn", "role", weight=5e4, prefix="c", form="bnode"),
    ]
    number = Property(BASE + "region_number", "n_regionkey", prefix=f"{BASE}num/")
    tables.append(TableMap("number", read("nation"), f"{BASE}num/", ("n_nationkey",), BASE + "Number", (number,), weight=25))
    return VirtualGraph(spark, tables, {"t": BASE, "rdf": RDF.ns})
