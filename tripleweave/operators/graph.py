"""What every graph offers: triple scans with eight access paths, statistics, prefixes and queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.functions.terms import IRI, TRIPLE_SCHEMA, RDFNode, Triple, node_of, row_of, term_literal
from tripleweave.plans import ast as A
from tripleweave.plans.bindings import Relation
from tripleweave.plans.compile import Compiler, pattern_relation, results
from tripleweave.plans.parser import parse_sparql
from tripleweave.plans.results import AskResult, ConstructResult, DescribeResult, SelectResult


def filtered(df: DataFrame, subject: RDFNode | None, predicate: IRI | None, object: RDFNode | None) -> DataFrame:
    """Triples that agree with the given parts."""
    if subject is not None:
        kind, value, *_ = row_of(subject)
        df = df.where((F.col("s.value") == value) & (F.col("s.kind") == kind))
    if predicate is not None:
        df = df.where(F.col("p") == predicate.value)
    return df.where(F.col("o") == term_literal(object)) if object is not None else df


class Graph:
    def __init__(self, spark: SparkSession, namespaces: dict[str, str] | None = None):
        self.spark, self.namespaces = spark, dict(namespaces or {})

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], TRIPLE_SCHEMA)

    # access
    def triples(self, subject: RDFNode | None = None, predicate: IRI | None = None, object: RDFNode | None = None) -> DataFrame:
        raise NotImplementedError

    def has_triple(self, triple: Triple) -> bool:
        return not self.triples(triple.subject, triple.predicate, triple.object).isEmpty()

    def __iter__(self):
        for r in self.triples().toLocalIterator():
            yield Triple(node_of(r["s"]), IRI(r["p"]), node_of(r["o"]))

    def __len__(self) -> int:
        return self.count_triples()

    # statistics
    def count_triples(self) -> int:
        return self.triples().count()

    def count_subjects(self) -> int:
        return self.triples().select("s").distinct().count()

    def count_predicates(self) -> int:
        return self.triples().select("p").distinct().count()

    def count_objects(self) -> int:
        return self.triples().select("o").distinct().count()

    def get_predicate_count(self, predicate: IRI) -> int:
        return self.triples(predicate=predicate).count()

    def predicate_counts(self) -> DataFrame:
        return self.triples().groupBy("p").agg(F.count("*").alias("n"))

    # prefixes
    def register_namespace(self, prefix: str, iri: IRI | str) -> Graph:
        self.namespaces[prefix] = iri.value if isinstance(iri, IRI) else iri
        return self

    def expand(self, curie: str) -> IRI:
        prefix, colon, local = curie.partition(":")
        if not colon or prefix not in self.namespaces:
            raise ValueError(f"unknown prefix in {curie!r}")
        return IRI(self.namespaces[prefix] + local)

    def abbreviate(self, iri: IRI) -> str | None:
        """The CURIE under the longest namespace that fits."""
        fits = [(len(ns), p) for p, ns in self.namespaces.items() if iri.value.startswith(ns)]
        if not fits:
            return None
        n, prefix = max(fits)
        return f"{prefix}:{iri.value[n:]}"

    # planning
    def stars(self, patterns: list[A.TriplePattern]) -> list[tuple]:
        """``(cost, make relation, variables)`` of every scan that the patterns need."""
        out = []
        for p in patterns:
            free = sum(isinstance(t, A.Var) for t in (p.subject, p.predicate, p.object))
            out.append((self.cost(p, free), lambda p=p: self.scan(p), set(A.get_variables(p))))
        return out

    def cost(self, pattern: A.TriplePattern, free: int) -> float:
        return float(free)

    def widened(self, patterns: list[A.TriplePattern], optional: A.TriplePattern) -> Relation | None:
        """A scan that also answers an optional pattern, if one source can."""
        return None

    def functional(self, rdf_class: IRI, path: IRI) -> bool:
        return False

    def scan(self, pattern: A.TriplePattern) -> Relation:
        given = [None if isinstance(t, A.Var) else t for t in (pattern.subject, pattern.predicate, pattern.object)]
        return pattern_relation(self.triples(*given), pattern)

    def triples_of(self, rel: Relation, name: str) -> DataFrame:
        """Triples whose subject is a value of a variable."""
        wanted = rel.df.select(rel.vars[name].term().alias("__wanted"))
        return self.triples().join(wanted, F.col("s") == F.col("__wanted"), "left_semi")

    def triples_to(self, rel: Relation, name: str) -> DataFrame:
        """Triples whose object is a value of a variable."""
        wanted = rel.df.select(rel.vars[name].term().alias("__wanted"))
        return self.triples().join(wanted, F.col("o") == F.col("__wanted"), "left_semi")

    # queries
    def query(self, q: A.SPARQLQuery | str, extensions: bool = False, numeric_order: bool = False):
        """Run a query, given as a tree or as text (which may use this graph's prefixes)."""
        if isinstance(q, str):
            own = set(re.findall(r"(?i)prefix\s+([\w-]*):", q))
            q = parse_sparql("".join(f"PREFIX {p}: <{ns}>\n" for p, ns in self.namespaces.items() if p not in own) + q)
        plan = Compiler(self, extensions, numeric_order)
        if isinstance(q, A.SelectQuery):
            rel, names = plan.select(q)
            return SelectResult(results(rel, names, False), results(rel, names, True), names)
        if isinstance(q, A.ConstructQuery):
            return ConstructResult(plan.construct(q))
        if isinstance(q, A.AskQuery):
            return AskResult(plan.ask(q))
        if isinstance(q, A.DescribeQuery):
            return DescribeResult(plan.describe(q))
        raise TypeError(f"not a query: {q!r}")
