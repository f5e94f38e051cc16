"""A graph held as a DataFrame of triples. Stores are values: changing one gives a new plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.functions.terms import IRI, TRIPLE_SCHEMA, RDFNode, Triple, term_literal, triple_rows
from tripleweave.operators.graph import Graph, filtered
from tripleweave.plans import ast as A


#: Predicates, the commonest first, whose counts the planner keeps.
COUNTED = 10_000


class TripleStore(Graph):
    """A set of triples. ``df`` holds each triple once."""

    def __init__(self, spark: SparkSession, df: DataFrame | None = None, namespaces: dict[str, str] | None = None, is_set: bool = False):
        super().__init__(spark, namespaces)
        if df is None:
            df, is_set = self.empty(), True
        self.df = df if is_set else df.select("s", "p", "o").distinct()
        self._counts: dict[str, int] | None = None

    @classmethod
    def of(cls, spark: SparkSession, triples: Iterable[Triple], namespaces: dict[str, str] | None = None) -> TripleStore:
        return cls(spark, spark.createDataFrame(list(dict.fromkeys(triple_rows(triples))), TRIPLE_SCHEMA), namespaces, is_set=True)

    def _become(self, df: DataFrame) -> TripleStore:
        self.df, self._counts = df, None
        return self

    def add(self, *what) -> TripleStore:
        """Add a triple, its three parts, a list of triples or a DataFrame of them."""
        if len(what) == 3:
            what = (Triple(*what),)
        given = what[0]
        if not isinstance(given, DataFrame):
            rows = triple_rows([given] if isinstance(given, Triple) else given)
            given = self.spark.createDataFrame(rows, TRIPLE_SCHEMA)
        return self._become(self.df.union(given.select("s", "p", "o")).distinct())

    def remove(self, triple: Triple | list[Triple]) -> TripleStore:
        """Remove triples; absent ones are no error."""
        given = [triple] if isinstance(triple, Triple) else list(triple)
        gone = F.lit(False)
        for t in given:
            gone = gone | F.coalesce((F.col("s") == term_literal(t.subject)) & (F.col("p") == t.predicate.value) & (F.col("o") == term_literal(t.object)), F.lit(False))
        return self._become(self.df.where(~gone))

    def remove_all(self, triples: DataFrame) -> TripleStore:
        """Remove the triples of a DataFrame."""
        other = triples.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
        same = F.col("s").eqNullSafe(F.col("s2")) & (F.col("p") == F.col("p2")) & F.col("o").eqNullSafe(F.col("o2"))
        return self._become(self.df.join(other, same, "left_anti"))

    def triples(self, subject: RDFNode | None = None, predicate: IRI | None = None, object: RDFNode | None = None) -> DataFrame:
        return filtered(self.df, subject, predicate, object)

    def analyze(self) -> TripleStore:
        """Count predicates once; joins are then ordered by them."""
        self._counts = {r["p"]: r["n"] for r in self.predicate_counts().orderBy(F.desc("n")).limit(COUNTED).collect()}
        return self

    def cost(self, pattern: A.TriplePattern, free: int) -> float:
        if self._counts is None or not isinstance(pattern.predicate, IRI):
            return free * 1e12
        # a predicate that was not among those counted has no more triples than the last of them
        n = self._counts.get(pattern.predicate.value, min(self._counts.values()) if len(self._counts) == COUNTED else 0)
        return n / (1 + 1000 * sum(not isinstance(t, A.Var) for t in (pattern.subject, pattern.object)))

