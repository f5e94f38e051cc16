"""Query results: a DataFrame, with the iteration that callers expect on top."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripleweave.functions.terms import IRI, Triple, node_of


class _Rows:
    def __init__(self, df: DataFrame):
        self.df, self._rows = df, None

    def _collected(self) -> list:
        if self._rows is None:
            self._rows = [self._item(r) for r in self.df.collect()]
        return self._rows

    def __iter__(self):
        return iter(self._collected())

    def __len__(self) -> int:
        return len(self._collected())

    def __getitem__(self, i):
        return self._collected()[i]


class SelectResult(_Rows):
    """Solutions. ``df``: one term column a variable; ``flat``: one plain column a variable."""

    def __init__(self, df: DataFrame, flat: DataFrame, variables: list[str]):
        super().__init__(df)
        self.flat, self.variables = flat, variables

    def _item(self, row) -> dict:
        return {k: node_of(v) for k, v in row.asDict().items() if v is not None}


class _Triples(_Rows):
    def _item(self, row) -> Triple:
        return Triple(node_of(row["s"]), IRI(row["p"]), node_of(row["o"]))

    @property
    def triples(self) -> list[Triple]:
        return self._collected()


class ConstructResult(_Triples):
    pass


class DescribeResult(_Triples):
    pass


class AskResult:
    def __init__(self, df: DataFrame):
        self.df, self._answer = df, None

    @property
    def result(self) -> bool:
        if self._answer is None:
            self._answer = bool(self.df.first()[0])
        return self._answer

    def __bool__(self) -> bool:
        return self.result
