"""RDF terms: driver-side values, and their columnar form.

A term in a DataFrame is the struct ``TERM``; NULL stands for an unbound variable.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "datatype", "lang")])
TRIPLE_SCHEMA = T.StructType([T.StructField("s", TERM, False), T.StructField("p", T.StringType(), False), T.StructField("o", TERM, False)])
QUAD_SCHEMA = T.StructType([*TRIPLE_SCHEMA.fields, T.StructField("g", T.StringType())])

_ANONYMOUS = itertools.count(1)
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"))


def escaped(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


class RDFNode:
    """An IRI, a literal or a blank node."""


RDFTerm = RDFNode


@dataclass(frozen=True)
class IRI(RDFNode):
    value: str

    def __post_init__(self):
        if re.search(r"\s", self.value):
            raise ValueError(f"IRI cannot contain whitespace: {self.value!r}")

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class Literal(RDFNode):
    """A lexical form with a datatype or a language, never both. Numbers and booleans get their XSD type."""

    value: str
    datatype: IRI | None = None
    lang: str | None = None

    def __post_init__(self):
        if self.datatype is not None and self.lang is not None:
            raise ValueError("a literal has a datatype or a language, not both")
        if not isinstance(self.value, str):
            native = self.value
            kind = "boolean" if isinstance(native, bool) else "integer" if isinstance(native, int) else "double"
            object.__setattr__(self, "value", str(native).lower() if isinstance(native, bool) else str(native))
            if self.datatype is None and self.lang is None:
                object.__setattr__(self, "datatype", IRI("http://www.w3.org/2001/XMLSchema#" + kind))
        if self.lang is not None:
            object.__setattr__(self, "lang", self.lang.lower())

    @property
    def language(self) -> str | None:
        return self.lang

    def __str__(self) -> str:
        tail = f"^^{self.datatype}" if self.datatype else f"@{self.lang}" if self.lang else ""
        return f'"{escaped(self.value)}"{tail}'


@dataclass(frozen=True, init=False)
class BlankNode(RDFNode):
    """A blank node. The label is kept without ``_:``, which is shown by ``id`` and in output."""

    label: str

    def __init__(self, id: str | None = None):
        label = f"anon{next(_ANONYMOUS)}" if id is None else id
        object.__setattr__(self, "label", label.removeprefix("_:"))

    @property
    def id(self) -> str:
        return "_:" + self.label

    def __str__(self) -> str:
        return self.id


@dataclass(frozen=True)
class Triple:
    subject: RDFNode
    predicate: IRI
    object: RDFNode

    def __post_init__(self):
        if not isinstance(self.subject, IRI | BlankNode):
            raise TypeError("a subject is an IRI or a blank node")
        if not isinstance(self.predicate, IRI):
            raise TypeError("a predicate is an IRI")
        if not isinstance(self.object, RDFNode):
            raise TypeError("an object is an IRI, a blank node or a literal")

    def __str__(self) -> str:
        return f"{self.subject} {self.predicate} {self.object} ."


@dataclass(frozen=True)
class Quad:
    subject: RDFNode
    predicate: IRI
    object: RDFNode
    graph: IRI | None = None

    def __post_init__(self):
        Triple(self.subject, self.predicate, self.object)

    @classmethod
    def of(cls, triple: Triple, graph: IRI | None = None) -> Quad:
        return cls(triple.subject, triple.predicate, triple.object, graph)

    def __str__(self) -> str:
        return f"{self.subject} {self.predicate} {self.object} {f'{self.graph} ' if self.graph else ''}."


def row_of(node: RDFNode) -> tuple:
    """A term as a row of ``TERM``."""
    if isinstance(node, IRI):
        return ("iri", node.value, None, None)
    if isinstance(node, BlankNode):
        return ("bnode", node.label, None, None)
    return ("literal", node.value, node.datatype.value if node.datatype else None, node.lang)


def node_of(row) -> RDFNode | None:
    """The term of a row of ``TERM``."""
    if row is None:
        return None
    kind, value, datatype, lang = row
    if kind == "iri":
        return IRI(value)
    return BlankNode(value) if kind == "bnode" else Literal(value, IRI(datatype) if datatype else None, lang)


def triple_rows(triples) -> list[tuple]:
    return [(row_of(t.subject), t.predicate.value, row_of(t.object)) for t in triples]


def iri_term(value: Column) -> Column:
    return _term("iri", value)


def bnode_term(label: Column) -> Column:
    return _term("bnode", label)


def _term(kind: str, value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    named = F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (none if datatype is None else datatype).alias("datatype"), (none if lang is None else lang).alias("lang"))
    return F.when(value.isNotNull(), named)


def literal_term(value: Column, datatype: str | None = None, lang: Column | None = None) -> Column:
    return _term("literal", value, F.lit(datatype) if datatype else None, F.lower(lang) if lang is not None else None)


def term_literal(node: RDFNode) -> Column:
    """A constant term as a column."""
    kind, value, datatype, lang = row_of(node)
    return F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"))


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(value: Column) -> Column:
    """The number that a lexical form spells, else NULL; NaN compares with nothing."""
    infinite = F.when(F.lower(F.trim(value)).isin("inf", "+inf", "infinity"), float("inf")).when(F.lower(F.trim(value)).isin("-inf", "-infinity"), float("-inf"))
    return F.when(value.rlike(NUMBER), value.try_cast("double")).otherwise(infinite)


def serialized(term: Column) -> Column:
    """N-Triples form of a term column."""
    text = term["value"]
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    tail = F.when(term["datatype"].isNotNull(), F.concat(F.lit("^^<"), term["datatype"], F.lit(">"))).when(term["lang"].isNotNull(), F.concat(F.lit("@"), term["lang"])).otherwise("")
    quoted = F.concat(F.lit('"'), text, F.lit('"'), tail)
    return F.when(term["kind"] == "iri", F.concat(F.lit("<"), term["value"], F.lit(">"))).when(term["kind"] == "bnode", F.concat(F.lit("_:"), term["value"])).otherwise(quoted)

