"""JSON-LD: contexts, expansion, triples both ways, and typed records.

Contexts live on the driver. Documents in bulk are rows: nested ones are expanded in Arrow batches, and
documents whose shape a Spark schema knows are mapped to triples or typed columns by expressions alone.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import types
import typing
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.functions.terms import IRI, TRIPLE_SCHEMA, BlankNode, Literal, RDFNode, Triple, bnode_term, iri_term, triple_rows
from tripleweave.functions.vocab import RDF, XSD
from tripleweave.operators.store import TripleStore

SCHEMA_ORG = "http://schema.org/"


@dataclass(frozen=True)
class TermDefinition:
    iri: str
    type: str | None = None
    container: str | None = None
    language: str | None = None
    reverse: bool = False


@dataclass
class Context:
    vocab: str | None = None
    base: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    terms: dict[str, TermDefinition] = field(default_factory=dict)


@dataclass
class ConversionOptions:
    compact: bool = True
    context: Context | None = None
    generate_blank_nodes: bool = True
    validate: bool = False


@dataclass
class TypeMapping:
    rdf_type: str
    vocab: str
    fields: dict[str, str]
    id_field: str | None = None


# contexts
#: Names that are resolved already: addresses, blank nodes and keywords.
ABSOLUTE = r"^(?:https?://|urn:|_:|@)"


def parse_context(document) -> Context:
    """The context of a document, given as text or as parsed JSON."""
    document = json.loads(document) if isinstance(document, str) else document
    return parse_context_object(document.get("@context")) if isinstance(document, dict) else Context()


def parse_context_object(given) -> Context:
    """A context from an object, a list of contexts or an address.

    A remote context is never fetched; its address is the vocabulary.
    """
    if isinstance(given, list):
        return merge_contexts(*map(parse_context_object, given))
    entries = {"@vocab": given} if isinstance(given, str) else given or {}
    own = {k: v for k, v in entries.items() if not k.startswith("@")}
    namespaces = {k: v for k, v in own.items() if isinstance(v, str) and v.endswith((":", "/", "#"))}
    terms = {k: _definition(k, v) for k, v in own.items() if isinstance(v, str | dict)}
    return Context(entries.get("@vocab"), entries.get("@base"), namespaces, terms)


def _definition(name: str, given) -> TermDefinition:
    parts = {"@id": given} if isinstance(given, str) else given
    iri = next(filter(None, (parts.get("@id"), parts.get("@reverse"), name)))
    return TermDefinition(iri, *map(parts.get, ("@type", "@container", "@language")), reverse="@reverse" in parts)


def merge_contexts(*contexts: Context) -> Context:
    """One context; what comes later counts."""

    def last(name: str) -> str | None:
        return next((x for c in reversed(contexts) if (x := getattr(c, name))), None)

    def together(name: str) -> dict:
        return {k: v for c in contexts for k, v in getattr(c, name).items()}

    return Context(last("vocab"), last("base"), together("prefixes"), together("terms"))


class Names:
    """The tables by which a context resolves names, for Python and for expressions alike.

    A name with a known prefix takes its namespace, a term its IRI, and all others the vocabulary.
    """

    def __init__(self, context: Context):
        self.namespaces = {f"{p}:": ns for p, ns in context.prefixes.items()}
        self.vocab = context.vocab or ""
        self.terms = {name: self._with_namespace(t.iri) or t.iri for name, t in context.terms.items()}

    def _with_namespace(self, name: str) -> str | None:
        head = name[: name.find(":") + 1]
        return self.namespaces[head] + name[len(head) :] if head in self.namespaces else None

    def __call__(self, name: str) -> str:
        if re.match(ABSOLUTE, name):
            return name
        return self._with_namespace(name) or self.terms.get(name, self.vocab + name)

    def column(self, name: Column) -> Column:
        """The same of a column."""
        found = F.when(name.rlike(ABSOLUTE), name)
        for head, ns in self.namespaces.items():
            found = found.when(name.startswith(head), F.concat(F.lit(ns), F.substring(name, F.lit(len(head) + 1), F.length(name))))
        for term, iri in self.terms.items():
            found = found.when(name == term, iri)
        return found.otherwise(F.concat(F.lit(self.vocab), name))


def expand_iri(term: str, context: Context) -> str:
    return Names(context)(term)


def compact_iri(iri: str, context: Context) -> str:
    """The first short form that there is: a term, a name of the vocabulary, or a prefixed name."""
    return iri if iri.startswith(("@", "_:")) else next(_short_forms(iri, context), iri)


def _short_forms(iri: str, context: Context) -> Iterator[str]:
    yield from (name for name, t in context.terms.items() if t.iri == iri and name not in context.prefixes)
    if context.vocab and iri.startswith(context.vocab) and not re.search("[:/]", iri[len(context.vocab) :]):
        yield iri[len(context.vocab) :]
    longest = max(((len(ns), p) for p, ns in context.prefixes.items() if iri.startswith(ns)), default=None)
    if longest:
        yield f"{longest[1]}:{iri[longest[0] :]}"


def context_to_dict(context: Context) -> dict:
    def long(t: TermDefinition) -> dict:
        return {"@id": t.iri, "@type": t.type, "@container": t.container, "@language": t.language, "@reverse": t.reverse}

    terms = {name: {k: v for k, v in long(t).items() if v} for name, t in context.terms.items()}
    short = {name: t["@id"] if t.keys() == {"@id"} else t for name, t in terms.items()}
    return {k: v for k, v in (("@base", context.base), ("@vocab", context.vocab)) if v} | context.prefixes | short


# expansion
#: Datatypes of plain JSON values; text has none.
DATATYPES = {bool: XSD.boolean.value, int: XSD.integer.value, float: XSD.double.value}


def _listed(value) -> list:
    return value if isinstance(value, list) else [value]


class _Expansion:
    """Expanded objects under one context."""

    def __init__(self, context: Context):
        self.context, self.name = context, Names(context)

    def object(self, given: dict) -> dict:
        keywords = {k: self.keyword(k, v) for k, v in given.items() if k.startswith("@") and k != "@context"}
        properties: dict[str, list] = {}
        for key, value in given.items():
            iri = self.name(key)
            # a name that nothing resolves is no property
            if not key.startswith("@") and (iri != key or self.context.vocab or ":" in key):
                properties.setdefault(iri, []).extend(self.values(value, self.context.terms.get(key)))
        return keywords | {iri: values for iri, values in properties.items() if values}

    def keyword(self, key: str, value):
        if key == "@type":
            return [self.name(t) for t in _listed(value)]
        if key == "@graph":
            return [self.object(x) for x in _listed(value) if isinstance(x, dict)]
        return self.identifier(value) if key == "@id" else value

    def identifier(self, given: str) -> str:
        iri = self.name(given)
        relative = iri == given and ":" not in iri
        return urljoin(self.context.base, iri) if relative and self.context.base else iri

    def values(self, given, term: TermDefinition | None) -> Iterator[dict]:
        links = term is not None and term.type == "@id"
        for value in _listed(given):
            if isinstance(value, dict):
                yield dict(value) if "@value" in value else {"@id": self.name(value["@id"])} if value.keys() == {"@id"} else self.object(value)
            elif links and isinstance(value, str):
                yield {"@id": self.name(value)}
            elif value is not None:
                kind = DATATYPES.get(type(value))
                yield {"@value": value} | ({"@type": kind} if kind else {})


def expand(document, context: Context | None = None) -> list[dict]:
    """Expanded form, one object a document. A given context goes before the document's own."""
    document = json.loads(document) if isinstance(document, str) else document
    if isinstance(document, list):
        return [x for d in document for x in expand(d, context)]
    return [_Expansion(context or parse_context(document)).object(document)]


# triples
def _lexical(value) -> str:
    return json.dumps(value) if isinstance(value, bool | int | float) else str(value)


def document_triples(document, context: Context | None = None, scope: str | None = None) -> list[Triple]:
    """Triples of a document. Unnamed nodes are labelled by the document and their place in it."""
    text = document if isinstance(document, str) else json.dumps(document, sort_keys=True)
    scope = scope or hashlib.sha256(text.encode()).hexdigest()[:16]
    out: list[Triple] = []

    def node(obj: dict, path: str) -> RDFNode:
        given = obj.get("@id")
        subject = BlankNode(f"b{scope}{path}") if given is None else BlankNode(given) if given.startswith("_:") else IRI(given)
        for t in obj.get("@type", []):
            out.append(Triple(subject, RDF.type, BlankNode(t) if t.startswith("_:") else IRI(t)))
        for i, inner in enumerate(obj.get("@graph", [])):
            node(inner, f"{path}g{i}")
        for k, (key, values) in enumerate((k, v) for k, v in obj.items() if not k.startswith("@")):
            for i, v in enumerate(values):
                out.append(Triple(subject, IRI(key), value(v, f"{path}p{k}v{i}")))
        return subject

    def value(v: dict, path: str) -> RDFNode:
        if "@value" not in v:
            return node(v, path)
        if v.get("@language"):
            return Literal(_lexical(v["@value"]), lang=v["@language"])
        return Literal(_lexical(v["@value"]), IRI(v["@type"]) if v.get("@type") else None)

    for i, obj in enumerate(expand(document, context)):
        node(obj, f"n{i}")
    return out


def jsonld_to_triples(store: TripleStore, document, base: str | None = None) -> TripleStore:
    context = None
    if base:
        own = parse_context(document)
        context = merge_contexts(own, Context(base=own.base or base))
    triples = document_triples(document, context)
    return store.add(triples) if triples else store


def documents_to_triples(docs: DataFrame, column: str = "value", context: Context | None = None) -> DataFrame:
    """Triples of a column of JSON-LD documents.

    Under a given context, documents without inner objects and fractions stay in the engine.
    """
    if context is None or context.base:
        return _nested_triples(docs, column, context)
    flat = F.col(column).rlike(r"^\s*\{[^{]*$") & ~F.col(column).rlike(r"[:\[,]\s*-?[0-9]+[.eE]")
    nested = docs.where(F.col(column).isNotNull() & ~flat)
    return _flat_triples(docs.where(flat), column, context).union(_nested_triples(nested, column, context))


def _named(value: Column) -> Column:
    return F.when(value.startswith("_:"), bnode_term(F.substring(value, F.lit(3), F.length(value)))).otherwise(iri_term(value))


def _flat_triples(docs: DataFrame, column: str, context: Context) -> DataFrame:
    """Triples of documents that are one object of scalars and arrays of them."""
    spark = docs.sparkSession
    scope = F.concat(F.lit("b"), F.substring(F.sha2(F.col(column), 256), 1, 16), F.lit("n0"))
    parsed = docs.select(F.parse_json(column).alias("j"), scope.alias("own"))
    ident, names = F.try_variant_get("j", "$['@id']", "string"), Names(context)
    parsed = parsed.select("j", F.when(ident.isNull(), bnode_term(F.col("own"))).otherwise(_named(names.column(ident))).alias("s"))
    pairs = spark.sql("select t.s, v.key as k, v.value as v from {t} t, lateral variant_explode(t.j) v", t=parsed)
    # a scalar is a list of one
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    items = pairs.select("s", "k", F.explode(listed).alias("v")).select("s", "k", F.schema_of_variant("v").alias("kind"), F.try_variant_get("v", "$", "string").alias("text")).where("kind <> 'VOID'")
    key = F.col("k")
    iri = names.column(key)
    plain = F.lit(True) if context.vocab else (iri != key) | F.contains(iri, F.lit(":"))
    items = items.where((key == "@type") | ~key.startswith("@") & plain)
    links = [t for t, d in context.terms.items() if d.type == "@id"]
    is_link = (key == "@type") | (F.col("kind") == "STRING") & key.isin(links)
    datatype = F.when(F.col("kind") == "BIGINT", XSD.integer.value).when(F.col("kind") == "BOOLEAN", XSD.boolean.value)
    none = F.lit(None).cast("string")
    literal = F.struct(F.lit("literal").alias("kind"), F.col("text").alias("value"), datatype.alias("datatype"), none.alias("lang"))
    target = F.when(is_link, _named(names.column(F.col("text")))).otherwise(literal)
    return items.select("s", F.when(key == "@type", RDF.type.value).otherwise(iri).alias("p"), target.alias("o"))


def _nested_triples(docs: DataFrame, column: str, context: Context | None) -> DataFrame:
    """Triples of documents of any shape, expanded in Arrow batches."""
    names = ("kind", "value", "datatype", "lang")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for d in frame[column] if d for r in triple_rows(document_triples(d, context))]
            named = [(dict(zip(names, s, strict=True)), p, dict(zip(names, o, strict=True))) for s, p, o in rows]
            yield pd.DataFrame(named, columns=["s", "p", "o"])

    return docs.select(column).mapInPandas(run, TRIPLE_SCHEMA)


def triples_to_nodes(triples: DataFrame) -> DataFrame:
    """``(s, json)``: each subject's expanded JSON-LD object, built by expressions."""
    o, p = F.col("o"), F.col("p")
    is_type = (p == RDF.type.value) & (o["kind"] == "iri")
    named = F.when(o["kind"] == "bnode", F.concat(F.lit("_:"), o["value"])).otherwise(o["value"])
    plain = F.to_json(F.struct(F.when(o["kind"] != "literal", named).alias("@id"), F.when(o["kind"] == "literal", o["value"]).alias("@value"), o["lang"].alias("@language"), F.when(o["lang"].isNull(), o["datatype"]).alias("@type")))
    value = F.when(is_type, F.to_json(F.array(o["value"])).substr(F.lit(2), F.length(F.to_json(F.array(o["value"]))) - 2)).otherwise(plain)
    key = F.when(is_type, "@type").otherwise(p)
    by_key = triples.where(~((p == RDF.type.value) & (o["kind"] == "literal"))).select("s", key.alias("k"), value.alias("v"))
    by_key = by_key.groupBy("s", "k").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    member = F.concat(F.to_json(F.array("k")).substr(F.lit(2), F.length(F.to_json(F.array("k"))) - 2), F.lit(":["), F.array_join("vs", ","), F.lit("]"))
    grouped = by_key.groupBy("s").agg(F.array_sort(F.collect_list(member)).alias("ms"))
    own = F.when(F.col("s.kind") == "bnode", F.concat(F.lit("_:"), F.col("s.value"))).otherwise(F.col("s.value"))
    ident = F.to_json(F.struct(own.alias("@id")))
    return grouped.select("s", F.concat(ident.substr(F.lit(1), F.length(ident) - 1), F.lit(","), F.array_join("ms", ","), F.lit("}")).alias("json"))


def triples_to_jsonld(store: TripleStore, context: Context | None = None, subject: RDFNode | None = None) -> str:
    """One object for one node, else an array, or a ``@graph`` under a context."""
    found = triples_to_nodes(store.triples(subject=subject)).orderBy("s.value")
    nodes = [json.loads(r["json"]) for r in found.toLocalIterator()]
    if context is None:
        return json.dumps(nodes[0] if len(nodes) == 1 else nodes, ensure_ascii=False)
    head = {"@context": context_to_dict(context)}
    return json.dumps(head | nodes[0] if len(nodes) == 1 else head | {"@graph": nodes}, ensure_ascii=False)


# dynamic and typed records
class JSONLDObject:
    """A record whose properties answer to their short or expanded names."""

    def __init__(self, expanded: dict, context: Context):
        self.expanded, self.context = expanded, context

    @property
    def id(self) -> str | None:
        return self.expanded.get("@id")

    @property
    def type(self) -> list[str]:
        return self.expanded.get("@type", [])

    def __getitem__(self, name: str):
        values = self.expanded.get(name, self.expanded.get(expand_iri(name, self.context)))
        if values is None:
            return None
        plain = [v.get("@value", v.get("@id", v)) if isinstance(v, dict) else v for v in values]
        return plain[0] if len(plain) == 1 else plain

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def to_camel_case(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


REGISTRY: dict[type, TypeMapping] = {}


def jsonld(rdf_type: str | None = None, vocab: str = SCHEMA_ORG, fields: dict[str, str] | None = None, id_field: str | None = None):
    """Class decorator that gives a dataclass its mapping. Class attributes ``rdf_type``, ``jsonld_context``
    and ``field_mapping`` do the same and may be set later: mappings are made at first use."""

    def keep(cls: type) -> type:
        cls.__jsonld__ = {"rdf_type": rdf_type, "vocab": vocab, "fields": fields or {}, "id_field": id_field}
        return cls

    return keep


def infer_type_mapping(cls: type) -> TypeMapping:
    given = getattr(cls, "__jsonld__", {})
    vocab = getattr(cls, "jsonld_context", None) or given.get("vocab") or SCHEMA_ORG
    names = getattr(cls, "field_mapping", None) or given.get("fields") or {}
    own = [f.name for f in dataclasses.fields(cls)]
    id_field = given.get("id_field") or ("id" if "id" in own else None)
    found = {n: names.get(n, to_camel_case(n)) for n in own if n != id_field and n not in ("type", "types")}
    return TypeMapping(getattr(cls, "rdf_type", None) or given.get("rdf_type") or vocab + cls.__name__, vocab, found, id_field)


def get_type_mapping(cls: type) -> TypeMapping:
    return REGISTRY.setdefault(cls, infer_type_mapping(cls))


def _convert(value, kind):
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        kind = next(a for a in args if a is not type(None))
        return None if value is None else _convert(value, kind)
    if origin is list:
        return [_convert(v, args[0]) for v in (value if isinstance(value, list) else [value])]
    if isinstance(value, list):
        value = value[0]
    if kind is bool and isinstance(value, str):
        if value not in ("true", "false"):
            raise ValueError(f"not a boolean: {value!r}")
        return value == "true"
    return value if kind in (typing.Any, None) or not isinstance(kind, type) or isinstance(value, kind) else kind(value)


def from_jsonld(document, cls: type | None = None, options: ConversionOptions | None = None):
    """A ``JSONLDObject``, or an instance of a dataclass."""
    document = json.loads(document) if isinstance(document, str) else document
    context = (options and options.context) or parse_context(document)
    item = JSONLDObject(expand(document, context)[0], context)
    if cls is None:
        return item
    mapping, hints, values = get_type_mapping(cls), typing.get_type_hints(cls), {}
    if item.type and expand_iri(mapping.rdf_type, context) not in item.type:
        warnings.warn(f"document is a {item.type}, not a {mapping.rdf_type}", stacklevel=2)
    if mapping.id_field:
        values[mapping.id_field] = item.id
    for name, key in mapping.fields.items():
        raw = item[key]
        raw = item[expand_iri(key, Context(vocab=mapping.vocab))] if raw is None else raw
        if raw is not None:
            values[name] = _convert(raw, hints[name])
        elif type(None) in typing.get_args(hints[name]):
            values[name] = None
    return cls(**values)


def to_jsonld(item, options: ConversionOptions | None = None) -> str:
    options = options or ConversionOptions()
    mapping = get_type_mapping(type(item))
    context = options.context or Context(vocab=mapping.vocab)
    out: dict = {"@context": context_to_dict(context)} if options.compact else {}
    out["@type"] = mapping.rdf_type
    if mapping.id_field and getattr(item, mapping.id_field) is not None:
        out["@id"] = getattr(item, mapping.id_field)
    for name, key in mapping.fields.items():
        value = getattr(item, name)
        if value is not None:
            out[expand_iri(key, Context(mapping.vocab, prefixes=context.prefixes, terms=context.terms))] = value
    return json.dumps(out, ensure_ascii=False)


def typed_records(docs: DataFrame, schema: T.StructType, context: Context, column: str = "value", id_field: str | None = "id") -> DataFrame:
    """Documents as rows of ``schema``. Keys may be short, prefixed or full; scalars take the first of several values."""
    fields = [f for f in schema.fields if f.name != id_field]
    parsed = docs.select(F.parse_json(F.col(column)).alias("j"))
    cols = []
    if id_field in schema.fieldNames():
        cols.append(F.try_variant_get("j", "$['@id']", "string").alias(id_field))
    for f in fields:
        short = to_camel_case(f.name)
        keys = dict.fromkeys([short, expand_iri(short, context), compact_iri(expand_iri(short, context), context)])
        many = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.simpleString()
        item = f.dataType.elementType.simpleString() if many else kind
        found = []
        for key in keys:
            at = f"$['{key}']"
            one = F.coalesce(F.try_variant_get("j", at, item), F.try_variant_get("j", f"{at}['@value']", item))
            if many:
                found.append(F.coalesce(F.try_variant_get("j", at, kind), F.when(one.isNotNull(), F.array(one))))
            else:
                found.append(F.coalesce(one, F.try_variant_get("j", f"{at}[0]", item), F.try_variant_get("j", f"{at}[0]['@value']", item)))
        cols.append(F.coalesce(*found).alias(f.name))
    return parsed.select(*cols).select(*schema.fieldNames())
