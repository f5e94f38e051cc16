"""Queries of sources and sinks: text formats and JSON-LD."""

from __future__ import annotations

import dataclasses
import json
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.catalogue import CUSTOMERS, NATION, _store, lines, query
from tripleweave.functions.terms import serialized
from tripleweave.operators.store import TripleStore
from tripleweave.sources import jsonld as J
from tripleweave.sources import rdf_text as R
from tripleweave.sources.folders import scratch
from tripleweave.sources.tables import BASE

EVENT_CONTEXT = {"@vocab": BASE, "ev": BASE + "events/", "user": {"@id": BASE + "user_id", "@type": "@id"}}


@query("ntriples_write", f"select s || ' <' || p || '> ' || o || ' .' as value from ({NATION} union all {CUSTOMERS})")
def _write(spark, sf_dir):
    return R.ntriples_lines(_store(spark, sf_dir, "nation", "customer").df)


@query("ntriples_roundtrip", f"select * from ({NATION} union all {CUSTOMERS})")
def _roundtrip(spark, sf_dir):
    return lines(R.parse_ntriples(R.ntriples_lines(_store(spark, sf_dir, "nation", "customer").df)))


@query(
    "turtle_write",
    "select '<{B}customer/' || c_custkey || '>' as s, '<{B}customer/' || c_custkey || '> <{B}c_acctbal> \"' || c_acctbal || '\"^^<http://www.w3.org/2001/XMLSchema#double> ;' || chr(10) || '    <{B}c_mktsegment> \"' || c_mktsegment || '\" ;' || chr(10) || '    <{B}c_name> \"' || c_name || '\" ;' || chr(10) || '    <{B}c_nationkey> <{B}nation/' || c_nationkey || '> ;' || chr(10) || '    <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{B}Customer> .' as value from customer",
)
def _turtle(spark, sf_dir):
    return R.turtle_blocks(_store(spark, sf_dir, "customer").df)


def _reread(spark, sf_dir, format: str, **options) -> TripleStore:
    """The customers' graph, saved to a folder and loaded from it."""
    path = scratch(spark, format)
    R.save(_store(spark, sf_dir, "customer"), path, format)
    return R.load(TripleStore(spark), path, format, **options)


@query("turtle_roundtrip", f"select * from ({CUSTOMERS})")
def _turtle_roundtrip(spark, sf_dir):
    return lines(_reread(spark, sf_dir, "turtle", statements=True).df)


@query("turtle_files", f"select *, '{{B}}' as namespace from ({CUSTOMERS})")
def _turtle_files(spark, sf_dir):
    store = _reread(spark, sf_dir, "ttl")
    return lines(store.df).withColumn("namespace", F.lit(store.namespaces["t"]))


@query("ntriples_files", f"select * from ({CUSTOMERS})")
def _ntriples_files(spark, sf_dir):
    return lines(_reread(spark, sf_dir, "nt").df)


@query("nquads_files", f"select * from ({CUSTOMERS}) where p <> '{{B}}c_name' and p <> '{{B}}c_acctbal'")
def _nquads_files(spark, sf_dir):
    df = _store(spark, sf_dir, "customer").df
    graph = F.when(F.col("p") == BASE + "c_name", "<http://example.org/g>").when(F.col("p") == BASE + "c_acctbal", "_:g1")
    path = scratch(spark, "nquads")
    quads = df.select(F.concat_ws(" ", serialized(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), serialized(F.col("o")), graph, F.lit(".")).alias("value"))
    quads.write.text(path)
    return lines(R.load(TripleStore(spark), path, "nquads").df)


@query("trig_files", f"select * from ({CUSTOMERS})")
def _trig_files(spark, sf_dir):
    blocks = R.turtle_blocks(_store(spark, sf_dir, "customer").df)
    path = scratch(spark, "trig")
    hidden = F.concat(F.lit("GRAPH <http://example.org/g> { <http://example.org/x> <http://example.org/y> 1 }\n"), F.lit("{ "), F.col("value"), F.lit(" }"))
    blocks.select(hidden.alias("value")).write.text(path)
    return lines(R.load(TripleStore(spark), path, "trig").df)


def _documents(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ident = F.concat(F.lit("ev:"), F.col("event_id").cast("string"))
    user = F.concat(F.lit(BASE + "customer/"), F.col("user_id").cast("string"))
    body = F.struct(ident.alias("@id"), F.lit("Events").alias("@type"), user.alias("user"), F.col("event_type"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return events.select(F.to_json(body).alias("value"))


@query(
    "jsonld_to_triples",
    "select '<{B}events/' || event_id || '>' as s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, '<{B}Events>' as o from events union all select '<{B}events/' || event_id || '>', '{B}user_id', '<{B}customer/' || user_id || '>' from events union all select '<{B}events/' || event_id || '>', '{B}event_type', '\"' || event_type || '\"' from events union all select '<{B}events/' || event_id || '>', '{B}k', '\"' || (props->>'$.k') || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' from events where props->>'$.k' is not null",
)
def _jsonld(spark, sf_dir):
    return lines(J.documents_to_triples(_documents(spark, sf_dir), context=J.parse_context_object(EVENT_CONTEXT)))


@query("jsonld_typed", "select 'ev:' || event_id as id, event_type, cast(props->>'$.k' as integer) as k from events")
def _typed(spark, sf_dir):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("k", T.IntegerType())])
    docs = _documents(spark, sf_dir).select(F.replace("value", F.lit('"event_type"'), F.lit('"eventType"')).alias("value"))
    return J.typed_records(docs, schema, J.Context(vocab=BASE))


@query(
    "jsonld_from_triples",
    "select '<{B}customer/' || c_custkey || '>' as s, '{\"@id\":\"{B}customer/' || c_custkey || '\",\"@type\":[\"{B}Customer\"],\"{B}c_acctbal\":[{\"@value\":\"' || c_acctbal || '\",\"@type\":\"http://www.w3.org/2001/XMLSchema#double\"}],\"{B}c_mktsegment\":[{\"@value\":\"' || c_mktsegment || '\"}],\"{B}c_name\":[{\"@value\":\"' || c_name || '\"}],\"{B}c_nationkey\":[{\"@id\":\"{B}nation/' || c_nationkey || '\"}]}' as json from customer",
)
def _from_triples(spark, sf_dir):
    return J.triples_to_nodes(_store(spark, sf_dir, "customer").df).select(serialized(F.col("s")).alias("s"), "json")


#: An event with its own context, a list of types, an inner node with a name, one without and a tagged value.
NESTED = [
    '{"@context":{"@vocab":"' + BASE + '","ev":"' + BASE + 'events/","user":{"@id":"' + BASE + 'user_id","@type":"@id"}},"@id":"ev:',
    '","@type":["Events","ev:Kind"],"user":"' + BASE + "customer/",
    '","actor":{"@id":"' + BASE + "customer/",
    '","rank":',
    '},"detail":{"event_type":"',
    '","flag":true},"label":{"@value":"',
    '","@language":"en"},"marks":["a",null,"b"],"undefined":null}',
]
EVENT, OWN = "'<{B}events/' || event_id || '>'", "'_:b' || substr(sha256(doc), 1, 16) || 'n0p2v0'"


@query(
    "jsonld_nested",
    "with d as (select *, "
    + " || ".join(x for text, part in zip(NESTED, ["event_id", "user_id", "user_id", "event_id % 7", "event_type", "event_type", None]) for x in (f"'{text}'", part) if x)
    + " as doc from events) "
    + " union all ".join(
        f"select {s} as s, '{p}' as p, {o} as o from d"
        for s, p, o in [
            (EVENT, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "'<{B}Events>'"),
            (EVENT, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "'<{B}events/Kind>'"),
            (EVENT, "{B}user_id", "'<{B}customer/' || user_id || '>'"),
            (EVENT, "{B}actor", "'<{B}customer/' || user_id || '>'"),
            ("'<{B}customer/' || user_id || '>'", "{B}rank", "'\"' || event_id % 7 || '\"^^<http://www.w3.org/2001/XMLSchema#integer>'"),
            (EVENT, "{B}detail", OWN),
            (OWN, "{B}event_type", "'\"' || event_type || '\"'"),
            (OWN, "{B}flag", "'\"true\"^^<http://www.w3.org/2001/XMLSchema#boolean>'"),
            (EVENT, "{B}label", "'\"' || event_type || '\"@en'"),
            (EVENT, "{B}marks", "'\"a\"'"),
            (EVENT, "{B}marks", "'\"b\"'"),
        ]
    ),
)
def _nested(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = [F.col("event_id"), F.col("user_id"), F.col("user_id"), F.col("event_id") % 7, F.col("event_type"), F.col("event_type"), F.lit("")]
    doc = F.concat(*(x for text, part in zip(NESTED, parts, strict=True) for x in (F.lit(text), part.cast("string"))))
    return lines(J.documents_to_triples(events.select(doc.alias("value"))))


@J.jsonld(vocab=BASE)
@dataclasses.dataclass
class EventRecord:
    id: str | None
    event_type: str
    k: int | None = None


RECORD_SQL = (
    "select '{B}events/' || event_id as id, event_type, cast(props->>'$.k' as integer) as k, '{B}Events' as kind, event_type as dynamic, "
    "'{\"@context\": {\"@vocab\": \"{B}\", \"ev\": \"{B}events/\"}, \"@type\": \"{B}EventRecord\", \"@id\": \"{B}events/' || event_id || '\", \"{B}eventType\": \"' || event_type || '\"' || coalesce(', \"{B}k\": ' || (props->>'$.k'), '') || '}' as compact, "
    "'{\"@type\": \"{B}EventRecord\", \"@id\": \"{B}events/' || event_id || '\", \"{B}eventType\": \"' || event_type || '\"' || coalesce(', \"{B}k\": ' || (props->>'$.k'), '') || '}' as plain from events"
)


@query("jsonld_records", RECORD_SQL)
def _records(spark, sf_dir):
    """Documents to records and back, one by one in batches: for shapes that only a class describes."""
    docs = _documents(spark, sf_dir).select(F.replace("value", F.lit('"event_type"'), F.lit('"eventType"')).alias("value"))

    def run(frames):
        own = J.Context(vocab=BASE, prefixes={"ev": BASE + "events/"})
        options, bare = J.ConversionOptions(context=own), J.ConversionOptions(compact=False)
        for frame in frames:
            rows = []
            for text in frame["value"]:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # the documents' type has another name than the class
                    record = J.from_jsonld(text, EventRecord, options)
                free = J.from_jsonld(text, options=options)
                rows.append((record.id, record.event_type, record.k, free.type[0], free.eventType, J.to_jsonld(record, options), J.to_jsonld(record, bare)))
            yield pd.DataFrame(rows, columns=["id", "event_type", "k", "kind", "dynamic", "compact", "plain"]).astype({"k": "Int32"})

    return docs.mapInPandas(run, "id string, event_type string, k int, kind string, dynamic string, compact string, plain string")


@query("jsonld_merged_contexts", "select 'http://later.example/' as vocab, 'http://base.example/' as base, '{B}events/7' as prefixed, '{\"@base\": \"http://base.example/\", \"@vocab\": \"http://later.example/\", \"ev\": \"{B}events/\", \"user\": {\"@id\": \"{B}user_id\", \"@type\": \"@id\"}, \"back\": {\"@id\": \"{B}of\", \"@reverse\": true}}' as written, true as same")
def _merged(spark, sf_dir):
    later = J.parse_context_object(["http://later.example/", {"@base": "http://base.example/", "back": {"@reverse": BASE + "of"}}])
    both = J.merge_contexts(J.parse_context_object(EVENT_CONTEXT), later)
    written = J.context_to_dict(both)
    again = J.parse_context(json.dumps({"@context": EVENT_CONTEXT})) == J.parse_context_object(EVENT_CONTEXT)
    row = (both.vocab, both.base, J.expand_iri("ev:7", both), json.dumps(written), again)
    return spark.createDataFrame([row], "vocab string, base string, prefixed string, written string, same boolean")


@query("jsonld_context", "select '{B}event_type' as expanded, 'event_type' as compacted, 'ev:7' as prefixed, '{B}events/7' as full_iri")
def _context(spark, sf_dir):
    c = J.parse_context_object(EVENT_CONTEXT)
    row = (J.expand_iri("event_type", c), J.compact_iri(BASE + "event_type", c), J.compact_iri(BASE + "events/7", c), J.expand_iri("ev:7", c))
    return spark.createDataFrame([row], "expanded string, compacted string, prefixed string, full_iri string")
