import dataclasses
import json

import pytest
from pyspark.sql import types as T

from tripleweave.functions.terms import IRI, BlankNode, Literal, Triple
from tripleweave.functions.vocab import RDF, XSD
from tripleweave.operators.store import TripleStore
from tripleweave.sources import jsonld as J
from tripleweave.sources import rdf_text as R

EX, SCHEMA = "http://example.org/", "http://schema.org/"
TTL = """@prefix ex: <http://example.org/> .
PREFIX foaf: <http://xmlns.com/foaf/0.1/>
ex:alice a foaf:Person ; foaf:name "Alice" , "Ali"@EN ; foaf:age 30 ; ex:h 1.75 , 1e0 ; ex:ok true ; # comment
  foaf:mbox <mailto:alice@example.org> ; foaf:knows [ foaf:name 'B\\u00f6b' ] ; ex:l ( 1 "x" ) .
_:b1 foaf:knows _:b2 ."""


def ex(name):
    return IRI(EX + name)


def test_turtle(spark):
    s = R.parse_string(TripleStore(spark), TTL)
    got = set(s)
    assert len(got) == 16 and s.namespaces["ex"] == EX
    for o in (Literal(30), Literal("true", XSD.boolean)):
        assert any(t.object == o for t in got)
    assert Triple(ex("alice"), ex("h"), Literal("1.75", XSD.decimal)) in got and Triple(ex("alice"), ex("h"), Literal("1e0", XSD.double)) in got
    assert any(t.object == Literal("Böb") and isinstance(t.subject, BlankNode) for t in got)
    for text in (R.to_turtle(s), R.to_ntriples(s)):
        again = R.parse_string(TripleStore(spark), text, "turtle" if text.startswith("@") else "nt")
        assert set(again) == got


@pytest.mark.parametrize("o", [Literal("a\\nb"), Literal('q"\n\r\\'), Literal("é\t日"), Literal("x", XSD.date), Literal("y", lang="en-gb"), BlankNode("b.1"), ex("o")])
def test_ntriples_round_trip(spark, o):
    s = TripleStore.of(spark, [Triple(BlankNode("s"), ex("p"), o)])
    assert list(R.parse_string(TripleStore(spark), R.to_ntriples(s), "ntriples")) == list(s)


def test_ntriples_escapes_and_comments(spark):
    text = '# c\n\n<http://e/a> <http://e/p> "\\u00e9\\\\u0041\\U0001F600" . # end\n'
    assert [t.object.value for t in R.parse_string(TripleStore(spark), text, "nt")] == ["é\\u0041😀"]


def test_files(spark, tmp_path):
    s = R.parse_string(TripleStore(spark), TTL)
    for form, name in (("turtle", "t.ttl"), ("ntriples", "n.nt"), ("nquads", "q")):
        R.save(s, str(tmp_path / name), form)
        again = R.load(TripleStore(spark), str(tmp_path / name), "auto" if "." in name else "nt")
        assert len(again) == len(s)
    assert R.load(TripleStore(spark), str(tmp_path / "t.ttl")).namespaces["ex"] == EX


def test_quads_give_their_default_graph(spark, tmp_path):
    nq = '<http://e/a> <http://e/p> "x" <http://e/g> .\n<http://e/a> <http://e/p> "y"@en .\n_:b <http://e/p> _:c _:g . # end\n_:b <http://e/p> _:c.\n'
    want = {Triple(IRI("http://e/a"), IRI("http://e/p"), Literal("y", lang="en")), Triple(BlankNode("b"), IRI("http://e/p"), BlankNode("c"))}
    assert set(R.parse_string(TripleStore(spark), nq, "nquads")) == want
    trig = "@prefix e: <http://e/> .\n{ e:a e:p 'y'@en . _:b e:p _:c }\ne:g { e:a e:p [ e:p 1 ] . }\nGRAPH e:h { e:a e:p e:b }\ne:a e:p e:z ."
    assert set(R.parse_string(TripleStore(spark), trig, "trig")) == want | {Triple(IRI("http://e/a"), IRI("http://e/p"), IRI("http://e/z"))}
    for text, name in ((nq, "q.nq"), (trig, "t.trig")):
        (tmp_path / name).write_text(text)
        assert len(R.load(TripleStore(spark), str(tmp_path / name))) == len(R.parse_string(TripleStore(spark), text, name.rpartition(".")[2]))
    for bad, form in (("<http://e/a> <http://e/p> .", "nq"), ("e:g { e:a e:p e:b", "trig"), ("{ <http://e/a> }", "trig")):
        with pytest.raises(R.RDFParseError):
            R.parse_string(TripleStore(spark), bad, form)


def test_split_turtle_files(spark, tmp_path):
    s = TripleStore.of(spark, [Triple(ex(f"s{i}"), ex("p"), Literal(f"a . b\n{i} .", lang="en")) for i in range(300)] + [Triple(BlankNode("x"), ex("p"), BlankNode("y"))], {"ex": EX})
    R.save(s, str(tmp_path / "t.ttl"))
    again = R.load(TripleStore(spark), str(tmp_path / "t.ttl"), statements=True)
    assert len(again) == 301 and again.namespaces == {"ex": EX}
    assert {t for t in again if isinstance(t.subject, IRI)} == {t for t in s if isinstance(t.subject, IRI)}
    (tmp_path / "u.ttl").write_text("@prefix ex: <http://example.org/> .\nex:a ex:p [ ex:q 1 ] .\nex:a ex:p [ ex:q 1 ] .\n_:n ex:p _:n .\n_:n ex:q 2 .\n")
    odd = R.load(TripleStore(spark), str(tmp_path / "u.ttl"), statements=True)
    assert len(odd) == 6 and odd.count_subjects() == 4


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.load(TripleStore(spark), str(tmp_path / "missing.ttl"))
    with pytest.raises(ValueError):
        R.parse_string(TripleStore(spark), "", "rdfxml")
    for bad in ("ex:a ex:b ex:c .", "<http://a> <http://b> .", "<http://a> <http://b> <http://c>", '"x" <http://b> "y" .'):
        with pytest.raises(R.RDFParseError):
            R.parse_string(TripleStore(spark), bad)
    with pytest.raises(R.RDFParseError):
        R.parse_string(TripleStore(spark), "no triple", "nt")
    assert R.format_of("auto", "a.NT") == "ntriples" and R.format_of("auto", "a.xyz") == "turtle"


def doc(**more):
    return json.dumps({"@context": {"@vocab": SCHEMA}, "@id": EX + "alice", "@type": "Person", **more})


@pytest.mark.parametrize(
    ("document", "n"),
    [
        (doc(name="Alice"), 2),
        (doc(name="Alice", email="a@b", age=30), 4),
        (json.dumps({"@context": {"@vocab": SCHEMA}, "@type": "Person", "name": "x"}), 2),
        (json.dumps({"@context": {"@vocab": SCHEMA}, "@id": "_:p", "@type": "Person", "name": "x"}), 2),
        (doc(email=["a", "b", None]), 3),
        (json.dumps({"@context": {"schema": SCHEMA, "ex": EX}, "@id": "ex:a", "@type": "schema:Person", "schema:name": "x", "dropped": 1}), 2),
        (json.dumps({"@context": SCHEMA, "@id": EX + "a", "@type": ["Person", "Employee"], "name": "x"}), 3),
        (doc(name="x", knows={"@id": EX + "bob"}), 3),
        (doc(knows={"@type": "Person", "name": "Bob"}), 4),
        (json.dumps({"@context": [{"@vocab": SCHEMA}], "@graph": [{"@id": EX + "a", "name": "x"}, {"@id": EX + "b", "name": "y"}]}), 2),
    ],
)
def test_jsonld_to_triples(spark, document, n):
    s = J.jsonld_to_triples(TripleStore(spark), document)
    assert len(s) == n
    bulk = J.documents_to_triples(spark.createDataFrame([(document,), (None,)], "value string"))
    assert bulk.count() == n


def test_flat_documents_give_the_same_triples(spark):
    c = J.parse_context_object({"@vocab": SCHEMA, "ex": EX, "friend": {"@id": "ex:friend", "@type": "@id"}})
    docs = [{"@id": "ex:a", "@type": ["Person", "ex:B"], "name": ["x", 'q"\n', None], "age": 3, "ok": True, "friend": ["ex:b", "_:c"], "@index": "i"}, {"name": "no id"}, {"@id": "_:z", "n": -5, "f": 1.5}, {"a": {"b": "c"}}, {"@id": "rel", "s": "a { brace", "big": 12345678901}]
    texts = [json.dumps(d) for d in docs]
    want = {t for d in texts for t in J.document_triples(d, c)}
    got = J.documents_to_triples(spark.createDataFrame([(t,) for t in [*texts, None]], "value string"), context=c)
    assert set(TripleStore(spark, got)) == want
    bare = J.Context(prefixes={"ex": EX})
    flat = json.dumps({"@id": "ex:a", "ex:p": "v", "dropped": 1})
    assert set(TripleStore(spark, J.documents_to_triples(spark.createDataFrame([(flat,)], "value string"), context=bare))) == set(J.document_triples(flat, bare))


def test_contexts():
    c = J.parse_context_object({"@vocab": SCHEMA, "ex": EX, "mail": {"@id": "ex:mail", "@type": "@id"}})
    assert [J.expand_iri(t, c) for t in ("name", "ex:a", "mail", "http://x/", "_:b", "@type")] == [SCHEMA + "name", EX + "a", EX + "mail", "http://x/", "_:b", "@type"]
    assert [J.compact_iri(t, c) for t in (SCHEMA + "name", EX + "a", "http://x/")] == ["name", "ex:a", "http://x/"]
    both = J.merge_contexts(c, J.Context(vocab=EX))
    assert both.vocab == EX and "ex" in both.prefixes and J.parse_context_object(J.context_to_dict(c)) == c
    assert J.expand(doc(mail="x", n=1, f=1.5, b=True))[0][SCHEMA + "f"] == [{"@value": 1.5, "@type": XSD.double.value}]


def test_triples_to_jsonld(spark):
    s = J.jsonld_to_triples(TripleStore(spark), doc(name="Alice", age=30, knows={"@id": EX + "bob"}))
    one = json.loads(J.triples_to_jsonld(s))
    assert one["@id"] == EX + "alice" and one["@type"] == [SCHEMA + "Person"] and one[SCHEMA + "age"] == [{"@value": "30", "@type": XSD.integer.value}]
    assert set(J.jsonld_to_triples(TripleStore(spark), one)) == set(s)
    s.add(ex("bob"), RDF.type, IRI(SCHEMA + "Person"))
    assert len(json.loads(J.triples_to_jsonld(s, J.Context(vocab=SCHEMA)))["@graph"]) == 2
    assert json.loads(J.triples_to_jsonld(s, J.Context(vocab=SCHEMA), ex("bob")))["@context"] == {"@vocab": SCHEMA}


@J.jsonld()
@dataclasses.dataclass
class Member:
    id: str | None
    first_name: str
    age: int | None = None
    emails: list[str] = dataclasses.field(default_factory=list)


def test_typed_records(spark):
    assert [J.to_camel_case(x) for x in ("name", "first_name", "user_email_address", "a_b_c")] == ["name", "firstName", "userEmailAddress", "aBC"]
    text = json.dumps({"@context": {"@vocab": SCHEMA}, "@id": EX + "a", "@type": "Member", "firstName": "Al", "age": "30", "emails": "x"})
    m = J.from_jsonld(text, Member)
    assert m == Member(EX + "a", "Al", 30, ["x"]) and J.from_jsonld(J.to_jsonld(m), Member) == m
    assert J.from_jsonld(text).firstName == "Al" and J.from_jsonld(text).none is None and J.from_jsonld(text).type == [SCHEMA + "Member"]
    with pytest.warns(UserWarning):
        J.from_jsonld(text.replace('"Member"', '"Other"'), Member)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("first_name", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("emails", T.ArrayType(T.StringType()))])
    row = J.typed_records(spark.createDataFrame([(text,)], "value string"), schema, J.Context(vocab=SCHEMA)).first()
    assert tuple(row) == (EX + "a", "Al", 30, ["x"])
