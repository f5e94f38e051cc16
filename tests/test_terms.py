import pytest

from tripleweave.functions.terms import IRI, BlankNode, Literal, Quad, Triple, node_of, row_of
from tripleweave.functions.vocab import OWL, RDF, RDFS, SHACL, XSD

EX = "http://example.org/"


def test_iri_rejects_white_space_and_compares_by_value():
    assert IRI(EX + "a") == IRI(EX + "a") and hash(IRI(EX + "a")) == hash(IRI(EX + "a"))
    assert str(IRI(EX + "a")) == f"<{EX}a>"
    with pytest.raises(ValueError):
        IRI("http://a b")


def test_literals_keep_their_lexical_form():
    assert Literal("30") != Literal("30", XSD.string) and Literal("30", XSD.integer) != Literal("30.0", XSD.integer)
    assert Literal("x", lang="EN-gb").lang == "en-gb"
    assert Literal(3) == Literal("3", XSD.integer) and Literal(True) == Literal("true", XSD.boolean) and Literal(1.5).datatype == XSD.double
    with pytest.raises(ValueError):
        Literal("x", XSD.string, "en")
    assert str(Literal('a"b\n', lang="en")) == '"a\\"b\\n"@en'


def test_blank_nodes_show_their_prefix_once():
    assert BlankNode("_:b1").id == "_:b1" and BlankNode("b1") == BlankNode("_:b1")
    assert BlankNode() != BlankNode()


def test_triples_and_quads_check_their_parts():
    t = Triple(IRI(EX + "a"), RDF.type, Literal("x"))
    assert Quad.of(t, IRI(EX + "g")).graph == IRI(EX + "g") and Quad.of(t) == Quad(t.subject, t.predicate, t.object)
    for bad in ((Literal("x"), RDF.type, t.object), (t.subject, BlankNode("p"), t.object), (t.subject, RDF.type, "x")):
        with pytest.raises(TypeError):
            Triple(*bad)


def test_rows_are_inverse():
    for n in (IRI(EX), BlankNode("b"), Literal("x"), Literal("x", lang="en"), Literal(1)):
        assert node_of(row_of(n)) == n


def test_vocabularies():
    assert (len(RDF), len(RDFS), len(OWL), len(XSD), len(SHACL)) == (12, 15, 18, 39, 36)
    assert RDF.type_ == RDF.type and RDF.type.value.endswith("#type") and RDF.type.value.startswith(RDF.ns)
    with pytest.raises(AttributeError):
        RDF.missing
