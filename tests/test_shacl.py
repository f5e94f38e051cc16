import pytest

from tripleweave.functions.terms import IRI, BlankNode, Literal, Triple
from tripleweave.functions.vocab import RDF, XSD
from tripleweave.operators import shacl as S
from tripleweave.operators.store import TripleStore

EX = "http://example.org/"


def ex(name):
    return IRI(EX + name)


DATA = [("alice", "name", Literal("Al")), ("alice", "age", Literal(30)), ("alice", "title", Literal("Dr", lang="en")), ("alice", "knows", ex("bob")), ("alice", "likes", ex("bob"))]
DATA += [("bob", "name", Literal("Bob")), ("bob", "name", Literal("Robert")), ("bob", "age", Literal("old")), ("bob", "nick", Literal("Bob")), ("bob", "nick", Literal("Robert"))]


@pytest.fixture(scope="module")
def graph(spark):
    store = TripleStore.of(spark, [Triple(ex(s), ex(p), o) for s, p, o in DATA] + [Triple(ex("alice"), RDF.type, ex("Person")), Triple(ex("bob"), RDF.type, ex("Person"))])
    store.df = store.df.cache()
    return store


def failing(graph, path, *constraints, target=None, extensions=False):
    shape = S.NodeShape(ex("S"), (target or S.TargetClass(ex("Person")),), (), (S.PropertyShape(ex(path), constraints),))
    return sorted((r.focus_node.value[len(EX) :], r.value.value if r.value and not isinstance(r.value, BlankNode) else None) for r in S.validate(graph, [shape], extensions).results)


@pytest.mark.parametrize(
    ("path", "constraint", "want"),
    [
        ("nick", S.MinCount(1), [("alice", None)]),
        ("name", S.MaxCount(1), [("bob", None)]),
        ("age", S.Datatype(XSD.integer), [("bob", "old")]),
        ("knows", S.Class(ex("Person")), []),
        ("knows", S.Class(ex("Dog")), [("alice", EX + "bob")]),
        ("name", S.Class(ex("Dog")), [("alice", "Al"), ("bob", "Bob"), ("bob", "Robert")]),
        ("knows", S.NodeKind("Literal"), [("alice", EX + "bob")]),
        ("knows", S.NodeKind("BlankNodeOrIRI"), []),
        ("knows", S.NodeKind("Strange"), [("alice", EX + "bob")]),
        ("name", S.MinLength(3), [("alice", "Al")]),
        ("name", S.MaxLength(3), [("bob", "Robert")]),
        ("knows", S.MinLength(100), []),
        ("name", S.Pattern("o"), [("alice", "Al")]),
        ("name", S.Pattern("^b", "i"), [("alice", "Al"), ("bob", "Robert")]),
        ("title", S.LanguageIn(("de",)), [("alice", "Dr")]),
        ("name", S.LanguageIn(("de",)), []),
        ("name", S.HasValue(Literal("Bob")), [("alice", None)]),
        ("name", S.In((Literal("Al"), Literal("Bob"))), [("bob", "Robert")]),
        ("age", S.MinInclusive(30), [("bob", "old")]),
        ("age", S.MaxExclusive("30"), [("alice", "30"), ("bob", "old")]),
        ("age", S.MinExclusive("x"), [("alice", "30"), ("bob", "old")]),
        ("name", S.Equals(ex("nick")), [("alice", None)]),
        ("knows", S.Disjoint(ex("likes")), [("alice", None)]),
    ],
)
def test_constraints(graph, path, constraint, want):
    assert failing(graph, path, constraint) == want


def test_messages_severity_and_conformance(graph):
    shape = S.NodeShape(ex("S"), (S.TargetClass(ex("Person")),), (), (S.PropertyShape(ex("nick"), (S.MinCount(1),), severity="Warning"),))
    report = S.validate(graph, [shape])
    assert report.conforms and [r.severity for r in report.results] == ["Warning"]
    assert report.results[0].message == "Property has 0 values but requires at least 1"
    shape = S.NodeShape(ex("S"), (S.TargetClass(ex("Person")),), (), (S.PropertyShape(ex("nick"), (S.MinCount(1),), message="give a nick", id=ex("P")),))
    report = S.validate(graph, [shape])
    assert not report.conforms and [(r.message, r.source_shape, r.result_path) for r in report.results] == [("give a nick", EX + "P", ex("nick"))]
    assert S.validate(graph, []).conforms
    assert S.validate(graph, [S.NodeShape(ex("S"), (S.TargetNode(ex("x")),), (S.MinCount(1),), deactivated=True)]).conforms


def test_targets(graph):
    assert failing(graph, "none", S.MinCount(1), target=S.TargetNode(ex("nobody"))) == [("nobody", None)]
    assert failing(graph, "none", S.MinCount(1), target=S.TargetSubjectsOf(ex("title"))) == [("alice", None)]
    assert failing(graph, "none", S.MinCount(1), target=S.TargetObjectsOf(ex("knows"))) == [("bob", None)]
    both = S.NodeShape(ex("S"), (S.TargetClass(ex("Person")), S.TargetNode(ex("bob"))))
    assert S.target_nodes(graph, both).count() == 2


def test_logic(graph):
    def inner(*constraints):
        return S.NodeShape(ex("I"), (), (), (S.PropertyShape(ex("age"), constraints),))

    def nodes(*constraints, extensions=False):
        return sorted(r.focus_node.value[len(EX) :] for r in S.validate(graph, [S.NodeShape(ex("S"), (S.TargetClass(ex("Person")),), constraints)], extensions).results)

    old, any_age = inner(S.MinInclusive(30)), inner(S.MinCount(1))
    assert nodes(S.And((old, any_age))) == ["bob"] and nodes(S.Or((old, any_age))) == []
    assert nodes(S.Or((old, inner(S.MaxCount(0))))) == ["bob"] and nodes(S.Not(old)) == ["alice"]
    assert nodes(S.Not(S.PropertyShape(ex("age")))) == [] and nodes(S.HasValue(ex("x"))) == ["alice", "bob"]
    assert nodes(S.Equals(ex("nick"))) == ["bob"] and nodes(S.MinLength(9)) == []
    with pytest.warns(UserWarning):
        assert nodes(S.Xone((old, any_age))) == []
    assert nodes(S.Xone((old, any_age)), extensions=True) == ["alice"]


def test_invalid_patterns_give_a_warning(graph):
    with pytest.warns(UserWarning):
        assert failing(graph, "name", S.Pattern("(")) == []
    with pytest.raises(NotImplementedError):
        S.validate(graph, graph)
