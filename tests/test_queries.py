import pytest

from tripleweave.functions.terms import IRI, BlankNode, Literal, Triple
from tripleweave.functions.vocab import RDF, XSD
from tripleweave.operators.store import TripleStore
from tripleweave.plans import ast as A
from tripleweave.plans.parser import SparqlSyntaxError, UnsupportedSparqlError, parse_sparql

EX, FOAF = "http://example.org/", "http://xmlns.com/foaf/0.1/"
HEAD = f"PREFIX ex: <{EX}> PREFIX foaf: <{FOAF}> "


def ex(name):
    return IRI(EX + name)


def foaf(name):
    return IRI(FOAF + name)


@pytest.fixture(scope="module")
def graph(spark):
    out = []
    for name, age in (("alice", 30), ("bob", 25), ("charlie", 35)):
        out += [Triple(ex(name), RDF.type, foaf("Person")), Triple(ex(name), foaf("name"), Literal(name.capitalize())), Triple(ex(name), foaf("age"), Literal(age))]
    out += [Triple(ex(a), foaf("knows"), ex(b)) for a, b in (("alice", "bob"), ("alice", "charlie"), ("bob", "charlie"))]
    store = TripleStore.of(spark, out)
    store.df = store.df.cache()
    return store


def names(result, var="n"):
    return sorted(r[var].value for r in result)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("SELECT ?p WHERE { ?p a foaf:Person }", 3),
        ("SELECT ?p ?n WHERE { ?p foaf:knows ?f . ?f foaf:name ?n }", 3),
        ("SELECT ?p WHERE { ?p foaf:knows ?f } LIMIT 2", 2),
        ("SELECT ?p WHERE { ?p foaf:knows ?f } OFFSET 1", 2),
        ("SELECT ?p WHERE { ?p foaf:knows ?f } LIMIT 1 OFFSET 1", 1),
        ("SELECT ?p WHERE { ?p foaf:knows ?f } OFFSET 9", 0),
        ("SELECT DISTINCT ?p ?f WHERE { ?p foaf:knows ?f }", 3),
        ("SELECT DISTINCT ?p WHERE { ?p foaf:knows ?f }", 2),
        ("SELECT ?p WHERE { ?p foaf:age ?a FILTER(?a > 28) }", 2),
        ("SELECT ?p WHERE { ?p foaf:age ?a FILTER(?a > 20 && ?a < 32) }", 2),
        ("SELECT ?p WHERE { ?p foaf:age ?a FILTER(!(?a > 28) || ?a = 35) }", 2),
        ("SELECT ?p ?q WHERE { ?p foaf:knows ?f . ?f foaf:knows ?q FILTER(?p != ?q) }", 1),
        ("SELECT ?p WHERE { ?p ?x ?o FILTER(isLiteral(?o) && isIRI(?p) && !isBlank(?p)) }", 6),
        ('SELECT ?p WHERE { { ?p foaf:name "Alice" } UNION { ?p foaf:name "Bob" } }', 2),
        ("SELECT ?p ?a WHERE { ?p foaf:name ?n OPTIONAL { ?p foaf:age ?a FILTER(?a > 30) } }", 3),
        ("SELECT * WHERE { }", 1),
        ("SELECT ?p WHERE { ?p foaf:age 30 }", 1),
        ('SELECT ?p WHERE { ?p foaf:age "30" }', 0),
        (f"SELECT ?p WHERE {{ <{EX}alice> ?p <{EX}bob> }}", 1),
    ],
)
def test_solutions(graph, text, n):
    assert len(graph.query(HEAD + text)) == n


def test_optional_leaves_variables_unbound(graph):
    rows = {r["p"]: r.get("a") for r in graph.query(HEAD + "SELECT ?p ?a WHERE { ?p foaf:name ?n OPTIONAL { ?p foaf:age ?a FILTER(?a > 30) } }")}
    assert rows == {ex("alice"): None, ex("bob"): None, ex("charlie"): Literal(35)}


def test_joins_on_unbound_variables_are_compatible(spark):
    store = TripleStore.of(spark, [Triple(ex("a"), ex("p"), ex("x")), Triple(ex("b"), ex("p"), ex("y")), Triple(ex("a"), ex("q"), ex("u")), Triple(ex("v"), ex("r"), ex("u")), Triple(ex("w"), ex("r"), ex("t"))])
    text = HEAD + "SELECT ?s ?o ?v WHERE { ?s ex:p ?i OPTIONAL { ?s ex:q ?o } ?v ex:r ?o }"
    assert sorted((r["s"].value[-1], r["o"].value[-1], r["v"].value[-1]) for r in store.query(text)) == [("a", "u", "v"), ("b", "t", "w"), ("b", "u", "v")]


def test_order(graph, spark):
    assert [r["n"].value for r in graph.query(HEAD + "SELECT ?n WHERE { ?p foaf:name ?n ; foaf:age ?a } ORDER BY DESC(?a)")] == ["Charlie", "Alice", "Bob"]
    store = TripleStore.of(spark, [Triple(ex("s"), ex("p"), o) for o in (Literal("9"), Literal("100"), ex("z"), BlankNode("m"))])
    assert [r["o"].value if not isinstance(r["o"], BlankNode) else "m" for r in store.query(HEAD + "SELECT ?o WHERE { ?s ex:p ?o } ORDER BY ?o")] == [EX + "z", "m", "100", "9"]
    assert [r["o"].value for r in store.query(HEAD + "SELECT ?o WHERE { ?s ex:p ?o FILTER(isLiteral(?o)) } ORDER BY ?o", numeric_order=True)] == ["9", "100"]


def test_repeated_variable_and_union_of_different_variables(spark):
    store = TripleStore.of(spark, [Triple(ex("a"), ex("p"), ex("a")), Triple(ex("a"), ex("p"), ex("b")), Triple(ex("c"), ex("q"), Literal("x"))])
    assert [r["x"] for r in store.query(HEAD + "SELECT ?x WHERE { ?x ?p ?x }")] == [ex("a")]
    rows = list(store.query(HEAD + "SELECT ?x ?y WHERE { { ?x ex:p ?o } UNION { ?y ex:q ?o } }"))
    assert sorted(map(len, rows)) == [1, 1, 1]


def test_forms(graph):
    built = graph.query(HEAD + "CONSTRUCT { ?b ex:knownBy ?a . ?n ex:bad ?a } WHERE { ?a foaf:knows ?b ; foaf:name ?n }")
    assert len(built) == 3 and all(t.predicate == ex("knownBy") for t in built)
    assert graph.query(HEAD + "ASK { ex:alice foaf:knows ex:bob }").result and not graph.query(HEAD + "ASK { ex:bob foaf:knows ex:alice }").result
    assert len(graph.query(HEAD + "DESCRIBE ex:alice")) == 5 and len(graph.query(HEAD + "DESCRIBE ex:charlie")) == 5
    assert len(graph.query(HEAD + 'DESCRIBE ?x WHERE { ?x foaf:name "Bob" }')) == 5
    assert len(graph.query(HEAD + 'DESCRIBE ex:alice WHERE { ?x foaf:name "Nobody" }')) == 0


def test_unknown_functions_are_false(graph):
    with pytest.warns(UserWarning):
        assert len(graph.query(HEAD + 'SELECT ?n WHERE { ?p foaf:name ?n FILTER(regex(?n, "A")) }')) == 0
    assert names(graph.query(HEAD + 'SELECT ?n WHERE { ?p foaf:name ?n FILTER(regex(?n, "^a", "i")) }', extensions=True)) == ["Alice"]


def test_trees_and_text_agree():
    q = parse_sparql(HEAD + 'SELECT ?s WHERE { ?s a foaf:Person ; foaf:name "A"@en , "B"^^ex:t . FILTER(?a<?b && ?c>1.5) } ORDER BY ?s LIMIT 5')
    s = A.Var("s")
    assert q.where[:3] == (A.TriplePattern(s, RDF.type, foaf("Person")), A.TriplePattern(s, foaf("name"), Literal("A", lang="en")), A.TriplePattern(s, foaf("name"), Literal("B", ex("t"))))
    assert q.where[3].expression.args[1].right == A.LiteralExpr(Literal("1.5", XSD.decimal))
    assert q.modifiers == A.QueryModifiers(5, None, (A.OrderKey("s"),)) and A.get_variables(q) == ["s", "a", "b", "c"]


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?x { ?x ?y }", "SELECT ?x { ?x a ex:A } trailing", "SELECT ?x { ?x none:p ?y }", "SELECT ?x { ?x a ?y", "ASK { 'a' }"])
def test_errors(text):
    with pytest.raises(SparqlSyntaxError):
        parse_sparql(f"PREFIX ex: <{EX}> {text}")


@pytest.mark.parametrize("text", ["SELECT ?x { GRAPH ?g { ?x ?y ?z } }", "SELECT ?x { BIND(1 AS ?x) }", "SELECT ?x { ?x ex:p/ex:q ?y }", "SELECT (COUNT(?x) AS ?n) { ?x ?y ?z }", "SELECT ?x { FILTER NOT EXISTS { ?x ?y ?z } }"])
def test_unsupported_parts_are_named(text):
    with pytest.raises(UnsupportedSparqlError):
        parse_sparql(f"PREFIX ex: <{EX}> {text}")
