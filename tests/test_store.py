import pytest

from tripleweave.functions.terms import IRI, Literal, Triple
from tripleweave.operators.store import TripleStore

EX = "http://example.org/"


def ex(name):
    return IRI(EX + name)


@pytest.fixture()
def store(spark):
    t = [("alice", "knows", "bob"), ("alice", "knows", "charlie"), ("alice", "likes", "bob"), ("bob", "knows", "charlie")]
    return TripleStore.of(spark, [Triple(*map(ex, x)) for x in t])


@pytest.mark.parametrize(
    ("given", "n"),
    [({}, 4), ({"subject": "alice"}, 3), ({"predicate": "knows"}, 3), ({"object": "bob"}, 2), ({"subject": "alice", "predicate": "knows"}, 2)]
    + [({"predicate": "knows", "object": "charlie"}, 2), ({"subject": "alice", "object": "bob"}, 2), ({"subject": "alice", "predicate": "knows", "object": "bob"}, 1)]
    + [({"subject": "charlie"}, 0)],
)
def test_access_paths(store, given, n):
    assert store.triples(**{k: ex(v) for k, v in given.items()}).count() == n


def test_changes_keep_a_set(spark):
    s = TripleStore(spark)
    assert len(s) == 0
    t = Triple(ex("a"), ex("p"), Literal("x"))
    s.add(t).add(t).add(ex("a"), ex("p"), Literal("y")).add([t, Triple(ex("b"), ex("p"), Literal("x", lang="en"))])
    assert len(s) == 3 and s.has_triple(t)
    s.remove(t).remove(t)
    assert len(s) == 2 and not s.has_triple(t)
    s.remove_all(s.triples(subject=ex("b")))
    assert [x.object for x in s] == [Literal("y")]


def test_statistics(store):
    assert (store.count_triples(), store.count_subjects(), store.count_predicates(), store.count_objects()) == (4, 2, 2, 2)
    assert store.get_predicate_count(ex("knows")) == 3 and store.get_predicate_count(ex("none")) == 0
    assert store.analyze().query(f"select ?x ?y where {{ ?x <{EX}knows> ?y . ?x <{EX}likes> ?y }}").df.count() == 1


def test_prefixes(store):
    store.register_namespace("ex", EX).register_namespace("k", EX + "kn").register_namespace("", EX)
    assert store.expand("ex:a") == ex("a") and store.expand(":a") == ex("a")
    assert store.abbreviate(ex("knows")) == "k:ows" and store.abbreviate(IRI("http://other/")) is None
    store.register_namespace("ex", "http://new/")
    assert store.expand("ex:a") == IRI("http://new/a")
    with pytest.raises(ValueError):
        store.expand("none:a")
