"""Small random graphs against an evaluator that follows the definitions literally."""

import random

import pytest

from tripleweave.functions.terms import IRI, Literal, Triple
from tripleweave.operators.store import TripleStore
from tripleweave.plans import ast as A

EX = "http://e/"


def merge(a, b):
    return None if any(k in a and a[k] != v for k, v in b.items()) else a | b


def evaluate(patterns, triples):
    out, filters = [{}], []
    for p in patterns:
        if isinstance(p, A.TriplePattern):
            new = []
            for s in out:
                for t in triples:
                    found = {}
                    for want, got in zip((p.subject, p.predicate, p.object), (t.subject, t.predicate, t.object), strict=True):
                        if isinstance(want, A.Var):
                            if found.setdefault(want.name, got) != got:
                                break
                        elif want != got:
                            break
                    else:
                        if (m := merge(s, found)) is not None:
                            new.append(m)
            out = new
        elif isinstance(p, A.OptionalPattern):
            inner = evaluate(p.patterns, triples)
            kept = []
            for s in out:
                fits = [x for i in inner if (x := merge(s, i)) is not None]
                kept += fits or [s]
            out = kept
        elif isinstance(p, A.UnionPattern):
            found = [x for b in p.branches for s in out for i in evaluate(b, triples) if (x := merge(s, i)) is not None]
            out = [dict(x) for x in dict.fromkeys(tuple(sorted(x.items(), key=lambda kv: kv[0])) for x in found)]
        else:
            filters.append(p.expression)
    for f in filters:
        out = [s for s in out if (s.get(f.left.name) is not None and s.get(f.right.name) is not None and (s[f.left.name] == s[f.right.name]) == (f.op == "="))]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_random(spark, seed):
    rng = random.Random(seed)
    nodes, preds = [IRI(EX + c) for c in "abcd"], [IRI(EX + c) for c in "pq"]
    triples = list({Triple(rng.choice(nodes), rng.choice(preds), rng.choice([*nodes, Literal("1"), Literal(1)])) for _ in range(14)})

    def pattern():
        return A.TriplePattern(rng.choice([A.Var(rng.choice("xyz")), nodes[0]]), rng.choice([*preds, A.Var("w")]), rng.choice([A.Var(rng.choice("xyzu")), rng.choice(nodes)]))

    patterns = [pattern()]
    for _ in range(rng.randint(1, 2)):
        kind = rng.choice(["triple", "optional", "union", "filter"])
        if kind == "triple":
            patterns.append(pattern())
        elif kind == "optional":
            patterns.append(A.OptionalPattern((pattern(),)))
        elif kind == "union":
            patterns.append(A.UnionPattern(((pattern(),), (pattern(),))))
        else:
            patterns.append(A.FilterPattern(A.ComparisonExpr(rng.choice(["=", "!="]), A.VarExpr("x"), A.VarExpr("y"))))
    want = sorted(sorted((k, str(v)) for k, v in s.items()) for s in evaluate(patterns, triples))
    got = TripleStore.of(spark, triples).query(A.SelectQuery((), tuple(patterns)))
    assert sorted(sorted((k, str(v)) for k, v in s.items()) for s in got) == want
