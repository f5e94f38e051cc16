"""The query catalogue of the graph engine: queries for every operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.functions.terms import IRI, BlankNode, Literal, Triple, iri_term, literal_term, serialized
from tripleweave.functions.vocab import RDF, XSD
from tripleweave.operators import shacl as S
from tripleweave.operators.store import TripleStore
from tripleweave.plans import ast as A
from tripleweave.sources.tables import BASE, VirtualGraph, sample_graph

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _FOUND[name] = (f, sql.replace("{B}", BASE) if sql else None)
        return f

    return keep


def sparql(name: str, text: str, sql: str, **options) -> None:
    """A query in text over the sample graph; its plain columns are the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sample_graph(spark, sf_dir).query(text, **options).flat

    query(name, sql)(run)


def node(path: str) -> IRI:
    return IRI(BASE + path)


def lines(df: DataFrame) -> DataFrame:
    """Triples as columns of N-Triples text."""
    return df.select(serialized(F.col("s")).alias("s"), F.col("p"), serialized(F.col("o")).alias("o"))


def _store(spark: SparkSession, sf_dir: str, *names: str) -> TripleStore:
    graph = sample_graph(spark, sf_dir)
    parts = [VirtualGraph(spark, [t]).triples() for t in graph.tables if t.name in names]
    return TripleStore(spark, reduce(lambda a, b: a.union(b), parts), graph.namespaces)


# access paths, over the virtual graph
NATION = """
  select '<{B}nation/' || n_nationkey || '>' as s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, '<{B}Nation>' as o from nation
  union all select '<{B}nation/' || n_nationkey || '>', '{B}n_name', '"' || n_name || '"' from nation
  union all select '<{B}nation/' || n_nationkey || '>', '{B}n_regionkey', '<{B}region/' || n_regionkey || '>' from nation
"""
REGION = """
  select '<{B}region/' || r_regionkey || '>' as s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, '<{B}Region>' as o from region
  union all select '<{B}region/' || r_regionkey || '>', '{B}r_name', '"' || r_name || '"' from region
"""
CUSTOMERS = """
  select '<{B}customer/' || c_custkey || '>' as s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, '<{B}Customer>' as o from customer
  union all select '<{B}customer/' || c_custkey || '>', '{B}c_name', '"' || c_name || '"' from customer
  union all select '<{B}customer/' || c_custkey || '>', '{B}c_acctbal', '"' || c_acctbal || '"^^<http://www.w3.org/2001/XMLSchema#double>' from customer
  union all select '<{B}customer/' || c_custkey || '>', '{B}c_mktsegment', '"' || c_mktsegment || '"' from customer
  union all select '<{B}customer/' || c_custkey || '>', '{B}c_nationkey', '<{B}nation/' || c_nationkey || '>' from customer
"""


def scan(name: str, sql: str, **parts) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = sample_graph(spark, sf_dir)
        graph = VirtualGraph(spark, [t for t in graph.tables if t.name in ("region", "nation", "customer")])
        return lines(graph.triples(**parts))

    query(name, f"select * from ({NATION} union all {REGION} union all {CUSTOMERS}) {sql}")(run)


scan("scan_all", "")
scan("scan_s", "where s = '<{B}nation/3>'", subject=node("nation/3"))
scan("scan_p", "where p = '{B}n_regionkey'", predicate=node("n_regionkey"))
scan("scan_o", "where o = '<{B}region/1>'", object=node("region/1"))
scan("scan_sp", "where s = '<{B}nation/3>' and p = '{B}n_name'", subject=node("nation/3"), predicate=node("n_name"))
scan("scan_po", "where p = '{B}n_regionkey' and o = '<{B}region/1>'", predicate=node("n_regionkey"), object=node("region/1"))
scan("scan_so", "where s = '<{B}nation/3>' and o = '<{B}region/3>'", subject=node("nation/3"), object=node("region/3"))
scan("scan_spo", "where s = '<{B}nation/3>' and p = '{B}n_name' and o = '\"NATION_3\"'", subject=node("nation/3"), predicate=node("n_name"), object=Literal("NATION_3"))


# stores
@query("stats_predicates", f"select p, count(*) as n from ({NATION} union all {CUSTOMERS}) group by p")
def _stats(spark, sf_dir):
    return _store(spark, sf_dir, "nation", "customer").predicate_counts()


@query("stats_counts", f"select count(*) as triples, count(distinct s) as subjects, count(distinct p) as predicates, count(distinct o) as objects from ({CUSTOMERS})")
def _counts(spark, sf_dir):
    df = lines(_store(spark, sf_dir, "customer").df)
    return df.agg(F.count("*").alias("triples"), *(F.countDistinct(c).alias(n) for c, n in (("s", "subjects"), ("p", "predicates"), ("o", "objects"))))


@query("store_create", "select '<{B}a>' as s, '{B}knows' as p, '<{B}b>' as o union all select '<{B}a>', '{B}name', '\"A\"@en-gb' union all select '_:n', '{B}age', '\"30\"^^<http://www.w3.org/2001/XMLSchema#integer>'")
def _create(spark, sf_dir):
    store = TripleStore.of(spark, [Triple(node("a"), node("knows"), node("b")), Triple(node("a"), node("knows"), node("b"))], {"t": BASE})
    store.add(node("a"), node("name"), Literal("A", lang="en-GB"))
    return lines(store.add([Triple(BlankNode("n"), node("age"), Literal(30))]).df)


@query("add_dedup", f"select * from ({CUSTOMERS}) union select * from ({CUSTOMERS}) union select '<{{B}}customer/3>', '{{B}}c_name', '\"Other\"'")
def _add(spark, sf_dir):
    store = _store(spark, sf_dir, "customer")
    return lines(store.add(store.df).add(node("customer/3"), node("c_name"), Literal("Other")).df)


@query("remove_triples", f"select * from ({CUSTOMERS}) where p <> '{{B}}c_nationkey' and not (s = '<{{B}}customer/3>' and p = '{{B}}c_mktsegment' and o = '\"BUILDING\"') and not (s = '<{{B}}customer/4>' and p = '{{B}}c_mktsegment' and o = '\"MACHINERY\"')")
def _remove(spark, sf_dir):
    store = _store(spark, sf_dir, "customer")
    links = store.triples(predicate=node("c_nationkey"))
    gone = [Triple(node("customer/3"), node("c_mktsegment"), Literal("BUILDING")), Triple(node("customer/4"), node("c_mktsegment"), Literal("MACHINERY"))]
    return lines(store.remove(gone).remove_all(links).df)


@query("has_triple", f"select exists(select * from ({CUSTOMERS}) where p = '{{B}}c_nationkey' and o = '<{{B}}nation/3>') as yes, exists(select * from ({CUSTOMERS}) where o = '\"none\"') as no")
def _has(spark, sf_dir):
    store = _store(spark, sf_dir, "customer")
    yes, no = (store.triples(predicate=p, object=o).limit(1).agg((F.count("*") > 0).alias(n)) for p, o, n in ((node("c_nationkey"), node("nation/3"), "yes"), (node("c_name"), Literal("none"), "no")))
    return yes.crossJoin(no)


@query("store_join", "select c_name as cn, n_name as nn from customer join nation on n_nationkey = c_nationkey")
def _store_join(spark, sf_dir):
    return _store(spark, sf_dir, "nation", "customer").analyze().query("select ?cn ?nn where { ?c t:c_name ?cn ; t:c_nationkey ?n . ?n t:n_name ?nn }").flat


@query("prefixes", "select '{B}nation/7' as expanded, 'n:7' as abbreviated, 't:x' as shorter, 'http://other.example/n/7' as overridden, 'http://e.example/a' as empty_prefix")
def _prefixes(spark, sf_dir):
    g = TripleStore(spark).register_namespace("t", BASE).register_namespace("n", IRI(BASE + "nation/")).register_namespace("", "http://e.example/")
    row = [g.expand("n:7").value, g.abbreviate(node("nation/7")), g.abbreviate(node("x"))]
    row += [g.register_namespace("n", "http://other.example/n/").expand("n:7").value, g.expand(":a").value]
    return spark.createDataFrame([row], "expanded string, abbreviated string, shorter string, overridden string, empty_prefix string")


# basic graph patterns
sparql("bgp_single", "select ?c ?b where { ?c t:c_acctbal ?b }", "select '{B}customer/' || c_custkey as c, c_acctbal as b from customer")
sparql(
    "bgp_star",
    "select ?c ?n ?b ?m where { ?c a t:Customer ; t:c_name ?n ; t:c_acctbal ?b ; t:c_mktsegment ?m }",
    "select '{B}customer/' || c_custkey as c, c_name as n, c_acctbal as b, c_mktsegment as m from customer",
)
sparql(
    "bgp_chain",
    'select ?c ?name ?bal ?rn where { ?c a t:Customer ; t:c_name ?name ; t:c_acctbal ?bal ; t:c_nationkey ?n . ?n t:n_name "NATION_1" ; t:n_regionkey ?r . ?r t:r_name ?rn filter(?bal > 5000) }',
    "select '{B}customer/' || c_custkey as c, c_name as name, c_acctbal as bal, r_name as rn from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where n_name = 'NATION_1' and c_acctbal > 5000",
)
sparql(
    "bgp_long_chain",
    "select ?l ?price ?nn ?rn where { ?l t:l_extendedprice ?price ; t:l_orderkey ?o . ?o t:o_custkey ?c . ?c t:c_nationkey ?n . ?n t:n_name ?nn ; t:n_regionkey ?r . ?r t:r_name ?rn filter(?price > 90000) }",
    "select '{B}lineitem/' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || cast(l_quantity as bigint) as l, l_extendedprice as price, n_name as nn, r_name as rn from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_extendedprice > 90000",
)
sparql("bgp_cross", "select ?a ?b where { ?x t:r_name ?a . ?y t:r_name ?b }", "select x.r_name as a, y.r_name as b from region x, region y")
sparql("bgp_repeated_var", "select ?x where { ?x t:region_number ?x }", "select '{B}num/' || n_nationkey as x from nation where n_nationkey = n_regionkey")
sparql("bgp_var_predicate", "select ?p ?n where { <http://example.org/tpch/nation/3> ?p ?o . ?o t:r_name ?n }", "select '{B}n_regionkey' as p, r_name as n from nation join region on n_regionkey = r_regionkey where n_nationkey = 3")
sparql("bgp_constant_subject", "select ?n where { <http://example.org/tpch/customer/7> t:c_name ?n }", "select c_name as n from customer where c_custkey = 7")
sparql("bgp_shared_object", "select ?c ?s where { ?c t:c_nationkey ?n . ?s t:s_nationkey ?n . ?n t:n_name \"NATION_2\" }", "select '{B}customer/' || c_custkey as c, '{B}supplier/' || s_suppkey as s from customer join supplier on c_nationkey = s_nationkey join nation on n_nationkey = c_nationkey where n_name = 'NATION_2'")


# filters
def filters(name: str, test: str, where: str) -> None:
    sparql(f"filter_{name}", f"select ?p ?z ?b where {{ ?p t:p_size ?z ; t:p_brand ?b filter({test}) }}", f"select '{{B}}part/' || p_partkey as p, p_size as z, p_brand as b from part where {where}")


filters("eq", "?z = 7", "p_size = 7")
filters("ne", "?z != 7", "p_size <> 7")
filters("lt", "?z < 7", "p_size < 7")
filters("le", "?z <= 7", "p_size <= 7")
filters("gt", "?z > 40", "p_size > 40")
filters("ge", "?z >= 40", "p_size >= 40")
filters("and", "?z > 10 && ?z < 20", "p_size > 10 and p_size < 20")
filters("or", "?z < 5 || ?z > 45", "p_size < 5 or p_size > 45")
filters("not", "!(?z < 25)", "not (p_size < 25)")
filters("nested", "!(?z < 5 || (?z > 10 && ?z < 40))", "not (p_size < 5 or (p_size > 10 and p_size < 40))")
filters("bound", "bound(?z)", "true")
filters("variable", "?z && !?missing", "true")
filters("isiri", "isIRI(?p) && !isURI(?z)", "true")
filters("isliteral", "isLiteral(?z) && !isLiteral(?p)", "true")
filters("not_number", "!(?b > 3)", "true")
filters("term_equality", '?z = "7"', "false")
filters("literal", '"x"', "true")
filters("literal_or", "?z < 5 || false", "true")
sparql("filter_isblank", "select ?t ?r where { ?t t:role ?r filter(isBlank(?t)) }", "select 'c' || conv_id || '_' || turn as t, role as r from conversations")
sparql("filter_two_variables", "select ?a ?b where { ?x t:n_regionkey ?r ; t:n_name ?a . ?y t:n_regionkey ?r ; t:n_name ?b filter(?x != ?y) }", "select x.n_name as a, y.n_name as b from nation x join nation y on x.n_regionkey = y.n_regionkey where x.n_nationkey <> y.n_nationkey")
sparql("filter_arithmetic", "select ?p where { ?p t:p_size ?z filter(?z * 2 - 1 > 80) }", "select '{B}part/' || p_partkey as p from part where p_size * 2 - 1 > 80", extensions=True)
sparql("filter_regex", 'select ?n where { ?c t:c_name ?n filter(regex(?n, "99$")) }', "select c_name as n from customer where regexp_matches(c_name, '99$')", extensions=True)

@query("query_tree", "select '{B}part/' || p_partkey as p, p_size as z, 'p,z' as names, true as bound, false as missing from part where p_size > 10 and not (p_size >= 20)")
def _tree(spark, sf_dir):
    """A query built as a tree, with the helpers for trees and solutions."""
    p, z = A.variables("p", "z")
    size = A.VarExpr("z")
    test = A.LogicalExpr("and", (A.ComparisonExpr(">", size, A.LiteralExpr(Literal(10))), A.LogicalExpr("not", (A.ComparisonExpr(">=", size, A.LiteralExpr(Literal(20))),))))
    where = (A.TriplePattern(p, node("p_size"), z), A.FilterPattern(test))
    names = [v for v in A.get_variables(where) if A.is_variable(A.Var(v))]
    found = sample_graph(spark, sf_dir).query(A.SelectQuery(A.variables(*names), where)).flat
    bound, missing = (A.is_bound({"z": Literal(1), "q": None}, v) for v in ("z", "q"))
    return found.select("*", F.lit(",".join(names)).alias("names"), F.lit(bound).alias("bound"), F.lit(missing).alias("missing"))


# optional
sparql("optional_basic", "select ?d ?q where { ?d t:source ?s optional { ?l t:label_of ?d ; t:quality ?q } }", "select '{B}documents/' || d.doc_id as d, quality as q from documents d left join labels l on l.doc_id = d.doc_id")
sparql(
    "optional_chained",
    "select ?d ?q ?x where { ?d t:source ?s optional { ?l t:label_of ?d . ?l t:quality ?q } optional { ?k t:label_of ?d ; t:toxic ?x filter(?x = 1) } }",
    "select '{B}documents/' || d.doc_id as d, l.quality as q, m.toxic as x from documents d left join labels l on l.doc_id = d.doc_id left join labels m on m.doc_id = d.doc_id and m.toxic = 1",
)
sparql("optional_filter", "select ?d where { ?d t:source ?s optional { ?l t:label_of ?d } filter(!bound(?l)) }", "select '{B}documents/' || doc_id as d from documents where doc_id not in (select doc_id from labels)")
sparql("optional_same_subject", "select ?c ?b where { ?c t:c_name ?n optional { ?c t:c_acctbal ?b } }", "select '{B}customer/' || c_custkey as c, c_acctbal as b from customer")
sparql(
    "optional_unbound_join",
    "select ?n ?q ?rn where { ?n t:n_name ?nn optional { ?n t:n_regionkey ?q . ?q t:r_name \"ASIA\" } ?q t:r_name ?rn }",
    "select '{B}nation/' || n_nationkey as n, '{B}region/' || r_regionkey as q, r_name as rn from nation, region where (n_regionkey = r_regionkey and r_name = 'ASIA') or n_regionkey not in (select r_regionkey from region where r_name = 'ASIA')",
)

sparql(
    "optional_unbound_right",
    "select ?n ?q ?nn where { ?n t:n_regionkey ?q optional { ?m t:n_name ?nn optional { ?m t:n_regionkey ?q . ?q t:r_name \"ASIA\" } } }",
    "select '{B}nation/' || n.n_nationkey as n, '{B}region/' || n.n_regionkey as q, m.n_name as nn from nation n join nation m on (m.n_regionkey = n.n_regionkey and m.n_regionkey in (select r_regionkey from region where r_name = 'ASIA')) or m.n_regionkey not in (select r_regionkey from region where r_name = 'ASIA')",
)
sparql(
    "optional_unbound_alone",
    "select ?d ?q where { ?d t:source ?s optional { ?l t:toxic ?x optional { ?l t:label_of ?d } ?l t:quality ?q filter(?x = 1) } }",
    "select '{B}documents/' || d.doc_id as d, l.quality as q from documents d left join labels l on l.doc_id = d.doc_id and l.toxic = 1",
)

# union and groups
sparql("union_basic", "select ?n where { { ?x t:c_name ?n } union { ?x t:s_name ?n } }", "select c_name as n from customer union all select s_name from supplier")
sparql("union_diff_vars", "select ?x ?b ?k where { { ?x t:c_acctbal ?b } union { ?x t:s_nationkey ?k } }", "select '{B}customer/' || c_custkey as x, c_acctbal as b, null::varchar as k from customer union select '{B}supplier/' || s_suppkey, null, '{B}nation/' || s_nationkey from supplier")
sparql("union_same_branch", "select ?x where { { ?x t:r_name ?n } union { ?x t:r_name ?n } }", "select '{B}region/' || r_regionkey as x from region")
sparql(
    "union_joined",
    "select ?nn ?b where { ?n t:n_name ?nn { ?x t:c_nationkey ?n ; t:c_acctbal ?b } union { ?x t:s_nationkey ?n ; t:s_acctbal ?b } filter(?b > 9000) }",
    "select n_name as nn, b from nation join (select c_nationkey as k, c_acctbal as b, 'c' || c_custkey as x from customer union select s_nationkey, s_acctbal, 's' || s_suppkey from supplier) on k = n_nationkey where b > 9000",
)
sparql("group_join", "select ?c ?rn where { ?c t:c_nationkey ?n { ?n t:n_regionkey ?r . ?r t:r_name ?rn } }", "select '{B}customer/' || c_custkey as c, r_name as rn from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")

# modifiers
sparql("distinct", "select distinct ?b ?z where { ?p t:p_brand ?b ; t:p_size ?z }", "select distinct p_brand as b, p_size as z from part")
sparql("distinct_order_hidden", "select distinct ?b where { ?p t:p_brand ?b ; t:p_name ?n } order by ?n ?b limit 3", "select p_brand as b from part group by p_brand order by min(p_name), b limit 3")
sparql("order_lexical", "select ?c where { ?c t:c_name ?n } order by ?c limit 20", "select '{B}customer/' || c_custkey as c from customer order by c limit 20")
sparql("order_numeric", "select ?p where { ?p t:p_retailprice ?r } order by ?r ?p limit 20", "select '{B}part/' || p_partkey as p from part order by p_retailprice, p limit 20", numeric_order=True)
sparql("order_multi", "select ?b ?c where { ?c t:c_mktsegment ?b } order by desc(?b) ?c limit 25", "select c_mktsegment as b, '{B}customer/' || c_custkey as c from customer order by b desc, c limit 25")
sparql("offset_limit", "select ?c where { ?c t:c_name ?n } order by ?n offset 10 limit 15", "select '{B}customer/' || c_custkey as c from customer order by c_name limit 15 offset 10")
sparql("topk", "select ?o ?d where { ?o t:o_orderdate ?d ; t:o_orderstatus ?s } order by ?d desc ?o limit 10", "select '{B}orders/' || o_orderkey as o, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as d from orders order by d desc, o limit 10")
sparql("select_star", "select * where { ?n t:n_name ?nn ; t:n_regionkey ?r }", "select '{B}nation/' || n_nationkey as n, n_name as nn, '{B}region/' || n_regionkey as r from nation")
sparql("text_lists", 'select ?n where { ?n a t:Nation ; t:n_regionkey <http://example.org/tpch/region/1> , ?r ; t:n_name ?m . filter(?m != "NATION_1") }', "select '{B}nation/' || n_nationkey as n from nation where n_regionkey = 1 and n_name <> 'NATION_1'")
sparql("text_language", "select ?d ?l where { ?l t:label_of ?d . ?d t:n_chars ?n filter(?n < 300) }", "select '{B}documents/' || d.doc_id as d, '{B}labels/' || d.doc_id as l from documents d join labels using (doc_id) where n_chars < 300")


# forms
@query("construct", "select distinct '<{B}region/' || n_regionkey || '>' as s, '{B}holds' as p, '<{B}nation/' || n_nationkey || '>' as o from nation union select '<{B}nation/' || n_nationkey || '>', '{B}label', '\"' || n_name || '\"' from nation")
def _construct(spark, sf_dir):
    return lines(sample_graph(spark, sf_dir).query("construct { ?r t:holds ?n . ?n t:label ?m . ?m t:bad ?r } where { ?n t:n_regionkey ?r ; t:n_name ?m }").df)


@query("ask_true", "select true as result")
def _ask_true(spark, sf_dir):
    return sample_graph(spark, sf_dir).query('ask { ?n t:n_name "NATION_3" }').df


@query("ask_false", "select exists(select * from nation where n_name = 'NOWHERE') as result")
def _ask_false(spark, sf_dir):
    return sample_graph(spark, sf_dir).query('ask { ?n t:n_name "NOWHERE" }').df


DESCRIBED = f"select * from ({NATION} union all {REGION}) where s = '<{{B}}region/1>' or o = '<{{B}}region/1>'"


@query("describe_iri", DESCRIBED)
def _describe(spark, sf_dir):
    return lines(sample_graph(spark, sf_dir).query("describe <http://example.org/tpch/region/1>").df)


@query("describe_where", f"select * from ({NATION} union all {REGION}) where s in (select '<{{B}}region/' || r_regionkey || '>' from region where r_name = 'ASIA') or o in (select '<{{B}}region/' || r_regionkey || '>' from region where r_name = 'ASIA')")
def _describe_where(spark, sf_dir):
    return lines(sample_graph(spark, sf_dir).query('describe ?r where { ?r t:r_name "ASIA" }').df)


@query("describe_many", f"select * from ({CUSTOMERS}) where s in (select '<{{B}}customer/' || c_custkey || '>' from customer where c_mktsegment = 'BUILDING') union select '<{{B}}orders/' || o_orderkey || '>', '{{B}}o_custkey', '<{{B}}customer/' || o_custkey || '>' from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' union select '<{{B}}events/' || event_id || '>', '{{B}}user_id', '<{{B}}customer/' || user_id || '>' from events join customer on c_custkey = user_id where c_mktsegment = 'BUILDING'")
def _describe_many(spark, sf_dir):
    return lines(sample_graph(spark, sf_dir).query('describe ?c where { ?c t:c_mktsegment "BUILDING" }').df)


# constraints
def shape(name: str, target: str, path: str, constraint, sql: str, severity: str = "Violation", node_level: bool = False, extensions: bool = False) -> None:
    """One violation row each: focus node, value and message."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = constraint if isinstance(constraint, tuple) else (constraint,)
        kind = S.TargetClass(node(target)) if isinstance(target, str) else target
        prop = () if node_level else (S.PropertyShape(node(path), given, severity=severity),)
        report = S.validate(sample_graph(spark, sf_dir), [S.NodeShape(node("shape"), (kind,), given if node_level else (), prop)], extensions)
        return report.df.select(F.col("focus_node.value").alias("focus"), F.col("value.value").alias("value"), "source_constraint", "message", "severity")

    query(f"shacl_{name}", sql)(run)


def violations(name: str, focus: str, value: str, message: str, source: str, severity: str = "Violation") -> str:
    return f"select '{{B}}' || {focus} as focus, {value} as value, '{name}' as source_constraint, {message} as message, '{severity}' as severity from {source}"


CUSTOMER, PART, DOC, NO_VALUE = "'customer/' || c_custkey", "'part/' || p_partkey", "'documents/' || doc_id", "null::varchar"
shape("min_count", "Documents", "absent", S.MinCount(1), violations("MinCount", DOC, NO_VALUE, "'Property has 0 values but requires at least 1'", "documents"))
shape("max_count", "Customer", "c_name", S.MaxCount(0), violations("MaxCount", CUSTOMER, NO_VALUE, "'Property has 1 values but allows at most 0'", "customer"))
shape("datatype", "Part", "p_brand", S.Datatype(XSD.integer), violations("Datatype", PART, "p_brand", "'Value must have datatype http://www.w3.org/2001/XMLSchema#integer'", "part"))
shape("class", "Customer", "c_nationkey", S.Class(node("Region")), violations("Class", CUSTOMER, "'{B}nation/' || c_nationkey", "'Value must be an instance of class {B}Region'", "customer"))
shape("class_held", "Customer", "c_nationkey", S.Class(node("Nation")), violations("Class", CUSTOMER, "'{B}nation/' || c_nationkey", "''", "customer where c_nationkey not in (select n_nationkey from nation)"))
shape("node_kind", "Customer", "c_name", S.NodeKind("IRI"), violations("NodeKind", CUSTOMER, "c_name", "'Value must be of node kind IRI'", "customer"))
shape("min_length", "Part", "p_brand", S.MinLength(8), violations("MinLength", PART, "p_brand", "'String length ' || length(p_brand) || ' is less than minimum 8'", "part where length(p_brand) < 8"))
shape("max_length", "Part", "p_name", S.MaxLength(8), violations("MaxLength", PART, "p_name", "'String length ' || length(p_name) || ' exceeds maximum 8'", "part where length(p_name) > 8"))
shape("pattern", "Customer", "c_name", S.Pattern("[0-4]$"), violations("Pattern", CUSTOMER, "c_name", "'Value does not match pattern [0-4]$'", "customer where not regexp_matches(c_name, '[0-4]$')"))
shape("pattern_flags", "Customer", "c_mktsegment", S.Pattern("^a", "i"), violations("Pattern", CUSTOMER, "c_mktsegment", "'Value does not match pattern ^a'", "customer where not regexp_matches(c_mktsegment, '^[aA]')"))
shape("language_in", "Documents", "text", S.LanguageIn(("en", "fr")), violations("LanguageIn", DOC, "text", "'Language tag ' || lang || ' not in allowed languages'", "documents where lang not in ('en', 'fr')"))
shape("has_value", "Customer", "c_mktsegment", S.HasValue(Literal("BUILDING")), violations("HasValue", CUSTOMER, NO_VALUE, "'Required value BUILDING not found'", "customer where c_mktsegment <> 'BUILDING'"))
shape("in", "Customer", "c_mktsegment", S.In((Literal("BUILDING"), Literal("MACHINERY"))), violations("In", CUSTOMER, "c_mktsegment", "'Value not in allowed list'", "customer where c_mktsegment not in ('BUILDING', 'MACHINERY')"))
shape("min_inclusive", "Part", "p_size", S.MinInclusive(10), violations("MinInclusive", PART, "p_size::varchar", "'Value must be >= 10'", "part where not p_size >= 10"))
shape("max_inclusive", "Part", "p_size", S.MaxInclusive(40), violations("MaxInclusive", PART, "p_size::varchar", "'Value must be <= 40'", "part where not p_size <= 40"))
shape("min_exclusive", "Part", "p_size", S.MinExclusive("10"), violations("MinExclusive", PART, "p_size::varchar", "'Value must be > 10'", "part where not p_size > 10"))
shape("max_exclusive", "Part", "p_size", S.MaxExclusive(40), violations("MaxExclusive", PART, "p_size::varchar", "'Value must be < 40'", "part where not p_size < 40"))
shape("bound_on_text", "Customer", "c_mktsegment", S.MinInclusive(1), violations("MinInclusive", CUSTOMER, "c_mktsegment", "'Value must be >= 1'", "customer"))
shape("equals", "Labels", "quality", S.Equals(node("toxic")), violations("Equals", "'labels/' || doc_id", NO_VALUE, "'Property values must equal values of {B}toxic'", "labels where quality <> toxic"))
shape("disjoint", "Labels", "quality", S.Disjoint(node("toxic")), violations("Disjoint", "'labels/' || doc_id", NO_VALUE, "'Property values must be disjoint from {B}toxic'", "labels where quality = toxic"))
shape("less_than", "Labels", "toxic", S.LessThan(node("quality")), violations("LessThan", "'labels/' || doc_id", "toxic::varchar", "'Value must be less than values of {B}quality'", "labels where not toxic < quality"), extensions=True)
shape("less_than_or_equals", "Labels", "toxic", S.LessThanOrEquals(node("quality")), violations("LessThanOrEquals", "'labels/' || doc_id", "toxic::varchar", "'Value must be less than values of {B}quality'", "labels where not toxic <= quality"), extensions=True)
shape("closed_many", "Customer", "", S.Closed(True, (RDF.type, node("c_name"), node("c_mktsegment"))), violations("Closed", CUSTOMER, "c_acctbal::varchar", "'Property not allowed: {B}c_acctbal'", "customer") + " union all " + violations("Closed", CUSTOMER, "'{B}nation/' || c_nationkey", "'Property not allowed: {B}c_nationkey'", "customer"), node_level=True, extensions=True)


@query("shacl_unique_lang", "select '{B}pair/' || k as focus, null::varchar as value, 'UniqueLang' as source_constraint, 'Language tags must be unique' as message, 'Violation' as severity from (select distinct doc_id // 3 as k from documents group by doc_id // 3, lang having count(distinct source || doc_id) > 1)")
def _unique_lang(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = iri_term(F.concat(F.lit(BASE + "pair/"), F.floor(F.col("doc_id") / 3).cast("string")))
    o = literal_term(F.concat("source", F.col("doc_id").cast("string")), None, F.col("lang"))
    titles = docs.select(s.alias("s"), F.lit(BASE + "title").alias("p"), o.alias("o"))
    shapes = [S.NodeShape(node("shape"), (S.TargetSubjectsOf(node("title")),), (), (S.PropertyShape(node("title"), (S.UniqueLang(),)),))]
    found = S.validate(TripleStore(spark, titles), shapes, extensions=True).df
    return found.select(F.col("focus_node.value").alias("focus"), F.col("value.value").alias("value"), "source_constraint", "message", "severity")


@query("shacl_shapes_graph", "select true as refused")
def _shapes_graph(spark, sf_dir):
    """Shapes are given as values; a graph of shapes is refused."""
    graph = sample_graph(spark, sf_dir)
    try:
        S.validate(graph, TripleStore(spark))
        refused = False
    except NotImplementedError:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


shape("combined", "Part", "p_size", (S.MinInclusive(10), S.MaxInclusive(40), S.MinCount(1)), violations("MinInclusive", PART, "p_size::varchar", "'Value must be >= 10'", "part where not p_size >= 10") + " union all " + violations("MaxInclusive", PART, "p_size::varchar", "'Value must be <= 40'", "part where not p_size <= 40"))
shape("severity", "Part", "p_size", S.MinInclusive(10), violations("MinInclusive", PART, "p_size::varchar", "'Value must be >= 10'", "part where not p_size >= 10", "Warning"), severity="Warning")


def _sized(*constraints) -> S.NodeShape:
    return S.NodeShape(node("inner"), (), (), (S.PropertyShape(node("p_size"), constraints),))


LOW, HIGH = violations("MinInclusive", PART, "p_size::varchar", "'Value must be >= 10'", "part where not p_size >= 10"), violations("MaxInclusive", PART, "p_size::varchar", "'Value must be <= 40'", "part where not p_size <= 40")
shape("and", "Part", "", S.And((_sized(S.MinInclusive(10)), _sized(S.MaxInclusive(40)))), f"{LOW} union all {HIGH}", node_level=True)
shape("or", "Part", "", S.Or((_sized(S.MinInclusive(30)), _sized(S.MaxInclusive(10)))), violations("Or", PART, NO_VALUE, "'Node must satisfy at least one of the OR constraints'", "part where p_size < 30 and p_size > 10"), node_level=True)
shape("not", "Part", "", S.Not(_sized(S.MinInclusive(10))), violations("Not", PART, NO_VALUE, "'Node must NOT satisfy the constraint'", "part where p_size >= 10"), node_level=True)
shape("xone", "Part", "", S.Xone((_sized(S.MinInclusive(30)), _sized(S.MinInclusive(10)))), violations("Xone", PART, NO_VALUE, "'Node must satisfy exactly one of the XONE constraints'", "part where (p_size >= 30) = (p_size >= 10)"), node_level=True, extensions=True)
shape("node_level", "Part", "", (S.HasValue(Literal("x")), S.MinLength(5), S.MinCount(1)), violations("HasValue", PART, NO_VALUE, "'Required value x not found'", "part") + " union all " + violations("MinCount", PART, NO_VALUE, "'Property has 0 values but requires at least 1'", "part"), node_level=True)
shape("closed", "Region", "", S.Closed(True, (RDF.type,)), violations("Closed", "'region/' || r_regionkey", "r_name", "'Property not allowed: {B}r_name'", "region"), node_level=True, extensions=True)
shape("target_node", S.TargetNode(node("part/1")), "p_size", S.MaxCount(0), violations("MaxCount", PART, NO_VALUE, "'Property has 1 values but allows at most 0'", "part where p_partkey = 1"))
shape("target_subjects", S.TargetSubjectsOf(node("label_of")), "quality", S.MinInclusive(1), violations("MinInclusive", "'labels/' || doc_id", "quality::varchar", "'Value must be >= 1'", "labels where quality < 1"))
shape("target_objects", S.TargetObjectsOf(node("n_regionkey")), "r_name", S.MinLength(7), violations("MinLength", "'region/' || r_regionkey", "r_name", "'String length ' || length(r_name) || ' is less than minimum 7'", "region where length(r_name) < 7 and r_regionkey in (select n_regionkey from nation)"))
shape("target_class", "Nation", "n_name", S.Pattern("1$"), violations("Pattern", "'nation/' || n_nationkey", "n_name", "'Value does not match pattern 1$'", "nation where not regexp_matches(n_name, '1$')"))


def queries() -> dict[str, Query]:
    from tripleweave import exchange_queries  # noqa: F401  registers the sources' queries

    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from tripleweave import exchange_queries  # noqa: F401

    return {n: s for n, (_, s) in _FOUND.items() if s}
