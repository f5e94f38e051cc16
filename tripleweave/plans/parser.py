"""SPARQL text to query trees: a regular-expression lexer and a recursive-descent parser."""

from __future__ import annotations

import re

from tripleweave.functions.terms import IRI, Literal
from tripleweave.functions.vocab import RDF, XSD
from tripleweave.plans import ast as A


class SparqlSyntaxError(ValueError):
    """The text is not a query of the supported grammar."""


class UnsupportedSparqlError(SparqlSyntaxError):
    """The text uses a part of SPARQL that is not supported."""


LEXER = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^\s<>"{}|^`\\]*>)
    |(?P<var>[?$]\w+)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<curie>(?:[A-Za-z_][\w-]*)?:(?:[\w%-](?:[\w.%:-]*[\w%-])?)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<symbol>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!*+/\[\]-])""",
    re.X | re.S,
)
UNSUPPORTED = set("BASE BIND VALUES MINUS EXISTS GRAPH FROM SERVICE HAVING GROUP REDUCED INSERT DELETE LOAD CLEAR NOT".split())
ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    """Decode string escapes."""

    def one(m: re.Match) -> str:
        code = m[1]
        if code[0] in "uU":
            return chr(int(code[1:], 16))
        if code not in ESCAPED:
            raise SparqlSyntaxError(f"unknown escape \\{code}")
        return ESCAPED[code]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = LEXER.match(text, at)
        if not m:
            raise SparqlSyntaxError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return [*out, ("end", "", len(text))]


def number_literal(text: str) -> Literal:
    kind = XSD.double if re.search("[eE]", text) else XSD.decimal if "." in text else XSD.integer
    return Literal(text, kind)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.prefixes = tokens(text), 0, {}

    # tokens
    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def fail(self, wanted: str):
        raise SparqlSyntaxError(f"expected {wanted}, found {self.text or 'the end'!r} at {self.tokens[self.at][2]}")

    def next(self) -> str:
        text = self.text
        self.at += 1
        return text

    def keyword(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words

    def take(self, symbol: str) -> bool:
        if self.kind == "symbol" and self.text == symbol:
            self.at += 1
            return True
        return False

    def need(self, symbol: str) -> None:
        if not self.take(symbol):
            self.fail(repr(symbol))

    # queries
    def query(self) -> A.SPARQLQuery:
        while self.keyword("PREFIX"):
            self.next()
            if self.kind != "curie" or not self.text.endswith(":"):
                self.fail("a prefix")
            prefix = self.next()[:-1]
            if self.kind != "iri":
                self.fail("an IRI")
            self.prefixes[prefix] = self.next()[1:-1]
        form = self.text.upper() if self.kind == "word" else ""
        if form not in ("SELECT", "CONSTRUCT", "ASK", "DESCRIBE"):
            if form in UNSUPPORTED:
                raise UnsupportedSparqlError(f"{form} is not supported")
            self.fail("SELECT, CONSTRUCT, ASK or DESCRIBE")
        self.next()
        found = getattr(self, form.lower())()
        if self.kind != "end":
            self.fail("the end")
        return found

    def select(self) -> A.SelectQuery:
        distinct = False
        if self.keyword("DISTINCT"):
            self.next()
            distinct = True
        names: list[str] = []
        if not self.take("*"):
            while self.kind == "var":
                names.append(self.next()[1:])
            if not names:
                if self.kind == "symbol" and self.text == "(":
                    raise UnsupportedSparqlError("expressions in SELECT are not supported")
                self.fail("variables or *")
        where = self.where()
        return A.SelectQuery(tuple(names), where, self.modifiers(), distinct)

    def construct(self) -> A.ConstructQuery:
        self.need("{")
        template: list = []
        while not self.take("}"):
            template += self.triples()
            self.take(".")
        return A.ConstructQuery(tuple(template), self.where(), self.modifiers())

    def ask(self) -> A.AskQuery:
        return A.AskQuery(self.where())

    def describe(self) -> A.DescribeQuery:
        resources: list = []
        while self.kind in ("var", "iri", "curie"):
            resources.append(self.term())
        if not resources:
            self.fail("a resource")
        where = self.where() if self.keyword("WHERE") or self.text == "{" else ()
        return A.DescribeQuery(tuple(resources), where, self.modifiers())

    def where(self) -> tuple:
        if self.keyword("WHERE"):
            self.next()
        return self.group()

    def modifiers(self) -> A.QueryModifiers:
        limit = offset = None
        keys: list = []
        while self.keyword("ORDER", "LIMIT", "OFFSET"):
            word = self.next().upper()
            if word == "ORDER":
                if not self.keyword("BY"):
                    self.fail("BY")
                self.next()
                while self.kind == "var" or self.keyword("ASC", "DESC"):
                    if self.kind == "var":
                        name = self.next()[1:]
                        down = self.keyword("DESC")
                        if self.keyword("ASC", "DESC"):
                            self.next()
                    else:
                        down = self.next().upper() == "DESC"
                        self.need("(")
                        if self.kind != "var":
                            self.fail("a variable")
                        name = self.next()[1:]
                        self.need(")")
                    keys.append(A.OrderKey(name, down))
                if not keys:
                    self.fail("a variable to order by")
            else:
                if self.kind != "number" or not self.text.isdigit():
                    self.fail("a whole number")
                value = int(self.next())
                limit, offset = (value, offset) if word == "LIMIT" else (limit, value)
        return A.QueryModifiers(limit, offset, tuple(keys))

    # patterns
    def group(self) -> tuple:
        self.need("{")
        out: list = []
        while not self.take("}"):
            if self.kind == "end":
                self.fail("'}'")
            if self.keyword("FILTER"):
                self.next()
                out.append(A.FilterPattern(self.constraint()))
            elif self.keyword("OPTIONAL"):
                self.next()
                out.append(A.OptionalPattern(self.group()))
            elif self.kind == "symbol" and self.text == "{":
                branches = [self.group()]
                while self.keyword("UNION"):
                    self.next()
                    branches.append(self.group())
                out.append(A.UnionPattern(tuple(branches)) if len(branches) > 1 else A.GroupPattern(branches[0]))
            elif self.kind == "word" and self.text.upper() in UNSUPPORTED:
                raise UnsupportedSparqlError(f"{self.text.upper()} is not supported")
            else:
                out += self.triples()
            self.take(".")
        return tuple(out)

    def triples(self) -> list[A.TriplePattern]:
        out, subject = [], self.term()
        while True:
            predicate = self.verb()
            while True:
                out.append(A.TriplePattern(subject, predicate, self.term()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return out
            while self.take(";"):
                pass
            if self.text in (".", "}"):
                return out

    def verb(self):
        if self.kind == "word" and self.text == "a":
            self.next()
            return RDF.type
        found = self.term()
        if isinstance(found, Literal):
            raise SparqlSyntaxError("a predicate is an IRI or a variable")
        if self.kind == "symbol" and self.text in ("/", "*", "+"):
            raise UnsupportedSparqlError("property paths are not supported")
        return found

    def term(self):
        kind = self.kind
        if kind == "var":
            return A.Var(self.next()[1:])
        if kind == "iri":
            return IRI(self.next()[1:-1])
        if kind == "curie":
            prefix, _, local = self.next().partition(":")
            if prefix == "_":
                raise UnsupportedSparqlError("blank nodes are not supported in queries")
            if prefix not in self.prefixes:
                raise SparqlSyntaxError(f"unknown prefix {prefix!r}")
            return IRI(self.prefixes[prefix] + local)
        if kind == "string":
            raw = self.next()
            text = unescape(raw[3:-3] if raw[:3] in ('"""', "'''") and len(raw) >= 6 else raw[1:-1])
            if self.kind == "lang":
                return Literal(text, lang=self.next()[1:])
            if self.take("^^"):
                return Literal(text, self.term())
            return Literal(text)
        if kind == "number":
            return number_literal(self.next())
        if self.keyword("TRUE", "FALSE"):
            return Literal(self.next().lower(), XSD.boolean)
        if kind == "word" and self.text.upper() in UNSUPPORTED:
            raise UnsupportedSparqlError(f"{self.text.upper()} is not supported")
        if kind == "symbol" and self.text in ("[", "("):
            raise UnsupportedSparqlError("blank nodes and collections are not supported in queries")
        self.fail("a term")

    # expressions: || below && below comparison below + - below * / below ! and the rest
    def constraint(self) -> A.FilterExpression:
        if self.kind == "word":
            return self.primary()
        self.need("(")
        found = self.either()
        self.need(")")
        return found

    def either(self):
        args = [self.both()]
        while self.take("||"):
            args.append(self.both())
        return args[0] if len(args) == 1 else A.LogicalExpr("or", tuple(args))

    def both(self):
        args = [self.comparison()]
        while self.take("&&"):
            args.append(self.comparison())
        return args[0] if len(args) == 1 else A.LogicalExpr("and", tuple(args))

    def comparison(self):
        left = self.sum()
        if self.kind == "symbol" and self.text in ("=", "!=", "<", "<=", ">", ">="):
            op = self.next()
            return A.ComparisonExpr(op, left, self.sum())
        return left

    def sum(self):
        left = self.product()
        while True:
            if self.kind == "symbol" and self.text in ("+", "-"):
                op = "add" if self.next() == "+" else "sub"
                left = A.ArithmeticExpr(op, left, self.product())
            elif self.kind == "number" and self.text[0] in "+-":  # a sign that the lexer took for the number's
                raw = self.next()
                left = A.ArithmeticExpr("add" if raw[0] == "+" else "sub", left, A.LiteralExpr(number_literal(raw[1:])))
            else:
                return left

    def product(self):
        left = self.unary()
        while self.kind == "symbol" and self.text in ("*", "/"):
            op = "mul" if self.next() == "*" else "div"
            left = A.ArithmeticExpr(op, left, self.unary())
        return left

    def unary(self):
        if self.take("!"):
            return A.LogicalExpr("not", (self.unary(),))
        return self.primary()

    def primary(self):
        if self.take("("):
            found = self.either()
            self.need(")")
            return found
        if self.kind == "word" and not self.keyword("TRUE", "FALSE"):
            if self.text.upper() in UNSUPPORTED:
                raise UnsupportedSparqlError(f"{self.text.upper()} is not supported")
            name = self.next()
            self.need("(")
            args: list = []
            while not self.take(")"):
                args.append(self.either())
                self.take(",")
            return A.FunctionExpr(name, tuple(args))
        found = self.term()
        return A.VarExpr(found.name) if isinstance(found, A.Var) else A.LiteralExpr(found)


def parse_sparql(text: str) -> A.SPARQLQuery:
    """The query that ``text`` spells."""
    return Parser(text).query()
