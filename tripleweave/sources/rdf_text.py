"""N-Triples, N-Quads, Turtle and TriG, read and written.

N-Triples and N-Quads are split by Spark and parsed by one regular expression a line. A Turtle document only
makes sense as a whole, so files are parsed by document, many documents side by side; files in which every
statement ends its line, as those that ``save`` writes, may be split by statement instead. Of quads the triples of
the default graph are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.functions.terms import IRI, TRIPLE_SCHEMA, BlankNode, Literal, RDFNode, Triple, serialized, triple_rows
from tripleweave.functions.vocab import RDF, XSD
from tripleweave.operators.store import TripleStore
from tripleweave.plans.parser import ESCAPED

# Names and file endings of the formats.
FORMATS = {"turtle": "turtle", "ttl": "turtle", "ntriples": "ntriples", "nt": "ntriples", "nquads": "nquads", "nq": "nquads", "trig": "trig"}


class RDFParseError(ValueError):
    """The text is no RDF document of its format."""


def format_of(name: str, path: str = "") -> str:
    """Name of a format; ``auto`` goes by the file's ending and takes Turtle if that is unknown."""
    if name == "auto":
        return FORMATS.get(path.rpartition(".")[2].lower(), "turtle")
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown format {name!r}")
    return FORMATS[name.lower()]


# N-Triples
TRIPLE = (
    r"^\s*(?:<([^<>\s]*)>|_:(\S+))\s+<([^<>\s]*)>\s+"
    r'(?:<([^<>\s]*)>|_:([^\s.]+(?:\.+[^\s.]+)*)|"((?:[^"\\\n\r]|\\.)*)"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)'
)
END = r"\s*\.\s*(?:#.*)?$"
LINE, QUAD_LINE = TRIPLE + END, TRIPLE + r"\s*(<[^<>\s]*>|_:[^\s.]+(?:\.+[^\s.]+)*)?" + END


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of lines of N-Triples text. A line that is neither a triple, a comment nor blank is an error."""
    text = F.col(column)

    def part(k: int):
        return F.regexp_extract(text, LINE, k)

    def node(kind, value, datatype=None, lang=None):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), (none if datatype is None else datatype).alias("datatype"), (none if lang is None else lang).alias("lang"))

    lines = lines.where(~text.rlike(r"^\s*(#.*)?$"))
    checked = F.when(text.rlike(LINE), text).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), text)))
    lines = lines.select(checked.alias(column))
    lexical = part(6)
    for name, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'")):
        # an escape counts only after an even number of backslashes; these are set aside first
        lexical = F.replace(F.replace(F.replace(lexical, F.lit("\\\\"), F.lit("")), F.lit(name), F.lit(char)), F.lit(""), F.lit("\\\\"))
    coded = lexical.rlike(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[bf]")
    lexical = F.when(coded, decoded(lexical)).otherwise(F.replace(lexical, F.lit("\\\\"), F.lit("\\")))
    blank = F.lit("")
    literal = node("literal", lexical, F.nullif(part(7), blank), F.lower(F.nullif(part(8), blank)))
    subject = F.when(part(2) != "", node("bnode", part(2))).otherwise(node("iri", part(1)))
    target = F.when(part(5) != "", node("bnode", part(5))).when(text.rlike(r"^\s*\S+\s+\S+\s+<"), node("iri", part(4))).otherwise(literal)
    return lines.select(subject.alias("s"), part(3).alias("p"), target.alias("o"))


def parse_nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of the default graph of lines of N-Quads text."""
    text = F.col(column)
    checked = F.when(text.rlike(QUAD_LINE) | text.rlike(r"^\s*(#.*)?$"), text).otherwise(F.raise_error(F.concat(F.lit("not a quad: "), text)))
    # a line whose quad has no graph is a line of N-Triples
    return parse_ntriples(lines.select(checked.alias(column)).where(F.regexp_extract(column, QUAD_LINE, 9) == ""), column)


@F.pandas_udf(T.StringType())
def decoded(values: pd.Series) -> pd.Series:
    """Texts with numeric escapes; rare, so they alone leave the engine."""

    def one(m: re.Match) -> str:
        code = m[1]
        return chr(int(code[1:], 16)) if code[0] in "uU" else ESCAPED.get(code, m[0])

    return values.map(lambda v: None if v is None else re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, v))


# Turtle
TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><(?:[^\s<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%]|\\[~.\-!$&'()*+,;=/?\#@%_])(?:(?:[\w:%.-]|\\[~.\-!$&'()*+,;=/?\#@%_])*(?:[\w:%-]|\\[~.\-!$&'()*+,;=/?\#@%_]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<symbol>\^\^|[.;,\[\](){}])""",
    re.X | re.S,
)


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        if code[0] in "uU":
            return chr(int(code[1:], 16))
        if code not in ESCAPED:
            raise RDFParseError(f"unknown escape \\{code}")
        return ESCAPED[code]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def _resolved(base: str, iri: str) -> str:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) or not base:
        return iri
    from urllib.parse import urljoin

    return urljoin(base, iri)


class TurtleParser:
    """One document. ``scope`` keeps its blank nodes apart from those of other documents."""

    def __init__(self, text: str, base: str = "", scope: str = "", prefixes: dict[str, str] | None = None):
        self.base, self.scope, self.prefixes, self.out, self.made = base, scope, dict(prefixes or {}), [], 0
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise RDFParseError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def take(self, symbol: str) -> bool:
        if self.kind == "symbol" and self.text == symbol:
            self.at += 1
            return True
        return False

    def need(self, symbol: str) -> None:
        if not self.take(symbol):
            raise RDFParseError(f"expected {symbol!r}, found {self.text or 'the end'!r}")

    def fresh(self) -> BlankNode:
        self.made += 1
        return BlankNode(f"{self.scope}genid{self.made}")

    def iri(self) -> IRI:
        if self.kind == "iri":
            return IRI(_resolved(self.base, _unescaped(self.next()[1:-1])))
        if self.kind != "name":
            raise RDFParseError(f"expected an IRI, found {self.text!r}")
        prefix, _, local = self.next().partition(":")
        if prefix not in self.prefixes:
            raise RDFParseError(f"unknown prefix {prefix!r}")
        return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    def document(self) -> list[Triple]:
        while self.kind != "end":
            if not self.directive():
                self.statement()
                self.need(".")
        return self.out

    def directive(self) -> bool:
        word = self.text.lower().lstrip("@")
        if self.kind != "directive" and not (self.kind == "word" and word in ("prefix", "base")):
            return False
        dotted = self.next().startswith("@")
        if word == "prefix":
            if self.kind != "name" or not self.text.endswith(":"):
                raise RDFParseError("a prefix is expected")
            name = self.next()[:-1]
        if self.kind != "iri":
            raise RDFParseError("an IRI is expected")
        iri = _resolved(self.base, self.next()[1:-1])
        if word == "prefix":
            self.prefixes[name] = iri
        else:
            self.base = iri
        if dotted:
            self.need(".")
        return True

    def statement(self) -> None:
        own = self.kind == "symbol" and self.text == "["
        subject = self.node()
        if isinstance(subject, Literal):
            raise RDFParseError("a subject is no literal")
        if not (own and self.kind == "symbol" and self.text in (".", "}")):
            self.properties(subject)

    def properties(self, subject: RDFNode) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self.next()
                predicate = RDF.type
            else:
                predicate = self.iri()
            while True:
                self.out.append(Triple(subject, predicate, self.node()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.kind == "symbol" and self.text in (".", "]", "}"):
                return

    def node(self) -> RDFNode:
        kind, text = self.kind, self.text
        if kind in ("iri", "name"):
            return self.iri()
        if kind == "bnode":
            return BlankNode(self.scope + self.next()[2:])
        if kind == "string":
            raw = self.next()
            value = _unescaped(raw[3:-3] if raw[:3] in ('"""', "'''") and len(raw) >= 6 else raw[1:-1])
            if self.kind == "lang":
                return Literal(value, lang=self.next()[1:])
            return Literal(value, self.iri()) if self.take("^^") else Literal(value)
        if kind == "number":
            self.next()
            return Literal(text, XSD.double if re.search("[eE]", text) else XSD.decimal if "." in text else XSD.integer)
        if kind == "word" and text in ("true", "false"):
            return Literal(self.next(), XSD.boolean)
        if self.take("["):
            own = self.fresh()
            if not self.take("]"):
                self.properties(own)
                self.need("]")
            return own
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node())
            head: RDFNode = RDF.nil
            for item in reversed(items):
                cell = self.fresh()
                self.out += [Triple(cell, RDF.first, item), Triple(cell, RDF.rest, head)]
                head = cell
            return head
        raise RDFParseError(f"unexpected {text or 'end'!r}")


class TrigParser(TurtleParser):
    """A TriG document: statements on their own or in braces are in the default graph, named graphs are passed over."""

    def document(self) -> list[Triple]:
        while self.kind != "end":
            if self.directive():
                continue
            named = self.kind == "word" and self.text.lower() == "graph"
            if named:
                self.next()
            start = len(self.out)
            if not named and self.take("{"):
                self.block()
            elif named or self.tokens[self.at + 1] == ("symbol", "{"):
                self.node()
                self.need("{")
                self.block()
                del self.out[start:]
            else:
                self.statement()
                self.need(".")
        return self.out

    def block(self) -> None:
        while not self.take("}"):
            self.statement()
            if not self.take("."):
                self.need("}")
                return


PARSERS = {"turtle": TurtleParser, "trig": TrigParser}
LINES = {"ntriples": (parse_ntriples, LINE), "nquads": (parse_nquads, QUAD_LINE)}


def parse_string(store: TripleStore, content: str, format: str = "turtle", base: str = "") -> TripleStore:
    """Add the triples of a document; its prefixes are registered."""
    kind = format_of(format)
    if kind in LINES:
        read, line = LINES[kind]
        rows = store.spark.createDataFrame([(x,) for x in re.split(r"\r\n|\n|\r", content)], "value string")
        wrong = rows.where(~F.col("value").rlike(line) & ~F.col("value").rlike(r"^\s*(#.*)?$")).first()
        if wrong is not None:
            raise RDFParseError(f"not a line of {kind}: {wrong['value']}")
        return store.add(read(rows))
    parser = PARSERS[kind](content, base)
    triples = parser.document()
    for prefix, iri in parser.prefixes.items():
        store.register_namespace(prefix, iri)
    return store.add(triples) if triples else store


def _frame(triples: list[Triple]) -> pd.DataFrame:
    named = [(dict(zip(NODE, s, strict=True)), p, dict(zip(NODE, o, strict=True))) for s, p, o in triple_rows(triples)]
    return pd.DataFrame(named, columns=["s", "p", "o"])


def _scope(file: str) -> Column:
    return F.concat(F.lit("d"), F.hex(F.xxhash64(file)))


def read_turtle(spark: SparkSession, path: str, base: str = "", kind: str = "turtle") -> DataFrame:
    """Triples of all Turtle (or TriG) files below a path, one task working through whole files."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, scope in zip(frame["value"], frame["scope"], strict=True):
                yield _frame(PARSERS[kind](text, base, scope).document())

    return files.select("value", _scope("file").alias("scope")).mapInPandas(run, TRIPLE_SCHEMA)


def turtle_prefixes(spark: SparkSession, path: str, base: str = "", kind: str = "turtle") -> DataFrame:
    """The distinct prefixes that the parser finds in all files below a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                parser = PARSERS[kind](text, base)
                parser.document()
                yield pd.DataFrame(list(parser.prefixes.items()), columns=["prefix", "iri"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "prefix string, iri string").distinct()


def read_statements(spark: SparkSession, path: str, base: str = "") -> tuple[DataFrame, dict[str, str]]:
    """Triples and prefixes of Turtle files of any size in which each statement, and nothing else, ends a line with `` .``

    Files are split by statement. A prefix holds for all files; base directives are not taken.
    """
    rows = spark.read.option("lineSep", " .\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    is_prefix = F.col("value").rlike(r"(?i)^\s*@prefix\s")
    heads = rows.where(is_prefix).select(F.regexp_extract("value", r"(?i)^\s*@prefix\s+([\w.-]*):", 1).alias("prefix"), F.regexp_extract("value", r"<([^>]*)>", 1).alias("iri"))
    prefixes = {r["prefix"]: r["iri"] for r in heads.distinct().orderBy("prefix", "iri").collect()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, scope, at in zip(frame["value"], frame["scope"], frame["at"], strict=True):
                parser = TurtleParser(text + " .", base, scope, prefixes)
                # unnamed nodes belong to their statement, labelled ones to the file
                parser.fresh = lambda own=parser, at=at: _numbered(own, at)
                out += parser.document()
            yield _frame(out)

    body = rows.where(~is_prefix & (F.trim("value") != "") & (F.trim(F.replace("value", F.lit("\n"))) != ""))
    body = body.select("value", _scope("file").alias("scope"), F.monotonically_increasing_id().alias("at"))
    return body.mapInPandas(run, TRIPLE_SCHEMA), prefixes


def _numbered(parser: TurtleParser, at: int) -> BlankNode:
    parser.made += 1
    return BlankNode(f"{parser.scope}s{at}genid{parser.made}")


NODE = ("kind", "value", "datatype", "lang")


def load(store: TripleStore, path: str, format: str = "auto", base: str = "", statements: bool = False) -> TripleStore:
    """Add the triples of a file or of a folder of files. ``statements``: Turtle files may be split, see ``read_statements``."""
    kind = format_of(format, path)
    try:
        if kind in LINES:
            return store.add(LINES[kind][0](store.spark.read.text(path)))
        if statements and kind == "turtle":
            found, prefixes = read_statements(store.spark, path, base)
        else:
            heads = turtle_prefixes(store.spark, path, base, kind).orderBy("prefix", "iri").collect()
            found, prefixes = read_turtle(store.spark, path, base, kind), {r["prefix"]: r["iri"] for r in heads}
    except PySparkException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    for prefix, iri in prefixes.items():
        store.register_namespace(prefix, iri)
    return store.add(found)


# writers
def ntriples_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", serialized(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), serialized(F.col("o")), F.lit(".")).alias("value"))


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """One block a subject, its properties in order."""
    pair = F.concat(F.lit("<"), F.col("p"), F.lit("> "), serialized(F.col("o")))
    grouped = triples.groupBy(serialized(F.col("s")).alias("s")).agg(F.array_sort(F.collect_list(pair)).alias("ps"))
    return grouped.select("s", F.concat(F.col("s"), F.lit(" "), F.array_join("ps", " ;\n    "), F.lit(" .")).alias("value"))


def to_ntriples(store: TripleStore) -> str:
    return "".join(r["value"] + "\n" for r in ntriples_lines(store.df).orderBy("value").toLocalIterator())


def to_turtle(store: TripleStore) -> str:
    head = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in sorted(store.namespaces.items()))
    return head + ("\n" if head else "") + "".join(r["value"] + "\n" for r in turtle_blocks(store.df).orderBy("s").toLocalIterator())


def save(store: TripleStore, path: str, format: str = "turtle") -> None:
    """Write a folder of text files; Turtle and TriG names give Turtle, all others N-Triples."""
    if format_of(format) in ("turtle", "trig"):
        prefixes = [(f"@prefix {p}: <{ns}> .",) for p, ns in sorted(store.namespaces.items())]
        # IRIs are written in full, so the files need no prefixes to be read; the first one keeps them
        blocks = turtle_blocks(store.df).orderBy("s").select("value")
        if prefixes:
            blocks = store.spark.createDataFrame(prefixes, "value string").coalesce(1).union(blocks)
        blocks.write.mode("overwrite").text(path)
    else:
        ntriples_lines(store.df).orderBy("value").write.mode("overwrite").text(path)


__all__ = ["RDFParseError", "TrigParser", "TurtleParser", "load", "parse_nquads", "parse_ntriples", "parse_string", "save", "to_ntriples", "to_turtle"]
