"""Personal data: fixed patterns, and further spans by weak supervision, in DataFrame operations only.

Base spans are the leftmost, non-overlapping matches of four patterns that pass their checks. Candidates
for further spans are looser shapes (phones without a country code, disguised addresses, identity numbers,
names, street addresses) and base matches that fail their checks. Regex, gazetteer and context labelers vote
on every candidate and every base span: 1 for, -1 against, 0 silent. Votes of all documents are counted by
pattern; expectation-maximisation over these counts estimates each labeler's reliabilities and the chance that
a span is personal data. With these chances as labels a logistic span classifier is fitted, which besides the
votes sees what no labeler looks at: the span's length, the share of its digits that are distinct, and the kinds
of characters next to it. Candidates that it accepts are added unless they overlap a base span.

Patterns run once: the candidates of every row are written, and counting, the result and the overlaps read
them. A text with many matches costs time in proportion to them: their places are summed in runs of ``RUN``, and
overlaps are found by a window over the spans of a row.

Defined results: a null or empty text has no spans; rows that repeat are searched each; positions are code
points, the end exclusive; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.shared import written

# The patterns. Look-behinds and possessive repeats only spare the engine futile starts;
# a match begins where one does without them, or right behind the match before (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur in a text before a pattern is tried on it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = list(BASE)

#: Looser shapes, each with the kind that it would add.
LOOSE = {
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)+",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Gazetteers and context words.
ENDINGS = "com net org edu gov io de fr es uk eu it nl at ch be pt ie se no dk fi pl cz us ca mx br ar au nz jp cn in info biz dev app example test".split()
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 966 971 972".split()
GIVEN = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew nancy anthony betty mark sandra paul ashley steven emily andrew michelle peter laura george anna marie jean pierre jacques sophie camille julien nicolas isabelle louis claire hans klaus jürgen petra sabine monika stefan wolfgang heike ursula karl heinz jose maria carmen juan antonio manuel lucia pablo javier carlos ana pilar luis miguel elena rosa ahmed mohammed fatima ali wei li ming yuki hiro raj priya".split()
PLACES = "london paris berlin madrid rome vienna zurich geneva brussels amsterdam dublin lisbon munich hamburg cologne frankfurt stuttgart lyon marseille toulouse nice bordeaux barcelona valencia seville boston chicago dallas houston denver seattle portland atlanta miami york angeles francisco washington toronto montreal vancouver sydney melbourne tokyo".split()
FOR = {"email": "mail|contact|write|reach", "phone": "phone|tel|call|fax|mobile|dial|contact", "card": "card|visa|credit|pay|account", "ip": "ip|host|server|address|client", "id": "ssn|social|id|number|tax", "name": "name|by|from|dear|contact|sign|attn", "address": "address|live|lives|at|home|ship|office|resid"}
AGAINST = r"version|isbn|page|figure|table|total|price|release|chapter|section"
#: Titles and street words, as they are written.
TITLES = r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)"
STREETS = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Way|Court|Square)"
LOOSE["name"] = rf"\b{TITLES}\.?\x20\p{{Lu}}[\p{{L}}'-]+(?:\x20\p{{Lu}}[\p{{L}}'-]+)?"
LOOSE["address"] = rf"(?<![0-9.,-])[0-9]{{1,5}}\x20(?:\p{{Lu}}[\p{{L}}'-]+\x20){{1,3}}{STREETS}\b(?:,\x20\p{{Lu}}\p{{L}}+)?"
LOOSE_NEEDS = {"phone": r"[0-9]{3}[\x20.-][0-9]{4}", "email": r"(?:\(at\)|\[at\])", "id": r"-[0-9]{2}-", "name": rf"{TITLES}\.?\x20\p{{Lu}}", "address": rf"\x20{STREETS}\b"}
BEFORE_CHARS = 24
LABELERS = ["shape", "gazetteer", "context", "border"]
#: What the classifier sees besides the votes, each with so many values.
TRAITS = {"length": 5, "distinct": 3, "left": 4, "right": 4}
#: Matches whose places are summed at a time.
RUN = 64


def _matches(text: Column, pattern: str, need: str) -> Column:
    """Array of ``(start, end, value, before, after)`` of all matches of a pattern in ``text``.

    ``before``: up to ``BEFORE_CHARS`` characters, no further back than the match before; ``after``: one character.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def steps(found: Column) -> Column:
        # what lies between matches and the matches themselves give every match its place
        n, gaps = F.size(found), F.split(text, pattern, -1)
        around = F.zip_with(gaps, F.concat(F.array(F.lit("")), found), lambda g, p: F.struct(F.length(g).alias("gap"), F.right(F.concat(p, g), F.lit(BEFORE_CHARS)).alias("before"), F.left(g, F.lit(1)).alias("first")))

        def beside(around: Column) -> Column:
            both = F.zip_with(F.slice(around, 1, n), F.slice(around, 2, n), lambda a, b: F.struct(a["gap"].alias("gap"), a["before"].alias("before"), b["first"].alias("after")))
            return F.zip_with(both, found, lambda a, m: F.struct(a["gap"].alias("gap"), F.length(m).alias("size"), m.alias("value"), a["before"].alias("before"), a["after"].alias("after")))

        return within(around, beside)

    def summed(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), lambda at, m: at + m["gap"] + m["size"])

    def placed(run: Column, first: Column) -> Column:
        """The matches of a run that begins at ``first``."""
        return F.aggregate(
            run,
            F.struct(first.alias("at"), empty.alias("out")),
            lambda s, m: F.struct((s["at"] + m["gap"] + m["size"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["size"]).alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))).alias("out")),
            lambda s: s["out"],
        )

    def within(source: Column, body) -> Column:
        """``body`` of a column that is computed once, although it is used more than once."""
        return F.get(F.transform(F.array(source), body), F.lit(0))

    def folded(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / RUN).cast("int")), lambda i: F.slice(steps, i * RUN + 1, F.lit(RUN)))
        return within(runs, spread)

    def spread(runs: Column) -> Column:
        begin = F.aggregate(runs, F.array(F.lit(0)), lambda out, run: F.concat(out, F.array(F.element_at(out, -1) + summed(run))))
        return F.flatten(F.zip_with(runs, F.slice(begin, 1, F.size(runs)), placed))

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed_all = within(every, lambda found: F.when(F.size(found) > 0, within(steps(found), folded)).otherwise(empty))
    return F.when(text.rlike(need), placed_all).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def share(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(places, share), F.lit(0), lambda a, b: a + b) % 10 == 0


OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(9, 15)


def _votes(kind: str, value: Column, before: Column, after: Column, sound: Column) -> list[Column]:
    """One vote of each labeler, 1, 0 or -1."""
    digits = _digits(value)
    if kind == "email":
        known = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(ENDINGS)
    elif kind == "phone":
        known = F.substring(digits, 1, 1).isin(DIALLING) | F.substring(digits, 1, 2).isin(DIALLING) | F.substring(digits, 1, 3).isin(DIALLING)
    elif kind == "card":
        known = F.substring(digits, 1, 1).isin("3", "4", "5", "6")
    elif kind == "ip":
        known = ~value.rlike(r"^(?:0|127|255)\.")
    elif kind == "id":
        known = ~F.substring(digits, 1, 3).isin("000", "666")
    else:
        known = F.arrays_overlap(F.split(F.lower(value), r"[^\p{L}]+", -1), F.array(*map(F.lit, GIVEN if kind == "name" else PLACES)))
    context = F.when(F.lower(before).rlike(rf"(?:{FOR[kind]})[^\n]*$"), 1).when(F.lower(before).rlike(rf"(?:{AGAINST})[^a-z\n]*$"), -1).otherwise(0)
    border = F.when(before.rlike(r"[A-Za-z0-9=/_-]$") | after.rlike(r"^[A-Za-z0-9=/_-]"), -1).otherwise(0)
    return [F.when(sound, 1).otherwise(-1), F.when(known, 1).otherwise(-1), context, border]


def _traits(value: Column, before: Column, after: Column) -> list[Column]:
    """What the classifier sees besides the votes, as small numbers."""
    digits = _digits(value)
    length = sum(((F.length(value) >= n).cast("int") for n in (10, 14, 18, 26)), F.lit(0))
    kinds = F.size(F.array_distinct(F.split(digits, "")))
    distinct = F.when(F.length(digits) == 0, 0).when(kinds > 3, 2).otherwise(1)

    def side(c: Column) -> Column:
        return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"[\p{L}\p{N}]"), 1).when(c.rlike(r"[.,;:!?()]"), 2).otherwise(3)

    return [length, distinct, side(F.substring(before, -1, 1)), side(after)]


def _judged(kind: str, strict: bool):
    """A match with its kind, place, votes and traits."""

    def span(m: Column) -> Column:
        start, end, value = m["start"], m["end"], m["value"]
        before, after = m["before"], m["after"]
        sound = _valid(kind, value) if strict else F.lit(True)
        rank = KINDS.index(kind) if kind in KINDS else len(KINDS) + list(LOOSE).index(kind)
        named = [F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"), (sound if strict else F.lit(False)).alias("base")]
        votes = [v.cast("int").alias(f"v{j}") for j, v in enumerate(_votes(kind, value, before, after, sound))]
        traits = [t.cast("int").alias(f"t{j}") for j, t in enumerate(_traits(value, before, after))]
        return F.struct(*named, *votes, *traits)

    return span


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as ``(doc_id, spans)``: array of ``(kind, rank, start, end, base, v0.., t0..)``.

    ``base``: the span stands whatever the classifier says. ``rank`` is the kind's place in the list.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = [(k, BASE[k], NEEDS[k], True) for k in KINDS] + [(k, p, LOOSE_NEEDS[k], False) for k, p in LOOSE.items()]
    docs = docs.select("doc_id", "text", *(_matches(F.col("text"), p, need).alias(f"m{i}") for i, (_, p, need, _) in enumerate(found)))
    parts = []
    for i, (kind, _, _, strict) in enumerate(found):
        parts.append(F.transform(F.col(f"m{i}"), _judged(kind, strict)))
    # digit runs that fail as cards are candidates only where they are long enough for one
    spans = F.filter(F.concat(*parts), lambda s: s["base"] | (s["kind"] != "card") | (s["end"] - s["start"] >= 12))
    return docs.select("doc_id", spans.alias("spans"))


@dataclass
class SpanModel:
    """Reliabilities of the labelers and weights of the final classifier: of votes, kinds and values of traits."""

    reliability: dict[str, dict[int, tuple[float, float]]]
    prior: float
    bias: float
    weights: list[float]
    kinds: dict[str, float]
    traits: list[list[float]]


def fit(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 50) -> SpanModel:
    """EM over counted vote patterns, then the span classifier. ``patterns``: kind, votes, traits (may be empty), count."""
    m = len(LABELERS)
    names = {j: dict.fromkeys((-1, 0, 1), (0.5, 0.5)) for j in range(m)}
    kinds, sizes = sorted({k for k, *_ in patterns}), list(TRAITS.values())
    if not patterns:
        return SpanModel({LABELERS[j]: names[j] for j in range(m)}, 0.5, 0.0, [0.0] * m, {}, [[0.0] * n for n in sizes])
    votes = np.array([v for _, v, *_ in patterns])
    count = np.array([float(c) for *_, c in patterns])
    # where a labeler votes for, personal data is at first thought likelier
    rel = np.where(np.arange(-1, 2)[None, :, None] == 0, 0.2, np.where((np.arange(-1, 2)[None, :, None] > 0) == np.array([True, False]), 0.6, 0.2)).repeat(m, 0)
    prior = 0.5
    for _ in range(rounds):
        like = np.array([prior, 1 - prior])[None, :] * np.prod([rel[j, votes[:, j] + 1] for j in range(m)], axis=0)
        post = like[:, 0] / np.maximum(1e-300, like.sum(1))
        yes, no = float(post @ count), float((1 - post) @ count)
        prior = min(0.99, max(0.01, yes / (yes + no)))
        for j in range(m):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                rel[j, v + 1] = ((post @ (count * at) + 1) / (yes + 3), ((1 - post) @ (count * at) + 1) / (no + 3))
    x = np.hstack([votes, np.array([[k == n for n in kinds] for k, *_ in patterns])]).astype(float)
    seen = [[i, sum(sizes[:j]) + t] for i, (_, _, traits, _) in enumerate(patterns) for j, t in enumerate(traits)]
    held = np.zeros((len(patterns), sum(sizes)))
    if seen:
        held[tuple(np.array(seen).T)] = 1
    x, share = np.hstack([x, held]), count / count.sum()
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(400):
        d = share * (1 / (1 + np.exp(-np.clip(x @ w + bias, -40, 40))) - post)
        w, bias = w - 1.5 * (d @ x + 1e-4 * w), bias - 1.5 * float(d.sum())
    for j in range(m):
        names[j] = {v: (float(rel[j, v + 1, 0]), float(rel[j, v + 1, 1])) for v in (-1, 0, 1)}
    cuts = np.cumsum([m + len(kinds), *sizes])
    return SpanModel({LABELERS[j]: names[j] for j in range(m)}, prior, bias, w[:m].tolist(), dict(zip(kinds, w[m:].tolist(), strict=False)), [w[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)])


def trained(found: DataFrame) -> SpanModel:
    """Count the patterns of votes and traits of all spans and fit the model on the counts.

    There are at most 3^labelers times the values of all traits for a kind, whatever the table holds.
    """
    votes, traits = [f"v{j}" for j in range(len(LABELERS))], [f"t{j}" for j in range(len(TRAITS))]
    counts = found.select(F.explode("spans").alias("s")).select("s.*").groupBy("kind", *votes, *traits).count().orderBy("kind", *votes, *traits).collect()
    return fit([(r["kind"], tuple(r[v] for v in votes), tuple(r[t] for t in traits), r["count"]) for r in counts])


def score(model: SpanModel, s: Column) -> Column:
    """The classifier's score of a span; 0 and more is personal data."""
    z = F.lit(model.bias)
    for j, w in enumerate(model.weights):
        z = z + F.lit(w) * s[f"v{j}"]
    for j, ws in enumerate(model.traits):
        z = z + F.get(F.array(*map(F.lit, ws)), s[f"t{j}"])
    kind = F.lit(0.0)
    for k, w in model.kinds.items():
        kind = F.when(s["kind"] == k, w).otherwise(kind)
    return z + kind


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: arrays of ``(start, rank, end, kind)`` in order, base spans and all spans."""
    # the number of a row is fixed by the table that it is written to
    found = written(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "spans")
    model = trained(found)

    def short(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    # only rows with candidates that the classifier accepts are compared with their base spans
    accepted = found.where(F.exists("spans", lambda s: ~s["base"] & (score(model, s) >= 0)))
    spans = accepted.select("row", F.explode("spans").alias("s")).where(F.col("s.base") | (score(model, F.col("s")) >= 0))
    spans = spans.select("row", short(F.col("s")).alias("s"), F.col("s.base").alias("base")).distinct()
    ordered = Window.partitionBy("row").orderBy("s.start", F.desc("base"))
    until = F.max(F.when(F.col("base"), F.col("s.end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("row").orderBy(F.desc("s.start"), "base")
    following = F.min(F.when(F.col("base"), F.col("s.start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("row", "s", "base", until.alias("until"), following.alias("following"))
    apart = (F.coalesce("until", F.lit(-1)) <= F.col("s.start")) & (F.coalesce("following", F.lit((1 << 31) - 1)) >= F.col("s.end"))
    more = spans.where(~F.col("base") & apart).groupBy("row").agg(F.collect_list("s").alias("more"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), short))
    out = found.select("doc_id", "row", base.alias("base")).join(more, "row", "left")
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(table: DataFrame) -> DataFrame:
    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in KINDS]
    return table.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
