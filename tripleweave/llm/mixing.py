"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A softmax classifier is fitted on labelled rows over the hashed words of a text and some statistics of it, and
gives every document posteriors over the domains. Document rates r >= 0 are then fitted so that the expected
tokens of each domain, the sum of r * tokens * posterior, match the targets: projected-gradient least squares
from r = 1. The gradient of a document's rate is the product of its posteriors with the domains' surplus, so
one projected step is r = max(0, 1 - posteriors * step), with one number for each domain. The step is the
implicit one, ``RIDGE`` * step = the surplus that it leaves itself, since explicit steps need thousands of passes
where targets are nearly out of reach. Newton rounds find it: each sums the domains' tokens and their overlap (a
small matrix) over all documents for a few lengths at once, and keeps the best by a convex function. So no table of
rates is carried from round to round and no shuffle moves a text. Targets that no rates reach are met as nearly
as least squares do, but for ``RIDGE``; ``Fit.residual`` tells how nearly. Texts are parsed once: tokens, posteriors
and the columns that are asked for are written, and the rounds and the result read that table.

Training takes at most ``rows`` labelled rows, evenly over the domains; weights restore their shares. The
statistics, sums and rates cover every document. Tokens are words between white space.

Defined results: a null text counts as empty, without tokens; null labels are not trained on; without
labelled rows posteriors are even; a target domain without labelled rows is left out and the others scaled;
rows that repeat are rated each; an empty table gives an empty one; other columns are passed through, but
columns by the names of the four added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import written

TRAIN_ROWS, ROUNDS, CLOSE, RIDGE = 4000, 40, 1e-9, 1e-7
#: Hash buckets of words.
BUCKETS = 1024
STATISTICS = ("size", "symbols", "bars", "bangs", "stops", "commas", "breaks", "long", "distinct", "caps")
ADDED = ("tokens", "posteriors", "rate", "copies")
TEXT, WORDS, TOKENS, MEMBER, DRAW = "__mix_text", "__mix_words", "__mix_tokens", "__mix_member", "__mix_draw"


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _sum_over_words(weights: list[float]) -> Column:
    """The sum of the weights of all words' buckets. The weights are one constant of the plan."""
    of_bucket = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(WORDS, F.lit(0.0), lambda total, w: total + F.get(of_bucket, _bucket(w)))


def _parsed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the text, its words and their number."""
    docs = docs.withColumn(TEXT, F.trim(F.coalesce(F.col(text_col), F.lit(""))))
    docs = docs.withColumn(WORDS, F.split(TEXT, r"\s+", -1))
    # only the first and the last piece can be empty
    blank = [(F.element_at(WORDS, i) == "").cast("int") for i in (1, -1)]
    return docs.withColumn(TOKENS, F.greatest(F.lit(0), F.size(WORDS) - blank[0] - blank[1]).cast("double"))


def _statistics(docs: DataFrame) -> DataFrame:
    """Parsed ``docs`` with the statistics as columns."""
    text, n, words = F.col(TEXT), F.greatest(F.length(TEXT), F.lit(1)).cast("double"), F.greatest(F.col(TOKENS), F.lit(1.0))
    found = (
        F.log1p(n),
        F.regexp_count(text, F.lit("[#$%&*]")) / words,
        _count(text, "|") / words,
        _count(text, "!") / words,
        _count(text, ".") / words,
        _count(text, ",") / words,
        _count(text, "\n") / words,
        n / words,
        F.size(F.array_distinct(WORDS)) / words,
        F.regexp_count(text, F.lit(r"\p{Lu}{2,}")) / words,
    )
    return docs.withColumns({f"__mix_{name}": c for name, c in zip(STATISTICS, found, strict=True)})


@dataclass
class Domains:
    """Softmax weights, one row a domain: bias, a weight for each statistic, a weight for each bucket's share of the words."""

    names: list[str]
    bias: list[float] = field(default_factory=list)
    statistics: list[list[float]] = field(default_factory=list)
    buckets: list[list[float]] = field(default_factory=list)

    def member(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``MEMBER``, the posteriors in the order of ``names``; texts are gone over once."""
        if not self.bias:
            return docs.withColumn(MEMBER, F.array(*[F.lit(1.0 / len(self.names))] * len(self.names)))
        docs = _statistics(docs)
        scores = []
        for k in range(len(self.names) - 1):  # against the last domain
            heard = _sum_over_words([a - b for a, b in zip(self.buckets[k], self.buckets[-1], strict=True)])
            score = F.lit(self.bias[k] - self.bias[-1]) + heard / F.greatest(F.col(TOKENS), F.lit(1.0))
            for name, a, b in zip(STATISTICS, self.statistics[k], self.statistics[-1], strict=True):
                score = score + F.lit(a - b) * F.col(f"__mix_{name}")
            scores.append(score)
        # each step is a projection of its own: what is used twice is computed once
        names = [f"__mix_score_{k}" for k in range(len(scores))]
        docs = docs.withColumns(dict(zip(names, scores, strict=True)))
        docs = docs.withColumn("__mix_top", F.greatest(*names, F.lit(0.0)))
        lifted = [f"__mix_lifted_{k}" for k in range(len(scores) + 1)]
        docs = docs.withColumns({e: F.exp((F.col(names[k]) if k < len(names) else F.lit(0.0)) - F.col("__mix_top")) for k, e in enumerate(lifted)})
        total = sum((F.col(e) for e in lifted), F.lit(0.0))
        return docs.withColumn(MEMBER, F.array(*(F.col(e) / total for e in lifted)))


def classifier(docs: DataFrame, labels: DataFrame, domain: Column, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Domains:
    """Fit domain posteriors on rows of ``labels``; ``domain`` is a condition over its columns that names one."""
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(domain).alias("__domain")).where("__domain is not null")
    marked = written(marked, "domains")
    groups = sorted((r["__domain"], r["count"]) for r in marked.groupBy("__domain").count().collect())
    chosen = []
    for name, held in groups:
        take = marked.where(F.col("__domain") == name).orderBy(F.xxhash64("__id"), "__id").limit(max(1, rows // len(groups))).collect()
        chosen += [(r["__id"], name, held / len(take)) for r in take]
    names = [g for g, _ in groups]
    if len(names) < 2:
        return Domains(names)
    sample = spark.createDataFrame(chosen, f"__id {dict(marked.dtypes)['__id']}, __domain string, __weight double")
    # the sample is bounded by ``rows``; an id that repeats takes part with its smallest text
    held = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(sample), "__id")
    held = held.groupBy("__id", "__domain", "__weight").agg(F.min("__t").alias("__t"))
    held = written(_parsed(held, "__t"), "labelled")
    got = sorted(_statistics(held).select("__id", "__domain", "__weight", TOKENS, *(f"__mix_{n}" for n in STATISTICS)).collect())
    if not got:
        return Domains(names)
    heard = held.select("__id", F.explode(WORDS).alias("w")).groupBy("__id", _bucket(F.col("w")).alias("b")).count().toArrow()
    at = {r["__id"]: i for i, r in enumerate(got)}
    x = np.array([[r[f"__mix_{n}"] for n in STATISTICS] for r in got], float)
    of_words = np.zeros((len(got), BUCKETS), np.float32)
    of_words[[at[i] for i in heard["__id"].to_pylist()], heard["b"].to_numpy()] = heard["count"].to_numpy()
    of_words /= np.maximum(1.0, np.array([r[TOKENS] for r in got], np.float32))[:, None]
    y = np.array([[r["__domain"] == n for n in names] for r in got], float)
    w = np.array([r["__weight"] for r in got])
    w /= w.sum()
    mean, spread = x.mean(0), x.std(0) + 1e-9
    # all buckets have one scale, such that together they weigh as much as the statistics do
    middle = of_words.mean(0)
    of_words -= middle
    scale = float(np.sqrt(np.square(of_words).sum(1).mean() / len(STATISTICS)) + 1e-9)
    z = np.hstack([np.ones((len(x), 1), np.float32), np.clip((x - mean) / spread, -1e6, 1e6).astype(np.float32), of_words / np.float32(scale)])
    theta = np.zeros((len(names), z.shape[1]), np.float32)
    look, rate = theta, 2.0 / float((w * np.square(z).sum(1)).sum())
    for k in range(400):
        score = z @ look.T
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = look - np.float32(rate) * ((((p - y) * w[:, None]).T.astype(np.float32) @ z) + np.float32(1e-5) * look)
        look, theta = new + np.float32(k / (k + 3)) * (new - theta), new
    theta = theta.astype(float)
    cut = 1 + len(STATISTICS)
    of_statistics, of_buckets = theta[:, 1:cut] / spread, theta[:, cut:] / scale
    bias = theta[:, 0] - of_statistics @ mean - of_buckets @ middle
    return Domains(names, bias.tolist(), of_statistics.tolist(), of_buckets.tolist())


@dataclass
class Fit:
    """The projected step, the domains' expected tokens before and after it, and what was wanted."""

    step: list[float]
    before: list[float]
    after: list[float]
    wanted: list[float]

    @property
    def residual(self) -> float:
        """Distance from the targets, as a share of all wanted tokens."""
        return float(np.linalg.norm(np.subtract(self.after, self.wanted)) / max(1e-300, sum(self.wanted)))


def _rate(step: list[float]) -> Column:
    """A document's rate after the step."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(MEMBER)[i] * F.lit(float(x)) for i, x in enumerate(step)), F.lit(0.0)))


def fitted(table: DataFrame, names: list[str], targets: dict[str, float], anchor: str | None = None) -> Fit:
    """Fit rates for ``table`` with ``TOKENS`` and ``MEMBER``.

    ``targets``: domain to weight. The total of tokens stays, or is such that domain ``anchor`` keeps its own.
    """
    d = len(names)
    weight = np.array([max(0.0, float(targets.get(n, 0.0))) for n in names])
    if not d or not weight.sum():
        return Fit([], [], [], [])
    weight /= weight.sum()
    member = F.col(MEMBER)

    def sums(steps: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Expected tokens, overlap of the domains and tokens times squared rates after each step, in one pass."""
        rated = table.select(TOKENS, MEMBER, *(_rate(s.tolist()).alias(f"r{k}") for k, s in enumerate(steps)))
        asked = []
        for k in range(len(steps)):
            live, rate = F.when(F.col(f"r{k}") > 0, F.col(TOKENS)).otherwise(0.0), F.col(f"r{k}") * F.col(TOKENS)
            asked += [F.sum(rate * member[i]) for i in range(d)] + [F.sum(live * member[i] * member[j]) for i in range(d) for j in range(d)]
            asked.append(F.sum(rate * F.col(f"r{k}")))
        got = np.array([x or 0.0 for x in rated.agg(*(c.alias(f"c{i}") for i, c in enumerate(asked))).first()]).reshape(len(steps), d + d * d + 1)
        return [(row[:d], row[d:-1].reshape(d, d), row[-1]) for row in got]

    step = np.zeros(d)
    now, overlap, squares = first = sums([step])[0]
    total = now[names.index(anchor)] / weight[names.index(anchor)] if anchor in names and weight[names.index(anchor)] else now.sum()
    want, ridge = weight * total, RIDGE * now.sum()

    def height(x: np.ndarray, squares: float) -> float:
        """The convex function whose least point is the implicit step."""
        return float(squares / 2 + want @ x + ridge / 2 * x @ x)

    for _ in range(ROUNDS if now.sum() else 0):
        slope = want - now + ridge * step
        if np.abs(slope).max() <= CLOSE * want.sum():
            break
        way = -np.linalg.solve(overlap + np.eye(d) * ridge, slope)
        tried = [step + way * s for s in (1.0, 0.5, 0.25, 0.0625, 0.0078125)]
        found = sums(tried)
        best = int(np.argmin([height(x, f[2]) for x, f in zip(tried, found, strict=True)]))
        if height(tried[best], found[best][2]) >= height(step, squares):
            break
        step, (now, overlap, squares) = tried[best], found[best]
    return Fit(step.tolist(), first[0].tolist(), now.tolist(), want.tolist())


def mixed_rates(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], anchor: str | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``tokens``, ``posteriors`` (by domain name), ``rate`` and ``copies``.

    ``copies`` is the rate rounded up or down by a hash keyed by seed, id and text, so that it is met on average.
    ``keep``: the columns of ``docs`` to pass on, all if not given.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    model = classifier(docs, labels, domain, id_col=id_col, text_col=text_col)
    if not model.names:
        model = Domains(sorted(targets))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    found = model.member(_parsed(docs.withColumn(DRAW, draw), text_col))
    table = written(found.select(*kept, TOKENS, MEMBER, DRAW), "posteriors")
    fit = fitted(table, model.names, targets, anchor)
    out = table.withColumn("rate", _rate(fit.step)).withColumn("copies", F.floor(F.col("rate") + F.col(DRAW)).cast("long"))
    named = F.map_from_arrays(F.array(*map(F.lit, model.names)), F.col(MEMBER))
    return out.select(*kept, F.col(TOKENS).cast("long").alias("tokens"), named.alias("posteriors"), "rate", "copies")


def quality_domain() -> Column:
    """Domains of the ``labels`` table."""
    return F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


TARGETS = {"high": 0.9, "low": 0.1}
