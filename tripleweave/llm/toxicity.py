"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regression over the words and within-word
character n-grams that a text holds. A later model also sees the probabilities of earlier categories.
In training those are out of fold: each labelled row gets them from a model that was fitted without it,
so later models learn from probabilities as uncertain as those they will meet.

Training takes at most ``rows`` labelled rows, dealt evenly over the combinations of labels and chosen by
a hash of the id; weights restore the combinations' shares. Everything else reads every row.

Defined results: a null text counts as empty; a text without words is never flagged; rows without a label are scored all the same; an id that
is labelled twice uses the larger labels; null labels or ids are not trained on; without labels of both
kinds a category's probability is its share (0 without labels) and nothing is flagged; rows that repeat
are scored each; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import bounded_batches, frugal, written

TRAIN_ROWS, FEATURES, FOLDS = 4000, 600, 5
#: Lengths of character n-grams; a feature must occur in so many training rows.
GRAMS, LEAST_ROWS = (4, 5), 5
WORDS = re.compile(r"[^\W\d_]+|[^\w\s]+")
#: Words whose features a worker remembers, and texts that it scores at a time.
REMEMBERED, BATCH_ROWS = 120_000, 256


def grams(word: str) -> set[str]:
    return {"=" + word, *(word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1))}


def features(text: str | None) -> set[str]:
    return set().union(*map(grams, set(WORDS.findall((text or "").lower()))))


@dataclass
class Link:
    """One model of the chain."""

    name: str
    weights: np.ndarray
    bias: float
    earlier: np.ndarray
    threshold: float
    fixed: float | None = None


@dataclass
class Chain:
    vocabulary: dict[str, int]
    links: list[Link]
    known: dict[str, bytes] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One row a text and one column a category; and which texts have words at all.

        Texts by features is a sparse matrix of zeros and ones.
        """
        numbers: dict[str, int] = {}
        words = [list({numbers.setdefault(w, len(numbers)) for w in WORDS.findall((t or "").lower())}) for t in texts]
        get, known, hits = self.vocabulary.get, self.known, []
        for word in numbers:
            found = known.get(word)
            if found is None:
                found = array("i", [i for g in grams(word) if (i := get(g)) is not None]).tobytes()
                # frequent words come early, so what does not fit is rare
                if len(known) < REMEMBERED:
                    known[word] = found
            hits.append(found)
        held = np.array(list(map(len, words)), np.int64)
        size = np.array(list(map(len, hits)), np.int64) // 4
        flat = np.frombuffer(b"".join(hits), np.int32).astype(np.int64)
        word = np.fromiter(itertools.chain.from_iterable(words), np.int64, int(held.sum()))
        many = size[word]
        starts = (np.cumsum(size) - size)[word]
        feature = flat[np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        wide = max(1, len(self.vocabulary))
        cells = np.unique(np.repeat(np.repeat(np.arange(len(texts)), held), many) * wide + feature)
        row, column = cells // wide, cells % wide
        out = np.zeros((len(texts), len(self.links)))
        for k, link in enumerate(self.links):
            if link.fixed is not None:
                out[:, k] = link.fixed
                continue
            z = link.bias + np.bincount(row, weights=link.weights[column].astype(np.float64), minlength=len(texts)) + out[:, :k] @ link.earlier
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out, held > 0


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 250, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Nesterov's method, in the precision of ``x``."""
    w = w / w.sum()
    theta, bias = np.zeros(x.shape[1], x.dtype), 0.0
    look, look_bias = theta, bias
    rate = 8.0 / (float((w * np.square(x).sum(1)).sum()) + 2.0)
    for k in range(steps):
        z = x @ look + look_bias
        g = w * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new, new_bias = look - rate * (g.astype(x.dtype) @ x + penalty * look), look_bias - rate * float(g.sum())
        m = k / (k + 3)
        look, look_bias = (new + m * (new - theta)).astype(x.dtype), new_bias + m * (new_bias - bias)
        theta, bias = new.astype(x.dtype), new_bias
    return theta, bias


def _cut(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The threshold of best F1, in the middle of its gap."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum((w * y)[order])
    f1 = 2 * hit / (np.cumsum(w[order]) + (w * y).sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain. ``categories``: name to condition on ``labels``, in the order of the chain."""
    spark, names = bounded_batches(docs).sparkSession, list(categories)
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(*(F.max(c.cast("int")).alias(n) for n, c in categories.items()))
    for n in names:
        marked = marked.where(F.col(n).isNotNull())
    marked = written(marked, "labels")
    groups = marked.groupBy(*names).count().collect()
    chosen = []
    for g in groups:
        same = marked
        for n in names:
            same = same.where(F.col(n) == g[n])
        take = same.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, rows // len(groups))).collect()
        chosen += [(r["doc_id"], *(r[n] for n in names), g["count"] / len(take)) for r in take]
    kinds = ", ".join(f"{n} int" for n in names)
    sample = spark.createDataFrame(chosen, f"doc_id {dict(marked.dtypes)['doc_id']}, {kinds}, weight double")
    # the sample is bounded by ``rows``, whatever the tables hold
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    held = written(held.repartition(8, "doc_id"), "training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {n: Counter() for n in ["", *names]}
        for batch in batches:
            for text, *ys in zip(batch["text"].to_pylist(), *(batch[n].to_pylist() for n in names), strict=True):
                own = features(text)
                seen[""].update(own)
                for n, y in zip(names, ys, strict=True):
                    if y:
                        seen[n].update(own)
        keys = list(seen[""])
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([seen[n][k] for k in part], pa.int64()) for n in ["", *names])], names=["feature", "n", *names])

    counted = held.mapInArrow(frugal(count), "feature string, n long, " + ", ".join(f"{n} long" for n in names))
    counted = counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ["n", *names])).where(F.col("n") >= LEAST_ROWS)
    counted = written(counted, "features")
    totals = held.agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in names)).first()
    picked: set[str] = set()
    for n in names:
        yes, all_rows = totals[n] or 0, totals["n"]
        if not 0 < yes < all_rows:
            continue
        a, b = F.col(n), F.col("n") - F.col(n)
        gap = F.log((a + 0.5) / (yes + 1)) - F.log((b + 0.5) / (all_rows - yes + 1))
        score = F.abs(gap) * F.sqrt(F.when(gap > 0, a).otherwise(b))
        picked |= {r["feature"] for r in counted.orderBy(F.desc(score), "feature").limit(FEATURES).collect()}
    vocabulary = {f: i for i, f in enumerate(sorted(picked))}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(vocabulary[f] for f in features(t) if f in vocabulary) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["weight"], *(batch[n] for n in names), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "weight", *names, "hits"])

    small = held.mapInArrow(frugal(project), f"doc_id {dict(held.dtypes)['doc_id']}, weight double, {kinds}, hits array<int>").toPandas().sort_values("doc_id")
    x = np.zeros((len(small), len(vocabulary)), np.float32)
    for i, hits in enumerate(small["hits"]):
        x[i, hits] = 1
    weight = small["weight"].to_numpy(float)
    fold = np.arange(len(small)) % FOLDS
    earlier = np.zeros((len(small), 0), np.float32)
    links = []
    for k, n in enumerate(names):
        y = small[n].to_numpy(float)
        if not len(y) or not 0 < y.sum() < len(y):
            share = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
            links.append(Link(n, np.zeros(len(vocabulary)), 0.0, np.zeros(k), 2.0, share))
            earlier = np.hstack([earlier, np.full((len(y), 1), share, np.float32)])
            continue
        both = np.hstack([x, earlier])
        out = np.zeros(len(y))
        for f in range(FOLDS):
            other = fold != f
            theta, bias = fit(both[other], y[other], weight[other])
            out[~other] = 1 / (1 + np.exp(-np.clip(both[~other] @ theta + bias, -40, 40)))
        theta, bias = fit(both, y, weight)
        links.append(Link(n, theta[: x.shape[1]], bias, theta[x.shape[1] :], _cut(out, y, weight)))
        earlier = np.hstack([earlier, out[:, None].astype(np.float32)])
    return Chain(vocabulary, links)


def scored(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for every category and ``flagged``: the last one reaches its threshold."""
    added = [f"p_{link.name}" for link in chain.links]
    kept = [c for c in docs.columns if c not in [*added, "flagged"]]
    source = bounded_batches(docs).select(*kept)
    at, held = kept.index(text_col), source.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        cut = own.links[-1].threshold
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                p, worded = own.probabilities(part.column(at).to_pylist())
                columns = [pa.array(p[:, i]) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array((p[:, -1] >= cut) & worded)], names=[*kept, *added, "flagged"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(frugal(run), f"{fields}, {', '.join(f'{a} double' for a in added)}, flagged boolean")


def label_chain() -> dict[str, Column]:
    """The chain over the ``labels`` table: junk first, as it is easy and toxic rows rarely are junk."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
