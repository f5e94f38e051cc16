"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector o is turned by a random rotation P; its code is the signs of P o. Beside the code stands
the correction factor f = |P o|_1 / sqrt(D), the inner product of o with its own code. For another
unit vector q, <code/sqrt(D), P q> / f estimates <o, q> without bias, and the estimate's error stays
below EPSILON * sqrt((1 - f^2) / (f^2 (D - 1))) but for a vanishing share. A pair whose upper bound
reaches the threshold is computed anew in double precision; no other pair is.

Codes, factors and keys are made once for each vector and stored beside it.

Pairs meet in buckets: bits of codes under several rotations, banded. The number of bits in a band
follows the size of the label, the number of bands the recall wanted at the threshold: a label of up to
``BUCKET`` vectors is one bucket, so nothing of it is missed, and beyond that a pair at the threshold itself meets
with a chance of at least ``recall``. With a recall of 1 every label is one bucket, whatever its size: the exact way,
in blocks. A pair is owned by the first band in which both keys agree, so it counts once. Equal vectors are one
beforehand; a bucket larger than a task takes is cut into chunks, and every pair of chunks is a task. Only sums and
spanning links leave a task, never all pairs.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have a null
label link with nothing; rows that repeat a vec_id are one vector, the smallest in array order; vectors
of different lengths never link; an empty table gives an empty one; a null vec_id is left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import components, frugal, small_side, written

#: Standard errors to the confidence bound.
EPSILON = 4.0
#: Chance at least with which a pair at the threshold itself meets.
RECALL = 0.9999
#: Vectors of a label to a bucket, and vectors that a task compares at a time.
BUCKET, BLOCK = 2048, 4096
SEED = 20_240_607


@functools.lru_cache(maxsize=64)
def rotation(dim: int, index: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, index]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bands_of(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits to a band and number of bands for a label of ``n`` vectors."""
    bits = max(0, min(30, math.ceil(math.log2(max(1, n) / BUCKET)))) if recall < 1 else 0
    agree = 1 - math.acos(threshold) / math.pi
    return bits, 1 if not bits else math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def band_keys(units: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Keys of each unit vector, one column a band."""
    n, dim = units.shape
    if not bits:
        return np.zeros((n, 1), np.int32)
    signs = np.concatenate([units @ rotation(dim, i + 1).T >= 0 for i in range(-(-bits * bands // dim))], axis=1)
    return signs[:, : bits * bands].reshape(n, bands, bits) @ (np.int32(1) << np.arange(bits, dtype=np.int32))


def codes_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of unit vectors."""
    turned = units @ rotation(units.shape[1], 0).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(units.shape[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def links_within(vectors: np.ndarray, packed: np.ndarray, factor: np.ndarray, first: np.ndarray, threshold: float, keys: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs that this band owns. ``packed``, ``factor``: what ``codes_of`` gave.

    ``first``: chunk of each, 0 or 1; pairs of one chunk are left out where the bucket has several (``first`` has
    both values).
    """
    dim = vectors.shape[1]
    turned = (unit(vectors) @ rotation(dim, 0).T).astype(np.float32)
    codes = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    spread = EPSILON * np.sqrt(np.maximum(0.0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))
    two = len(np.unique(first)) > 1
    left, right = (np.flatnonzero(first == 0), np.flatnonzero(first == 1)) if two else (np.arange(len(vectors)),) * 2
    found_a, found_b = [], []
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        estimate = (turned[a] @ codes[right].T) / (math.sqrt(dim) * factor[right])[None, :]
        i, j = np.nonzero(estimate + spread[right][None, :] + 1e-5 >= threshold)
        i, j = a[i], right[j]
        if not two:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 200_000):
            x, y = i[s : s + 200_000], j[s : s + 200_000]
            exact = cosines(vectors[x].astype(np.float64), vectors[y].astype(np.float64)) >= threshold
            x, y = x[exact], y[exact]
            owned = ~(keys[x, :band] == keys[y, :band]).any(1)
            found_a.append(x[owned])
            found_b.append(y[owned])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64),) * 2


def near_vectors(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each vector; links only join equal labels."""
    # single precision stays as it is: all computing is in double precision
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    source = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    source = source.where("vec_id is not null")
    sound = F.expr("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    every = source.select("vec_id").distinct()
    usable = source.where(sound).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.*")
    usable = written(usable, "vectors")
    classes = written(usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))

    @F.pandas_udf("struct<bits int, bands int>")
    def shape(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bands_of(int(x), threshold, recall) for x in n], columns=["bits", "bands"])

    shaped = sizes.select("label", "dim", shape("n").alias("s")).select("label", "dim", "s.*")
    placed = classes.withColumn("dim", F.size("v")).join(small_side(shaped, 64), ["label", "dim"])

    @F.pandas_udf("struct<code binary, factor double, keys array<int>>")
    def coded(v: pd.Series, bits: pd.Series, bands: pd.Series) -> pd.DataFrame:
        out = np.empty((len(v), 3), object)
        frame = pd.DataFrame({"d": v.map(len), "b": bits, "n": bands})
        for (_, b, n), at in frame.groupby(["d", "b", "n"]).indices.items():
            units = unit(np.stack(v.iloc[at].to_list()))
            codes, factors = codes_of(units)
            for i, c, f, row in zip(at, codes, factors.tolist(), band_keys(units, int(b), int(n)), strict=True):
                out[i, 0], out[i, 1], out[i, 2] = c.tobytes(), f, row
        return pd.DataFrame({"code": out[:, 0], "factor": out[:, 1].astype(float), "keys": out[:, 2]})

    keyed = written(placed.withColumn("c", coded("v", "bits", "bands")).select("label", "dim", "rep", "weight", "v", "c.*"), "coded")
    spots = keyed.select("label", "dim", "rep", "weight", "v", "code", "factor", "keys", F.posexplode("keys").alias("band", "key"))
    held = spots.groupBy("label", "dim", "band", "key").agg(F.count("*").alias("held")).where("held > 1")
    held = held.withColumn("chunks", F.ceil(F.col("held") / BLOCK).cast("int")).drop("held")
    spots = spots.join(small_side(held, 80), ["label", "dim", "band", "key"])
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(mine, c).alias("a"), F.greatest(mine, c).alias("b"), F.when(mine == c, 2).when(mine < c, 0).otherwise(1).alias("side")))
    tasks = spots.withColumn("pair", F.explode(pairs)).select("label", "dim", "band", "key", "pair.a", "pair.b", "pair.side", "rep", "weight", "v", "code", "factor", "keys")
    ident = ["label", "dim", "band", "key", "a", "b"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tripleweave.llm.ngramjoin import spanning

        now, rows = None, []

        def close():
            if len(rows) < 2:
                return [], [], []
            side, rep, weight, factor, code, v, keys = zip(*rows, strict=True)
            side, rep, weight = np.array(side), np.array(rep, np.int64), np.array(weight, np.int64)
            # a chunk with itself: all its pairs; two chunks: only pairs across
            first = np.zeros(len(rows), int) if (side == 2).all() else side
            if (side != 2).all() and len(np.unique(side)) < 2:
                return [], [], []
            packed = np.frombuffer(b"".join(code), np.uint8).reshape(len(rows), -1)
            a, b = links_within(np.stack(v), packed, np.array(factor), first, threshold, np.stack(keys), now[2])
            count = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
            hit = np.flatnonzero(count)
            s, d = spanning(rep[a], rep[b])
            return [*rep[hit].tolist(), *s.tolist()], [None] * len(hit) + d.tolist(), [*count[hit].astype(int).tolist(), *[None] * len(s)]

        names = ["node", "other", "links"]
        for batch in batches:
            out = ([], [], [])
            cols = [batch[c].to_pylist() for c in ident] + [batch[c].to_pylist() for c in ("side", "rep", "weight", "factor", "code")]
            values = [batch[c].to_numpy(zero_copy_only=False) for c in ("v", "keys")]
            for i, (*key, side, rep, weight, factor, code) in enumerate(zip(*cols, strict=True)):
                if key != now:
                    for o, x in zip(out, close(), strict=True):
                        o.extend(x)
                    now, rows = key, []
                rows.append((side, rep, weight, factor, code, values[0][i], values[1][i]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)
        out = close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)

    found = written(tasks.repartition(*ident).sortWithinPartitions(*ident).mapInArrow(frugal(walk), "node long, other long, links long"), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    classed = classes.select("label", "v", F.col("rep").alias("node"), "weight").join(counts, "node", "left").join(joined, "node", "left")
    classed = classed.select("node", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    copies = classes.where("weight > 1").select("label", "v", F.col("rep").alias("copy"))
    widest = classes.agg(F.max(F.size("v"))).first()[0] or 0
    members = usable.join(small_side(copies, 8 * widest + 64), ["label", "v"], "left").select("vec_id", F.coalesce("copy", "vec_id").alias("node"))
    linked = members.join(classed, "node").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component")
    out = every.join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as src, b.vec_id as dst from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), r as (
  select vec_id as node, vec_id as other from embeddings union select r.node, l.dst from r join l on l.src = r.other
), c as (
  select node, min(other) as component_id from r group by node
)
select e.vec_id, (select count(*) from l where l.src = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.node = e.vec_id
"""
