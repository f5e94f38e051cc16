"""Jaccard self-join of word n-gram sets through a prefix tree.

Each document is the set of its distinct word shingles, hashed to 64 bits. The global order of
shingles puts rare ones first and the commonest last, so that a document's prefix (the part in which
any partner must share a shingle) avoids passages that many documents hold.

1. One pass gives every document's set size and set digest; equal sets are one from here on.
2. A document can only link if ``percent`` hundredths of its shingles also occur in others. Shingles go, as
   packed blocks, to the partition of their hash, and the number of repeated ones comes back for each
   document. Documents below the bound link with nothing; the step is run again on those that remain,
   until few more go. Their sets are kept as a table.
3. Prefixes of the remaining documents are chained: documents of a task that share a shingle and have
   fitting sizes become one run first, so a shingle that a third of all documents hold crosses the
   shuffle once a task. A run carries its range of sizes; runs whose ranges fit are chained, never
   paired off. Chains join into candidate groups.
4. Within a group the sets, as their differences from what most of them hold, go into a radix tree, commonest
   first, so that near copies share paths and are told by few items. A set walks the tree level by level with its
   overlap so far, leaves subtrees whose remaining length cannot bring the overlap that is needed, and skips
   subtrees already in its component. The largest component's sets need not walk: all others meet them. A group
   too large for a task is cut into bands of set sizes, so wide that links only join one band or two neighbours,
   and bands into chunks; every pair of chunks that links can join is a task of its own.
5. The links found join into components.

Counts of common shingles only order them: any order gives the same links, so the bounded list of common
shingles loses nothing.

Defined results: a null or blank text has no shingles and links with nothing; a text of fewer words
than ``k`` has its whole sequence as its one shingle; equal sets link; rows that repeat an id are one
document, and where their texts differ the set with the smallest digest stands for the id; a null id links with nothing and has a null component; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.pieces import mixed
from tripleweave.llm.shared import bounded_batches, components, frugal, small_side, written

#: Shingles that a task holds at a time.
CHUNK = 1_000_000
#: A shingle is common if a chunk has it in so many documents; so many common shingles are ranked.
COMMON_LOCAL, COMMON_RANKED = 3, 1 << 17
#: Shingles of a candidate group that one task takes, and shingles to a partition of a shuffle.
GROUP_SHINGLES, PART_SHINGLES = 1 << 21, 2_500_000
#: Documents of a chunk, counted in 16 bits.
CHUNK_DOCS = 60_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Words(dict):
    """Hashes of short words, remembered up to a bound. Every pass over a partition forgets them in the end."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000 and len(word) < 32:
            self[word] = value
        return value


_WORDS = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.array(list(map(_WORDS.__getitem__, words)), np.uint64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += h[j : j + n] * (FACTORS[j % 5] + np.uint64(2 * j))
        return np.unique(mixed(total))


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of two sets of these sizes that reach ``percent``."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets, from texts or stored sets, of about ``CHUNK`` shingles at a time."""
    ids, sets, total = [], [], 0
    for batch in batches:
        stored = "items" in batch.schema.names
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for doc_id, value in zip(part["doc_id"].to_pylist(), part["items" if stored else "text"].to_pylist(), strict=True):
                s = np.frombuffer(value, np.uint64) if stored else shingles(value, k)
                ids.append(doc_id)
                sets.append(s)
                total += len(s)
                if total >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield ids, sets
                    ids, sets, total = [], [], 0
    _WORDS.clear()
    if ids:
        yield ids, sets


class Forest:
    """Union-find over the positions of an array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the given ones."""
    if not len(src):
        return src, dst
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = np.int64(len(nodes))
    pairs = np.unique(at[: len(src)] * n + at[len(src) :])
    forest = Forest(len(nodes))
    kept = [p for p in pairs.tolist() if forest.join(p // int(n), p % int(n))]
    kept = np.array(kept, np.int64)
    return nodes[kept // n], nodes[kept % n]


def chained(token: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int):
    """Chain what shares a token and fits in size. Returns edges, and the runs: token, first doc, low, high."""
    order = np.lexsort((low, token))
    token, doc, low, high = token[order], doc[order], low[order].astype(np.int64), high[order].astype(np.int64)
    fresh = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
    group = np.cumsum(fresh)
    top = np.maximum.accumulate(group << 40 | high) & ((1 << 40) - 1)
    fits = np.zeros(len(token), bool)
    fits[1:] = ~fresh[1:] & (100 * top[:-1] >= percent * low[1:])
    at = np.flatnonzero(fits)
    starts = np.flatnonzero(~fits)
    ends = np.append(starts[1:], len(token)) - 1
    return (doc[at - 1], doc[at]), (token[starts], doc[starts], low[starts], top[ends] if len(starts) else top[:0])


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _opened(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(raw) // width, 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def parts_for(shingle_count: int) -> int:
    return max(1, -(-int(shingle_count) // PART_SHINGLES))


def _part_of(token: np.ndarray, parts: int) -> np.ndarray:
    return (token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


BLOCKS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("docs", pa.int32()), ("names", pa.binary()), ("block", pa.binary())])
HELD = pa.schema([("chunk", pa.int64()), ("names", pa.binary()), ("held", pa.binary())])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that end in a block of bytes, in batches of about a megabyte."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[-1])
        if held >= 1 << 20 or len(some) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def repeated(source: DataFrame, k: int, parts: int) -> DataFrame:
    """``(doc_id, repeated)``: shingles of a document that other documents of ``source`` have too.

    Within a partition shingles are told apart by 32 bits; a chance meeting only keeps a document longer.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            full = [(i, s) for i, s in zip(ids, sets, strict=True) if len(s) and i is not None]
            if not full:
                continue
            token = np.concatenate([s for _, s in full])
            doc = np.repeat(np.arange(len(full), dtype=np.uint16), [len(s) for _, s in full])
            order = np.argsort(token)
            token, doc = token[order], doc[order]
            cuts = np.searchsorted(_part_of(token, parts), np.arange(parts + 1))
            short = (token * np.uint64(parts) & np.uint64(0xFFFFFFFFFFFFFFFF)).astype(np.uint64) >> np.uint64(32)
            names = _packed(np.array([i for i, _ in full], np.int64))
            chunk, filled = xxhash.xxh3_64_intdigest(names) >> 1, np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            # the chunk's ids travel once, with its first block
            yield from _batches(((p, chunk, len(full), names if p == filled[0] else None, _packed(short[cuts[p] : cuts[p + 1]].astype(np.uint32), doc[cuts[p] : cuts[p + 1]])) for p in filled), BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tokens, docs = [], [], []
        for batch in batches:
            for *head, block in zip(*(batch[c].to_pylist() for c in ("chunk", "docs", "names", "block")), strict=True):
                token, doc = _opened(block, np.uint32, np.uint16)
                heads.append(head)
                tokens.append(token)
                docs.append(doc)
        if not heads:
            return
        token = np.concatenate(tokens)
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        often = np.zeros(len(token), bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        ends = np.cumsum([len(d) for d in docs]).tolist()
        yield from _batches(((chunk, names, _packed(np.bincount(doc[often[end - len(doc) : end]], minlength=size).astype(np.uint32))) for (chunk, size, names), doc, end in zip(heads, docs, ends, strict=True)), HELD)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        ids: dict[int, bytes] = {}
        for batch in batches:
            for chunk, name, held in zip(batch["chunk"].to_pylist(), batch["names"].to_pylist(), batch["held"].to_pylist(), strict=True):
                add = _opened(held, np.uint32)[0].astype(np.int64)
                sums[chunk] = sums[chunk] + add if chunk in sums else add
                if name is not None:
                    ids[chunk] = name
        for chunk, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(_opened(ids[chunk], np.int64)[0]), pa.array(held)], names=["doc_id", "repeated"])

    blocks = source.mapInArrow(frugal(emit), "part int, chunk long, docs int, names binary, block binary")
    counts = blocks.repartitionById(parts, F.col("part")).mapInArrow(frugal(count), "chunk long, names binary, held binary")
    return counts.repartition("chunk").mapInArrow(frugal(total), "doc_id long, repeated long").groupBy("doc_id").agg(F.max("repeated").alias("repeated"))


POSTING = (np.uint64, np.int64, np.uint32, np.uint32)


def candidates(source: DataFrame, k: int, percent: int, common: np.ndarray, parts: int) -> DataFrame:
    """Edges ``(src, dst)`` such that linked documents are connected."""
    shared = source.sparkSession.sparkContext.broadcast(common)

    def prefix(s: np.ndarray) -> np.ndarray:
        known = shared.value
        size = len(s) - -(-percent * len(s) // 100) + 1
        if len(known):
            at = np.minimum(np.searchsorted(known[:, 0], s), len(known) - 1)
            rank = np.where(known[at, 0] == s, known[at, 1], 0)
            s = s[np.argsort(rank, kind="stable")]
        return s[:size]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            full = [(i, s) for i, s in zip(ids, sets, strict=True) if len(s) and i is not None]
            if not full:
                continue
            heads = [prefix(s) for _, s in full]
            counts = [len(h) for h in heads]
            size = np.repeat(np.array([len(s) for _, s in full], np.int64), counts)
            (a, b), runs = chained(np.concatenate(heads), np.repeat(np.array([i for i, _ in full], np.int64), counts), size, size, percent)
            a, b = spanning(a, b)
            cuts = np.searchsorted(_part_of(runs[0], parts), np.arange(parts + 1))
            rows = [(p, 0, _packed(*(r[x:y].astype(t) for r, t in zip(runs, POSTING, strict=True)))) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            if len(a):
                rows.append((int(a[0]) % parts, 1, _packed(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, edges = [], []
        for batch in batches:
            for kind, block in zip(batch["kind"].to_pylist(), batch["block"].to_pylist(), strict=True):
                (edges if kind else postings).append(_opened(block, np.int64, np.int64) if kind else _opened(block, *POSTING))
        if postings:
            pair, _ = chained(*(np.concatenate(x) for x in zip(*postings, strict=True)), percent)
            edges.append(list(pair))
        if edges:
            a, b = spanning(*(np.concatenate(x) for x in zip(*edges, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    blocks = source.mapInArrow(frugal(emit), "part int, kind int, block binary")
    return blocks.repartitionById(parts, F.col("part")).mapInArrow(frugal(meet), "src long, dst long")


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def differences(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set's differences from the core, as sorted ranks from the commonest down, and how many ranks there are.

    The core is what more than half of the sets hold. Two sets overlap in half of what their sizes leave
    when the differences that only one of them has are taken off, so near copies are told by few items.
    """
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    central = 2 * count > len(sets)
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(-np.where(central, len(sets) - count, count), kind="stable")] = np.arange(len(count), dtype=np.int32)
    core, held, out = np.flatnonzero(central), np.zeros(len(count), bool), []
    for s in np.split(place, cuts):
        held[s] = True
        out.append(np.sort(rank[np.concatenate([core[~held[core]], s[~central[s]]])]))
        held[s] = False
    return out, len(count)


class Tree:
    """Radix tree over sets in lexicographic order, in arrays. A node's children follow one another.

    ``start`` and ``depth``: items on the path to a node's beginning and end; ``first`` and ``last``: its sets.
    """

    def __init__(self, sets: list[np.ndarray]):
        first, last, start, depth, kids = [0], [len(sets)], [0], [], []
        at = 0
        while at < len(first):
            f, l, s = first[at], last[at], start[at]
            a, b = sets[f], sets[l - 1]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[s:n] != b[s:n])
            end = s + int(differ[0]) if len(differ) else n
            depth.append(end)
            kids.append(len(first))
            at += 1
            while f < l and last[at - 1] - first[at - 1] > 1:
                low = f + 1
                if len(sets[f]) > end:  # else the set that ends here
                    lead, high = sets[f][end], l
                    while low < high:
                        mid = (low + high) // 2
                        low, high = (mid + 1, high) if sets[mid][end] == lead else (low, mid)
                first.append(f)
                last.append(low)
                start.append(end)
                f = low
        self.first, self.last, self.start, self.depth = (np.array(x, np.int64) for x in (first, last, start, depth))
        self.kids, self.n_kids = np.array(kids, np.int64), np.diff([*kids, len(first)])
        self.length = self.depth - self.start
        self.at = np.cumsum(self.length) - self.length
        self.items = np.concatenate([sets[f][s:e] for f, s, e in zip(first, start, depth, strict=True)])
        full = self.length > 0
        self.lead, self.tail = np.full(len(full), -1, np.int64), np.full(len(full), -1, np.int64)
        self.lead[full], self.tail[full] = self.items[self.at[full]], self.items[(self.at + self.length - 1)[full]]

    def over(self, least: np.ufunc, values: np.ndarray) -> np.ndarray:
        """``least`` of the values of every node's sets."""
        bounds = np.stack([self.first, self.last], 1).ravel()
        return least.reduceat(np.append(values, values[-1]), bounds)[::2]


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among distinct sets, enough of them to connect every component."""
    if len(sets) < 2:
        return []
    unlike, n_ranks = differences(sets)
    order = sorted(range(len(sets)), key=lambda i: unlike[i].astype(">i4").tobytes())
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    unlike, ids = [unlike[i] for i in order], [ids[i] for i in order]
    apart = np.array([len(u) for u in unlike], np.int64)
    roots, links = np.arange(len(ids)), []
    members = {i: [i] for i in range(len(ids))}
    mask = np.zeros(n_ranks, bool)

    def link(a: int, b: int) -> None:
        big, small = int(roots[a]), int(roots[b])
        if big != small:  # the smaller component takes the root of the larger
            links.append((ids[a], ids[b]))
            big, small = (big, small) if len(members[big]) >= len(members[small]) else (small, big)
            roots[members[small]] = big
            members[big] += members.pop(small)

    def enough(a, b, alike):
        """Whether the sets at ``a`` and ``b``, with so many differences alike, overlap as they must."""
        both = sizes[a] + sizes[b]
        return both - apart[a] - apart[b] + 2 * alike >= 2 * needed(both, 0, percent)

    # neighbours in the order of the tree share most, and connect most near copies at once
    for i in range(1, len(ids)):
        mask[unlike[i - 1]] = True
        if enough(i, i - 1, int(mask[unlike[i]].sum())):
            link(i - 1, i)
        mask[unlike[i - 1]] = False
    if len(members) == 1:
        return links
    top = Tree(unlike)
    low, high, few, many = top.over(np.minimum, sizes), top.over(np.maximum, sizes), top.over(np.minimum, apart), top.over(np.maximum, apart)

    def one_component() -> np.ndarray:
        """Nodes whose sets are known to be connected; they stay so."""
        return top.over(np.minimum, roots) == top.over(np.maximum, roots)

    def walk(i: int, settled: np.ndarray) -> None:
        probe, own = unlike[i], int(sizes[i])
        mask[probe] = True
        nodes, alike = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            # differences that may be left between sets that link; what the probe has and the path has passed by
            slack = (own + high[nodes]) * (100 - percent) // (100 + percent)

            def able(passed: np.ndarray, depth: np.ndarray) -> np.ndarray:
                return (2 * (alike + len(probe) - passed) >= len(probe) + few[nodes] - slack) & (many[nodes] >= len(probe) - slack - 2 * alike + 2 * depth)

            fits = (100 * high[nodes] >= percent * own) & (100 * own >= percent * low[nodes]) & ~(settled[nodes] & (roots[top.first[nodes]] == roots[i]))
            fits &= able(np.searchsorted(probe, top.lead[nodes]), top.start[nodes])
            nodes, alike, slack = nodes[fits], alike[fits], slack[fits]
            length = top.length[nodes]
            found = np.concatenate([[0], np.cumsum(mask[top.items[spans(top.at[nodes], length)]])])
            ends = np.cumsum(length)
            alike = alike + found[ends] - found[ends - length]
            fits = able(np.searchsorted(probe, top.tail[nodes], "right"), top.depth[nodes])
            nodes, alike = nodes[fits], alike[fits]
            leaf = top.n_kids[nodes] == 0
            at = top.first[nodes[leaf]]
            at = at[enough(i, at, alike[leaf])]
            # one link to each of the components reached
            for j in at[np.unique(roots[at], return_index=True)[1]].tolist():
                link(i, j)
            count = top.n_kids[nodes]
            nodes, alike = spans(top.kids[nodes], count), np.repeat(alike, count)
        mask[probe] = False

    # the set nearest to the core reaches most; then all but the largest component, whose sets have only each other left
    walk(int(apart.argmin()), one_component())
    largest = max(members, key=lambda r: len(members[r]))
    for n, i in enumerate(np.flatnonzero(roots != largest).tolist()):
        if n % 256 == 0:
            settled = one_component()
        walk(i, settled)
    return links


def common_shingles(sets: DataFrame, k: int) -> np.ndarray:
    """Common shingles, sorted, each with its rank from the rarest up; ``COMMON_RANKED`` at most."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _sets(batches, k):
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= COMMON_LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often])], names=["token", "n"])

    top = sets.mapInArrow(frugal(survey), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON_RANKED).toPandas()
    common = np.stack([top["token"].to_numpy(np.int64).view(np.uint64), np.arange(len(top), 0, -1).astype(np.uint64)], 1)
    return common[np.argsort(common[:, 0])]


def stored_sets(chosen: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n_shingles, items)`` of ``chosen(doc_id, text, n_shingles)``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blobs = [shingles(t, k).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_shingles"], pa.array(blobs, pa.binary())], names=["doc_id", "n_shingles", "items"])
        _WORDS.clear()

    return chosen.select("doc_id", "text", "n_shingles").mapInArrow(frugal(pack), "doc_id long, n_shingles long, items binary")


def links_in_groups(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links ``(src, dst)`` found by walking the tree of every candidate group."""
    apart = sets.select("doc_id", "n_shingles").join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    sizes = apart.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("held")).where("members > 1").select("grp", "held")
    # sizes of linked sets differ by less than a band, so that they lie in one band or in two neighbours
    wide = math.log(100 / percent) + 1e-6 if percent < 100 else 1e-6
    band = F.when(F.col("held") > GROUP_SHINGLES, F.floor(F.log(F.col("n_shingles")) / wide)).otherwise(0).cast("long")
    apart = written(apart.join(sizes, "grp").select("doc_id", "n_shingles", "grp", band.alias("band")), "apart")
    chunks = apart.groupBy("grp", "band").agg(F.ceil(F.sum("n_shingles") * 2 / GROUP_SHINGLES).cast("int").alias("chunks"))
    chunks = written(chunks.withColumn("chunks", F.when(F.col("chunks") <= 2, 1).otherwise(F.col("chunks"))), "chunks")
    beside = chunks.select("grp", (F.col("band") - 1).alias("band"), F.col("chunks").alias("above"))
    under = chunks.select("grp", (F.col("band") + 1).alias("band"), F.col("chunks").alias("below"))
    shaped = chunks.join(beside, ["grp", "band"], "left").join(under, ["grp", "band"], "left")
    todo = written(apart.join(small_side(shaped, 48), ["grp", "band"]).select("doc_id", "grp", "band", "chunks", "above", "below"), "todo")
    packed = sets.join(small_side(todo, 56), "doc_id")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")

    def pair(band: Column, across: bool, a: Column, b: Column) -> Column:
        return F.struct(band.alias("low"), F.lit(across).alias("across"), a.alias("a"), b.alias("b"))

    def over(n: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1), make)

    within = F.filter(over("chunks", lambda c: pair(F.col("band"), False, F.least(mine, c), F.greatest(mine, c))), lambda p: (F.col("chunks") == 1) | (p["a"] != p["b"]))
    up = F.when(F.col("above").isNotNull(), over("above", lambda c: pair(F.col("band"), True, mine, c)))
    down = F.when(F.col("below").isNotNull(), over("below", lambda c: pair(F.col("band") - 1, True, c, mine)))
    none = F.slice(within, 1, 0)
    tasks = packed.withColumn("pair", F.explode(F.concat(within, F.coalesce(up, none), F.coalesce(down, none))))
    ident = ["grp", "low", "across", "a", "b"]
    tasks = tasks.select("grp", "pair.low", "pair.across", "pair.a", "pair.b", "doc_id", "items")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def close() -> list[tuple[int, int]]:
            return linked(list(held), list(held.values()), percent)

        for batch in batches:
            out: list[tuple[int, int]] = []
            for *own, doc_id, items in zip(*(batch[c].to_pylist() for c in (*ident, "doc_id", "items")), strict=True):
                if own != key:
                    out += close()
                    key, held = own, {}
                held[doc_id] = np.frombuffer(items, np.uint64)
            if out:
                yield pa.RecordBatch.from_pylist([{"src": s, "dst": d} for s, d in out])
        if out := close():
            yield pa.RecordBatch.from_pylist([{"src": s, "dst": d} for s, d in out])

    return tasks.repartition(*ident).sortWithinPartitions(*ident, "doc_id").mapInArrow(frugal(walk), "src long, dst long")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row; linked: Jaccard of at least ``percent`` hundredths."""
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "mark"])

    own = written(source.mapInArrow(frugal(survey), "doc_id long, n_shingles long, mark binary"), "sizes")
    shingled = own.where("n_shingles > 0 and doc_id is not null")

    # ids whose rows differ: one of their sets stands for the id
    odd = shingled.groupBy("doc_id").agg(F.min("mark").alias("chosen"), F.max("mark").alias("other")).where("chosen <> other").select("doc_id", "chosen")
    odd = small_side(written(odd, "odd"), 40)
    own = own.join(odd, "doc_id", "left").withColumn("stands", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (F.coalesce("chosen", "mark") == F.col("mark")))
    own = own.withColumn("mark", F.when(F.col("n_shingles") > 0, F.coalesce("chosen", "mark")).otherwise(F.col("mark")))

    # equal sets are one; the document with the smallest id stands for them
    alike = own.where("stands").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep <> other").select("mark", "rep")
    alike = small_side(written(alike, "alike"), 48)
    placed = own.join(alike, "mark", "left").select("doc_id", "n_shingles", "stands", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    placed = written(placed, "placed")
    copies = placed.where("doc_id <> rep").select("doc_id").distinct()
    alone = source.where("doc_id is not null").join(small_side(copies, 24), "doc_id", "left_anti")
    if not odd.isEmpty():

        @F.pandas_udf("binary")
        def mark_of(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else xxhash.xxh3_128_digest(shingles(t, k).tobytes()) for t in texts], dtype=object)

        several = F.col("chosen").isNotNull()
        alone = alone.join(odd, "doc_id", "left").where(~several | (mark_of(F.when(several, F.coalesce("text", F.lit("")))) == F.col("chosen"))).select("doc_id", "text")

    sizes = placed.where("stands and doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    sizes = written(sizes, "alone")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    enough = F.col("repeated") >= F.ceil(F.col("n_shingles") * percent / 100)
    remain = written(repeated(alone, k, parts_for(total)).join(sizes, "doc_id").where(enough).select("doc_id", "n_shingles"), "remain")
    sets = written(stored_sets(alone.join(small_side(remain, 24), "doc_id"), k), "stored")
    before = None
    while True:
        held = sets.agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("n")).first()
        if before is not None and held["rows"] > 0.95 * before or not held["rows"]:
            break
        before = held["rows"]
        again = repeated(sets, k, parts_for(held["n"])).join(sizes, "doc_id").where(enough).select("doc_id")
        keep = small_side(written(again, "remain"), 16)
        sets = written(sets.join(keep, "doc_id", "left_semi"), "stored", instead_of=sets)

    groups = components(candidates(sets, k, percent, common_shingles(sets, k), parts_for((held["n"] or 0) // 2)), "candidates")
    joined = written(components(links_in_groups(sets, groups, percent), "links"), "joined")
    moved = small_side(joined.where("node <> component").withColumnRenamed("node", "rep"), 24)
    return placed.join(moved, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as src, b.doc_id as dst, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), l as (
  select src, dst from p join n x on x.doc_id = src join n y on y.doc_id = dst where 100 * o >= 85 * (x.n + y.n - o)
), r as (
  select doc_id as node, doc_id as other from documents union select r.node, l.dst from r join l on l.src = r.other
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n using (doc_id) join (select node, min(other) as component_id from r group by node) c on c.node = d.doc_id
"""
