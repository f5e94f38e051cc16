"""SentencePiece encoding with seeded merge-dropout, and decoding.

The agenda of byte-pair merging holds the candidates of a word: neighbouring symbols whose joined
piece is in the vocabulary, best score first, leftmost among equals. A candidate is skipped when a
hash keyed by (seed, word, document, place, span) falls below the dropout rate, so every occurrence of a
word is segmented by itself. Another seed gives other segmentations and
the same seed always the same, on any executor and after any retry. Without dropout the result is that
of the library.

No piece of the vocabulary runs on from a letter into a word mark, so words are independent. What an
occurrence becomes depends on its word and on which of its candidates are skipped, so a worker keeps a tree
for each word: a node knows the candidates that come up next and the ids if none of them is skipped; the
candidates that are skipped lead to a child. Every occurrence draws for itself and walks down the tree; all
occurrences of a batch advance together as arrays. Branches that are not in the tree go through the agenda:
short words of a batch together, one merge a word in each round, words over ``LONG`` characters one by one by
a heap, in n log n. The trees only save work and no longer grow when they reach their bounds.

A text's own word-mark character (U+2581) is written as bytes, so that decoding gives back every text
exactly; the library would turn it into a blank.

Defined results: a null or empty text has no pieces and decodes to the empty text; rows that repeat
an id get the same pieces; an empty table gives an empty one; other columns are kept aside unread.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import bounded_batches, frugal

MARK = 0x2581
NONE = np.int64(1 << 62)
#: Characters of texts that are taken at a time, and of words that go through the agenda at a time.
BATCH_CHARS, AGENDA_CHARS = 1_000_000, 200_000
#: Words of more characters have no tree, and of more than the second number a heap of their own.
SHORT, LONG = 63, 400
#: Candidates that a node may have, and bounds of a worker's trees: nodes, candidates and ids.
MASKED, NODES, HELD = 52, 150_000, 2_000_000
#: A branch is kept if a batch takes it so often, or if it has few skips in a word that a batch holds so often.
BRANCH_TIMES, FEW_SKIPS, WORD_TIMES = 2, 2, 16
#: A word with the blanks before it.
WORDS = re.compile(" +[^ ]*|[^ ]+")
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def floor_of(dropout: float) -> np.uint64:
    return np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


def word_key(word: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), seed)


def occurrence_keys(words: np.ndarray, variant: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(words + (np.asarray(variant, np.uint64) + np.uint64(1)) * GOLD)


class Grown:
    """A numpy array that grows."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(max(len(more), self.n) + 1024, self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Trees:
    """What words become, by the candidates that are skipped. Spans are packed as begin, middle, end of 6 bits each."""

    def __init__(self):
        self.roots: dict[str, int] = {}
        self.branches: dict[int, int] = {}
        self.words: list[str] = []
        self.seed, self.keys = None, Grown(np.uint64)
        self.word, self.parent, self.mask = Grown(np.int32), Grown(np.int32), Grown(np.int64)
        self.first, self.many, self.spans, self.draws = Grown(np.int64), Grown(np.int32), Grown(np.int32), Grown(np.uint64)
        self.begin, self.size, self.ids = Grown(np.int64), Grown(np.int32), Grown(np.uint16)

    def full(self) -> bool:
        return self.word.n > NODES or self.spans.n > HELD or self.ids.n > HELD

    def add(self, word, parent, mask, ids: list[bytes], owner: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """New nodes with their ids and candidates (``owner``: the node among these, sorted). Returns their numbers."""
        n = len(ids)
        at = np.arange(self.word.n, self.word.n + n)
        many = np.bincount(owner, minlength=n)
        size = np.array([len(x) // 2 for x in ids], np.int64)
        self.first.add(self.spans.n + np.cumsum(many) - many)
        self.begin.add(self.ids.n + np.cumsum(size) - size)
        for column, more in ((self.word, word), (self.parent, parent), (self.mask, mask), (self.many, many), (self.size, size), (self.spans, spans)):
            column.add(np.asarray(more))
        self.draws.add(span_hash(spans >> 12, (spans >> 6 & 63) - (spans >> 12), (spans & 63) - (spans >> 12)))
        self.ids.add(np.frombuffer(b"".join(ids), np.uint16))
        return at

    def drawn(self, node: int, mask: int) -> tuple[list[int], list[int]]:
        """Spans drawn on the way to a branch, and those of them that were skipped."""
        seen, skipped = [], []
        while node >= 0:
            at, n = int(self.first.held[node]), int(self.many.held[node])
            own = self.spans.held[at : at + n].tolist()
            seen += own
            skipped += [s for k, s in enumerate(own) if mask >> k & 1]
            node, mask = int(self.parent.held[node]), int(self.mask.held[node])
        return seen, skipped


def span_hash(begin: np.ndarray, left: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Hash of candidates that begin at ``begin``, with the lengths of the left symbol and of both."""
    with np.errstate(over="ignore"):
        return mixed((begin.astype(np.uint64) << np.uint64(42) | left.astype(np.uint64) << np.uint64(21) | both.astype(np.uint64)) * GOLD)


def within(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``members``."""
    if not len(members):
        return np.zeros(len(x), bool)
    return members[np.minimum(np.searchsorted(members, x), len(members) - 1)] == x


def words_of(text: str) -> list[str]:
    """The words of a text, each without the blank that every word begins with (the first one by encoding)."""
    return [w[1:] for w in WORDS.findall(" " + text)] if text else []


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, the numbers of all words in order, and how many words each text has."""
    try:
        column = pa.array(texts, pa.string())
    except UnicodeEncodeError:  # half a surrogate pair
        split, names = [words_of(t) for t in texts], {}
        at = np.array([names.setdefault(w, len(names)) for ws in split for w in ws], np.int64)
        return [" " + w for w in names], at, np.array(list(map(len, split)), np.int64)
    # texts with single blanks between words alone are split as they are
    odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.equal(column, "")), pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")))
    odd = odd.to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(column.filter(pa.array(~odd)), " ")
    strange = pa.array([words_of(texts[i]) for i in np.flatnonzero(odd).tolist()], plain.type)
    order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
    split = pa.concat_arrays([plain, strange]).take(pa.array(order)) if len(strange) else plain
    made = split.flatten().dictionary_encode()
    count = pc.list_value_length(split).to_numpy().astype(np.int64)
    return [" " + w for w in made.dictionary.to_pylist()], made.indices.to_numpy().astype(np.int64), count


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``starts``."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class PieceModel:
    """Vocabulary, merge table and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        ids = {names[i]: i for i in plain}
        self.bytes_at = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.text_of = [n.replace(chr(MARK), " ").encode() if not library.is_byte(i) else bytes([int(n[3:5], 16)]) for i, n in enumerate(names)]
        self.char_at = np.full(0x110000, -1, np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.char_at[ord(name)] = i
        self.mark = int(self.char_at[MARK])
        self.char_at[MARK] = -1
        self.char_at[ord(" ")] = self.mark
        order = sorted(plain, key=lambda i: -library.get_score(i))
        rank = {i: r for r, i in enumerate(order)}
        pairs: dict[int, int] = {}
        for name, i in ids.items():
            assert chr(MARK) not in name.lstrip(chr(MARK)), "a piece runs on into a word mark"
            for k in range(1, len(name)):
                a, b = ids.get(name[:k]), ids.get(name[k:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = i
        keys = np.array(sorted(pairs), np.int64)
        joined = np.array([pairs[int(k)] for k in keys], np.int32)
        self.bits = max(10, int(len(keys)).bit_length() + 2)
        slots = np.full(1 << self.bits, -1, np.int64)
        value = np.zeros(1 << self.bits, np.int32)
        for k, v in zip(keys.tolist(), joined.tolist(), strict=True):
            at = self.slot(np.array([k], np.int64))[0]
            while slots[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            slots[at], value[at] = k, v
        self.slots, self.value = slots, value
        assert size <= 1 << 16, "ids are kept as 16-bit numbers"
        self.trees = Trees()
        self.pair_of: dict[int, int] | None = None
        texts = [np.frombuffer(t, np.uint8) for t in self.text_of]
        self.text_size = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.text_bytes = np.concatenate(texts)
        self.rank = np.zeros(size, np.int64)
        for i, r in rank.items():
            self.rank[i] = r

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = left.astype(np.int64) << 16 | right
        keys[(left < 0) | (right < 0)] = -2
        at = self.slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.value[at], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.value[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def encode(self, texts: list[str], owners: np.ndarray, dropout: float, seed: int) -> list[np.ndarray]:
        """Ids of each text. ``owners``: 64-bit keys of the documents, for the hash."""
        flat, ends = self.encoded(texts, owners, dropout, seed)
        return [flat[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def encoded(self, texts: list[str], owners: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins and the last one ends."""
        words, at, count = numbered(texts)
        if not len(at):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        trees, floor = self.trees, floor_of(dropout)
        times = np.bincount(at, minlength=len(words))
        number = np.fromiter(map(trees.roots.get, words, itertools.repeat(-1)), np.int64, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        # frequent words come early, so trees that are full are kept as they are
        worthy = (number < 0) & (lengths <= SHORT) & (not trees.full())
        if floor:
            # with dropout, a word that comes once is not worth a tree
            worthy &= times > 1
            if trees.seed != seed or trees.keys.n != len(trees.words):
                trees.seed, trees.keys = seed, Grown(np.uint64)
                trees.keys.add(np.array([word_key(w, seed) for w in trees.words], np.uint64))
        fresh = [words[i] for i in np.flatnonzero(worthy).tolist()]
        for part in self.parts(fresh, list(map(len, fresh))):
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            ids = self.agenda(part, 0, 0.0, 0, seen)
            owner, spans = self.sorted_spans(seen)
            names = range(len(trees.words), len(trees.words) + len(part))
            trees.words += part
            if floor:
                trees.keys.add(np.array([word_key(w, seed) for w in part], np.uint64))
            trees.roots.update(zip(part, trees.add(names, [-1] * len(part), [0] * len(part), ids, owner, spans).tolist(), strict=True))
        if fresh:
            number[worthy] = np.fromiter(map(trees.roots.__getitem__, fresh), np.int64, len(fresh))
        node = number[at]
        direct = node < 0
        if floor:
            own = np.zeros(len(words), np.uint64)
            rooted = number >= 0
            own[rooted] = trees.keys.held[trees.word.held[number[rooted]]]
            strange = np.flatnonzero(~rooted)
            own[strange] = [word_key(words[i], seed) for i in strange.tolist()]
            with np.errstate(over="ignore"):
                inside = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                draws = mixed(np.repeat(owners.astype(np.uint64), count) + inside.astype(np.uint64) * GOLD)
            keys, often = occurrence_keys(own[at], draws), times >= WORD_TIMES
            todo = np.flatnonzero(~direct)
            while len(todo):
                masks, wide = self.skipped(node[todo], keys[todo], floor)
                direct[todo[wide]] = True
                more = (masks > 0) & ~wide
                todo, masks = todo[more], masks[more]
                found = self.children(node[todo], masks, often[at[todo]])
                direct[todo[found < 0]] = True
                node[todo[found >= 0]] = found[found >= 0]
                todo = todo[found >= 0]
        anew = np.flatnonzero(direct)
        made: list[bytes] = []
        for some in self.parts(anew.tolist(), lengths[at[anew]].tolist()):
            made += self.agenda([words[i] for i in at[some].tolist()], draws[some] if floor else 0, dropout, seed, own=own[at[some]] if floor else None)
        held = np.concatenate([trees.ids.all, np.frombuffer(b"".join(made), np.uint16)])
        size, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        size[~direct], begin[~direct] = trees.size.held[node[~direct]], trees.begin.held[node[~direct]]
        size[anew] = [len(x) // 2 for x in made]
        begin[anew] = trees.ids.n + np.cumsum(size[anew]) - size[anew]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        return held[spread(begin, size)].astype(np.int32), ends

    def skipped(self, node: np.ndarray, keys: np.ndarray, floor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of each occurrence's node that it skips, as bits; and nodes with too many candidates."""
        trees, step = self.trees, 1 << 15
        masks, wide = np.zeros(len(node), np.int64), trees.many.held[node] > MASKED
        for a in range(0, len(node), step):
            first, many = trees.first.held[node[a : a + step]], np.where(wide[a : a + step], 0, trees.many.held[node[a : a + step]])
            which = np.repeat(np.arange(len(first)), many)
            hit = np.flatnonzero(mixed(keys[a : a + step][which] ^ trees.draws.held[spread(first, many)]) < floor)
            bit = hit - (np.cumsum(many) - many)[which[hit]]
            masks[a : a + step] = np.bincount(which[hit], weights=np.ldexp(1.0, bit.astype(np.int32)), minlength=len(first)).astype(np.int64)
        return masks, wide

    def children(self, node: np.ndarray, masks: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The child that each occurrence's skips lead to, or -1; new ones are made if they are worth it."""
        trees = self.trees
        with np.errstate(over="ignore"):
            names = mixed(node.astype(np.uint64) * GOLD ^ mixed(masks.astype(np.uint64) + GOLD))
        _, first, which, times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        found = np.fromiter((trees.branches.get(k, -1) for k in names[first].tolist()), np.int64, len(first))
        few = np.zeros(len(first), np.int64)
        left = masks[first].copy()
        for _ in range(FEW_SKIPS + 1):
            few += left > 0
            left &= left - 1
        new = np.flatnonzero((found < 0) & (not trees.full()) & ((times >= BRANCH_TIMES) | (often[first] & (few <= FEW_SKIPS))))
        for part in self.parts(new.tolist(), [12] * len(new)):
            own, mask = node[first[part]], masks[first[part]]
            ways = [trees.drawn(n, m) for n, m in zip(own.tolist(), mask.tolist(), strict=True)]
            drawn, skips = (np.sort(np.array([i << 18 | s for i, way in enumerate(ways) for s in way[k]], np.int64)) for k in (0, 1))
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            ids = self.agenda([trees.words[w] for w in trees.word.held[own]], 0, 0.0, 0, seen, skips=skips)
            owner, spans = self.sorted_spans(seen)
            open_ = ~within(owner << 18 | spans, drawn)
            found[part] = trees.add(trees.word.held[own], own, mask, ids, owner[open_], spans[open_])
            trees.branches.update(zip(names[first[part]].tolist(), found[part].tolist(), strict=True))
        # a name is a hash: whatever does not truly belong to its node and skips goes through the agenda
        child = found[which]
        true = (child >= 0) & (trees.parent.held[child] == node) & (trees.mask.held[child] == masks)
        return np.where(true, child, -1)

    @staticmethod
    def sorted_spans(seen: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        packed = np.unique(np.concatenate([owner << 18 | spans for owner, spans in seen]))
        return packed >> 18, packed & (1 << 18) - 1

    @staticmethod
    def parts(items: list, sizes: list[int]) -> Iterator[list]:
        """``items`` in runs of about ``AGENDA_CHARS``."""
        start = total = 0
        for i, size in enumerate(sizes):
            total += size
            if total >= AGENDA_CHARS or i + 1 == len(items):
                yield items[start : i + 1]
                start, total = i + 1, 0

    def agenda(self, words: list[str], variant: int | np.ndarray, dropout: float, seed: int, seen: list | None = None, own: np.ndarray | None = None, skips: np.ndarray | None = None) -> list[bytes]:
        """Ids of each word, as 16-bit numbers. Words of about one length advance together, by one merge a round.

        ``variant``: one for all words or one for each; ``own``: the keys of the words, if they are known.
        ``seen`` takes the words and packed spans of all candidates (words up to ``SHORT`` only). ``skips``: sorted
        packed spans that are skipped, with the number of the word above them.
        """
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            variants = np.broadcast_to(np.asarray(variant, np.uint64), len(words))
            rest = [i for i, w in enumerate(words) if len(w) <= LONG]
            out: list[bytes] = [b""] * len(words)
            if rest:
                for i, x in zip(rest, self.agenda([words[i] for i in rest], variants[rest], dropout, seed, own=None if own is None else own[rest]), strict=True):
                    out[i] = x
            for i in long:
                out[i] = self.heaped(words[i], variants[i], dropout, seed)
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, begin, floor = self.char_at[chars], np.cumsum(lengths) - lengths, floor_of(dropout)
        keys = None
        if floor:
            own = np.array([word_key(w, seed) for w in words], np.uint64) if own is None else own
            keys = occurrence_keys(own, np.broadcast_to(np.asarray(variant, np.uint64), len(words)))
        # words of about one length go together
        by_length = np.argsort(lengths, kind="stable")
        found, first = [], 0
        while first < len(words):
            last = int(np.searchsorted(lengths[by_length], lengths[by_length[first]] * 5 // 4 + 2, "right"))
            some = by_length[first:last]
            found += self.rounds(some, symbols, begin[some], lengths[some], keys[some] if floor else None, floor, seen, skips)
            first = last
        at, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at, ids = self.spelled(at[order], ids[order], chars)
        cut = np.searchsorted(at, np.cumsum(lengths))
        flat, cut = ids.astype(np.uint16).tobytes(), (cut * 2).tolist()
        return [flat[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def rounds(self, names: np.ndarray, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray | None, floor: np.uint64, seen: list | None, skips: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and ids of what words become; ``names`` are their numbers. A column a word, a row a place in it."""
        many, high = len(names), int(size.max())
        inside = np.arange(high)[:, None] < size
        sym = np.full((high, many), -1, np.int32)
        sym.T[inside.T] = symbols[spread(begin, size)]
        # each symbol knows the places of the next and the last one
        after = np.repeat(np.arange(1, high + 1, dtype=np.int32), many)
        before = np.repeat(np.arange(-1, high - 1, dtype=np.int32), many)
        sym, alive = sym.ravel(), inside.ravel()
        made, worth = np.full(high * many, -1, np.int32), np.full(high * many, NONE)
        out = []

        def weigh(word: np.ndarray, place: np.ndarray) -> None:
            """Candidates of the symbols at ``place`` and the next ones."""
            at = place * many + word
            middle = after[at].astype(np.int64)
            worth[at] = NONE
            ok = middle < size[word]
            if not ok.all():
                word, place, middle, at = word[ok], place[ok], middle[ok], at[ok]
            other = middle * many + word
            got = self.joined(sym[at], sym[other])
            live = np.flatnonzero(got >= 0)
            word, place, middle, at, got = word[live], place[live], middle[live], at[live], got[live]
            if keys is not None or seen is not None:
                end = after[other[live]].astype(np.int64)
                if seen is not None:
                    spans = place << 12 | middle << 6 | end
                    seen.append((names[word], spans))
                    fine = ~within(names[word] << 18 | spans, skips) if skips is not None else None
                else:
                    fine = mixed(keys[word] ^ span_hash(place, middle - place, end - place)) >= floor
                if fine is not None:
                    place, at, got = place[fine], at[fine], got[fine]
            made[at] = got
            worth[at] = self.rank[got] << 32 | place

        def finished(which: np.ndarray) -> None:
            left = alive.reshape(high, many)[:, which].T
            place = begin[which][:, None] + np.arange(high)
            out.append((place[left], sym.reshape(high, many)[:, which].T[left]))

        all_places, all_words = np.divmod(np.arange(high * many), many)
        weigh(all_words[alive], all_places[alive])
        while many:
            best = worth.reshape(high, many).min(axis=0)
            live = np.flatnonzero(best != NONE)
            if len(live) <= many * 0.6:
                # finished words leave the arrays
                finished(np.flatnonzero(best == NONE))
                sym, after, before, alive, made, worth = (x.reshape(high, many)[:, live].ravel() for x in (sym, after, before, alive, made, worth))
                names, begin, size, best, many = names[live], begin[live], size[live], best[live], len(live)
                keys = keys[live] if keys is not None else None
                live = np.arange(many)
                if not many:
                    break
            place = best[live] & 0xFFFFFFFF
            at = place * many + live
            other = after[at] * many + live
            end = after[other]
            sym[at], after[at] = made[at], end
            alive[other], worth[other] = False, NONE
            inner = end < size[live]
            before[end[inner] * many + live[inner]] = place[inner]
            prior = before[at].astype(np.int64)
            weigh(live, place)
            has = prior >= 0
            weigh(live[has], prior[has])
        return out

    def spelled(self, at: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and ids with the bytes of characters that have no piece."""
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            raw = [list(chr(c).encode("utf-8", "surrogatepass")) for c in chars[at[strange]]]
            width = np.ones(len(ids), np.int64)
            width[strange] = [len(r) for r in raw]
            at, ids = np.repeat(at, width), np.repeat(ids, width)
            ids[ids < 0] = self.bytes_at[np.concatenate([np.array(r, np.int64) for r in raw])]
        return at, ids

    def heaped(self, word: str, variant: int, dropout: float, seed: int) -> bytes:
        """Ids of one long word, by a heap of candidates over a linked list of symbols."""
        if self.pair_of is None:
            full = np.flatnonzero(self.slots >= 0)
            self.pair_of = dict(zip(self.slots[full].tolist(), self.value[full].tolist(), strict=True))
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, floor, rank, pair_of = len(chars), int(floor_of(dropout)), self.rank.tolist(), self.pair_of.get
        sym = self.char_at[chars]
        key = occurrence_keys(np.array([word_key(word, seed)], np.uint64), variant)[0]
        got = self.joined(sym[:-1], sym[1:])
        if floor:
            place = np.arange(n - 1)
            got[mixed(key ^ span_hash(place, np.full(n - 1, 1), np.full(n - 1, 2))) < floor_of(dropout)] = -1
        live = np.flatnonzero(got >= 0)
        # (rank, begin, end) in one number: a symbol is named by where it begins, a candidate dies with either
        heap = (self.rank[got[live]] << 48 | live << 24 | live + 2).tolist() if n < 1 << 24 else [(int(self.rank[got[i]]) << 96) | int(i) << 48 | int(i) + 2 for i in live]
        width = 24 if n < 1 << 24 else 48
        low = (1 << width) - 1
        heapq.heapify(heap)
        made, sym = dict(zip(live.tolist(), got[live].tolist(), strict=True)), sym.tolist()
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        key, m64 = int(key), (1 << 64) - 1

        def weigh(a: int) -> None:
            m = end[a]
            if m >= n:
                made.pop(a, None)
                return
            x, y = sym[a], sym[m]
            piece = pair_of(x << 16 | y, -1) if x >= 0 and y >= 0 else -1
            if piece >= 0 and floor:
                # the scalar twin of mixed(key ^ span_hash(...))
                h = ((a << 42 | (m - a) << 21 | (end[m] - a)) * 0x9E3779B97F4A7C15) & m64
                for _ in range(2):
                    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m64
                    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m64
                    h ^= h >> 31
                    h ^= key
                if h ^ key < floor:
                    piece = -1
            if piece >= 0:
                made[a] = piece
                heapq.heappush(heap, rank[piece] << 2 * width | a << width | end[m])
            else:
                made.pop(a, None)

        while heap:
            top = heapq.heappop(heap)
            a, b = top >> width & low, top & low
            m = end[a]
            # stale: a symbol has gone, or either has grown
            if sym[a] is None or m >= n or end[m] != b or a not in made or rank[made[a]] != top >> 2 * width:
                continue
            sym[a], sym[m], end[a] = made[a], None, b
            if b < n:
                back[b] = a
            weigh(a)
            if a:
                weigh(back[a])
        at = np.array([i for i, s in enumerate(sym) if s is not None], np.int64)
        return self.spelled(at, np.array([sym[i] for i in at.tolist()], np.int32), chars)[1].astype(np.uint16).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``ids`` stand for, without the blank that encoding puts in front."""
        return b"".join(map(self.text_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")

    def decoded(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of each text that ``flat`` holds the ids of."""
        size = self.text_size[flat]
        out = self.text_bytes[spread(self.text_at[flat], size)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[ends].tolist()
        return [out[a + 1 : b] for a, b in itertools.pairwise(cuts)]


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def owner_key(doc_id, text: str) -> int:
    """Key of a document for the hash: its id, or its text where it has none."""
    return xxhash.xxh3_64_intdigest(f"{doc_id}" if doc_id is not None else "t" + text)


def encoded(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``pieces`` (array of ids) and ``lossless`` (decoding gave the text back)."""
    kept = [c for c in docs.columns if c not in ("pieces", "lossless")]
    source = bounded_batches(docs).select(*kept)
    id_at, text_at = kept.index(id_col), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            size = max(1, int(batch.num_rows * BATCH_CHARS / max(1, batch.column(text_at).nbytes)))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                owners = np.array([owner_key(i, t) for i, t in zip(part.column(id_at).to_pylist(), texts, strict=True)], np.uint64)
                flat, ends = coder.encoded(texts, owners, dropout, seed)
                same = [x == t.encode("utf-8", "surrogatepass") for x, t in zip(coder.decoded(flat, ends), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same, pa.bool_())], names=[*kept, "pieces", "lossless"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(frugal(run), f"{fields}, pieces array<int>, lossless boolean")


def decoded(table: DataFrame, path: str, pieces_col: str = "pieces") -> DataFrame:
    """``table`` with ``decoded``, the text of its pieces."""
    kept = [c for c in table.columns if c != "decoded"]
    source = bounded_batches(table).select(*kept)
    at = kept.index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(frugal(run), f"{fields}, decoded string")


def counted(table: DataFrame) -> DataFrame:
    """What the query reports of encoded documents: the pieces themselves and their number."""
    return table.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")
