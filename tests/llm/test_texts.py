"""Fingerprints, token counts, pieces, line dedup and n-gram join against brute force."""

import hashlib
import random
import re
import time
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from tripleweave.llm import fingerprints, linededup, ngramjoin, pieces, tokencounts
from tripleweave.llm.shared import components


def tuples(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


# components
def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[3] == 1 and got[9] == 7 and 5 not in got and got[140] == 100 and got[549] == 500 and got[1] == 1
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# fingerprints
def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split())


def test_compared(docs, corpus, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4096)
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = fingerprints.compared(docs).collect()
    assert len(got) == len(rows)
    marks, want = {}, []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        near = (float(canonical(edit) == canonical(text)), float(canonical(following) == canonical(text)))
        want.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), *near))
        marks.setdefault(canonical(text), len(marks))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"])) for r in got)
    assert len({r["fingerprint"] for r in got}) == len(marks)


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    rows = [(1, "a"), (2, "A "), (3, "b"), (4, "c")]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    prints = spark.createDataFrame([(i, "same") for i, _ in rows], "doc_id long, fingerprint string")
    monkeypatch.setattr(fingerprints, "digest", lambda form: "same")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.verified(source, prints, ["fingerprint"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_fingerprints_of_odd_tables(docs, empty, corpus):
    got = defaultdict(set)
    texts = defaultdict(set)
    for doc_id, t in corpus:
        texts[doc_id].add(canonical(t or ""))
    for r in fingerprints.fingerprints(docs).collect():
        got[r["doc_id"]].add(r["fingerprint"])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in texts.items()}
    assert fingerprints.compared(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.compared(docs.where("doc_id = 4")).first()["near_next"] == 1.0


# token counts
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(docs, corpus, empty, name, tmp_path):
    path = tokencounts.tokenizer_path(name)
    want = tokencounts.LibraryCounter(path).counts([t or "" for _, t in corpus])
    cache = f"file://{tmp_path}/cache"
    expected = sorted(repr((i, len((t or "").encode()), n, n > 50)) for (i, t), n in zip(corpus, want, strict=True))
    half = docs.where("doc_id < 50")
    assert tokencounts.token_counts(half, path).count() == half.count()
    first = tokencounts.token_counts(docs, path, over=50)
    assert tuples(first, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    spark = docs.sparkSession
    spark.createDataFrame([], tokencounts.CACHE_SCHEMA).write.parquet(cache)
    tokencounts.token_counts(half, path, cache=cache).count()
    held = spark.read.parquet(cache).count()
    assert tuples(tokencounts.token_counts(docs, path, cache=cache, over=50), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    grown = spark.read.parquet(cache)
    assert grown.count() > held and grown.count() == grown.select("content").distinct().count()
    tokencounts.token_counts(docs, path, cache=cache).count()
    assert spark.read.parquet(cache).count() == grown.count()
    assert tokencounts.token_counts(empty, path).count() == 0


# pieces
def test_pieces_without_dropout_are_those_of_the_library(docs, corpus):
    import sentencepiece

    path = tokencounts.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in corpus]
    got = pieces.model(path).encode(texts, np.arange(len(texts), dtype=np.uint64), 0.0, 0)
    for t, g in zip(texts, got, strict=True):
        if "▁" not in t:
            assert g.tolist() == library.encode(t)


def agenda(word, model, skip):
    """The agenda of one word, by a list."""
    symbols = [(i, i + 1, int(model.char_at[ord(c)])) for i, c in enumerate(word)]
    while True:
        found = []
        for k, ((a, _, x), (m, b, y)) in enumerate(zip(symbols, symbols[1:], strict=False)):
            made = int(model.joined(np.array([x]), np.array([y]))[0])
            if made >= 0 and not skip(a, m, b):
                found.append((int(model.rank[made]), k, made))
        if not found:
            return [s[2] for s in symbols]
        _, k, made = min(found)
        symbols[k : k + 2] = [(symbols[k][0], symbols[k + 1][1], made)]


def test_dropout_follows_the_agenda():
    import xxhash

    m = pieces.model(tokencounts.tokenizer_path("piece_bpe_32k.model"))
    rate, seed = 0.3, 9
    floor = int(rate * 2.0**64)
    for v in range(4):
        for word in (" international", " a", " unbelievable", "  two", " hippopotamus"):
            with np.errstate(over="ignore"):
                key = pieces.mixed(np.array([xxhash.xxh3_64_intdigest(word.encode(), seed)], np.uint64) + np.uint64(v + 1) * pieces.GOLD)[0]

            def skip(a, mid, b, key=key):
                span = np.array([a << 42 | (mid - a) << 21 | (b - a)], np.uint64)
                return int(pieces.mixed(key ^ pieces.mixed(span * pieces.GOLD))[0]) < floor

            got = np.frombuffer(m.agenda([" x", word], v, rate, seed)[1], np.uint16).tolist()
            assert got == agenda(word, m, skip)


def test_dropout_is_drawn_for_every_occurrence():
    m = pieces.model(tokencounts.tokenizer_path("piece_bpe_32k.model"))
    rate, seed = 0.1, 1
    owners = np.array([pieces.owner_key(i, "") for i in range(1500)], np.uint64)
    one, two = m.encode(["a"] * 1500, owners, rate, seed), m.encode(["of a a"] * 1500, owners, rate, seed)
    assert [len(x) for x in m.encode(["a"], owners[:1], 0.0, seed)] == [1]
    assert abs(np.mean([len(x) > 1 for x in one]) - rate) < 0.03
    floor = int(rate * 2.0**64)
    long = m.encode(["international unbelievable once%d international" % (i % 40) for i in range(1500)], owners, rate, seed)
    assert len({x.tobytes() for x in long}) > 40
    for i in range(40):
        for text, found in (("of a a", two[i]), ("international unbelievable once%d international" % i, long[i])):
            want = []
            for n, word in enumerate(pieces.WORDS.findall(" " + text)):
                with np.errstate(over="ignore"):
                    draw = pieces.mixed(owners[i : i + 1] + np.uint64(n) * pieces.GOLD)
                    key = pieces.mixed(np.array([pieces.word_key(word, seed)], np.uint64) + (draw + np.uint64(1)) * pieces.GOLD)[0]

                def skip(a, mid, b, key=key):
                    span = np.array([a << 42 | (mid - a) << 21 | (b - a)], np.uint64)
                    return int(pieces.mixed(key ^ pieces.mixed(span * pieces.GOLD))[0]) < floor

                want += agenda(word, m, skip)
            assert found.tolist() == want


@pytest.mark.parametrize(("times", "nodes", "masked"), [(2, 300_000, 52), (1, 300_000, 52), (1, 200, 3)])
def test_whole_documents_follow_the_agenda(times, nodes, masked, monkeypatch):
    """Trees of words, at any bound, give what a plain agenda gives for every word of every document."""
    monkeypatch.setattr(pieces, "BRANCH_TIMES", times)
    monkeypatch.setattr(pieces, "NODES", nodes)
    monkeypatch.setattr(pieces, "MASKED", masked)
    m = pieces.PieceModel(tokencounts.tokenizer_path("piece_bpe_32k.model"))
    rng, rate, seed = random.Random(3), 0.25, 4
    words = ["international", "of", "unbelievable", "a", "hippopotamus", "strength,", "日本語", "x" * 70, "ab" * 250, "\x00", "word\nline", "ﬁne"]
    texts = [" ".join(rng.choices(words, weights=[9, 9, 9, 9, 9, 9, 9, 1, 1, 1, 3, 3], k=rng.randint(0, 25))) for _ in range(12)]
    owners = np.array([pieces.owner_key(i, "") for i in range(12)], np.uint64)
    floor = int(rate * 2.0**64)
    for _ in range(2):
        for i, found in enumerate(m.encode(texts, owners, rate, seed)):
            want = []
            for n, word in enumerate(pieces.WORDS.findall(" " + texts[i]) if texts[i] else []):
                with np.errstate(over="ignore"):
                    draw = pieces.mixed(owners[i : i + 1] + np.uint64(n) * pieces.GOLD)
                    key = pieces.mixed(np.array([pieces.word_key(word, seed)], np.uint64) + (draw + np.uint64(1)) * pieces.GOLD)[0]

                def skip(a, mid, b, key=key):
                    span = np.array([a << 42 | (mid - a) << 21 | (b - a)], np.uint64)
                    with np.errstate(over="ignore"):
                        return int(pieces.mixed(key ^ pieces.mixed(span * pieces.GOLD))[0]) < floor

                if len(word) < 30 and all(m.char_at[ord(c)] >= 0 for c in word):
                    want += agenda(word, m, skip)
                else:
                    want += np.frombuffer(m.agenda([word], draw, rate, seed)[0], np.uint16).tolist()
            assert found.tolist() == want, texts[i]


@pytest.mark.parametrize("dropout", [0.0, 0.1])
def test_long_texts_without_blanks(dropout):
    """A megabyte without a blank: n log n, the same as the agenda in rounds, and lossless."""
    import time

    m = pieces.model(tokencounts.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(8)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(3000)) + "日本é" * 3
    key = np.array([5], np.uint64)
    assert m.heaped(word, key[0], dropout, 3) == m.agenda([word[i:] for i in (0,)], key, dropout, 3)[0]
    limit, pieces.LONG = pieces.LONG, 10_000
    try:
        assert m.heaped(word, key[0], dropout, 3) == m.agenda([word], key, dropout, 3)[0]
    finally:
        pieces.LONG = limit
    text, began = "".join(rng.choice("etaoinshrdlu{}()=;") for _ in range(1_000_000)), time.time()
    flat, ends = m.encoded([text, "", "a b"], np.arange(3, dtype=np.uint64), dropout, 3)
    assert time.time() - began < 30
    assert m.decoded(flat, ends) == [text.encode(), b"", b"a b"]


def test_dropout_is_lossless_keyed_and_varied(docs, corpus, empty):
    path = tokencounts.tokenizer_path("piece_bpe_32k.model")
    one = pieces.encoded(docs, path, 0.1, 1)
    assert "key" in one.columns and one.count() == len(corpus) and one.where("not lossless").count() == 0
    first = {r["doc_id"]: r["pieces"] for r in one.collect() if r["doc_id"] is not None}
    again = {r["doc_id"]: r["pieces"] for r in pieces.encoded(docs.repartition(2), path, 0.1, 1).collect() if r["doc_id"] is not None}
    other = {r["doc_id"]: r["pieces"] for r in pieces.encoded(docs, path, 0.1, 2).collect() if r["doc_id"] is not None}
    assert first == again and sum(first[k] != other[k] for k in first) > 80
    back = pieces.decoded(one, path)
    assert tuples(back, "doc_id", "decoded") == sorted(repr((i, t or "")) for i, t in corpus)
    assert pieces.encoded(empty, path).count() == 0 and first[100] == first[101] == []


# line dedup
def norm(line):
    return re.sub(r"\s+", " ", line, flags=re.A).strip(" ").lower()


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def lines_by_brute_force(rows):
    """Each row with its text without the lines that go, and the numbers of lines, exact and near repeats."""
    first = {}
    for doc_id, text in sorted(((-1 if i is None else i, t or "") for i, t in rows)):
        for n, line in enumerate(text.split("\n")):
            if len(norm(line)) >= linededup.LINE_CHARS and (norm(line) not in first or (doc_id, n) < first[norm(line)]):
                first[norm(line)] = (doc_id, n)
    long = [x for x in first if len(x) >= linededup.FUZZY_CHARS]
    near = {x for x in long for y in long if first[y] < first[x] and within_one(x, y)}
    want = []
    for i, t in rows:
        lines, own, exact, close = (t or "").split("\n"), -1 if i is None else i, 0, 0
        kept = []
        for n, line in enumerate(lines):
            x = norm(line)
            if x in first and first[x] < (own, n):
                exact += 1
            elif x in near:
                close += 1
            else:
                kept.append(line)
        want.append((i, "\n".join(kept), len(lines), exact, close))
    return want


def dropped_by_brute_force(rows):
    return [(i, text, exact + near) for i, text, _, exact, near in lines_by_brute_force(rows)]


def check_lines(spark, rows):
    want = lines_by_brute_force(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = linededup.deduplicated(frame)
    assert tuples(got, "doc_id", "text", "n_lines", "n_exact", "n_near") == sorted(map(repr, want))
    return sum(w[4] for w in want)


def test_lines(spark, corpus):
    assert check_lines(spark, [r for r in corpus if r[0] != 110]) >= 0


@pytest.mark.parametrize("paired", [0, 3])
def test_lines_within_one_edit(spark, paired, monkeypatch):
    monkeypatch.setattr(linededup, "PAIRED", paired)
    base = ["the quick brown fox jumps over the lazy dog", "exactly twenty chars", "a much longer line " * 9 + "ends", "thirty-two characters of text ab"]
    rows, i = [], 0
    for b in base:
        for k in range(0, len(b), 3):
            for v in (b[:k] + "#" + b[k:], b[:k] + b[k + 1 :], b[:k] + "%" + b[k + 1 :], b[:k] + "%%" + b[k + 2 :]):
                rows.append((1000 - i, v))
                i += 1
        rows.append((1000 - i, b))
        i += 1
    assert check_lines(spark, rows) > 100


def test_short_lines_take_part(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab. ") for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["Les.", "les.", "Let.", "heti eror anesti.", "heti, eror anesti.", "", " "]
    rng.shuffle(texts)
    forms = [norm(t) for t in texts]
    want = []
    for i, (t, x) in enumerate(zip(texts, forms, strict=True)):
        exact = x != "" and x in forms[:i]
        first = forms.index(x)
        near = x != "" and not exact and any(y != "" and within_one(x, y) for y in forms[:first])
        want.append(repr((i, "" if exact or near else t, int(exact), int(near))))
    got = linededup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert tuples(got, "doc_id", "text", "n_exact", "n_near") == sorted(want)


def test_lines_of_odd_tables(docs, empty):
    got = linededup.deduplicated(docs)
    assert got.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_exact", "n_near"] and got.count() == docs.count()
    assert linededup.deduplicated(empty).count() == 0


# n-gram join
def brute_join(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "bound"), [(4, 85, 1 << 21), (5, 80, 1 << 21), (3, 60, 300)])
def test_join(docs, corpus, empty, k, percent, bound, monkeypatch):
    monkeypatch.setattr(ngramjoin, "GROUP_SHINGLES", bound)
    want = brute_join(corpus, k, percent)
    got = ngramjoin.ngram_join(docs, k, percent).collect()
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert len({c for _, c in want.values()}) < len(want) - 10
    if k == 4:
        assert ngramjoin.ngram_join(empty, k, percent).count() == 0


def test_ids_with_different_texts(spark):
    """One set stands for such an id, whatever the order of rows; all its rows are in its component."""
    import xxhash

    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words[:40]), " ".join(words[20:])
    rows = [(7, one), (7, two), (3, one + " x"), (5, two + " y"), (7, None), (9, "nothing in common with these at all")]
    stands = min((one, two), key=lambda t: xxhash.xxh3_128_digest(ngramjoin.shingles(t, 4).tobytes()))
    for order in (rows, rows[::-1]):
        got = ngramjoin.ngram_join(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 4, 85).collect()
        found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
        root = 3 if stands == one else 5
        assert len(got) == 6 and found[7, 37] == found[7, 0 if False else 37] == root
        assert {c for (i, n), c in found.items() if i == 7 and n} == {root} and found[9, 4] == 9
        assert found[3, 38] == 3 and found[5, 38] == 5


def test_tree_finds_what_pairs_find():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 4000, 60)) for _ in range(6)]
    sets = {}
    for i in range(150):
        s = base[i % 6].copy()
        s[rng.integers(0, len(s), rng.integers(0, 9))] = rng.integers(5000, 9000)
        sets[np.unique(s).tobytes()] = np.unique(s).astype(np.uint64)
    sets = list(sets.values())
    up = list(range(len(sets)))
    forest, other = ngramjoin.Forest(len(sets)), ngramjoin.Forest(len(sets))
    for i in up:
        for j in up[:i]:
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                forest.join(i, j)
    for a, b in ngramjoin.linked(up, sets, 85):
        other.join(a, b)
    assert [forest.find(i) for i in up] == [other.find(i) for i in up]


def test_many_copies_of_one_text_with_too_many_edits_to_link():
    """Half of 2000 copies link with nothing, and none of them is cheap to tell apart by what all hold."""
    rng = np.random.default_rng(4)
    held = np.zeros((2000, 4400), bool)
    held[:, :400] = True
    for i, row in enumerate(held):
        edits = rng.integers(2, 12) if i % 2 else rng.integers(50, 110)
        row[rng.integers(0, 400, edits)] = False
        row[400 + rng.integers(0, 4000, edits)] = True
    sets = [np.flatnonzero(row).astype(np.uint64) for row in held]
    start = time.process_time()
    links = ngramjoin.linked(list(range(len(sets))), sets, 85)
    assert time.process_time() - start < 12  # with overlaps counted over whole sets: over 30
    alike = (held.astype(np.float32) @ held.T.astype(np.float32)).astype(int)
    sizes = held.sum(1)
    want, got = ngramjoin.Forest(len(sets)), ngramjoin.Forest(len(sets))
    for a, b in np.argwhere(100 * alike >= 85 * (sizes[:, None] + sizes - alike)).tolist():
        want.join(a, b)
    for a, b in links:
        got.join(a, b)
    roots = [want.find(i) for i in range(len(sets))]
    assert [got.find(i) for i in range(len(sets))] == roots and len(set(roots)) > 900


def test_ids_of_a_chunk_travel_once(docs, spark):
    """As many partitions as a large table has: the same counts, and the ids are not sent to each of them."""
    few, many = ({r["doc_id"]: r["repeated"] for r in ngramjoin.repeated(docs, 4, parts).collect()} for parts in (1, 64))
    assert few == many and len(few) > 100
    assert list(ngramjoin._batches(iter([(0, 1, 2, b"ids", b"x"), (1, 1, 2, None, b"y")]), ngramjoin.BLOCKS))[0]["names"].to_pylist() == [b"ids", None]
