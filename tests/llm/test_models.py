"""Vectors, classifiers, mixing, licences, personal data and the pipeline."""

import hashlib
import math
import os
import re
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tripleweave.llm import licences, mixing, pii, toxicity, vectors
from tripleweave.llm.registry import queries

SF = "/root/testdata/sf0.001"


# vectors
def brute_vectors(rows, threshold):
    sound = {}
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok and (i not in sound or list(v) < list(sound[i][0])):
            sound[i] = (v, label)
    ids = sorted({i for i, *_ in rows if i is not None})
    links = {i: set() for i in ids}
    for a in sound:
        for b in sound:
            (x, lx), (y, ly) = sound[a], sound[b]
            if a < b and lx == ly and len(x) == len(y):
                x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if (x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize(("bucket", "block"), [(256, 1024), (16, 7)])
def test_vectors(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", bucket)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * (0.02 + 0.3 * (i % 5))).tolist(), i % 3) for i in range(240)]
    rows += [(300 + i, rows[7][1], 1) for i in range(30)] + [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [math.nan] * 16, 1), (404, [None, *rows[7][1][1:]], 1)]
    rows += [(405, rows[7][1], None), (406, [math.inf, *rows[7][1][1:]], 1), (407, [x * 3 for x in rows[7][1]], 1), (408, [1.0, 2.0], 1), (None, rows[7][1], 1), rows[7], (rows[8][0], [9.0] * 16, 2)]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, links int, rep string").repartition(3)
    got = vectors.near_vectors(frame, 0.93).collect()
    want = brute_vectors(rows, 0.93)
    assert len(got) == len(want)
    same = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    wrong = [i for i in want if same[i] != want[i]]
    assert not wrong, [(i, want[i], same[i]) for i in wrong[:5]]
    assert vectors.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("recall", [vectors.RECALL, 1.0])
def test_recall_of_large_labels(spark, recall, monkeypatch):
    """Banded labels of thousands of vectors against brute force, with most links right at the threshold."""
    monkeypatch.setattr(vectors, "BUCKET", 256)
    rng = np.random.default_rng(11)
    centres = vectors.unit(rng.standard_normal((4000, 64)))
    noise = vectors.unit(rng.standard_normal((4000, 64)))
    noise = vectors.unit(noise - (noise * centres).sum(1)[:, None] * centres)
    cosine = rng.uniform(0.90, 0.97, 4000)[:, None]
    every = np.concatenate([centres, cosine * centres + np.sqrt(1 - cosine**2) * noise]).astype(np.float32)
    u = vectors.unit(every)
    want = (u @ u.T >= 0.93).sum(1) - 1
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = np.zeros(8000, int)
    for r in vectors.near_vectors(frame, 0.93, recall=recall).collect():
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all() and want.sum() > 4000
    print("recall", got.sum() / want.sum())
    assert got.sum() / want.sum() >= (1.0 if recall == 1 else 0.999)


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(2)
    o, q = vectors.unit(rng.standard_normal((400, 64))), vectors.unit(rng.standard_normal((400, 64)))
    p = vectors.rotation(64, 0)
    turned = o @ p.T
    factor = np.abs(turned).sum(1) / 8
    estimate = (np.sign(turned) * (q @ p.T)).sum(1) / (8 * factor)
    error = estimate - (o * q).sum(1)
    assert abs(error.mean()) < 0.02
    assert (np.abs(error) <= vectors.EPSILON * np.sqrt((1 - factor**2) / (factor**2 * 63))).all()
    assert np.allclose(p @ p.T, np.eye(64))


# toxicity
@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(1000):
        text = " ".join(rng.choice(words, 30))
        bad, junk = i % 5 == 0, i % 3 == 0
        text += " zzqk" + rng.choice(words) if bad else ""
        text = text.replace(" ", " ### ") if junk else text
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(not junk), int(bad)))
    rows += [(None, "zzqkx"), (2000, None), (2001, ""), rows[5]]
    labels += [(None, 1, 1), (3, None, None), (5000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("flagged", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain(labelled, spark):
    docs, labels = labelled
    chain = toxicity.train(docs, labels, toxicity.label_chain(), rows=500)
    assert [link.name for link in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    got = {r["doc_id"]: r for r in toxicity.scored(docs, chain).collect()}
    held_out = [i for i in range(0, 1000, 2)]
    right = sum(got[i]["flagged"] == (i % 5 == 0) for i in held_out) / len(held_out)
    junk = sum((got[i]["p_low_quality"] > 0.5) == (i % 3 == 0) for i in held_out) / len(held_out)
    assert right > 0.95 and junk > 0.95
    assert got[2000]["p_toxic"] == got[2001]["p_toxic"] and not got[2000]["flagged"]
    assert toxicity.scored(docs.limit(0), chain).count() == 0
    none = toxicity.train(docs, labels.limit(0), toxicity.label_chain())
    assert toxicity.scored(docs, none).where("flagged or p_toxic > 0").count() == 0
    flat = toxicity.train(docs, labels.withColumn("toxic", F.lit(0)), toxicity.label_chain())
    assert toxicity.scored(docs, flat).where("flagged").count() == 0


def test_chain_of_odd_rows(labelled, spark):
    """Very long texts, repeats, nulls and columns by the names of the scores."""
    docs, labels = labelled
    chain = toxicity.train(docs, labels, toxicity.label_chain(), rows=300)
    bad = next(r["text"] for r in docs.where("doc_id = 5").collect())
    rows = [(1, bad), (1, bad), (2, " ".join(f"w{i}" for i in range(200_000)) + " " + bad), (3, "x" * 300_000), (4, None), (5, " \n"), (None, bad), (6, "...!")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p_toxic": F.lit("mine"), "other": F.lit(None).cast("string")})
    got = toxicity.scored(frame, chain).collect()
    assert len(got) == len(rows) and all(isinstance(r["p_toxic"], float) and r["other"] is None for r in got)
    same = [r["p_toxic"] for r in got if r["text"] == bad]
    assert len(same) == 3 and len(set(same)) == 1
    for r in got:
        held, p = {chain.vocabulary[f] for f in toxicity.features(r["text"]) if f in chain.vocabulary}, []
        for link in chain.links:
            z = link.bias + sum(float(link.weights[f]) for f in held) + sum(a * b for a, b in zip(link.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
        assert abs(p[-1] - r["p_toxic"]) < 1e-6
    assert not any(r["flagged"] for r in got if r["doc_id"] in (4, 5))


def test_chain_on_the_test_data(spark):
    got = queries()["op9_toxicity_chain"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id").collect()
    right = sum(r["toxic"] == bool(r["label"]) for r in got) / len(got)
    assert right > 0.95


# mixing
def test_mixing_meets_targets(labelled):
    docs, labels = labelled
    for targets, anchor in (({"high": 0.9, "low": 0.1}, None), ({"high": 0.5, "low": 0.5}, "low"), ({"high": 1.0}, "high")):
        got = mixing.mixed_rates(docs, labels, mixing.quality_domain(), targets, anchor).collect()
        assert len(got) == docs.count() and "flagged" in got[0].asDict()
        total = {d: sum(r["rate"] * r["tokens"] * r["posteriors"][d] for r in got) for d in ("high", "low")}
        share = total["high"] / sum(total.values())
        assert abs(share - targets["high"]) < 0.01 and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) <= 1 for r in got)
    right = [(r["posteriors"]["low"] > 0.5) == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert sum(right) / len(right) > 0.95
    assert mixing.mixed_rates(docs.limit(0), labels, mixing.quality_domain(), mixing.TARGETS).count() == 0
    even = mixing.mixed_rates(docs, labels.limit(0), mixing.quality_domain(), mixing.TARGETS).first()
    assert even["posteriors"] == {"high": 0.5, "low": 0.5}


def brute_rates(tokens, member, want, rounds=50_000):
    """Nonnegative least squares by plain projected gradient with momentum-free small steps."""
    a = tokens[None, :] * member.T
    r = np.ones(len(tokens))
    step = 1 / np.linalg.eigvalsh(a @ a.T)[-1]
    for _ in range(rounds):
        new = np.maximum(0, r - step * (a.T @ (a @ r - want)))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return float(np.linalg.norm(a @ r - want) / want.sum())


@pytest.mark.parametrize("targets", [{"a": 1, "b": 1, "c": 1}, {"a": 1.0}, {"a": 0.9, "c": 0.1}, {"b": 5, "c": 1}])
def test_rates_are_least_squares(spark, targets):
    rng = np.random.default_rng(6)
    tokens, member = rng.integers(0, 60, 90).astype(float), rng.dirichlet([0.5, 0.5, 0.5], 90)
    member[0] = [1, 0, 0]
    table = spark.createDataFrame([(float(t), m.tolist()) for t, m in zip(tokens, member, strict=True)], f"{mixing.TOKENS} double, {mixing.MEMBER} array<double>")
    fit = mixing.fitted(table, ["a", "b", "c"], targets)
    weight = np.array([targets.get(n, 0.0) for n in "abc"], float)
    want = weight / weight.sum() * (tokens[:, None] * member).sum()
    rates = np.array([r[0] for r in table.select(mixing._rate(fit.step)).collect()])
    assert (rates >= 0).all() and np.allclose((rates * tokens) @ member, fit.after) and np.allclose(fit.wanted, want)
    # no rates can leave less than the least; the brute force may be short of it
    assert fit.residual < brute_rates(tokens, member, want) + 1e-3


def test_mixing_of_odd_rows(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    got = mixing.mixed_rates(docs, labels, mixing.quality_domain(), mixing.TARGETS).collect()
    assert sorted((repr((r["doc_id"], r["tokens"])) for r in got)) == sorted(repr((i, len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")))) for i, t in corpus)
    assert all(abs(sum(r["posteriors"].values()) - 1) < 1e-9 for r in got) and got[0]["key"] == 1
    assert mixing.mixed_rates(empty, labels, mixing.quality_domain(), mixing.TARGETS).count() == 0


# licences
def brute_licences(rows):
    texts = [(i, p or "", t or "") for i, p, t in rows]
    forms = [(n, licences.template_words(t)) for n, ts in licences.TEMPLATES.items() for t in ts]
    vocabulary = {w for _, ws in forms for w in ws}
    df = {w: sum(w in set(licences.template_words(t)) for *_, t in texts) for w in vocabulary}

    def weight(w):
        return math.log((1 + len(texts)) / (1 + df.get(w, 0))) + 1 if w in vocabulary else math.log(1 + len(texts)) + 1

    def vector(ws):
        v = {w: ws.count(w) * weight(w) for w in ws}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    def parts(t):
        paragraphs = re.split(r"\n[ \t\r]*\n", t)
        yield 0, t.split("\n")
        yield 1, [p for p in paragraphs if "\n" in p]
        yield 2, [t] if len(paragraphs) > 1 else []

    shapes = [(vector(f), n) for n, f in forms]
    own = []
    for _, _, t in texts:
        best, held = None, 0
        for _, some in parts(t):
            here = 0
            for part in some:
                if ws := licences.template_words(part):
                    v = vector(ws)
                    hits = [(-round(sum(v.get(w, 0) * x for w, x in f.items()), 9), n) for f, n in shapes]
                    if -min(hits)[0] >= licences.THRESHOLD:
                        best = min(hits) if best is None else min(best, min(hits))
                        here += len(ws)
            held = max(held, here)
        own.append((best, best is not None and held >= licences.FILE_SHARE * len(licences.template_words(t))))
    files = {}
    for (_, p, _), (best, is_file) in zip(texts, own, strict=True):
        if is_file:
            d = p.rpartition("/")[0]
            files[d] = min(best, files.get(d, best))
    out = []
    for (i, p, _), (best, _) in zip(texts, own, strict=True):
        if best:
            out.append((i, best[1], "own", None))
            continue
        parts = p.rpartition("/")[0].split("/")
        above = ["/".join(parts[:k]) for k in range(len(parts), 0, -1)] + [""]
        near = next((d for d in above if d in files), None)
        out.append((i, files[near][1], "inherited", near) if near is not None else (i, None, "none", None))
    return sorted(map(repr, out))


def test_licences(spark):
    apache, gpl = "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", apache), (2, "a/b/x", "text without"), (3, "a/b/c/y", "prose\n" + gpl), (4, "z/q", "none"), (5, "a/b/c/w", "x" * 3000), (6, None, None), (7, "", ""), (8, "LICENSE", "Released under the MIT License."), (9, "a/b/COPYING", gpl)]
    rows += [(10, "a/b/x2", "we licensed a song and paid for the license of a hall"), (11, "a/b/c/d/e/f", "plain"), (12, "a/b/c/d/e/f", "plain"), (12, "a/b/c/d/e/f", "plain"), (None, "a/k", "null id"), (13, "a/k", "licensed under CC BY-NC 4.0\nmore " + "words " * 40)]
    wrapped = {n: "\n".join(textwrap.wrap(max(ts, key=len), 70)) for n, ts in licences.TEMPLATES.items()}
    rows += [(20, "m/LICENSE", "The MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped["MIT"]), (21, "m/src/x.c", "int main"), (22, "bsd/COPYING", wrapped["BSD-3-Clause"] + "\n"), (23, "bsd/y", "text\n\n" + wrapped["Apache-2.0"] + "\n\n" + "more prose of no licence " * 60), (24, "r/s", "All rights reserved.\nprose"), (25, "r/t", "the rights of all were reserved for another evening of long prose and talk")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, path string, text string, licence string, n int").repartition(3)
    found = {r["doc_id"]: (r["licence"], r["source"]) for r in licences.scanned(frame, F.col("path")).collect()}
    assert found[20] == ("MIT", "own") and found[21] == ("MIT", "inherited") and found[22] == ("BSD-3-Clause", "own")
    assert found[23] == ("Apache-2.0", "own") and found[24] == ("all-rights-reserved", "own") and found[25][1] != "own"
    got = licences.scanned(frame, F.col("path"))
    assert sorted(repr((r["doc_id"], r["licence"], r["source"], r["directory"])) for r in got.collect()) == brute_licences(rows)
    assert licences.scanned(frame.limit(0), F.col("path")).count() == 0


def test_documents_without_paths_inherit_nothing(spark, tmp_path):
    rows = [(1, "Released under the MIT License.", "en", "s"), (2, "plain prose", "en", "s"), (3, None, "en", "s"), (2, "plain prose", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries()["op6_licences"](spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "licence", "cosine", "source", "directory"]
    assert sorted((r["doc_id"], r["licence"], r["source"], r["directory"]) for r in got.collect()) == [(1, "MIT", "own", None), (2, None, "none", None), (2, None, "none", None), (3, None, "none", None)]


def test_the_query_passes_whole_licence_texts_on(spark, tmp_path):
    mit = "\n".join(textwrap.wrap(max(licences.TEMPLATES["MIT"], key=len), 70))
    mpl = max(licences.TEMPLATES["MPL-2.0"], key=len)
    rows = [(1, mit, "en", "s"), (2, "plain prose", "en", "s"), (3, "prose", "de", "s"), (4, "This work is licensed under the GNU General Public License, version 3.", "en", "s"), (5, None, "en", "s")]
    rows += [(6, mpl, "fr", None), (7, "prose", "fr", None), (8, "prose", None, None), (9, "prose", None, "s"), (10, mit + "\nprose of no licence" * 200, "en", "t"), (11, "prose", "en", "t"), (None, "prose", "en", "s")]
    rows += [(12, "Released under the MIT License.\n" * 40, "en", "u"), (13, "prose", "en", "u")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["licence"], r["source"], r["directory"]) for r in queries()["op6_licences"](spark, f"file://{tmp_path}").collect()}
    assert got[1] == ("MIT", "own", None) and got[4] == ("GPL-3.0", "own", None) and got[6] == ("MPL-2.0", "own", None)
    assert got[2] == got[5] == got[None] == ("MIT", "inherited", "s/en") and got[7] == ("MPL-2.0", "inherited", "/fr")
    assert {got[i] for i in (3, 8, 9, 11, 13)} == {(None, "none", None)} and got[12][:2] == ("MIT", "own") and len(got) == len(rows)


# personal data
def test_personal_data(spark, docs, corpus, empty):
    texts = [t or "" for _, t in corpus] + ["a@b.c..d@e.f a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111-1111-1111-1111 4111 1111 1111 1112 " + "1 2 " * 3000, "++1 23 456 78 90 ( +12345 tel 555-123-4567", "é" * 5 + "日本 a@b.cc 😀 q@r.ss", "@" * 2000 + "a" * 3000 + "@" + "b." * 2000 + "c", "1" * 4000]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, value):
        d = re.sub("[^0-9]", "", value)
        luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    want = []
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, t) if passes(kind, m[0]))
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        want.append((i, *(sum(s[3] == k for s in spans) for k in patterns), hashlib.sha256(line.encode()).hexdigest(), line))
    got = {r["doc_id"]: r for r in pii.digests(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, *counts, sha, line in want:
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] == [*counts, sha], texts[i][:80]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    assert pii.digests(pii.personal_data(docs)).count() == len(corpus) and pii.digests(pii.personal_data(empty)).count() == 0


def test_added_spans(spark):
    """Added spans against brute force: accepted candidates that overlap no base span, with all places checked."""
    texts = [f"call me at 555-123-{i:04d} or phone (555) 123-4567" for i in range(60)] + [f"mail ann{i} (at) host (dot) com, from Dr. Maria Lopez" for i in range(60)]
    texts += [f"version 1.2.3.{300 + i} of page 555-123-4567-9" for i in range(60)] + ["she lives at 12 Baker Street, London. Mail a@b.com", "", "+1 555-123-4567 call 555-123-4567", "x 078-05-1120 ssn 078-05-1120", "a.b@c-d.org " * 400 + "call 555-123-4567 " * 400]
    frame = spark.createDataFrame([*enumerate(texts), (1000, None)], "doc_id long, text string").repartition(4)
    found = pii.candidates(frame)
    model = pii.trained(found)
    want, places = {}, 0
    for r in found.withColumn("scores", F.transform("spans", lambda s: pii.score(model, s))).collect():
        text = texts[r["doc_id"]] if r["doc_id"] < 1000 else ""
        base = {(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["base"]}
        more = {(s["start"], s["rank"], s["end"], s["kind"]) for s, z in zip(r["spans"], r["scores"], strict=True) if not s["base"] and z >= 0}
        want[r["doc_id"]] = sorted(base) + [s for s in sorted(more) if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        for s in r["spans"]:
            pattern = (pii.BASE | pii.LOOSE if s["rank"] >= 4 else pii.BASE)[s["kind"]]
            if s["kind"] in ("phone", "id", "name") and "(" not in pattern[:1]:
                places += text[s["start"] : s["end"]].strip() != ""
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_data(frame).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and places > 100
    kinds = {s[3] for v in got.values() for s in v}
    assert {"phone", "email"} <= kinds and any(len(v) > 400 for v in got.values())
    assert all(texts[i][s[0] : s[2]].startswith(("555-", "(555)", "+1")) for i, v in got.items() if i < 1000 for s in v if s[3] == "phone")


def test_many_matches_take_time_in_proportion(spark):
    import time

    text = "".join(f"u{i}@h.org 555-123-{i % 10000:04d} " for i in range(16_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.personal_data(frame.limit(0)).collect()
    began = time.time()
    assert len(pii.personal_data(frame).first()["base"]) == 16_000
    assert time.time() - began < 30


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(7)
    truth = rng.random(4000) < 0.4
    accuracy = [0.95, 0.85, 0.7, 0.6]
    votes = [tuple(int(1 if (rng.random() < a) == t else -1) for a in accuracy) for t in truth]
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    model = pii.fit([("phone", v, (), n) for v, n in sorted(counts.items())])
    found = [(model.reliability[name][1][0] + model.reliability[name][-1][1]) / 2 for name in pii.LABELERS]
    assert found == sorted(found, reverse=True) and abs(found[0] - 0.95) < 0.05
    z = [model.bias + model.kinds["phone"] + sum(w * x for w, x in zip(model.weights, v, strict=True)) for v in votes]
    assert np.mean((np.array(z) > 0) == truth) > 0.93


# pipeline and registry
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = seen.count()
        seen = stage(spark, seen, SF)
        seen = spark.createDataFrame(seen.collect(), seen.schema)
        assert 0 < seen.count() <= before * 1.2
        assert seen.columns == columns if name != "pieces" else set(columns) < set(seen.columns)
    ids = {r["doc_id"] for r in seen.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids and out.where("not lossless").count() == 0
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & ids) <= 0.2 * len(toxic)


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents with nulls, repeats, near copies, toxic words and columns that clash, and their labels."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(" ".join(rng.choice(words, 14)) for _ in range(3))
        bad, junk = i % 8 == 3, i % 5 == 0
        text += " zzqk" + words[i % 60] if bad else ""
        text = text.replace(" ", " ### ") if junk else text
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(not junk), int(bad)))
    rows += [(400 + i, rows[i][1]) for i in range(0, 30, 3)] + [(500 + i, rows[i][1] + "\n" + " ".join(rng.choice(words, 3))) for i in range(1, 30, 3)]
    rows += [(600, None), (601, ""), (None, "no id of its own here"), (None, None), rows[7], rows[9], (602, " \n\t"), (603, "shared line of text\n" + rows[2][1]), (604, "shared line of texts\n" + rows[4][1])]
    labels += [(None, 1, 1), (2, None, None)]
    folder = tmp_path_factory.mktemp("odd")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("flagged", "tokens", "rate", "copies", "n_lines", "key", "part", "rep", "posteriors"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    frame.write.parquet(f"file://{folder}/documents.parquet")
    frame.limit(0).write.parquet(f"file://{folder}/none/documents.parquet")
    for at in (folder, f"{folder}/none"):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{folder}"


def key(doc_id, text):
    return (-1 if doc_id is None else doc_id, "" if text is None else text)


def test_stages_against_brute_force(spark, odd_folder):
    """Each stage of the pipeline against plain Python over its own input."""
    from tests.llm.test_texts import agenda, brute_join, dropped_by_brute_force
    from tripleweave.llm import pieces, tokencounts

    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    labels = spark.read.parquet(f"{odd_folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]

    def rows(df):
        got = df.collect()
        assert df.columns[: len(docs.columns)] == docs.columns
        assert all(r[c] == f"own {c}" for r in got for c in own)
        return sorted(key(r["doc_id"], r["text"]) for r in got), spark.createDataFrame(got, df.schema)

    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # toxicity: word and n-gram sets and a sum of weights, text by text
    chain = toxicity.train(docs, labels, toxicity.label_chain())
    flagged = []
    for i, t in before:
        held, p = {chain.vocabulary[f] for f in toxicity.features(t) if f in chain.vocabulary}, []
        for link in chain.links:
            z = link.bias + sum(float(link.weights[f]) for f in held) + sum(a * b for a, b in zip(link.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-z)))
        flagged.append(bool(toxicity.WORDS.search(t or "")) and p[-1] >= chain.links[-1].threshold)
    got, kept = rows(stages["toxicity"](spark, docs, odd_folder))
    assert got == sorted(key(i, t) for (i, t), f in zip(before, flagged, strict=True) if not f) and 30 < sum(flagged) < 80
    # line dedup
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = sorted(key(i, t) for i, t, lost in dropped_by_brute_force(before) if not lost or t.strip(" "))
    got, kept = rows(stages["line_dedup"](spark, kept, odd_folder))
    assert got == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept.collect())
    # n-gram join
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = brute_join(before, 5, 80)
    got, kept = rows(stages["ngram_join"](spark, kept, odd_folder))
    assert got == sorted(key(i, t) for i, t in before if i is None or groups[i][1] == i)
    # mixing
    before = kept.collect()
    found = {(r["doc_id"], r["text"]): r for r in mixing.mixed_rates(kept, labels, mixing.quality_domain(), mixing.TARGETS, anchor="high").collect()}
    got, kept = rows(stages["mixing"](spark, kept, odd_folder))
    assert got == sorted(key(r["doc_id"], r["text"]) for r in before if found[r["doc_id"], r["text"]]["posteriors"]["high"] >= 0.5 or found[r["doc_id"], r["text"]]["copies"] > 0)
    high = sum(x["tokens"] * x["posteriors"]["high"] for x in found.values())
    wanted = sum(x["tokens"] * x["rate"] * x["posteriors"]["high"] for x in found.values())
    assert abs(high - wanted) < 0.02 * high
    # pieces
    model = pieces.model(tokencounts.tokenizer_path("piece_bpe_32k.model"))
    for r in stages["pieces"](spark, kept, odd_folder).collect()[:25]:
        want, owner = [], np.array([pieces.owner_key(r["doc_id"], r["text"] or "")], np.uint64)
        for n, word in enumerate(pieces.WORDS.findall(" " + r["text"]) if r["text"] else []):
            if not all(model.char_at[ord(c)] >= 0 for c in word):
                want = None
                break
            with np.errstate(over="ignore"):
                draw = pieces.mixed(owner + np.uint64(n) * pieces.GOLD)
                k = pieces.mixed(np.array([pieces.word_key(word, 1)], np.uint64) + (draw + np.uint64(1)) * pieces.GOLD)[0]

            def skip(a, mid, b, k=k):
                span = np.array([a << 42 | (mid - a) << 21 | (b - a)], np.uint64)
                with np.errstate(over="ignore"):
                    return int(pieces.mixed(k ^ pieces.mixed(span * pieces.GOLD))[0]) < int(0.1 * 2.0**64)

            want += agenda(word, model, skip)
        assert r["lossless"] and (want is None or r["pieces"] == want)


def test_pipeline_of_odd_tables(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    out = corpus_pipeline.run(spark, odd_folder)
    assert set(out.columns) == {*docs.columns, "pieces", "lossless"} and out.where("not lossless").count() == 0
    texts = {r["doc_id"] for r in out.collect()}
    assert {None, 600, 601} <= texts and 400 not in texts
    assert corpus_pipeline.run(spark, f"{odd_folder}/none").count() == 0


def test_every_query_is_registered():
    found = entry.queries()
    assert [n for n in found if re.match(r"op\d+_", n)] and {int(re.match(r"op(\d+)_", n)[1]) for n in found if n.startswith("op") and re.match(r"op\d+_", n)} == set(range(1, 11))
    assert "pipeline" in found


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "tripleweave"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for name in os.listdir(f"{root}/tripleweave"):
        if name != "llm":
            os.symlink(f"{root}/tripleweave/{name}", tmp_path / "tripleweave" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bgp_chain' in q and 'pipeline' not in q and e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{root}/__spark_entry__.py").read())
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
