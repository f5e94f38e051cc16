import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n, sep=" "):
    return sep.join(rng.choice(WORDS) + rng.choice(["", "", "x", "y", "zz"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows ``(doc_id, text)``: prose, copies, near copies, shared passages, odd texts, nulls and repeated rows."""
    rng = random.Random(5)
    rows = [(i, "\n".join(prose(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    passage = prose(rng, 60)
    for i in range(60, 80):
        base = rows[i % 7][1].split(" ")
        if len(base) > 12:
            base[rng.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base)))
    rows += [(i, rows[i - 80][1]) for i in range(80, 90)]
    rows += [(i, passage + "\n" + prose(rng, 20)) for i in range(90, 100)]
    odd = [None, "", "   \n\t", "one", "one two", "ONE  two", "É́ﬁ İstanbul ß 日本語 😀", "▁mark", "<|endoftext|> it's", "x" * 5000, prose(rng, 6000), "a\x00b", "\n\n\n", "card 4111 1111 1111 1111 or +1 (389) 555-5010, a.b@c-d.org; 10.0.0.256 and 192.168.1.1"]
    rows += [(100 + i, t) for i, t in enumerate(odd)]
    rows += [rows[3], rows[3], (None, "no id here at all"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators use themselves."""
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    from pyspark.sql import functions as F

    for name in ("key", "n", "content", "fingerprint", "n_lines", "tokens", "rate", "pieces", "flagged", "licence", "spans", "grp", "exact", "line", "block"):
        frame = frame.withColumn(name, F.lit(1))
    return frame.repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
