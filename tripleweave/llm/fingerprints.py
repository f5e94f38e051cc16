"""Document fingerprints: a canonical exact digest.

Canonical form: NFKC, case folding, NFKC again, and every run of white space as one blank with
none at the ends. The fingerprint is the 128-bit xxh3 digest of its UTF-8 bytes. Documents are
grouped by the digest, and inside every bucket of more than one document the canonical bytes are
compared; texts that merely share a digest get different suffixes, so equal fingerprints mean
equal canonical texts and the reverse.

Defined results: a null text counts as empty; empty texts share a fingerprint; rows without an id
come first in the order of documents; rows that repeat an id stay separate and are ordered by text;
an empty table gives an empty table; other columns are ignored. The fingerprint of an edited text is its plain
digest, since that text is no document; likeness to it is decided by the canonical texts themselves.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import bounded_batches, frugal, small_side, written

#: Bytes of text to a range of neighbours, which one task reads as a stream.
RANGE_BYTES = 16 << 20
#: Characters of a text that tell rows with one id apart when ranges are chosen.
PREFIX = 32
NO_ID = -(1 << 63)


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = unicodedata.normalize("NFKC", text.casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, fingerprint)`` for each document, verified byte by byte inside buckets."""
    source = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [digest(canonical(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    prints = written(source.mapInArrow(frugal(run), f"doc_id {id_type}, fingerprint string"), "prints")
    return verified(source, prints, ["fingerprint"])


def verified(source: DataFrame, prints: DataFrame, columns: list[str]) -> DataFrame:
    """``prints`` with a suffix on the first of ``columns`` where a digest stands for several canonical texts."""
    main = columns[0]
    shared = written(prints.groupBy(main).agg(F.count("*").alias("n")).where("n > 1").select(main), "buckets")
    # a bucket may hold a third of all rows: the join is a broadcast, or one whose large partitions are split
    members = written(prints.join(small_side(shared, 64), main, "left_semi").select("doc_id").where("doc_id is not null").distinct(), "members")
    texts = source.join(small_side(members, 24), "doc_id", "left_semi")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                form = [canonical(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(digest, form), pa.string()), pa.array(form, pa.string())], names=["doc_id", main, "form"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    formed = texts.mapInArrow(frugal(forms), f"doc_id {id_type}, {main} string, form string")
    # equal texts collapse before the shuffle, so a hot bucket moves two texts a task at most
    mixed = formed.groupBy(main).agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select(main)
    mixed = written(mixed, "collisions")
    if mixed.isEmpty():
        return prints
    split = formed.join(mixed, main, "left_semi")
    ranks = split.select(main, "form").distinct()
    ranks = ranks.withColumn("k", F.expr(f"row_number() over (partition by {main} order by form)"))
    named = split.join(ranks, [main, "form"]).select("doc_id", main, "k").distinct()
    out = prints.join(named, ["doc_id", main], "left")
    suffix = F.when(F.coalesce("k", F.lit(1)) > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")
    return out.withColumn(main, F.concat(main, suffix)).drop("k")


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
#: Results, and the first and last documents of each range.
WALK = pa.schema([("at", pa.int32()), ("kind", pa.int32()), *OUT, ("text", pa.string())])
DONE, FIRST, LAST = 0, 1, 2


def _result(doc_id, text: str, form: str, following: str, following_form: str) -> tuple:
    edit = edited_text(text, following)
    edit_form = canonical(edit)
    sha = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, digest(form), digest(edit_form), float(edit_form == form), float(form == following_form)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in the order of documents. One predecessor is held; both ends are handed on."""
    at, held, none = TaskContext.get().partitionId(), None, (None,) * (len(OUT) - 1)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = text or ""
            form = canonical(text)
            rows.append((at, FIRST, doc_id, *none, text) if held is None else (at, DONE, *_result(*held, text, form), None))
            held = doc_id, text, form
        yield _batch(rows, WALK)
    if held is not None:
        yield _batch([(at, LAST, held[0], *none, held[1])], WALK)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "following")), strict=True)
        yield _batch([_result(i, t, canonical(t), f, canonical(f)) for i, t, f in rows], OUT)


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every document and its edited text, with their likeness and that to the next document.

    Documents are dealt out by ranges of ids (and of the beginnings of their texts, where an id repeats), so that
    each text is moved once. The last document of a range meets the first of the next one in a join of these
    alone, two for a range; the driver sees the numbers of the ranges and no text.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = max(1, -(-int(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    key, order = F.coalesce("doc_id", F.lit(NO_ID)), [F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))]
    dealt = source.repartitionByRange(ranges, key, F.substring(F.coalesce("text", F.lit("")), 1, PREFIX)).sortWithinPartitions(*order)
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    walked = written(dealt.mapInArrow(frugal(_walk), f"at int, kind int, {fields}, text string"), "walked")
    held = sorted(r["at"] for r in walked.where(F.col("kind") == FIRST).select("at").collect())
    steps = source.sparkSession.createDataFrame([*zip(held, held[1:] + held[:1], strict=True)], "at int, onward int")
    # one row a range
    lasts = walked.where(F.col("kind") == LAST).select("at", "doc_id", "text").join(F.broadcast(steps), "at")
    firsts = walked.where(F.col("kind") == FIRST).select(F.col("at").alias("onward"), F.col("text").alias("following"))
    ends = lasts.join(firsts, "onward").select("doc_id", "text", "following").mapInArrow(frugal(_ends), fields)
    prints = written(walked.where(F.col("kind") == DONE).select(*OUT.names).union(ends), "prints")
    return verified(source, prints, ["fingerprint"]).select(*OUT.names)
