"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content with the digest of the tokenizer file. Keys
that the cache lacks are gathered once each, encoded, and appended to the cache; every row then
takes its count from the cache by a join.

For a tokenizer that drops white space, normalising makes every run of blanks, tabs and line ends
one blank. Such a tokenizer also splits a text into pieces that it encodes one by one, so a worker
remembers the counts of pieces and asks the library only for pieces that it has not met.

Defined results: a null text counts as empty and has 0 tokens; rows that repeat are counted each;
an empty table gives an empty result; columns that clash with those of the cache are never read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import bounded_batches, frugal, written
from tripleweave.sources.folders import scratch

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Pieces that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 600_000

# The split pattern of word_bpe_49k.json, for lower-case Latin-1 text.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: The same pattern as such tokenizer files write it.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of which the pattern above and the library are known to agree.
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
SPECIAL = "<|"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Digest of the tokenizer file: another file never reuses counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounter:
    """Counts of ``word_bpe_49k.json``, the same as the library's for every text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(pieces)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for piece, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[piece] = len(got)

    def pieces(self, text: str) -> list[str]:
        """Parts whose counts add up to that of the text."""
        if SPECIAL in text:
            return [text]
        if PLAIN.fullmatch(text):
            return PIECES.findall(text.lower())
        out: list[str] = []
        for word in re.split("[ \\t\\n\\r]+", text):
            out += PIECES.findall(word.lower()) if PLAIN.fullmatch(word) else [word]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        missing = set().union(*split) - self.known.keys()
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = set().union(*split)
        self.learn(missing)
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in split]


class LibraryCounter:
    """Counts of any other tokenizer file, whole texts at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: library.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.encode = lambda texts: library.encode_batch_fast(texts, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts)]


@functools.lru_cache(maxsize=4)
def drops_spaces(path: str) -> bool:
    """Whether the file, whatever its name, splits texts as ``WordCounter`` does and drops white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    parts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = (parts[0].get("pattern") or {}).get("Regex"), parts[0].get("behavior"), parts[0].get("invert")
    tidied = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers") or []]
    return split == (WORD_SPLIT, "Removed", True) and tidied == ["NFC", "Replace", "Lowercase"]


@functools.lru_cache(maxsize=4)
def counter(path: str):
    return WordCounter(path) if drops_spaces(path) else LibraryCounter(path)


def _parts(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` characters, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cache: str | None = None, over: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    ``tokenizer`` is the path of a tokenizer file that every executor has; ``cache`` that of a
    Parquet table of earlier counts, which is extended. Without one, a new cache is made.
    """
    spark = bounded_batches(docs).sparkSession
    version = version_digest(tokenizer)
    fresh = cache is None
    cache = cache or scratch(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")) if drops_spaces(tokenizer) else text
    texts = docs.select(F.sha2(content, 256).alias("content"), content.alias("text"))
    keyed = written(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("content")), "keyed")

    # the first of equal texts goes on from each task, so copies collapse before the shuffle
    missing = texts.groupBy("content").agg(F.first("text").alias("text"))
    if not fresh:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("content")
        lacking = keyed.select("content").distinct().join(known, "content", "left_anti")
        missing = missing.join(lacking, "content", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer).counts
        for batch in batches:
            rows = batch["text"].to_pylist()
            out: list[int] = []
            for a, b in _parts([len(x) for x in rows], 2_000_000):
                out += counts(rows[a:b])
            yield pa.RecordBatch.from_arrays([batch["content"], pa.array([version] * len(out), pa.string()), pa.array(out, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    missing.mapInArrow(frugal(encode), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    counts = counts.select("content", "n_tokens")
    if not fresh:
        # two runs that append at once may both add a key, with the same count
        counts = written(counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    # both sides come straight from tables, so that partitions with a hot text (empty ones, say) are split
    out = keyed.join(counts, "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
