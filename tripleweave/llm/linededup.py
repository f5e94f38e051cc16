"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared without case and with runs of white space as one blank. Equal lines keep their
earliest place, by (doc_id, line number). A line also goes if an earlier line lies within one edit
(insertion, deletion or substitution of a character). Every line that is not blank takes part in both.

Texts are split once: lines with their hashes and first keys are written, and each distinct line takes part
in the join once, by its earliest place.

Deleting one character from a line gives as many variants as it has characters, so the variants
are emitted in blocks, coarse ones first. The first keys delete the second or the first half of the line:
the hash of the half that is left stands for all single deletions in the other. Two lines within one edit
share one of the two for certain. In keys that few lines share, pairs are verified by edit distance. In keys
that more share (lines that begin alike, say) the deleted half is cut finer and the same is done inside it;
where many still meet, every single deletion becomes a key of its own. Lines that share one of those are
within one edit of each other, so each is only compared with the earliest.

Defined results: a null text counts as empty and gives an empty one; blank lines are always kept; null ids come before all others; rows that repeat an id and a text hold one place, so
neither loses lines to the other; an empty table gives an empty one; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import small_side, written

#: Shortest lines that are compared exactly and by edits: all but blank ones.
LINE_CHARS, FUZZY_CHARS = 1, 1
#: Lines that share a key up to which all pairs are verified.
PAIRED = 3


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(dk, rk, line_no, norm, h1, h2, k1 .. k4)`` of all lines that take part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(_place(id_col).alias("dk"), F.xxhash64(text).alias("rk"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    # most lines have no white space but single blanks, and are spared the search for it
    loose = F.contains("line", F.lit("  "))
    for blank in "\t\r\f\v":
        loose = loose | F.contains("line", F.lit(blank))
    norm = F.lower(F.trim(F.when(loose, F.regexp_replace("line", r"\s+", " ")).otherwise(F.col("line"))))
    lines = source.select("dk", "rk", "line_no", norm.alias("norm")).where(F.length("norm") >= LINE_CHARS).withColumn("len", F.length("norm"))
    lines = lines.withColumns({"ha": F.expr(HALF.format(n="len")), "hb": F.expr(HALF.format(n="(len + 1)"))})
    keys = {}
    for k, (h, other) in enumerate((("ha", F.lit(True)), ("hb", F.col("hb") != F.col("ha")))):
        open_ = other & (F.col("len") >= FUZZY_CHARS)
        keys[f"k{2 * k + 1}"] = F.when(open_, F.xxhash64(F.lit(1), h, F.expr(f"left(norm, {h})")))
        keys[f"k{2 * k + 2}"] = F.when(open_, F.xxhash64(F.lit(2), h, F.expr(f"substring(norm, len - {h} + 1)")))
    return lines.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), "norm")} | keys)


def _place(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


#: The length of the two halves of a line. It is rounded down, so that lines of nearly one length agree on it; a
#: line also uses the length that one longer by a character would.
HALF = "int(({n} div shiftleft(1, greatest(0, int(log2({n})) - 4) + 1)) * shiftleft(1, greatest(0, int(log2({n})) - 4)))"
#: The first keys of a line, with the length of a half, and what is left on either side of the deleted half.
HALVES = """
explode(array(
  named_struct('key', k1, 'b', ha, 'left', ha, 'right', 0),
  named_struct('key', k2, 'b', ha, 'left', 0, 'right', ha),
  named_struct('key', k3, 'b', hb, 'left', hb, 'right', 0),
  named_struct('key', k4, 'b', hb, 'left', 0, 'right', hb)
)) as v
"""

#: Every block of deletions of a text ``z``: for each block size b, i blocks are left of the gap, r right of it.
#: The hashes of what lies left and right are made once for each place.
BLOCKS = """
explode(flatten(flatten(transform(bs, b -> transform(
  array(named_struct(
    'm', int(len div b),
    'l', transform(sequence(0, int(len div b)), i -> xxhash64(left(z, i * b))),
    'r', transform(sequence(0, int(len div b)), r -> xxhash64(substring(z, len - r * b + 1)))
  )),
  h -> flatten(transform(sequence(0, h.m), i -> transform(
    filter(array(int((len - i * b) div b), int((len - i * b) div b) - 1), r -> r >= 0),
    r -> named_struct('key', xxhash64(parent, b, i, r, h.l[i], h.r[r]), 'b', b, 'left', i * b, 'right', r * b)
  )))
))))) as v
"""

#: Every gap inside a block: the line without the character there, and the line with room for one.
GAPS = """
explode(flatten(transform(sequence(left, length(norm) - right), p -> transform(
  array(norm, concat(left(norm, p), substring(norm, p + 2))),
  w -> named_struct('g1', xxhash64(p, w), 'g2', xxhash64(11, p, w))
)))) as g
"""
#: A block of a shared key is cut into so many parts, and again so many times.
FINER, FINER_LEVELS = 8, 2


def _blocks(lines: DataFrame, *columns: str) -> DataFrame:
    """``lines(z, bs, parent)`` and the keys of all blocks."""
    return lines.withColumn("len", F.length("z")).select(*columns, F.expr(BLOCKS)).select(*columns, F.col("v.*"))


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that different lines have."""
    keys = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    return small_side(written(keys, "line-keys"), 16)


def _counted(met: DataFrame) -> DataFrame:
    return met.join(met.groupBy("key").agg(F.count("*").alias("held")), "key")


def _met(keyed: DataFrame, name: str) -> DataFrame:
    """Lines whose key another line has too, with the number of lines at it."""
    met = keyed.join(_shared(keyed), "key")
    first = F.min(F.struct("dk", "line_no", "norm")).alias("m")
    met = met.groupBy("key", "b", "left", "right", "h1", "h2").agg(first)
    return _counted(written(met.select("key", "b", "left", "right", "h1", "h2", "m.dk", "m.line_no", "m.norm"), name))


def _met_by_halves(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """The same for the first keys. ``forms``: distinct lines without their texts, which only those that meet need."""
    place = ["dk", "line_no", "h1", "h2"]
    spots = forms.select(*place, F.expr(HALVES)).select(*place, "v.*").where("key is not null")
    met = written(spots.join(_shared(spots), "key"), "line-halves")
    needed = written(met.select(*place).distinct(), "line-places")
    texts = lines.select(*place, "norm").join(small_side(needed, 40), place).groupBy("h1", "h2").agg(F.first("norm").alias("norm"))
    return _counted(written(met.join(texts, ["h1", "h2"]), "line-texts"))


def _earlier(one: str, two: str) -> Column:
    return F.struct(f"{one}.dk", f"{one}.line_no") < F.struct(f"{two}.dk", f"{two}.line_no")


#: The time of an edit distance grows with the square of a line's length. What two lines have in common on both
#: sides does not change it, so each of ``PARTS`` parts is taken as the one that differs, and the distance is
#: that of this part alone where all others are equal.
PARTS = 16
WITHIN_ONE = """
exists(sequence(0, {parts} - 1), i ->
  left({a}, i * (least(length({a}), length({b})) div {parts})) = left({b}, i * (least(length({a}), length({b})) div {parts}))
  and right({a}, {rest}) = right({b}, {rest})
  and levenshtein(
    substring({a}, int(i * (least(length({a}), length({b})) div {parts})) + 1, int(length({a}) - i * (least(length({a}), length({b})) div {parts}) - {rest})),
    substring({b}, int(i * (least(length({a}), length({b})) div {parts})) + 1, int(length({b}) - i * (least(length({a}), length({b})) div {parts}) - {rest})),
    1) >= 0)
"""
REST = "int(if(i = {parts} - 1, 0, least(length({a}), length({b})) - (i + 1) * (least(length({a}), length({b})) div {parts})))"


def _near(one: str, two: str) -> Column:
    """Whether two lines lie within one edit."""
    names = {"a": f"{one}.norm", "b": f"{two}.norm", "parts": PARTS}
    within = F.expr(WITHIN_ONE.format(**names, rest=REST.format(**names)))
    return (F.abs(F.length(names["a"]) - F.length(names["b"])) <= 1) & within


def _paired(met: DataFrame) -> DataFrame:
    """``(h1, h2)`` of lines with an earlier one within one edit, at keys that few lines share."""
    few = met.where(F.col("held") <= PAIRED)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & _earlier("x", "y"))
    return pairs.where(_near("x", "y")).select("y.h1", "y.h2")


def near_lines(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """``(h1, h2)`` of lines that have an earlier, different line within one edit."""
    held = ["dk", "line_no", "norm", "h1", "h2"]
    coarse = _met_by_halves(lines, forms)
    gone = _paired(coarse)

    # keys that many lines share: the same again inside the block, twice
    met = coarse
    for level in range(FINER_LEVELS):
        many = met.where(F.col("held") > PAIRED)
        inner = F.expr("substring(norm, left + 1, length(norm) - left - right)")
        many = many.select(*held, F.col("left").alias("l0"), F.col("right").alias("r0"), inner.alias("z"), F.array(F.greatest(F.lit(1), F.expr(f"int(b div {FINER})"))).alias("bs"), F.col("key").alias("parent"))
        finer = _blocks(many, *held, "l0", "r0")
        finer = finer.withColumns({"left": F.col("l0") + F.col("left"), "right": F.col("r0") + F.col("right")}).drop("l0", "r0")
        met = _met(finer, f"line-blocks-{level}")
        gone = gone.union(_paired(met))

    # and where many still meet, every single deletion is a key: its lines are within one edit of each other
    last = met.where(F.col("held") > PAIRED).select("left", "right", *held)
    gaps = last.select("dk", "line_no", "h1", "h2", F.expr(GAPS)).select("dk", "line_no", "h1", "h2", "g.*")
    first = gaps.groupBy("g1", "g2").agg(F.min(F.struct("dk", "line_no", "h1", "h2")).alias("f"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("g1", "g2", "f")
    earlier = F.struct("f.dk", "f.line_no") < F.struct("dk", "line_no")
    later = gaps.join(first, ["g1", "g2"]).where(earlier).select("h1", "h2", F.col("f.h1").alias("f1"), F.col("f.h2").alias("f2")).distinct()
    texts = last.select("h1", "h2", F.struct("norm").alias("y")).dropDuplicates(["h1", "h2"])
    later = later.join(texts, ["h1", "h2"]).join(texts.toDF("f1", "f2", "x"), ["f1", "f2"]).where(_near("x", "y"))
    return gone.union(later.select("h1", "h2")).distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(dk, rk, exact, near)``: the numbers of the lines that each document loses."""
    lines = written(_lines(docs, id_col, text_col), "lines")
    narrow = lines.select("dk", "rk", "line_no", "h1", "h2")
    # the keys follow from the hashes, so the smallest struct is that of the earliest place
    first = F.min(F.struct("dk", "line_no", "ha", "hb", "k1", "k2", "k3", "k4")).alias("f")
    forms = written(lines.groupBy("h1", "h2").agg(first, F.count("*").alias("n")).select("h1", "h2", "n", "f.*"), "line-forms")
    repeated = forms.where("n > 1").select("h1", "h2", F.struct("dk", "line_no").alias("first"))
    near = written(near_lines(lines, forms).withColumn("near", F.lit(True)), "near-lines")
    marked = narrow.join(small_side(repeated, 48), ["h1", "h2"], "left").join(small_side(near, 32), ["h1", "h2"], "left")
    copy = F.coalesce(F.struct("dk", "line_no") > F.col("first"), F.lit(False))
    marked = marked.select("dk", "rk", "line_no", copy.alias("exact"), F.coalesce("near", F.lit(False)).alias("near")).where("exact or near")
    lists = F.collect_set(F.when(F.col("exact"), F.col("line_no"))), F.collect_set(F.when(~F.col("exact"), F.col("line_no")))
    return marked.groupBy("dk", "rk").agg(lists[0].alias("exact"), lists[1].alias("near"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_lines``, ``n_exact`` and ``n_near`` (lines lost).

    Columns of ``docs`` by these three names are replaced.
    """
    added = ("n_lines", "n_exact", "n_near")
    docs = docs.drop(*added)
    drops = written(dropped_lines(docs, id_col, text_col), "dropped").toDF("__dk", "__rk", "__exact", "__near")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c) for c in docs.columns if c != text_col]
    source = docs.select(*kept, F.split(text, "\n", -1).alias("__lines"), _place(id_col).alias("__dk"), F.xxhash64(text).alias("__rk"))
    # every document is moved once, at any size; the lists of lines are the side to be hashed
    joined = source.join(drops.hint("shuffle_hash"), ["__dk", "__rk"], "left")
    none = F.array().cast("array<int>")
    exact, near = F.coalesce("__exact", none), F.coalesce("__near", none)
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.concat(exact, near))
    joined = joined.withColumns({"__left": left, "n_lines": F.size("__lines").cast("long"), "n_exact": F.size(exact).cast("long"), "n_near": F.size(near).cast("long")})
    joined = joined.withColumn(text_col, F.expr("array_join(transform(__left, i -> __lines[i]), '\n')"))
    return joined.select(*docs.columns, *added)
