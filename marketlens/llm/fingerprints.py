"""Document fingerprints: the k smallest distinct hashes of a document's word shingles.

Sketches merge (the k smallest of two sketches are the sketch of the union) and estimate resemblance, containment and the
number of distinct shingles. A word is a run of characters other than ASCII white space; a document of fewer than five
words has one shingle of all its words, one without words has none. Everything is a column expression.

Null texts count as empty; two empty sketches are alike (1), an empty and another are not (0); equal texts have equal
fingerprints; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SKETCH = 128
#: Documents of one ordered window, on average.
MOST_RANGES = 4096
WINDOW_ROWS = 2000
BLANKS = r"[ \t-\r]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, BLANKS), lambda word: word != "")
    return F.transform(words, lambda word: F.xxhash64(word))


def shingle_hashes(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` words. ``words`` must be a column of its own, since it is used several times."""
    runs = F.size(words) - (width - 1)
    shifted = [F.slice(words, k + 1, F.greatest(runs, F.lit(0))).alias(f"w{k}") for k in range(width)]
    full = F.transform(F.arrays_zip(*shifted), lambda run: F.xxhash64(run))
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.when(runs > 0, full).otherwise(short)


def bottom(hashes: Column, k: int = SKETCH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of the union of two sets from their sketches."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both sketches hold."""
    union = merge(a, b, k)
    both = F.array_intersect(union, F.array_intersect(a, b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union)).cast("double")


def distinct_count(sketch: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of the first set that lies in the second."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared / distinct_count(a, k), F.lit(1.0)))


def as_text(sketch: Column) -> Column:
    """The sketch as hexadecimal numbers of 16 digits, one after another."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def sketched(df: DataFrame, text: str, to: str, width: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """``df`` with the sketch of its column ``text`` in ``to``."""
    names = df.columns
    out = df.withColumn("_words", word_hashes(F.col(text)))
    out = out.withColumn("_shingles", shingle_hashes(F.col("_words"), width))
    return out.select(*[F.col(f"`{c}`") for c in names], bottom(F.col("_shingles"), k).alias(to))


def ranges_of(docs: DataFrame, rows_per_window: int) -> Column:
    """A number that rises with (doc_id, nulls first, hash of the text) and that about ``rows_per_window`` rows share.

    Ids are cut at quantiles, so clumps of ids are spread as well. An id that is such a cut, or null, has a range of its own,
    split by the hash of the text in case many rows bear it.
    """
    rows = docs.count()
    count = min(MOST_RANGES, rows // max(1, rows_per_window))
    parts = [(k + 1) / (count + 1) for k in range(count)]
    found = docs.agg(F.percentile_approx("doc_id", parts, F.lit(8 * MOST_RANGES))).first()[0] if count else None
    cuts = sorted(set(found or []))
    where = F.lit(0)
    if cuts:
        array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        below = F.aggregate(  # a binary search for the number of cuts below the id
            steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(array, at + step) < F.col("doc_id")), at + step).otherwise(at)
        )
        where = 2 * below + F.coalesce(F.try_element_at(array, below + 1) == F.col("doc_id"), F.lit(False)).cast("int")
    piece = F.shiftright(F.xxhash64("text"), 58) + 32
    own = F.col("doc_id").isNull() | (where % 2 == 1)
    return (F.when(F.col("doc_id").isNull(), -1).otherwise(where) * 64 + F.when(own, piece).otherwise(0)).cast("long")


def with_next(docs: DataFrame, columns: list[str], rows_per_window: int = WINDOW_ROWS) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows by doc_id (nulls first, ties by hash of the text), the first
    after the last. Inside a range that is a window; the last row of a range looks up the first of the next.
    """
    place = ranges_of(docs, rows_per_window)
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    follow = F.lead(F.struct(*columns)).over(inside)
    dealt = docs.withColumn("_range", place)
    ranked = dealt.select("*", F.row_number().over(inside).alias("_rank"), follow.alias("_next"))
    ranges = docs.select(place.alias("_range")).distinct()
    order = Window.orderBy("_range")
    after = F.coalesce(F.lead("_range").over(order), F.min("_range").over(Window.partitionBy()))
    heads = ranked.filter("_rank = 1").select(F.col("_range").alias("_after"), F.struct(*columns).alias("_head"))
    heads = ranges.select("_range", after.alias("_after")).join(heads, "_after").select("_range", "_head")
    joined = ranked.join(heads, "_range", "left").withColumn("_follow", F.coalesce("_next", "_head"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_follow.{c}").alias(f"next_{c}") for c in columns])


def document_fingerprints(docs: DataFrame, width: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter comes from the next document's head."""
    plain = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(sketched(plain, "text", "sketch", width, k), ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - moved), F.substr("next_text", F.lit(1), moved))
    rows = sketched(rows.withColumn("edited", edited), "edited", "edited_sketch", width, k)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )
