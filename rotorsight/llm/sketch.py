"""Document fingerprints: threshold-scaled sketches of word shingles, JVM expressions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows
the document and two sketches of very unequal documents stay comparable: of the kept hashes of
one, the share that the other holds estimates containment. The smallest hash of a document always
stays, so that a short one has a sketch, too. Sketches merge: the sketch of two documents' shingles
taken together follows from their sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, id_text, text_hash

#: Words per shingle; share of the hash range that is kept; hexadecimal digits of a hash.
WORDS = 5
FRACTION = 1 / 8
DIGITS = 16

_EMPTY = "cast(array() as array<string>)"


def words(text: Column) -> Column:
    """Parts between white space, as they are; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")


def shingle_hashes(parts: Column, width: int = WORDS) -> Column:
    """Hashes of all runs of ``width`` words (fewer: of the whole sequence), as hex digits."""
    places = F.sequence(F.lit(1), F.greatest(F.size(parts) - width + 1, F.lit(1)))
    return F.when(F.size(parts) == 0, F.expr(_EMPTY)).otherwise(F.transform(
        places, lambda i: F.substring(F.md5(F.array_join(F.slice(parts, i, width), " ")), 1, DIGITS)))


def keep(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch of some hashes: those below the threshold and the smallest, in order."""
    bound = f"{min(int(fraction * 16 ** DIGITS), 16 ** DIGITS - 1):0{DIGITS}x}"
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.expr(_EMPTY))
    return F.array_sort(F.array_union(F.filter(hashes, lambda h: h < bound), least))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of both shingle sets."""
    return keep(F.concat(a, b), fraction)


def containment(a: Column, b: Column) -> Column:
    """Estimated share (0 to 1) of the shingles of ``a`` that ``b`` holds; both empty: 1."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a))


def pack(sketch: Column) -> Column:
    """A sketch as bytes, its hashes one after the other in order."""
    return F.unhex(F.array_join(sketch, ""))


def unpack(packed: Column) -> Column:
    """The sketch that ``pack`` made bytes of."""
    places = F.sequence(F.lit(0), F.octet_length(packed) - 1, F.lit(DIGITS // 2))
    return F.when(F.octet_length(packed) == 0, F.expr(_EMPTY)).otherwise(F.transform(
        places, lambda i: F.lower(F.hex(F.substring(packed, i + 1, F.lit(DIGITS // 2))))))


def as_text(packed: Column) -> Column:
    """A packed sketch as one string, ``DIGITS`` digits per hash."""
    return F.lower(F.hex(packed))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sketch of a text column; each step is a column, evaluated once per row."""
    return df.withColumn("_words", words(F.col(text))).withColumn(
        "_hashes", shingle_hashes(F.col("_words"))).withColumn(
        name, keep(F.col("_hashes"))).drop("_words", "_hashes")


def neighbours(rows: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, k1, h, n) -> (k1, h, before): the row (k1, h, n) before it in order.

    The order is that of doc_id (nulls first), then hash; the row before the first is the last.
    Ids alone are sorted, in ranges; every range hands its last row to the next one, so that only
    one row per range meets in one task.
    """
    thin = cut(rows.distinct().repartitionByRange("doc_id", "h").withColumn(
        "part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("doc_id", "h")
    lasts = thin.groupBy("part").agg(F.max(F.struct("doc_id", "h", "k1", "n")).alias("x")).select(
        "part", F.struct("x.k1", "x.h", "x.n").alias("last"))
    parts = Window.orderBy("part")
    everything = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = lasts.select("part", F.coalesce(
        F.lag("last").over(parts), F.last("last").over(everything)).alias("border"))
    return thin.withColumn("before", F.lag(F.struct("k1", "h", "n")).over(order)).join(
        borders, "part").select("k1", "h", F.coalesce("before", "border").alias("before"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its fingerprint, that of its edited text, and how alike they are.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, next_id. The edited text is the document without its last floor(n_chars / 2) code
    points, followed by as many of the first ones of the next document (all, if it has fewer);
    after the last document comes the first. near_edited and near_next are the estimated
    containments of the document in the edited text and in the next document. Null texts count as
    empty; an empty text has the empty fingerprint. Rows with equal ids follow in the order of
    their hashes, rows without an id come first; rows that repeat as a whole share one place and
    one result. A text of any length is one row, and the sketch keeps its share of it. An empty
    table gives an empty result; other columns are not read.

    Texts and sketches are shuffled once, by document; of each, the part that the document before
    needs once more.
    """
    texts = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("h"),
                        F.coalesce("text", F.lit("")).alias("text"))
    near = neighbours(texts.select("doc_id", "k1", "h", F.length("text").alias("n")))
    sketched = with_sketch(texts, "text", "sketch")
    rows = sketched.groupBy("k1", "h").agg(
        F.max(F.struct("doc_id", "text", pack(F.col("sketch")).alias("sketch"))).alias("own"),
        F.count(F.lit(1)).alias("copies"))
    # Both uses of rows read the same columns, so that Spark shuffles the texts once.
    given = rows.filter("copies > 0").join(near, ["k1", "h"]).select(
        "before.k1", "before.h", F.struct(
            "own.doc_id", F.expr("left(own.text, before.n div 2)").alias("text"),
            "own.sketch").alias("next")).groupBy("k1", "h").agg(F.max("next").alias("next"))
    met = rows.filter("copies > 0").join(given, ["k1", "h"]).select(
        "own.doc_id", "copies", F.length("own.text").alias("n"), F.col("own.sketch").alias("packed"),
        unpack(F.col("own.sketch")).alias("sketch"), unpack(F.col("next.sketch")).alias("next_sketch"),
        F.col("next.doc_id").alias("next_id"),
        F.expr("left(own.text, length(own.text) - length(own.text) div 2) || next.text").alias("edited"))
    return with_sketch(met, "edited", "edited_sketch").select(
        "doc_id", F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "next_id",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
