"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes of a text's word shingles, in ascending order. Sketches of
parts merge into the whole's; two of them estimate resemblance and containment, one the number of distinct
shingles. With fewer than k shingles all of these are exact.

Defined cases: words are runs without white space, A-Z lower-cased; a text of fewer words than a shingle is
one shingle of all its words; a null, empty or blank text has an empty sketch; two empty sketches are alike (1),
an empty and another one are not (0); repeated rows are neighbours in the order of documents, in the order of
their texts' hashes; null doc_ids come last in descending order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
K = 128
_LOWEST = -(2**63)


def _word_hashes(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_sketch(rows: DataFrame, text: Column, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds the sketch of text as an array column. Word hashes are a step of their own, so that they are made once for each row."""
    words, hashes = f"{name}__words", f"{name}__shingles"
    rows = rows.withColumn(words, _word_hashes(F.coalesce(text, F.lit(""))))
    some = F.transform(F.sequence(F.lit(0), F.size(words) - shingle), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(shingle)]))
    few = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array(reduce(lambda a, j: F.xxhash64(a, F.coalesce(F.get(F.col(words), F.lit(j)), F.lit(0))), range(shingle), F.lit(shingle))))
    rows = rows.withColumn(hashes, F.when(F.size(words) >= shingle, some).otherwise(few))
    return rows.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(words, hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K, both: Column | None = None) -> Column:
    """The estimated share of common shingles among all of both: of the union's k smallest (both, if it is at hand), those in both."""
    both = merge(a, b, k) if both is None else both
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: (k - 1) over the k-th hash's place in the range of hashes."""
    place = (F.element_at(sketch, -1).cast("double") - float(_LOWEST)) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_groups(rows: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group: its k smallest distinct hashes, over distinct (keys, hash) rows, so that no group is gathered."""
    hashes = rows.select(*keys, F.explode(sketch).alias("hash")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).filter(F.col("rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """doc_id, text and next_text (of the next document in descending doc_id; the last one's is the first), and the window that gives next rows.

    Ids are cut at quantiles; every bucket also gets the largest document of the bucket below it (the lowest
    one gets the largest of all), which is then the next one of its last. So one shuffle of the texts by bucket does,
    and no window goes over all rows. The cut points, `buckets` at most, are the only rows that come to the driver.
    """
    spark = docs.sparkSession
    buckets = buckets or min(2048, max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("place"))
    shares = [i / buckets for i in range(1, buckets + 1)]
    cuts = rows.agg(F.percentile_approx("place", shares, 20 * buckets).alias("cuts"), F.max("place").alias("most")).first()
    tops = sorted({*(cuts["cuts"] or []), *([cuts["most"]] if cuts["most"] is not None else [])})
    last = max(1, len(tops))
    top = F.array(*[F.lit(x).cast("long") for x in tops]) if tops else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(top, lambda t: t < F.col("place"))))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("bucket") + 1) % last).alias("bucket"), F.lit(True).alias("guest"))
    rows = rows.withColumn("at", F.explode(F.when(F.array_contains(top, F.col("place")), F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "place", F.col("at.bucket").alias("bucket"), F.col("at.guest").alias("guest"), F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("place"), "tie")
    return rows.withColumn("next_text", F.lead("text").over(order)), order


def fingerprint_documents(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next, distinct_estimate, kept_share (containment of the edited text in the text)."""
    rows, order = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text").withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_sketch(rows, F.col("text"), "sketch", k, shingle)
    rows = with_sketch(rows, F.col("edited"), "edited_sketch", k, shingle).drop("text", "edited")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).filter(~F.col("guest"))
    rows = rows.withColumn("with_edited", merge(F.col("sketch"), F.col("edited_sketch"), k)).withColumn("with_next", merge(F.col("sketch"), F.col("next_sketch"), k))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k, F.col("with_edited")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k, F.col("with_next")).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_estimate"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("kept_share"),
    )
