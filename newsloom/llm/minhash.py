"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each five-word shingle is hashed once. The hash's top bits name its bin; a bin keeps its least hash. To find
the least of every bin at once, one sentinel a bin (the bin's largest hash) joins the hashes; after sorting,
the first of each run is the bin's minimum, or the sentinel where the bin is empty. Empty bins are filled by
optimal densification: a bin probes others in an order of its own until it meets a full one, so each empty bin
draws its donor independently and alike for all documents. The low 8 bits of each bin are packed; likeness is
the share of equal bins, less what equal low bits owe to chance: (m - 2^-8) / (1 - 2^-8), at least 0.

Defined results: words are lower-cased and parted by ASCII white space; a text of one to four words is one
shingle; a null or empty text has the fingerprint of no shingles (all zero), like any other such text;
a row without a next document has likeness 0 to it; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import written

BINS, WORDS, PROBES, LOW_BITS = 256, 5, 12, 8
_TOP = 56  # the bits below the bin's number
_EMPTY = (1 << _TOP) - 1
_HEX = [f"{i:02x}" for i in range(256)]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, an array of BINS low bytes (less 128, as tinyint) of column `text`. Columns that start with _fp_ are in use meanwhile."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("_fp_words", F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col("_fp_words"), F.size("_fp_words")
    many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
    few = F.array(F.xxhash64(*(F.get(h, F.lit(k)) for k in range(WORDS))))
    hashes = F.when(n >= WORDS, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))
    sentinels = F.lit([_signed(b << _TOP | _EMPTY) for b in range(BINS)])
    df = df.withColumn("_fp_sorted", F.sort_array(F.concat(hashes, sentinels))).drop("_fp_words")
    s = F.col("_fp_sorted")
    bin_of = lambda x: F.shiftrightunsigned(x, _TOP)
    firsts = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    low = F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) != _EMPTY, (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint")))
    df = df.withColumn("_fp_bins", low).drop("_fp_sorted")
    m = F.col("_fp_bins")
    df = df.withColumn("_fp_full", F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda c: F.get(m, c).isNotNull()))
    full = F.col("_fp_full")

    def filled(p: Column) -> Column:
        probes = [F.get(m, F.pmod(F.xxhash64(p, F.lit(j)), F.lit(BINS)).cast("int")) for j in range(PROBES)]
        nearest = F.array_min(F.transform(full, lambda c: F.struct(F.xxhash64(p, F.lit(-1), c).alias("h"), F.get(m, c).alias("v"))))["v"]
        return F.coalesce(F.get(m, p), *probes, nearest, F.lit(-128).cast("tinyint"))

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), filled)).drop("_fp_bins", "_fp_full")


def packed(bins: Column) -> Column:
    """The fingerprint's bytes as lowercase hex digits."""
    return F.array_join(F.transform(bins, lambda x: F.get(F.lit(_HEX), x.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """The bias-corrected estimate of the shingles' Jaccard similarity."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, n_chars: each distinct doc_id with the next larger one, the first after the last.

    Ids are range-partitioned; only each partition's least id, a row a partition, is compared across partitions."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))
    dealt = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    heads = dealt.groupBy("part").agg(F.min("doc_id").alias("head"))
    by_part = Window.orderBy("part")  # a row a partition
    tails = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.min("head").over(by_part)).alias("after"))
    inside = dealt.withColumn("inner", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(tails, "part").select("doc_id", F.coalesce("inner", "after").alias("next_id"), "n_chars")


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id, text, next_id, edited: the last quarter replaced by the next document's start.

    Rows that share a doc_id take the same next document; where that repeats, the smallest of its starts.
    Rows without doc_id have no next document and lose their last quarter."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.where("doc_id is not null")
    wanted = order.select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), F.floor(F.col("n_chars") / 4).cast("int").alias("most"))
    starts = known.join(wanted, "doc_id").select("for_id", F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, most)").alias("start"))
    starts = starts.groupBy(F.col("for_id").alias("doc_id"), "next_id").agg(F.min("start").alias("start"))
    both = known.join(starts, "doc_id").unionByName(texts.where("doc_id is null").withColumns({"next_id": F.lit(None).cast("long"), "start": F.lit("")}))
    quarter = "cast(floor(char_length(text) / 4) as int)"
    edited = F.concat(F.expr(f"substring(text, 1, char_length(text) - {quarter})"), F.expr(f"substring(start, 1, {quarter})"))
    return both.select("doc_id", "text", "next_id", edited.alias("edited"))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text), of their edited texts, and the likeness to those and to the next document."""
    made = edited_texts(docs.select("doc_id", "text"), next_ids(docs))
    made = with_fingerprint(with_fingerprint(made, "text", "own"), "edited", "changed")
    kept = written(made.select("doc_id", "next_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "changed"), "fingerprints")
    others = kept.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("own").alias("other"))
    return kept.join(others, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"),
    )
