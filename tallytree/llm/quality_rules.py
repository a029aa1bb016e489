"""Quality rules: base counts of a text, and lines that too many documents of one host share.

Everything is SQL functions. Lines are normalised and hashed; the documents that
hold a line are counted per host; lines above the limit are taken out, and documents that lose most of
their words are rejected. Counts are combined before the shuffle, and hosts or lines with a
great many rows are split by adaptive joins, since only sums are formed per line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.llm.common import SPACE, cell, documents, looked_up, put_back, set_aside, stored, table, words


@dataclass(frozen=True)
class Limits:
    """max_documents, max_share, always_documents: a line is excess if more documents of a host
    hold it than both max_documents and max_share of the host's documents, and always above
    always_documents, however large the host. least_kept: share of a document's words that
    must remain. base limits: words, percentage of words in repeated windows."""

    max_documents: int = 20
    max_share: float = 0.01
    always_documents: int = 200
    least_kept: float = 0.3
    least_words: int = 20
    most_repeat_percent: int = 30
    window: int = 8


LIMITS = Limits()
USED = ("doc_id", "text", "source")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: Column) -> Column:
    """Lower case, digits as 0, white space as one space, none at the ends; null for lines without words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))
    return F.when(plain != "", F.xxhash64(plain))


def repeat_words(window_hashes: Column, window: int) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the array of hashes by place."""
    marked = F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(marked)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    # neighbours in hash order tell whether a hash is alone
    zipped = F.arrays_zip(ordered.alias("x"), F.concat(F.array(F.lit(None)), ordered).alias("before"), F.slice(ordered, F.lit(2), F.size(ordered)).alias("after"))
    again = F.filter(zipped, lambda z: z["x"].isNotNull() & (same(z["x"], z["before"]) | same(z["x"], z["after"])))
    places = F.sort_array(F.transform(again, lambda z: z["x"]["i"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")))
    return total["n"]


def base_counts(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are split at ASCII white space; a null text has none.
    """
    w = limits.window
    text = F.coalesce(F.col("text"), F.lit(""))
    with_lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn("_words", words(F.col("text")))
    counted = counted.withColumn("n_words", F.size("_words").cast("long"))
    counted = counted.withColumn("word_chars", F.length(F.regexp_replace(text, SPACE, "")).cast("long"))
    counted = counted.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
    counted = counted.withColumn("_lines", with_lines)
    counted = counted.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Hashes of windows of 1, 2, 4 and 8 words, each from two of the one before.
    counted = counted.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))
    step = 1
    while step < w:
        ahead = F.slice("_h", F.lit(step + 1), F.greatest(F.size("_h") - step, F.lit(0)))
        both = F.zip_with(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - step, F.lit(0))), ahead, lambda a, b: F.xxhash64(a, b))
        counted = counted.withColumn("_h", both)
        step *= 2
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    counted = counted.withColumn("n_repeat_words", F.when(some, repeat_words(F.col("_h"), w)).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("_words", "_lines", "_h")


def _key() -> list[Column]:
    """Rows are told apart by id, host and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64("text", "source").alias("_row")]


def excess_lines(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(_id, _row, _places, _lost): places of the lines above the limit in each document, and their words."""
    host = F.coalesce(F.col("source"), F.lit(""))
    kept = docs.select(*_key(), F.xxhash64(host).alias("_host"), lines(F.col("text")).alias("_lines"))
    in_documents = kept.select("_host", F.explode(F.array_distinct(F.transform("_lines", line_hash))).alias("_hash")).where("_hash IS NOT NULL")
    # A row holds a line once, so rows are documents; their counts are combined before the shuffle.
    often = in_documents.groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_documents")).where(F.col("_documents") > limits.max_documents)
    hosts = kept.groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    share = F.least(limits.max_share * F.col("_all"), F.lit(float(limits.always_documents)))
    above = often.join(hosts, "_host").where(F.col("_documents") > share)
    above = stored(above.select("_host", "_hash"), "above")
    # A table of fixed size tells most other lines from these before their words are counted.
    bits = table(above.select(cell(F.col("_hash")).alias("cell"), F.lit(1).alias("level")).distinct())
    each = kept.select("_id", "_row", "_host", F.posexplode("_lines").alias("_place", "_line"), bits.alias("_bits"))
    each = each.where(looked_up(F.col("_bits"), line_hash(F.col("_line"))) == 1)
    each = each.select("_id", "_row", "_host", "_place", line_hash(F.col("_line")).alias("_hash"), F.size(words(F.col("_line"))).alias("_n"))
    found = each.join(above, ["_host", "_hash"])
    return found.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_place")).alias("_places"), F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_count")).select(
        "_id", "_row", "_places", (F.col("_sum") * F.size("_places") / F.col("_count")).cast("long").alias("_lost")
    )


def judged(docs: DataFrame, limits: Limits = LIMITS, with_text: bool = False) -> DataFrame:
    """docs with the base counts, n_excess_lines, n_lost_words and kept (and, with_text, cleaned text).

    A document is kept if it passes the base rules and at least ``least_kept`` of its words
    are in lines below the limit. A null source is a host of its own, a null or empty text
    fails for want of words. Each row is a document, exact copies and repeated rows too, and
    equal rows are judged alike. The text loses its excess lines. Other columns of docs go into the struct _all.
    """
    docs = set_aside(docs, *USED)
    counted = base_counts(docs, limits).withColumns({"_id": _key()[0], "_row": _key()[1]})
    told = counted.join(excess_lines(docs, limits), ["_id", "_row"], "left")
    lost = F.coalesce("_lost", F.lit(0).cast("long"))
    rest = F.col("n_words") - lost >= limits.least_kept * F.col("n_words")
    told = told.withColumn("n_excess_lines", F.coalesce(F.size("_places"), F.lit(0)).cast("long")).withColumn("n_lost_words", lost).withColumn("kept", ~F.col("base_failed") & rest)
    told = told.withColumn("n_excess_lines", F.greatest("n_excess_lines", F.lit(0)))
    if with_text:
        left = F.filter(lines(F.col("text")), lambda x, i: ~F.array_contains("_places", i))
        cleaned = F.array_join(left, "\n")
        told = told.withColumn("text", F.when(F.col("_places").isNotNull(), cleaned).otherwise(F.col("text")))
    return told.drop("_id", "_row", "_places", "_lost")


def kept_documents(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The kept documents without their excess lines, with the columns of docs."""
    # Written first: the condition would be pushed into the scan and all counts worked out there again.
    return put_back(stored(judged(docs, limits, with_text=True), "judged").where("kept"), docs.columns, USED)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = judged(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_excess_lines", "n_lost_words")
