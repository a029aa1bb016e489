"""Document fingerprints: every shingle hash below a fixed fraction of all hashes is kept.

Everything is SQL functions. The sketch of a union is the union of the sketches, and since
both sketches of a pair keep the same hashes, overlap and containment are estimated without
bias however unequal the documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallytree.llm.common import documents, words

FRACTION = 1 / 8
SHINGLE = 5
#: Rows of one run of ids; the number of runs is bounded by MOST_RUNS.
RUN, MOST_RUNS, STEP = 512, 4096, 64
LAST = 2**63 - 1


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """Sorted hashes of the text's 5-word shingles (of all its words, if fewer) below the fraction.

    A short text may have none below it: its sketch is empty, so that the sketch of a union is
    always the union of the sketches. What such sketches cannot tell, the texts' words do.
    """
    limit = F.lit(min(-(2**63) + int(2**64 * fraction), 2**63 - 1))
    w = words(text)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: i)
    hashes = F.transform(F.array(w), lambda w: F.transform(hashes, lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE)))))[0]
    few = F.sort_array(F.array_distinct(F.filter(hashes, lambda x: x < limit)))
    return F.when(F.size(w) > 0, few).otherwise(F.expr("cast(array() AS array<bigint>)"))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike if their texts' words are the same, and else not."""
    both = shared(a, b)
    same = F.when(words(text_a) == words(text_b), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), same).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def containment(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Estimated share of a's shingles that b holds; where a's sketch is empty, 1 for a text without words or with b's words, and else 0."""
    none = F.when((F.size(words(text_a)) == 0) | (words(text_a) == words(text_b)), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(a) == 0, none).otherwise(shared(a, b) / F.greatest(F.size(a), F.lit(1)))


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def _run_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key, found in two steps."""
    chunks = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)] or [[]]
    if not bounds:
        return F.lit(0)
    coarse = F.size(F.filter(F.array(*(F.lit(c[0]) for c in chunks)), lambda b: b <= key)) - 1
    fine = F.array(*(F.array(*map(F.lit, c)) for c in chunks))
    return F.when(key < bounds[0], 0).otherwise(F.transform(F.array(coarse), lambda k: k * STEP + F.size(F.filter(F.get(fine, k), lambda b: b <= key)))[0])


def with_next(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """docs (_id, _text) with the sketch _sketch and, from the next row by id, _next_text and _next_sketch.

    Ids are cut at quantiles into runs of about RUN rows; a run is sorted by one task, and its
    last row meets the first of the next run, which is sent there too. The last row of all
    meets the first.
    """
    spark = docs.sparkSession
    n = docs.select("_id").count()
    runs = max(1, min(MOST_RUNS, n // RUN))
    cuts = docs.select("_id").approxQuantile("_id", [k / runs for k in range(1, runs)], 1 / (4 * runs)) if runs > 1 else []
    bounds = sorted({int(c) for c in cuts})
    placed = docs.withColumn("_run", _run_of(F.col("_id"), bounds))
    firsts = sorted(placed.groupBy("_run").agg(F.min("_id")).collect())  # at most MOST_RUNS rows
    before = [(run, first, firsts[k - 1][0]) for k, (run, first) in enumerate(firsts)]
    before = spark.createDataFrame(before, "_run int, _id long, _before int")
    placed = placed.join(F.broadcast(before), ["_run", "_id"], "left")
    twice = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("extra"))))
    twice = twice.otherwise(F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("extra")), F.struct(F.col("_before").alias("run"), F.lit(True).alias("extra"))))
    placed = placed.withColumn("_at", F.explode(twice)).select("_id", "_text", F.col("_at.run").alias("_run"), F.col("_at.extra").alias("_extra"))
    placed = placed.repartition("_run").withColumn("_sketch", sketch(F.col("_text"), fraction))
    order = Window.partitionBy("_run").orderBy("_extra", "_id", "_text")
    found = placed.withColumn("_next", F.lead(F.struct("_text", "_sketch")).over(order)).where("NOT _extra")
    return found.select("_id", "_text", "_sketch", F.col("_next._text").alias("_next_text"), F.col("_next._sketch").alias("_next_sketch"))


def fingerprinted(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of texts, of their edited texts and of the next documents, and their likeness.

    The edited text has its last quarter of code points replaced by the first as many of the
    next document by id (after the last comes the first). A null text counts as empty; a null
    id comes last and stays null; rows with one id are ordered by text, and each is a document.
    An only document is its own next. An empty table gives no rows.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    found = with_next(plain, fraction).withColumn("n_chars", F.length("_text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substr("_next_text", F.lit(1), quarter))
    found = found.withColumn("edited_text", edited)
    found = found.withColumn("_edited_sketch", sketch(F.col("edited_text"), fraction))
    own, new, after = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next_sketch")
    edit, following = (new, F.col("_text"), F.col("edited_text")), (after, F.col("_text"), F.col("_next_text"))
    return found.select(
        F.expr(f"nullif(_id, {LAST}L)").alias("doc_id"), "n_chars", "edited_text",
        written(own).alias("fingerprint"), written(new).alias("edited_fingerprint"),
        likeness(own, *edit).alias("near_edited"), likeness(own, *following).alias("near_next"),
        containment(own, *edit).alias("contained_in_edited"), containment(own, *following).alias("contained_in_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprinted(documents(spark, sf_dir))
    return found.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")
