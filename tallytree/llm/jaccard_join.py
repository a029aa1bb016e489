"""Groups of near-duplicate documents by a T-occurrence search over shingle lists.

Equal shingle sets are one set from the start, with its documents as members. A set of n
shingles needs at least T = ceil(0.8 n) of them in common with any partner, so by the
DivideSkip argument only its n - T + 1 rarest shingles have to be looked up in inverted
lists (the short lists, merged); the other, longer lists are skipped and probed by binary
search in the partner's sorted shingles when a candidate is verified. Rarity is a count per
cell of a hash table of fixed size, filled from all documents: any order that all documents
share gives complete results, a good one keeps the lists short.

Spark merges the lists by sorting on the shingle. A list of at most ``SMALL`` sets proposes
all its pairs. A longer one proposes each member with its first ``PIVOTS`` sets; what these
links join needs no further look, and only members of such a list that are still in
different components are paired in a second round. No pair that could link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallytree.llm.common import documents, put_back, set_aside, stored
from tallytree.llm.components import components
from tallytree.llm.hashing import mixed, shingle_sets, slices, word_hashes

SHINGLE = 5
SMALL = 16
PIVOTS = 4
CELLS = 1 << 20
BLOCK = 1 << 13
BLOOM_BITS = 1 << 23
#: Lists whose cell counts more are not gathered by one task.
HOT = 20_000


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap that a set of n shingles needs with any partner: ceil(0.8 n)."""
    return -(-8 * n // 10)


def _set_id(s: np.ndarray) -> int:
    """A 64-bit id of a set, by sums, which do not depend on order."""
    if not len(s):
        return 0
    total = mixed(np.array([mixed(s, 1).sum(), len(s)], np.uint64), 2)
    return int(mixed(total[:1] ^ (total[1:] >> np.uint64(1)), 3).view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Eight words of bits: bit k tells whether an odd number of the set's hashes fall in cell k of 512.

    Two sets differ in at least as many elements as these bits do.
    """
    return np.packbits((np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1).astype(bool)).view(np.int64)


PARITY = [f"k{i}" for i in range(8)]


def shingled(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document's id, set size, set id and parities; and blocks of the shingle counts by cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                ids = part.column("doc_id")
                sizes, names, bits = [], [], []
                for s in shingle_sets(*word_hashes(texts, lower=True), SHINGLE):
                    sizes.append(len(s))
                    names.append(_set_id(s))
                    bits.append(parities(s))
                    np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
                rows = len(sizes)
                words = [pa.array(k) for k in np.array(bits, np.int64).reshape(rows, 8).T]
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), *words, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["doc_id", "n_shingles", "sid", *PARITY, "block", "cells"],
                )
        blocks = [k for k in range(CELLS // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
        for k in blocks:
            one = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [one] * 11 + [pa.array([k], pa.int32()), pa.array([counts[k * BLOCK : (k + 1) * BLOCK].tobytes()], pa.binary())],
                names=["doc_id", "n_shingles", "sid", *PARITY, "block", "cells"],
            )

    schema = f"doc_id long, n_shingles long, sid long, {', '.join(f'{k} long' for k in PARITY)}, block int, cells binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(work, schema)


def cell_counts(blocks: DataFrame) -> np.ndarray:
    """The summed counts of all cells: an array of fixed size on the driver."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.uint64)
        for batch in batches:
            for cells in batch.column("cells"):
                total += np.frombuffer(cells.as_py(), np.uint32)
        total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "cells"])

    counts = np.zeros(CELLS, np.uint32)
    for block, cells in blocks.groupBy("block").applyInArrow(add, "block int, cells binary").collect():
        counts[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(cells), np.uint32)
    return counts


def prefix_rows(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, sid, pos, hot) for the n - T + 1 rarest shingles of each set, once per set and task."""
    told = docs.sparkSession.sparkContext.broadcast(counts)  # CELLS counts, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, seen = told.value, set()
        for batch in batches:
            for _, texts in slices(batch, "_text"):
                tokens, names, places = [], [], []
                for s in shingle_sets(*word_hashes(texts, lower=True), SHINGLE):
                    if not len(s) or (name := _set_id(s)) in seen:
                        continue
                    seen.add(name)
                    count = load[(s >> np.uint64(44)).astype(np.int64)]
                    keep = len(s) - needed(len(s)) + 1
                    tokens.append(s[np.lexsort((s, count))[:keep]])
                    names.append(np.full(keep, name, np.int64))
                    places.append(np.arange(keep, dtype=np.int32))
                if tokens:
                    token = np.concatenate(tokens)
                    hot = load[(token >> np.uint64(44)).astype(np.int64)] > HOT
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(places)), pa.array(hot)], names=["token", "sid", "pos", "hot"])

    return docs.select(F.col("text").alias("_text")).mapInArrow(work, "token long, sid long, pos int, hot boolean")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def small_list_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of lists of at most SMALL sets, with the number of such lists they share."""
    sets = lists.groupBy("token").agg(F.sort_array(F.collect_list("sid")).alias("s"))
    first = sets.select("s", F.posexplode("s").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("s", F.col("i") + 2, SMALL)).alias("y"))
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))


def _bloom(keys: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds all keys (and, by chance, some others)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            bits[_bloom_at(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in keys.coalesce(8).mapInArrow(work, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(row[0]), np.uint8)
    return total


def _bloom_at(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64), 7) % np.uint64(BLOOM_BITS)).astype(np.int64)


def linked(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (x, y) of set ids whose Jaccard similarity is 0.8 or more, as edges (u, v).

    sets: sid, first_doc. Only documents that stand for a set of some pair are read again
    into shingles; a bit table of fixed size tells which.
    """
    pairs = stored(pairs.select("x", "y"), "pairs")
    asked = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
    keys = asked.join(sets, "sid").select(F.coalesce("first_doc", F.lit(0)))
    told = docs.sparkSession.sparkContext.broadcast(_bloom(keys))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(told.value)
        for batch in batches:
            at = _bloom_at(batch.column("_key").to_numpy(zero_copy_only=False))
            chosen = batch.filter(pa.array(bits[at] == 1))
            for _, texts in slices(chosen, "_text"):
                found = [s for s in shingle_sets(*word_hashes(texts, lower=True), SHINGLE) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["sid", "s"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sx"), batch.column("sy"), strict=True):
                a, b = (np.frombuffer(k.as_py(), np.uint64) for k in (a, b))
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                good.append(100 * both >= 80 * (len(a) + len(b) - both))
            keep = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column("x"), keep.column("y")], names=["u", "v"])

    chosen = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_key"), F.col("text").alias("_text"))
    known = chosen.mapInArrow(arrays, "sid long, s binary")
    sided = pairs.join(known.select(F.col("sid").alias("x"), F.col("s").alias("sx")), "x")
    sided = sided.join(known.select(F.col("sid").alias("y"), F.col("s").alias("sy")), "y")
    return sided.select("x", "y", "sx", "sy").mapInArrow(probe, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_known_links of every row.

    Words are split at ASCII white space, A-Z lower-cased; sets hold 5-word shingles, the
    whole text if it has fewer words. component_id is the least doc_id reachable over links
    of similarity 0.8 or more; n_known_links counts the different shingle sets a set is known to
    be linked with (links inside one long list's component are not all listed). Rows without
    words link with nothing and stand for themselves. Repeated rows are copies. A null id
    counts as the largest. Other columns are ignored; an empty table gives no rows.
    """
    table = stored(shingled(docs), "sets")
    told = table.where("block IS NULL").select("doc_id", "n_shingles", "sid", *PARITY)
    sets = told.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), *(F.first(k).alias(k) for k in PARITY))
    sets = stored(sets, "members")
    rows = prefix_rows(docs, cell_counts(table.where("block IS NOT NULL")))

    # Lists of a bounded length are gathered by sorting; for the others only sums are.
    cold = rows.where("NOT hot").select("token", "sid", "pos").repartition("token").distinct()
    counted = cold.withColumn("n_list", F.count(F.lit(1)).over(Window.partitionBy("token")))
    cold = counted.where("n_list > 1").select("token", "sid", "pos", "n_list", F.lit(False).alias("hot"))
    hot = rows.where("hot").select("token", "sid", "pos").distinct()
    sums = hot.groupBy("token").agg(F.count(F.lit(1)).alias("n_list")).where("n_list > 1")
    hot = hot.join(sums, "token").select("token", "sid", "pos", "n_list", F.lit(True).alias("hot"))
    lists = stored(cold.union(hot), "lists")

    size = sets.select("sid", "n")

    def sized(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(size.select(F.col("sid").alias("x"), F.col("n").alias("nx")), "x")
        pairs = pairs.join(size.select(F.col("sid").alias("y"), F.col("n").alias("ny")), "y")
        return pairs.where("10 * least(nx, ny) >= 8 * greatest(nx, ny)")

    # A shingle of the prefix that is in no list is in no partner that shares a later one: it is lost.
    listed = F.row_number().over(Window.partitionBy("sid").orderBy("pos")) - 1
    small, large = lists.where(f"n_list <= {SMALL}"), lists.withColumn("lost", F.col("pos") - listed).where(f"n_list > {SMALL}").join(size, "sid")
    large = stored(large.select("token", "sid", "n", "lost", "hot"), "large")
    # Of the shared shingles, all but max(T) - 1 lie in both prefixes; those of long lists are not counted here.
    skipped = stored(large.groupBy("sid").agg(F.count(F.lit(1)).alias("skipped")), "skipped")
    # The sets with most shingles in long lists are likely what the others were edited from.
    weighed = large.join(skipped, "sid").withColumn("weight", F.struct(-F.col("skipped"), "sid", "n", "lost"))
    place = F.row_number().over(Window.partitionBy("token").orderBy("weight"))
    few = weighed.where("NOT hot").withColumn("place", place).where(F.col("place") <= PIVOTS).select("token", "weight")
    one = weighed.where("hot").groupBy("token").agg(F.min("weight").alias("weight"))
    pivots = few.union(one).select("token", *(F.col(f"weight.{c}").alias(f"{c}2") for c in ("sid", "n", "lost")))
    pivots = stored(pivots, "pivots")
    able = "least(n1 - lost1, n2 - lost2) >= ceil(8 * (n1 + n2) / 18)"
    counted = sized(small_list_pairs(small))
    for side in ("x", "y"):
        counted = counted.join(skipped.select(F.col("sid").alias(side), F.col("skipped").alias(f"k{side}")), side, "left")
    whole = F.expr("ceil(8 * (nx + ny) / 18) - ceil(8 * greatest(nx, ny) / 10) + 1")
    room = F.least(F.coalesce("kx", F.lit(0)), F.coalesce("ky", F.lit(0)))
    proposed = counted.where(F.col("shared") + room >= whole).select("x", "y")
    members = large.select("token", *(F.col(c).alias(f"{c}1") for c in ("sid", "n", "lost")))
    spokes = members.join(pivots, "token").where(f"sid1 <> sid2 AND {able}").select(*_ordered("sid1", "sid2")).distinct()
    edges = stored(linked(docs, sets, proposed.union(spokes).distinct()), "links")
    groups = components(edges)

    # Second round: members of one long list that no link has joined yet.
    labelled = large.join(groups.select(F.col("u").alias("sid"), F.col("v").alias("label")), "sid", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "sid"))
    mixed_lists = labelled.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("token")
    open_lists = labelled.join(mixed_lists, "token").join(skipped, "sid")
    open_lists = open_lists.join(pivots.select("token", F.col("sid2").alias("sid")), ["token", "sid"], "left_anti")
    open_lists = open_lists.join(sets.select("sid", *PARITY), "sid")
    open_lists = stored(open_lists.select("token", "sid", "label", "n", "lost", "skipped", *PARITY), "open")
    left, right = (open_lists.select("token", *(F.col(c).alias(f"{c}_{k}" if c in PARITY else f"{c}{k}") for c in ("sid", "label", "n", "lost", "skipped", *PARITY))) for k in (1, 2))
    # A pair that no short list holds has all its shared prefix shingles in long ones.
    able += " AND least(skipped1, skipped2) >= ceil(8 * (n1 + n2) / 18) - ceil(8 * greatest(n1, n2) / 10) + 1"
    # Nor do linked sets differ in more elements than 0.8 allows, so not in more parities either.
    differ = " + ".join(f"bit_count({k}_1 ^ {k}_2)" for k in PARITY)
    able += f" AND {differ} <= n1 + n2 - 2 * ceil(8 * (n1 + n2) / 18)"
    rest = left.join(right, "token").where(f"sid1 < sid2 AND label1 <> label2 AND {able}")
    more = linked(docs, sets, rest.select(*_ordered("sid1", "sid2")).distinct())
    edges = stored(edges.union(more).distinct(), "links")
    groups = components(edges)

    ends = edges.select(F.col("u").alias("sid")).union(edges.select("v")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_known_links"))
    of_set = sets.join(groups.select(F.col("u").alias("sid"), F.col("v").alias("root")), "sid", "left").join(ends, "sid", "left")
    of_set = of_set.select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("n_known_links", F.lit(0)).alias("n_known_links"), "first_doc")
    least = of_set.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_set = of_set.join(least, "root").select("sid", "component_id", "n_known_links")
    found = told.where("n_shingles > 0").join(of_set, "sid").select("doc_id", "n_shingles", "component_id", "n_known_links")
    alone = told.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_known_links"))
    return found.union(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id, a null id being the largest.

    Rows are told apart by a number of their own, so rows that share an id, or have none, count one by one. Of
    rows with one id any may stay. Documents without words are in no group, and stay.
    """
    numbered = stored(set_aside(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = groups.join(numbered.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return put_back(numbered.join(first.select("_row"), "_row", "left_semi"), docs.columns, ("doc_id", "text"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
