"""Removal of repeated passages by level-wise doubling of word windows.

A window of 20 words is repeated only if all shorter windows inside it are. So windows of 5
words are compared first, then those of 10 words around the repeated ones, then those of 20:
each length only looks at what was repeated at the one before, until the length asked for.
Below that length one window stands for each longer one: the inner window with the least
hash, which equal windows share, so about one position in eight is compared and nothing is
lost. Hashes of the next length come from two of the last. Within a run of rows equal
windows are reduced to one before the shuffle, so a passage that a third of all documents
hold does not gather in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallytree.functions.ordering import ranked
from tallytree.llm.common import documents, stored
from tallytree.llm.hashing import doubled, mixed, slices, window_hashes, word_hashes

WINDOW = 20
LAST = 2**63 - 1


def lengths(window: int) -> list[int]:
    """Window, half of it and so on, while whole and of five words at least; shortest first."""
    found = [window]
    while found[0] % 2 == 0 and found[0] // 2 >= 5:
        found.insert(0, found[0] // 2)
    return found


def _windows(h: np.ndarray, sizes: list[int], second: bool = False) -> np.ndarray:
    """Hashes of the windows of the last size, by doubling from the first."""
    w = window_hashes(h, sizes[0], second)
    for size in sizes[:-1]:
        w = doubled(w, size, second)
    return mixed(w)


def _anchors(values: np.ndarray, span: int, starts: np.ndarray) -> np.ndarray:
    """For each start the place of the least value among ``span`` from there on."""
    if span == 1 or not len(starts):
        return starts
    return starts + np.lib.stride_tricks.sliding_window_view(values, span)[starts].argmin(axis=1)


def _starts(first: np.ndarray, window: int) -> np.ndarray:
    """Where windows start that end in the same row."""
    n = int(first[-1])
    row_end = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(n) + window <= row_end)


def _marks(part: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """The words of a run of rows that the column _found lists, by row and place."""
    found = part.column("_found")
    marks = np.zeros(int(first[-1]), bool)
    counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    marks[np.repeat(first[:-1], counts) + found.flatten().to_numpy(zero_copy_only=False)] = True
    return marks


def window_rows(docs: DataFrame, sizes: list[int], level: int, window: int) -> DataFrame:
    """(key, id, check, place, known) of the windows to compare at a level.

    known: another window of the same run of rows is equal to it and, at the last level,
    comes before it. Such rows are dealt by a key of their own.
    """
    size, last = sizes[level], level == len(sizes) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                h, first = word_hashes(texts)
                starts = _starts(first, window)
                if level:
                    before = sizes[level - 1]
                    at = _anchors(_windows(h, sizes[:level]), window - before + 1, starts)
                    starts = starts[_marks(part, first)[at]] if len(starts) else starts
                if not len(starts):
                    continue
                values = _windows(h, sizes[: level + 1])
                at = np.unique(_anchors(values, window - size + 1, starts))
                key, row = values[at], np.searchsorted(first, at, side="right") - 1
                ids = part.column("_id").to_numpy(zero_copy_only=False)[row]
                place = at - first[row]
                order = np.lexsort((place, ids, key))
                key, ids, place, at = key[order], ids[order], place[order], at[order]
                again = np.append(False, key[1:] == key[:-1])
                known = again if last else again | np.append(again[1:], False)
                key = np.where(again, mixed(key ^ mixed(ids.view(np.uint64)), 5) + place.astype(np.uint64), key)
                check = (_windows(h, sizes, second=True)[at] >> np.uint64(32)).astype(np.int32) if last else np.zeros(len(at), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids), pa.array(check), pa.array(place.astype(np.int32)), pa.array(known)],
                    names=["key", "id", "check", "place", "known"],
                )

    return docs.mapInArrow(work, "key long, id long, check int, place int, known boolean")


def repeated_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _found): where windows start that also start earlier. docs: _id, _text, one row an id."""
    sizes = lengths(window)
    found = None
    for level in range(len(sizes)):
        source = docs if found is None else docs.join(found.hint("shuffle_hash"), "_id")
        rows = window_rows(source, sizes, level, window)
        # check and place share a column, known sits beside them: rows stay short in the shuffle.
        rows = rows.select("key", "id", F.expr("shiftleft(cast(check as bigint), 32) | (place * 2L) | int(known)").alias("_at"))
        if level < len(sizes) - 1:
            many = F.count(F.lit(1)).over(Window.partitionBy("key")) > 1
        else:
            rows = rows.withColumn("_check", F.shiftright("_at", 32))
            many = F.row_number().over(Window.partitionBy("key", "_check").orderBy("id", "_at")) > 1
        rows = rows.withColumn("_many", many).where("_many OR (_at & 1) = 1")
        place = F.expr("cast(shiftrightunsigned(_at & 4294967295L, 1) as int)")
        found = rows.select(F.col("id").alias("_id"), place.alias("_place")).groupBy("_id").agg(F.collect_list("_place").alias("_found"))
    return found


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row.

    Words are split at ASCII white space and compared as they are. A word goes if some window
    over it also starts earlier in the input: in a smaller doc_id, or sooner in its document.
    A null text has no words; a null id counts as larger than all others. Rows that share an id, or
    have none, are documents of their own, in the order of their texts' md5; of equal rows the first
    keeps what the others lose. Other columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.col("text").alias("_text"))
    if plain.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _without_repeats(plain, window).withColumn("doc_id", F.expr(f"nullif(doc_id, {LAST}L)"))
    # Ranks stand for ids where these are not a row's own.
    placed = ranked(plain.withColumns({"_all": F.lit(0), "_md5": F.md5(F.coalesce("_text", F.lit("")))}), ["_all"], ["_id", "_md5"], stored)
    done = _without_repeats(placed.select(F.col("rank").alias("_id"), "_text"), window).withColumnRenamed("doc_id", "rank")
    own = placed.select("rank", F.expr(f"nullif(_id, {LAST}L)").alias("doc_id"))
    return own.join(done, "rank").select("doc_id", "n_words", "n_removed", "kept_text")


def _without_repeats(plain: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of plain (_id, _text), whose ids differ."""
    # Of several documents with one text only the first has windows of its own.
    told = plain.select("_id", F.md5(F.coalesce("_text", F.lit(""))).alias("_md5"))
    first = told.groupBy("_md5").agg(F.min("_id").alias("_first"))
    roles = told.join(first, "_md5").where("_first < _id").select("_id", F.lit(True).alias("_copy"))
    whole = plain.join(roles.hint("shuffle_hash"), "_id", "left")
    found = repeated_starts(whole.where("_copy IS NULL").select("_id", "_text"), window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                # One row per word would be costly: starts are spread to covered words by sums.
                words = [t.split() for t in texts.to_pylist()]
                first = np.cumsum([0, *map(len, words)])
                marks = np.append(_marks(part, first), np.zeros(window, bool)).astype(np.int32)
                sums = np.cumsum(marks)
                covered = (sums - np.append(np.zeros(window, np.int32), sums[:-window]))[: first[-1]] > 0
                kept, removed = [], []
                copies = part.column("_copy").fill_null(False).to_pylist()
                for w, a, copy in zip(words, first[:-1].tolist(), copies, strict=True):
                    gone = covered[a : a + len(w)]
                    n = len(w) if copy and len(w) >= window else int(gone.sum())
                    removed.append(n)
                    kept.append(b" ".join(w if not n else [] if n == len(w) else [x for x, g in zip(w, gone.tolist(), strict=True) if not g]))
                kept = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(removed, pa.int64()), kept], names=["_id", "n_words", "n_removed", "kept_text"])

    whole = whole.join(found.hint("shuffle_hash"), "_id", "left")
    done = whole.select("_id", "_text", "_copy", "_found").mapInArrow(cut, "_id long, n_words long, n_removed long, kept_text string")
    return done.withColumnRenamed("_id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
