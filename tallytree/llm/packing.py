"""Packing of tokenized documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenized once, in the executors. Each is cut into full sequences and one
remainder. Remainders fall into length classes of ``quantum`` tokens; the histogram of
classes, whose size is fixed, goes to the driver. There the linear program over filling
patterns is solved by column generation, each new pattern being the best knapsack under the
current prices. Rounded-down patterns, then greedily filled ones for the rest, are dealt to
the documents by their rank in their class; ranks, sequence numbers and offsets are computed
by Spark. Nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallytree.llm.common import documents, stored
from tallytree.llm.hashing import slices

CAPACITY = 2048
QUANTUM = 8
END_ID = 1
#: Marks that the tokenizer splits from letters before them; runs of them stay together.
MARKS = ".,;:?!$&%#*)"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of texts through a table of words.

    The tokenizer drops white space and never merges across it, so a text's ids are its
    words' ids in a row; likewise letters and the punctuation after them never merge. Words of letters only give one token sequence whose last token alone ends a word,
    so many are encoded as one text and told apart afterwards. At ``limit`` words the table
    starts anew, which bounds memory.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1024, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, stems: list[str]) -> dict[str, list[int]]:
        """Ids of words of letters, 500 at a time."""
        known: dict[str, list[int]] = {}
        for at in range(0, len(stems), 500):
            some = stems[at : at + 500]
            ids = self.ids(" ".join(some))
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some):
                known.update((w, ids[a:b]) for w, a, b in zip(some, [0, *stops], stops, strict=False))
            else:
                known.update((w, self.ids(w)) for w in some)
        return known

    def add(self, new: list[bytes]) -> None:
        split = []
        for word in map(bytes.decode, new):
            stem = word.rstrip(MARKS)
            # What a letter becomes when it is normalised may join the marks after it, so only plain letters are split off.
            plain = stem.isalpha() and all(map(str.isalpha, unicodedata.normalize("NFC", stem).lower()))
            split.append((stem, word[len(stem) :]) if plain else (word, ""))
        known = self.learn([w for w in dict.fromkeys(w for w, tail in split if tail or w.isalpha() and all(map(str.isalpha, unicodedata.normalize("NFC", w).lower())))])
        for part in {x for pair in split for x in pair}:
            if part not in known:
                known[part] = self.ids(part)
        ids = [known[stem] + known[tail] for stem, tail in split]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.index), int(lens.sum())
        if n + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(n + len(new), np.int64)]) for x in (self.start, self.size))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + total, np.uint32)])
        self.start[n : n + len(new)] = self.used + np.cumsum(lens) - lens
        self.size[n : n + len(new)] = lens
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        self.used += total
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        # It lower-cases too; only a special token's name, which is read as such, must stay as it is.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        parts = list(itertools.chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.index) > self.limit:
            self.clear()
            new = np.arange(len(parts))
        if len(new):
            unknown = [parts[k] for k in new.tolist()]
            self.add(list(dict.fromkeys(unknown)))
            at[new] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        lens = self.size[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self.flat[np.repeat(self.start[at] - ends[:-1], lens) + np.arange(ends[-1])]
        stops = ends[np.cumsum([0, *map(len, split)])].tolist()
        return [flat[a:b] for a, b in zip(stops, stops[1:], strict=False)]


@functools.cache
def word_tokens(path: str) -> WordTokens:
    """One table for each Python worker, kept from task to task."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: full sequences of ``capacity`` ids, then the remainder of each document.

    Every document ends with END_ID, so a null or empty text gives one piece of one id.
    Repeated rows are separate documents; a null id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_tokens(tokenizer or default_tokenizer())
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), table.encode(texts.to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece), len(ids)))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(cut, PIECE_SCHEMA)


def best_knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The filling of the capacity with the highest total price, by dynamic programming."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = sizes <= room
        if fits.any():
            worth = np.where(fits, prices + value[np.maximum(room - sizes, 0)], -np.inf)
            k = int(worth.argmax())
            if worth[k] > value[room] + 1e-12:
                value[room], choice[room] = worth[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns over the sizes with how often each is used; together they hold the demand exactly.

    The linear program's basis starts with one pattern per size; columns are priced by
    best_knapsack and enter by the ratio test until none lowers the number of sequences.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    inverse, level = np.diag(1.0 / np.diag(columns)), demand / np.diag(columns)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        pattern = best_knapsack(prices, sizes, capacity)
        if prices @ pattern <= 1 + 1e-9:
            break
        change = inverse @ pattern
        ratio = np.where(change > 1e-10, level / np.where(change > 1e-10, change, 1), np.inf)
        out = int(ratio.argmin())
        level = level - ratio[out] * change
        level[out] = ratio[out]
        inverse[out] /= change[out]
        keep = np.arange(m) != out
        inverse[keep] -= np.outer(change[keep], inverse[out])
        columns[:, out] = pattern
    left, plan = demand.astype(np.int64).copy(), []
    for k in np.argsort(-level, kind="stable"):
        pattern = np.rint(columns[:, k]).astype(np.int64)
        times = int(min(np.floor(max(level[k], 0) + 1e-9), (left[pattern > 0] // pattern[pattern > 0]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():  # what rounding left: sequences filled with the largest that fit
        pattern, room = np.zeros(m, np.int64), capacity
        for k in np.argsort(-sizes, kind="stable"):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def deal(plan: list[tuple[np.ndarray, int]], sizes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, items per sequence) of each pattern's share of a class."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, times in plan:
        for k in np.flatnonzero(pattern):
            c, per = int(sizes[k]), int(pattern[k])
            rows.append((c, taken[c], taken[c] + per * times, sequence, per))
            taken[c] += per * times
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """Adds sequence_id and offset to pieces no longer than the capacity.

    Ties are broken by doc_id, start and the ids' checksum; equal pieces are interchangeable.
    No pieces give no rows.
    """
    spark = pieces.sparkSession
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / quantum).cast("int"))
    classed = classed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(1024)))
    counts = classed.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("_class").agg(F.sum("_n")).collect()}  # one row per class
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in sizes.tolist()], np.int64)
    share = deal(cutting_stock(sizes, demand, capacity // quantum), sizes)
    shares = spark.createDataFrame(share, "_class int, _lo long, _hi long, _seq long, _per long")
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "ids_crc32")
    ranked = classed.withColumn("_row", F.row_number().over(within) - 1).join(counts.drop("_n"), ["_class", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_row") + F.col("_before"))
    placed = ranked.join(F.broadcast(shares), "_class").where("_rank >= _lo AND _rank < _hi")  # at most patterns x classes rows
    placed = placed.withColumn("sequence_id", F.expr("_seq + (_rank - _lo) DIV _per"))
    filled = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(filled), F.lit(0)))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    return pack(stored(token_pieces(docs, tokenizer, capacity), "pieces"), capacity, quantum)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
