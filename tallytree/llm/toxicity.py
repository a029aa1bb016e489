"""Toxicity of texts after noisy-channel restoration of disguised words.

Words that may be disguised (any character that imitates a letter or separates letters, any
letter twice in a row) become lattices: every character may stand for itself or for a letter it
imitates, a separator or a repeated character may be dropped. Runs of single characters are one word. The cheapest path under a character language model (Viterbi, states
are the last three symbols) is the restored word. The language model is interpolated 4-grams
over 32 symbol classes, counted over all training texts. Plain words are their only path.

Restored words are scored by what labelled documents say: per word and per beginning of a
word, in a hashed table of fixed size, a cautious log-odds of toxic against other documents.
A document's features are its highest word scores; a logistic regression turns them into a
probability. Labelled rows beyond ``MOST_LABELLED`` are thinned by the hash of their id.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.llm.common import documents, id_crc, stored
from tallytree.llm.hashing import slices

#: Documented bound of the labelled sample that the classifier is fitted on.
MOST_LABELLED = 200_000
CELLS = 1 << 20
BEGINNINGS = (4, 5, 6)
TOP = 3
#: Word scores below this count as nothing.
LEAST = 0.5
#: Cost, as a log-probability, of a character that imitates a letter, of a separator that is dropped, of a character
#: that is no letter and stays, of a character that is dropped since it comes twice, and since it comes once more.
IMITATES, DROPS, KEEPS_ODD, DOUBLED, AGAIN = -1.0, -0.7, -2.5, -2.0, -0.2

SPACE, OTHER, HIGH = 26, 27, 28
CLASS = np.full(256, OTHER, np.uint8)
CLASS[97:123] = np.arange(26)
CLASS[65:91] = np.arange(26)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[128:] = HIGH + (np.arange(128) & 3)
#: Which letters a character is used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
SEPARATORS = ".-_*~'/\\,:"
EDGES = ".,;:!?\"'()[]{}«»“”„¿¡…"
#: Every word that has one of these characters, or any letter twice in a row, is decoded.
ODD = re.compile(rf"[{re.escape(''.join(LEET) + SEPARATORS)}]|([^\W\d_])\1")
TWICE = re.compile(r"(.)\1", re.DOTALL)
CLASSES = CLASS.tobytes()


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        yield from slices(batch, "_text")


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all runs of four symbol classes: an array of fixed size on the driver. docs: _text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for _, texts in _bytes_of(batches):
            data = np.frombuffer(b"   " + b"   ".join(texts.drop_null().to_pylist()) + b" ", np.uint8)
            c = CLASS[data].astype(np.int32)
            total += np.bincount(c[:-3] << 15 | c[1:-2] << 10 | c[2:-1] << 5 | c[3:], minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    found = docs.select("_text").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return counts


def character_model(counts: np.ndarray) -> np.ndarray:
    """log p(symbol | three before), each order interpolated with the next shorter one."""
    c4 = counts.reshape(32, 32, 32, 32)
    c3, c2, c1 = c4.sum(0), c4.sum((0, 1)), c4.sum((0, 1, 2))
    p = (c1 + 1) / (c1.sum() + 32)
    for c, strength in ((c2, 20.0), (c3, 20.0), (c4, 20.0)):
        p = (c + strength * p) / (c.sum(-1, keepdims=True) + strength)
    return np.log(p)


class Restorer:
    """Restores disguised words under a character model."""

    def __init__(self, model: np.ndarray):
        # A list is read much faster than an array, one number at a time; its size is fixed.
        self.model = model.astype(np.float64).ravel().tolist()
        self.word = lru_cache(100_000)(self._restored)
        self.classes = lru_cache(10_000)(self._classes)

    @staticmethod
    def _classes(text: str) -> tuple[int, ...]:
        return tuple(int(CLASS[b]) for b in text.encode("utf-8", "replace"))

    @staticmethod
    def _ways(c: str, repeats: int) -> list[tuple[str, float]]:
        """What a character may stand for; ``repeats``: how many equal ones come right before it."""
        if c.isalpha():
            ways = [(c, 0.0)]
        else:
            ways = [(c, KEEPS_ODD), *((to, IMITATES) for to in LEET.get(c, ""))]
            if c in SEPARATORS or c.isspace():
                ways.append(("", DROPS))
                if c.isspace():
                    ways.append((" ", 0.0))
        if repeats and (c.isalpha() or c in LEET):
            ways.append(("", DOUBLED if repeats == 1 else AGAIN))
        return ways

    def _restored(self, disguised: str) -> str:
        apart = self._apart(disguised) if disguised.isalpha() else None
        return self._word(disguised) if apart is None else apart

    def _apart(self, word: str) -> str | None:
        """The cheapest path of a word of letters whose doubled letters lie three places apart or more.

        No symbol's cost then depends on two of them, so each is decided by itself, with the result of
        the whole search. None for other words.
        """
        at = [m.start() + 1 for m in TWICE.finditer(word)]
        if any(not word[p].isascii() or word[p + 1 : p + 2] == word[p] for p in at):
            return None
        gone, raw, model = [], word.encode("utf-8", "replace"), self.model
        places = at if len(raw) == len(word) else [len(word[:p].encode("utf-8", "replace")) for p in at]
        if any(q - p < 3 for p, q in zip(places, places[1:], strict=False)):
            return None
        k = [SPACE, SPACE, SPACE, *raw.translate(CLASSES), SPACE]
        for p, place in zip(at, places, strict=True):
            a, b, c, d, e = k[place : place + 5]  # d is the letter that comes again, c the one before it
            keeps = model[((a << 5 | b) << 5 | c) << 5 | d] + model[((b << 5 | c) << 5 | d) << 5 | e]
            drops = DOUBLED + model[((a << 5 | b) << 5 | c) << 5 | e]
            if place + 5 < len(k):
                keeps += model[((c << 5 | d) << 5 | e) << 5 | k[place + 5]]
                drops += model[((b << 5 | c) << 5 | e) << 5 | k[place + 5]]
            if drops > keeps:
                gone.append(p)
        return "".join(x for i, x in enumerate(word) if i not in gone) if gone else word

    def _word(self, disguised: str) -> str:
        """The cheapest path through the lattice of a lower-cased word, by Viterbi search.

        A state is the last three classes as one number; each has its cost and its path as a chain, so
        that a step's work does not depend on how much was read.
        """
        model, lowest = self.model, (1 << 15) - 1
        states: dict[int, tuple[float, tuple]] = {SPACE << 10 | SPACE << 5 | SPACE: (0.0, ())}
        last, repeats = "", 0
        for c in disguised:
            repeats = repeats + 1 if c == last else 0
            ways = [(to, self.classes(to), price) for to, price in self._ways(c, repeats)]
            new: dict[int, tuple[float, tuple]] = {}
            for state, (cost, path) in states.items():
                for to, classes, price in ways:
                    at, total = state, cost + price
                    for k in classes:
                        at = at << 5 | k
                        total += model[at]
                        at &= lowest
                    if at not in new or total > new[at][0]:
                        new[at] = (total, (path, to) if to else path)
            states, last = new, c
        _, path = max(((cost + model[at << 5 | SPACE], path) for at, (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, to = path
            out.append(to)
        return "".join(reversed(out))


def _features(words: list[str]) -> np.ndarray:
    """Cells of each word and of its beginnings, one row a word (the word again where it is too short)."""
    rows = []
    for w in words:
        raw = w.encode("utf-8", "replace")
        whole = zlib.crc32(raw) & (CELLS - 1)
        rows.append([whole, *(zlib.crc32(w[:k].encode("utf-8", "replace"), k) & (CELLS - 1) if len(w) >= k else whole for k in BEGINNINGS)])
    return np.array(rows, np.int32).reshape(-1, 1 + len(BEGINNINGS))


class Words:
    """Feature cells of the words of texts; disguised words are restored. Starts anew at ``limit`` words."""

    def __init__(self, model: np.ndarray, odds: np.ndarray | None = None, limit: int = 500_000):
        self.restorer, self.odds, self.limit = Restorer(model), odds, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.cells = np.zeros((1 << 14, 1 + len(BEGINNINGS)), np.int32)
        self.single = np.zeros(1 << 14, bool)
        self.score = np.zeros(1 << 14)

    def add(self, new: list[str]) -> None:
        n = len(self.index)
        if (room := n + len(new)) > len(self.single):
            self.cells = np.concatenate([self.cells, np.zeros((room, self.cells.shape[1]), np.int32)])
            self.single = np.concatenate([self.single, np.zeros(room, bool)])
            self.score = np.concatenate([self.score, np.zeros(room)])
        clean = []
        for w in new:
            w = w.strip(EDGES) or w
            clean.append(self.restorer.word(w).strip(EDGES) if ODD.search(w) else w)
        self.cells[n:room] = _features(clean)
        if self.odds is not None:
            self.score[n:room] = self.odds[self.cells[n:room]].max(axis=1, initial=0.0)
        self.single[n:room] = [len(w.strip(EDGES) or w) == 1 for w in new]
        self.index.update(zip(new, range(n, room), strict=True))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words of all texts, spaced-out words restored and appended, and of which text each is."""
        split = [t.lower().split() for t in texts]
        parts = list(itertools.chain.from_iterable(split))
        at = self.look_up(parts)
        of = np.repeat(np.arange(len(split)), list(map(len, split)))
        single = np.append(self.single[at], False)
        # Runs of three or more single characters of one text are read as spaced-out words.
        starts = np.flatnonzero(single[:-1] & ~np.append(False, single[:-2])) if len(at) else np.zeros(0, np.int64)
        more, more_of = [], []
        for a in starts.tolist():
            b = a
            while single[b] and of[b] == of[a]:
                b += 1
            if b - a >= 3:
                restored = self.restorer.word(" ".join(p.strip(EDGES) or p for p in parts[a:b])).split()
                more += restored
                more_of += [of[a]] * len(restored)
        if more:
            # looking up may start the table anew, so everything is looked up together
            at = self.look_up(parts + more)
            of = np.append(of, more_of)
        return at, of

    def look_up(self, parts: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.index) > self.limit:
            self.clear()
            new = np.arange(len(parts))
        if len(new):
            unknown = [parts[k] for k in new.tolist()]
            self.add(list(dict.fromkeys(unknown)))
            at[new] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        return at


def _words_of(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word) pairs of a run of rows; where words have scores, of those with LEAST or more."""
    at, of = words.texts(texts.cast(pa.large_string()).to_pylist())
    if words.odds is not None:
        good = words.score[at] >= LEAST
        at, of = at[good], of[good]
    pair = np.unique(of.astype(np.int64) << 32 | at) if len(at) else np.zeros(0, np.int64)
    return pair >> 32, pair & 0xFFFFFFFF


def cell_odds(docs: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Counts of labelled documents by cell, toxic and others, and how many there are. docs: _text, _toxic."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n = Words(told.value), np.zeros((2, CELLS), np.int32), [0, 0]
        for part, texts in _bytes_of(batches):
            toxic = np.array(part.column("_toxic").to_pylist(), np.int64)
            row, at = _words_of(texts, words)
            for k in (0, 1):
                n[k] += int((toxic == k).sum())
                mine = toxic[row] == k
                # A cell counts once for a document whatever words lead to it.
                cells = np.sort(((row[mine] << 20)[:, None] | words.cells[at[mine]]).ravel())
                cells = cells[np.append(True, cells[1:] != cells[:-1])[: len(cells)]] & (CELLS - 1)
                counts[k] += np.bincount(cells, minlength=CELLS).astype(np.int32)
        at = np.flatnonzero(counts.any(axis=0))
        columns = [np.append(at, -1), np.append(counts[1][at], n[1]), np.append(counts[0][at], n[0])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["cell", "toxic", "other"])

    found = docs.select("_text", "_toxic").mapInArrow(work, "cell long, toxic long, other long")
    found = found.groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic > 0 OR cell < 0").toArrow()
    cell, toxic, other = (found.column(c).to_numpy() for c in ("cell", "toxic", "other"))
    counts = np.zeros((2, CELLS), np.int64)
    good = cell >= 0
    counts[1][cell[good]], counts[0][cell[good]] = toxic[good], other[good]
    return counts[1], counts[0], int(toxic[~good].sum()), int(other[~good].sum())


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Cautious log-odds: less one standard error, 0 where fewer than one toxic document is left."""
    toxic, other = np.maximum(toxic, 0), np.maximum(other, 0)
    odds = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((other + 0.5) / (n_other + 1.0))
    return np.where(toxic > 0, np.maximum(odds - np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)), 0), 0.0)


def document_features(docs: DataFrame, model: np.ndarray, odds: tuple[np.ndarray, np.ndarray, int, int]) -> DataFrame:
    """docs' doc_id, _held, _toxic with _s: the TOP highest word scores.

    docs: doc_id, _held, _toxic, _text; a labelled row (_toxic 0 or 1) is scored without its own counts.
    """
    told = docs.sparkSession.sparkContext.broadcast((model, *odds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, toxic, other, n1, n0 = told.value
        words = Words(model, log_odds(toxic, other, n1, n0))
        for part, texts in _bytes_of(batches):
            label = np.array(part.column("_toxic").fill_null(-1).to_pylist(), np.int64)
            row, at = _words_of(texts, words)
            cells = words.cells[at]
            score = words.score[at].copy()
            for k, (d1, d0) in enumerate(((0, 1), (1, 0))):
                mine = (label[row] == k) & (score > 0)
                c = cells[mine]
                score[mine] = log_odds(toxic[c] - d1, other[c] - d0, n1 - d1, n0 - d0).max(axis=1, initial=0.0)
            order = np.lexsort((-score, row))
            row, score = row[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top = np.zeros((part.num_rows, TOP))
            good = place < TOP
            top[row[good], place[good]] = score[good]
            ends = np.arange(0, TOP * part.num_rows + 1, TOP, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "_held", "_toxic")] + [lists], names=["doc_id", "_held", "_toxic", "_s"])

    return docs.select("doc_id", "_held", "_toxic", "_text").mapInArrow(work, "doc_id long, _held boolean, _toxic int, _s array<double>")


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method: the weights, then the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, _toxic) of at most about ``most`` labelled ids, thinned by hash; 1 if any row of an id says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("_toxic"))
    n = one.count()
    share = min(1.0, most / n) if n else 1.0
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def scored(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    held_out: a condition on columns of docs; what is learned comes from the other rows. A
    null or empty text has no words and gets the score of a text without toxic words. Ids that
    have several labels count as toxic if one says so. Rows that repeat are scored each, alike.
    Without labels, or with labels of one kind only, every score is the share of that kind,
    drawn towards one half. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    model = character_model(character_counts(docs.where("NOT _held")))
    known = F.broadcast(labelled(labels))  # two short columns of MOST_LABELLED rows
    told = docs.join(known, "doc_id", "left").withColumn("_toxic", F.when(~F.col("_held"), F.col("_toxic")))
    odds = cell_odds(told.where("_toxic IS NOT NULL"), model)
    rows = stored(document_features(told, model, odds), "toxicity")
    # One row for each labelled id, the highest scored one, so MOST_LABELLED bounds what is collected.
    sample = rows.where("_toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("_s", "_toxic")).alias("r")).select("r.*").toArrow()
    y = sample.column("_toxic").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        x, weights = None, np.append(np.zeros(TOP), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    else:
        x = np.array(sample.column("_s").to_pylist())
        weights = fitted(x, y)
    z = F.lit(float(weights[-1]))
    for k in range(TOP):
        z = z + F.lit(float(weights[k])) * F.get("_s", F.lit(k))
    score = 1 / (1 + F.exp(-z))
    return rows.select("doc_id", F.col("_held").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held)
