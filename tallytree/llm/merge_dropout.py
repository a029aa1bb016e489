"""Merge-type (BPE) encoding with seeded dropout over a SentencePiece vocabulary, and exact decoding.

The agenda of a chunk holds the merges of neighbouring symbols, best score first, leftmost
among equals. A candidate is skipped for good if a hash keyed by the seed, the document, the
chunk's place and the candidate's place falls below the dropout rate; merging its neighbours
makes new candidates. Spaces become U+2581, one is put in front of the text, and what the
vocabulary lacks is spelled in bytes, so decoding gives the text back whatever was skipped.

No piece holds a line feed or anything before a space, so a text falls into chunks (spaces
and the run of characters after them) that never merge with each other. The plain segmentation of a chunk and the merges it makes
are worked out once and kept by the Python worker. An occurrence that skips none of these
merges is plain; every other one goes through the agenda with its own key, many at once in
numpy; long ones use a heap.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.llm.common import documents
from tallytree.llm.hashing import mixed, slices

DROPOUT = 0.1
SEED = 20240501
#: Chunks of more symbols use the heap, since the joint agenda takes a round per merge.
LONG = 48
SPACE_MARK = "▁"
#: Spaces with what follows them; a line feed and a literal mark stand alone.
CHUNKS = re.compile(f" *[^ \n{SPACE_MARK}]+| +|\n|{SPACE_MARK}")
MASK = 2**64 - 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their ranks by score, and which two pieces merge into which."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {pieces[i]: i for i in plain}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.out = [b""] * size
        for i in plain:
            self.out[i] = pieces[i].replace(SPACE_MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.out[i] = bytes([b])
        score = np.array([-model.get_score(i) for i in range(size)])
        self.rank = np.unique(score, return_inverse=True)[1].astype(np.int64)
        self.merge: dict[int, int] = {}
        for piece, i in self.id.items():
            for cut in range(1, len(piece)):
                a, b = self.id.get(piece[:cut]), self.id.get(piece[cut:])
                if a is not None and b is not None:
                    self.merge[a << 20 | b] = i
        self.symbol = -1 - np.arange(0x110000)
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.symbol[ord(" " if piece == SPACE_MARK else piece)] = i
        self.pairs = np.array(sorted(self.merge), np.int64)
        self.into = np.array([self.merge[k] for k in self.pairs.tolist()], np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of what neighbours merge into; -1 where they don't."""
        key = np.where((a >= 0) & (b >= 0), a << 20 | b, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.into[at], -1)

    def symbols(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters of all chunks, and how many each has; those outside the vocabulary are -1 less the character."""
        ids = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        return ids, np.fromiter(map(len, chunks), np.int64, len(chunks))

    def spelled(self, ids: list[int]) -> list[int]:
        """Characters outside the vocabulary as their bytes."""
        if min(ids, default=0) >= 0:
            return ids
        return [i for s in ids for i in ([s] if s >= 0 else [self.byte[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")])]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded."""
        return b"".join(map(self.out.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    place = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return mixed(key ^ mixed(place, 11), 12) < np.uint64(limit)


def _limit(dropout: float) -> int:
    return min(int(dropout * 2.0**64), MASK)


def agenda(symbols: list[int], key: int, dropout: float, vocabulary: Vocabulary) -> list[int]:
    """One chunk's ids by a heap of candidate merges."""
    ids, n, limit = list(symbols), len(symbols), _limit(dropout)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, []

    def propose(at: int) -> None:
        if at >= 0 and after[at] < n:
            to = vocabulary.merge.get(ids[at] << 20 | ids[after[at]], -1) if ids[at] >= 0 and ids[after[at]] >= 0 else -1
            if to >= 0:
                heapq.heappush(heap, (int(vocabulary.rank[to]), at, after[at], end[after[at]], to))

    for at in range(n - 1):
        propose(at)
    while heap:
        _, at, middle, stop, to = heapq.heappop(heap)
        if not alive[at] or after[at] != middle or not alive[middle] or end[middle] != stop or end[at] != middle:
            continue
        if limit and bool(_skipped(np.array([key], np.uint64), np.array([at]), np.array([middle]), np.array([stop]), limit)[0]):
            continue
        ids[at], end[at], after[at], alive[middle] = to, stop, after[middle], False
        if after[at] < n:
            before[after[at]] = at
        propose(before[at])
        propose(at)
    return [i for i, x in zip(ids, alive, strict=True) if x]


def joint_agenda(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, dropout: float, vocabulary: Vocabulary, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of many short chunks: every round makes each chunk's best merge that is not skipped.

    The merges go to ``made``, as chunk, start, middle and end.
    """
    limit, ready = _limit(dropout), []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    none = np.int64(2**62)

    def candidates(at: np.ndarray) -> np.ndarray:
        """Order of merging symbol ``at`` with the next: rank, then place; ``none`` if it can't be."""
        out = np.full(len(at), none)
        able = at + 1 < len(ids)
        able[able] = owner[at[able]] == owner[at[able] + 1]
        a = at[able]
        to = vocabulary.merged(ids[a], ids[a + 1])
        stop = np.where((a + 2 < len(ids)) & (owner[np.minimum(a + 2, len(ids) - 1)] == owner[a]), start[np.minimum(a + 2, len(ids) - 1)], sizes[owner[a]])
        good = to >= 0
        if limit:
            good &= ~_skipped(keys[owner[a]], start[a], start[a + 1], stop, limit)
        out[able] = np.where(good, vocabulary.rank[np.maximum(to, 0)] << 20 | start[a], none)
        return out

    order = candidates(np.arange(len(ids)))
    while len(ids):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(order, first)
        open_ = best < none
        if not open_.all():  # chunks without a candidate are ready
            stay = np.repeat(open_, np.diff(np.append(first, len(ids))))
            ready.append((owner[~stay], ids[~stay]))
            ids, owner, start, order = ids[stay], owner[stay], start[stay], order[stay]
            if not len(ids):
                break
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = best[open_]
        at = np.flatnonzero(order == np.repeat(best, np.diff(np.append(first, len(ids)))))
        if made is not None:
            within = (at + 2 < len(ids)) & (owner[np.minimum(at + 2, len(ids) - 1)] == owner[at])
            made.append((owner[at], start[at], start[at + 1], np.where(within, start[np.minimum(at + 2, len(ids) - 1)], sizes[owner[at]])))
        ids[at] = vocabulary.merged(ids[at], ids[at + 1])
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids, owner, start, order = ids[stay], owner[stay], start[stay], order[stay]
        at = at - np.arange(len(at))
        marks = np.zeros(len(ids) + 1, bool)
        marks[at] = marks[at - 1] = True
        renew = np.flatnonzero(marks[: len(ids)])
        order[renew] = candidates(renew)
    owner = np.concatenate([o for o, _ in ready]) if ready else np.zeros(0, np.int64)
    ids = np.concatenate([i for _, i in ready]) if ready else np.zeros(0, np.int64)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))


class Segmenter:
    """Plain segmentations of chunks, kept until there are ``limit`` chunks, which bounds memory."""

    def __init__(self, path: str, dropout: float, seed: int, limit: int = 600_000):
        self.vocabulary = Vocabulary(path)
        self.dropout, self.seed, self.limit = dropout, seed, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.size, self.first_made, self.n_made = (np.zeros(0, np.int64) for _ in range(4))
        self.long = np.zeros(0, bool)
        self.made = np.zeros((3, 1 << 16), np.int32)
        self.used = self.used_made = 0

    def _segmented(self, names: list[str], keys: np.ndarray, dropout: float, made: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, where each chunk's begin, how many it has, and which chunks are long."""
        v = self.vocabulary
        symbols, sizes = v.symbols(names)
        short = sizes <= LONG
        flat, lens = joint_agenda(symbols[np.repeat(short, sizes)], sizes[short], keys[short], dropout, v, made)
        odd = np.zeros(len(names), bool)
        odd[np.flatnonzero(short)[np.repeat(np.arange(len(lens)), lens)[flat < 0]]] = True
        # Long chunks, and those with characters to spell in bytes, are few and go one by one.
        ends, stops = np.cumsum(sizes), np.cumsum(lens)
        size, start = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        size[short], start[short] = lens, stops - lens
        found, total = [], len(flat)
        for k in np.flatnonzero(odd | ~short).tolist():
            one = flat[start[k] : start[k] + size[k]].tolist() if short[k] else agenda(symbols[ends[k] - sizes[k] : ends[k]].tolist(), int(keys[k]), dropout, v)
            found.append(np.array(v.spelled(one), np.int32))
            start[k], size[k] = total, len(found[-1])
            total += len(found[-1])
        return np.concatenate([flat.astype(np.int32), *found]), start, size, ~short

    def _put(self, flat: np.ndarray) -> None:
        """Ids behind those that are kept; they stay only if ``used`` is moved on."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(flat), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat

    def _add(self, new: list[str]) -> None:
        made: list = []
        flat, start, size, long = self._segmented(new, np.zeros(len(new), np.uint64), 0.0, made)
        self._put(flat)
        self.start, self.size, self.long = (np.concatenate(x) for x in ((self.start, start + self.used), (self.size, size), (self.long, long)))
        self.used += len(flat)
        owner, *places = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 4
        order = np.argsort(owner, kind="stable")
        n_made = np.zeros(len(new), np.int64)
        n_made[~long] = np.bincount(owner, minlength=int((~long).sum()))
        self.first_made = np.concatenate([self.first_made, self.used_made + np.cumsum(n_made) - n_made])
        self.n_made = np.concatenate([self.n_made, n_made])
        if self.used_made + len(owner) > self.made.shape[1]:
            self.made = np.concatenate([self.made, np.zeros((3, self.used_made + len(owner)), np.int32)], axis=1)
        self.made[:, self.used_made : self.used_made + len(owner)] = np.array(places)[:, order]
        self.used_made += len(owner)

    def keys(self, names: list[int], sizes: np.ndarray) -> np.ndarray:
        """A key for every occurrence of a chunk, by the seed, the text's name and the place in the text."""
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = np.repeat(mixed(np.array([n & MASK for n in names], np.uint64) ^ np.uint64(self.seed & MASK), 15), sizes)
        return mixed(key + place.astype(np.uint64), 16)

    def _changed(self, found: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Occurrences that skip a merge of their plain segmentation, and the long ones."""
        n = self.n_made[found]
        of = np.repeat(np.arange(len(found)), n)
        at = np.arange(len(of)) + np.repeat(self.first_made[found] - (np.cumsum(n) - n), n)
        skipped = _skipped(keys[of], *self.made[:, at], _limit(self.dropout))
        out = self.long[found]
        out[of[skipped]] = True
        return np.flatnonzero(out)

    def encode(self, texts: list[str], names: list[int]) -> list[np.ndarray]:
        """The ids of each text. names: a number for each text, which keys its dropout."""
        split = [CHUNKS.findall(f" {t}") if t else [] for t in texts]
        parts = list(itertools.chain.from_iterable(split))
        if len(self.index) > self.limit:
            self.clear()
        found = np.fromiter(map(self.index.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        if len(fresh := np.flatnonzero(found < 0)):
            unknown = [parts[k] for k in fresh.tolist()]
            new, n = list(dict.fromkeys(unknown)), len(self.index)
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            self._add(new)
            found[fresh] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        begin, lens = self.start[found], self.size[found]
        if self.dropout and len(parts):
            keys = self.keys(names, sizes)
            changed = self._changed(found, keys)
            flat, start, size, _ = self._segmented([parts[k] for k in changed.tolist()], keys[changed], self.dropout)
            self._put(flat)
            begin[changed], lens[changed] = start + self.used, size
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self.flat[np.repeat(begin - ends[:-1], lens) + np.arange(ends[-1])]
        stops = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [flat[a:b] for a, b in zip(stops, stops[1:], strict=False)]


@functools.cache
def segmenter(path: str, dropout: float, seed: int, limit: int = 600_000) -> Segmenter:
    """One for each Python worker, kept from task to task."""
    return Segmenter(path, dropout, seed, limit)


def encoded(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row.

    A null or empty text has no ids. Rows with the same id and text get the same ids; with
    dropout 0 the ids are the model's own. Other columns are ignored; a null id stays null;
    an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model or default_model(), dropout, seed)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                ids = part.column("doc_id")
                got = s.encode(texts.cast(pa.large_string()).to_pylist(), [i or 0 for i in ids.to_pylist()])
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(work, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; no ids give the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = segmenter(model or default_model(), 0.0, 0).vocabulary
        for batch in batches:
            texts = [v.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trips(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and lossless of every row, encoded and decoded in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model or default_model(), dropout, seed)
        out = s.vocabulary.out
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                ids, raw = part.column("doc_id"), texts.to_pylist()
                got = s.encode([t.decode() for t in raw], [i or 0 for i in ids.to_pylist()])
                back = [b"".join(map(out.__getitem__, x.tolist()))[1:] for x in got]
                columns = [
                    pa.array(list(map(len, got)), pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4")) for x in got], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(raw, back, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"])

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(work, schema)


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir))
