"""Log-probabilities of documents under a backoff automaton of smoothed n-grams.

Words, pairs and triples are counted over all training documents; pairs and triples seen at
least ``LEAST_COUNT`` times become arcs, whatever the size of the input. A state is the
longest kept suffix of what was read, an arc a kept n-gram with its interpolated probability;
where a state has no arc for the next word, its failure arc leads to the next shorter suffix
and multiplies by the weight that absolute discounting left over.

The automaton is never in one place: it is a table of what a word, pair or triple adds to a
score. Failure weights are taken at every word and pair, and an arc's row gives back what
it replaces, so the walk is a sum. Documents lie in chunks of a few MB. A chunk asks once for
each of its different n-grams; what it asks of one range of hashes is one row of sorted hashes,
and the answer is a row of numbers in the same order. The number of ranges follows the
input, so that a group that adds up or answers keeps its size. Bit tables of fixed size leave
out n-grams that were surely not kept; they lose none of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.llm.common import documents, dropped, id_crc, stored
from tallytree.llm.hashing import mixed, slices, word_hashes

LEAST_COUNT = 3
DISCOUNT = 0.75
END = mixed(np.zeros(1, np.uint64), 99)[0]
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the tables that tell n-grams which were surely not kept.
BITS = 25
CHUNK = 1 << 22
#: Tokens of the training texts for each range of hashes that is added up.
PART = 1 << 19
#: Shares of the chunks that ask one after another, so that a share of the questions lies on disk at a time.
SHARES = 3


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two words, or of two pairs that overlap in a word and so make a triple."""
    return mixed(mixed(a, 21) * STEP + b, 22)


def _tokens(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens (words, then END for each row) and where rows begin."""
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _pairs(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, END at the beginning of a row; and the hashes of the pairs."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins[:-1]] = END
    return before, _joined(before, tokens)


def _later(begins: np.ndarray) -> np.ndarray:
    """Places of the tokens that are not the first of a row; a triple ends at each."""
    good = np.ones(begins[-1], bool)
    good[begins[:-1]] = False
    return np.flatnonzero(good)


def _at(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _at(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_table(keys: DataFrame) -> np.ndarray:
    """A packed bit table of fixed size that holds all keys (and, by chance, some others)."""
    at = F.shiftrightunsigned("key", 64 - BITS)
    blocks = keys.select(F.shiftright(at, 15).alias("block"), at.bitwiseAND(32767).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    total = np.zeros((1 << BITS >> 15, 4096), np.uint8)
    for block, bits in blocks.collect():
        total[block] = np.frombuffer(bits, np.uint8)
    return total.ravel()


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The number of each key's range, of ``ranges`` equal ones."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def range_of(key: Column, ranges: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(ranges).cast("long"), 32)


def _binaries(ends: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """The bytes of the numbers, cut at ``ends`` (the first is 0)."""
    offsets = pa.py_buffer((ends * numbers.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(numbers))])


def _packed(keys: np.ndarray, ranges: int, /, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each range that the sorted keys meet: its number and its stretch of every column."""
    at = _range(keys, ranges)
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    ends = np.append(begins, len(keys))
    return pa.RecordBatch.from_arrays([pa.array(at[begins]), *(_binaries(ends, x) for x in columns.values())], names=["range", *columns])


def _unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries, and how many each row has."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for c in filter(len, column.chunks):
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]])
        sizes.append(np.diff(ends))
    return np.concatenate(parts).view(kind), np.concatenate(sizes) // np.dtype(kind).itemsize


def _merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    key, a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
    key, at, place = np.unique(key, return_index=True, return_inverse=True)
    return key, a[at], b[at], np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)


def _adding(parts_of, sent, most: int = 750_000):
    """A task's work that adds n-grams up and sends them, ``most`` keys at a time.

    parts_of(tokens, begins) gives key, a and b of a run of rows; sent(key, a, b, n) makes a batch.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for _, texts in slices(batch, "_text"):
                key, a, b = parts_of(*_tokens(*word_hashes(texts, lower=True)))
                found.append(_merged([(key, a, b, np.ones(len(key)))]))
                held += len(found[-1][0])
                if held > most:
                    found = [_merged(found)]
                    held = len(found[0][0])
                    if held > most // 2:
                        yield sent(*found[0])
                        found, held = [], 0
        if found:
            yield sent(*_merged(found))

    return work


def counted_words(docs: DataFrame) -> DataFrame:
    """(key, n) of every word."""

    def sent(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    parts = docs.select("_text").mapInArrow(_adding(lambda t, begins: (t, t, t), sent), "key long, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, parts_of, ranges: int) -> DataFrame:
    """(key, a, b, n) of the n-grams that are kept; a group adds one range of hashes up."""

    def sent(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return _packed(key, ranges, a=a, b=b, n=n)

    def add(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        a, b, n = (_unpacked(rows[c], kind)[0] for c, kind in (("a", np.uint64), ("b", np.uint64), ("n", np.int64)))
        every = _merged([(_joined(a, b), a, b, n)])
        kept = every[3] >= LEAST_COUNT
        yield pa.RecordBatch.from_arrays([pa.array(x[kept].view(np.int64)) for x in every], names=["key", "a", "b", "n"])

    parts = docs.select("_text").mapInArrow(_adding(parts_of, sent), "range long, a binary, b binary, n binary")
    return parts.groupBy("range").applyInArrow(add, "key long, a long, b long, n long")


def trained(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int]:
    """(key, value, base) of every word and kept pair and triple, bit tables of the pairs and the triples, number of tokens and of different words.

    value: what a key adds to a score; base: log-probability of a word alone.
    """
    spark = docs.sparkSession
    words = stored(counted_words(docs), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = n // PART + 1
    known = spark.sparkContext.broadcast(bit_table(words.where(F.col("n") >= LEAST_COUNT)))

    # The words of a kept pair and the pairs of a kept triple are kept themselves.
    def pairs_of(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        often = _may_hold(known.value, tokens)
        before, key = _pairs(tokens, begins)
        good = often & _may_hold(known.value, before)
        return key[good], before[good], tokens[good]

    pairs = stored(counted(docs, pairs_of, ranges), "pairs")
    bits2 = bit_table(pairs)
    known2 = spark.sparkContext.broadcast(bits2)

    def triples_of(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        key, at = _pairs(tokens, begins)[1], _later(begins)
        often = _may_hold(known2.value, key)
        at = at[often[at] & often[at - 1]]
        return _joined(key[at - 1], key[at]), key[at - 1], key[at]

    triples = stored(counted(docs, triples_of, ranges), "triples")
    bits3, spent = bit_table(triples), [words, pairs, triples]

    def left(arcs: DataFrame, contexts: DataFrame) -> DataFrame:
        """Every context with f, the weight of its failure arc."""
        taken = arcs.groupBy(F.col("a").alias("key")).agg(F.sum(F.col("n") - DISCOUNT).alias("_taken"))
        return contexts.join(taken, "key", "left").withColumn("f", F.greatest(1 - F.coalesce(F.col("_taken") / F.col("n"), F.lit(0.0)), F.lit(1e-12))).drop("_taken")

    p1 = (F.col("n") + 1) / F.lit(float(n + v + 1))
    words = stored(left(pairs, words).select("key", "n", p1.alias("p"), "f"), "states")
    of = lambda df, end: df.select(F.col("key").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "p", "f")))
    lower = F.col("f_a") * F.col("p_b")

    def arcs(ngrams: DataFrame, states: DataFrame) -> DataFrame:
        told = ngrams.join(of(states, "a").drop("p_a"), "a").join(of(states, "b").drop("n_b", "f_b"), "b")
        p = (F.col("n") - DISCOUNT) / F.col("n_a") + lower
        return told.select("key", "n", p.alias("p"), F.log10(p / lower).alias("more"))

    pairs = stored(left(triples, arcs(pairs, words)), "states")
    spent += [words, pairs]
    triples = arcs(triples, pairs)
    base = F.log10("p")
    none = F.lit(0.0).alias("base")
    values = words.select("key", (base + F.log10("f")).alias("value"), base.alias("base"))
    values = values.union(pairs.select("key", F.col("more") + F.log10("f"), none)).union(triples.select("key", "more", none))
    values = stored(values, "values")
    dropped(*spent)
    return values, bits2, bits3, int(n), int(v)


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, rows): runs of rows as compressed Arrow streams of doc_id, _held and _text."""

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        run, sink = pa.Table.from_batches(parts).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(run)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size = [], 0
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                if size and size + part.nbytes > CHUNK:
                    yield row(run)
                    run, size = [], 0
                run.append(part.set_column(part.schema.get_field_index("_text"), "_text", texts))
                size += part.nbytes
        if run:
            yield row(run)

    return stored(docs.mapInArrow(work, "rows binary").withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def _rows_of(chunk: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(chunk.as_buffer()).read_all().combine_chunks()


def _tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As _tokens, of a whole chunk; texts are hashed in short runs."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        h, first = word_hashes(part, lower=True)
        hashes.append(h)
        sizes.append(np.diff(first))
    return _tokens(np.concatenate(hashes), np.cumsum(np.concatenate(sizes)))


def _asked(texts: pa.Array, bits2: np.ndarray, bits3: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where rows begin; the sorted different n-grams that may be in the table; and for each
    place of one (words first, then pairs, then triples) its row and its index among them."""
    tokens, begins = _tokens_of(texts)
    pairs, at = _pairs(tokens, begins)[1], _later(begins)
    may = _may_hold(bits2, pairs)
    at = at[may[at] & may[at - 1]]
    triples = _joined(pairs[at - 1], pairs[at])
    may3 = _may_hold(bits3, triples)
    row = np.repeat(np.arange(len(texts)), np.diff(begins))
    keys, place = np.unique(np.concatenate([tokens, pairs[may], triples[may3]]), return_inverse=True)
    return begins, keys, np.concatenate([row, row[may], row[at[may3]]]), place


def asked(told: DataFrame, bits: Broadcast, ranges: int) -> DataFrame:
    """(range, chunk, keys): what each chunk asks of a range, sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows"), strict=True):
                keys = _asked(_rows_of(rows)["_text"].chunk(0), *bits.value)[1]
                rows = _packed(keys, ranges, keys=keys)
                yield rows.append_column("chunk", pa.array(np.full(rows.num_rows, chunk)))

    return told.mapInArrow(work, "range long, keys binary, chunk long")


def in_ranges(values: DataFrame, ranges: int) -> DataFrame:
    """(range, key, value, base): a row for each range, its values as arrays sorted by key."""

    def work(known: pa.Table) -> pa.Table:
        order = np.argsort(known["key"].to_numpy().view(np.uint64))
        columns = [_binaries(np.array([0, len(order)]), known[c].to_numpy()[order]) for c in ("key", "value", "base")]
        return pa.Table.from_arrays([known["range"][:1], *columns], names=["range", "key", "value", "base"])

    told = values.withColumn("range", range_of(F.col("key"), ranges))
    return stored(told.groupBy("range").applyInArrow(work, "range long, key binary, value binary, base binary"), "ranges")


def answered(questions: DataFrame, told: DataFrame) -> DataFrame:
    """(chunk, range, value, base): numbers in the order of the questions, 0 for what is not in the table."""

    def work(asking: pa.Table, known: pa.Table) -> pa.Table:
        keys, sizes = _unpacked(asking["keys"], np.uint64)
        have = _unpacked(known["key"], np.uint64)[0]
        at = np.searchsorted(have, keys)
        hit = np.flatnonzero(at < len(have))
        hit = hit[have[at[hit]] == keys[hit]]
        ends, found = np.append(0, np.cumsum(sizes)), []
        for c in ("value", "base"):
            numbers = np.zeros(len(keys))
            numbers[hit] = _unpacked(known[c], np.float64)[0][at[hit]]
            found.append(_binaries(ends, numbers))
        return pa.Table.from_arrays([asking["chunk"], asking["range"], *found], names=["chunk", "range", "value", "base"])

    return questions.groupBy("range").cogroup(told.groupBy("range")).applyInArrow(work, "chunk long, range long, value binary, base binary")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def walked(told: DataFrame, answers: DataFrame, bits: Broadcast, unseen: float) -> DataFrame:
    """The scores of all rows, from the chunks and their answers; unseen: log-probability of a word not in the table."""

    def work(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows_of(chunk["rows"][0])
        ids, held, texts = (rows[c].chunk(0) for c in ("doc_id", "_held", "_text"))
        answers = answers.sort_by("range")
        value, base = (_unpacked(answers[c], np.float64)[0] for c in ("value", "base"))
        begins, _, row, place = _asked(texts, *bits.value)
        n = begins[-1]
        every, alone = value[place], base[place[:n]]
        seen = alone != 0
        every[:n][~seen] = unseen
        alone[~seen] = unseen
        total = lambda x: np.bincount(row[: len(x)], x, len(ids))
        columns = [ids, held, pa.array(np.diff(begins)), pa.array(total(seen).astype(np.int64)), pa.array(total(alone)), pa.array(total(every))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return told.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, SCORED)


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out: a condition on columns of docs; rows where it holds are not counted. A-Z is
    lower-cased, words split at ASCII white space, and one end token closes each text, so a
    null or empty text is one token. Repeated rows are scored and counted each time. The score
    never takes a word's spelling into account: unknown words share one probability. With
    nothing to learn from, every token has the probability one. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    values, bits2, bits3, n, v = trained(docs.where("NOT _held"))
    bits = docs.sparkSession.sparkContext.broadcast((bits2, bits3))
    told = chunks(docs)
    # As many ranges as chunks: a group answers about as much as one chunk asks.
    ranges = max(1, told.count())
    table, unseen, scores = in_ranges(values, ranges), -float(np.log10(n + v + 1)), []
    dropped(values)
    for share in range(SHARES):
        part = told.where(F.pmod(F.xxhash64("chunk"), F.lit(SHARES)) == share)
        answers = stored(answered(asked(part, bits, ranges), table), "answers")
        scores.append(stored(walked(part, answers, bits, unseen), "scores"))
        dropped(answers)
    dropped(told, table)
    rows = reduce(DataFrame.union, scores)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, F.pmod(id_crc(F.col("doc_id")), F.lit(7)) == 2)
