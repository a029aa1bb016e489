"""Ranked lexical search by a bit-sliced impact index.

The index is a row for each block of documents and term: which documents of the block hold the
term, and how often. A block is up to 8192 documents of one input split, so the texts are read once and
never shuffled. A term's impact on a document is an integer that depends on the term's weight and the
document's length. Search writes a term's impacts over a block as bitmaps, one for each bit; the
bitmaps of a query's terms are added with carries, 64 documents at a time and all queries of a
chunk at once, and the k best documents are found by going down from the most significant slice. The
best of all blocks are then merged.

A block is searched over as many documents at a time as fit 64 MB of bitmaps. Queries are
searched in chunks of about 256; a chunk's terms reach the blocks' postings by a join on term and a salt, so
the rows of a frequent term lie in several tasks. Reading texts, terms that no query holds are left out by
a table of 2^23 bits, whose size depends on nothing; the join leaves out the few that pass by chance.

A null or empty text has no terms: such a document counts nowhere, such a query has no result.
Every row is a document or a query of its own, also with equal or null ids; equal scores rank null ids first.
Without documents or queries the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallytree.llm.common import documents, lower_ascii, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What each UTF-8 byte of a text becomes: A-Z lower-cased, other ASCII beside letters and digits a space.
BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
K = 10
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 4_000_000
CHUNK = 256
SALTS = 16
#: Bits of the table of query terms.
KNOWN = 1 << 23
#: Bytes of bitmaps at a time.
BITMAPS = 64 << 20
INDEX = "block long, term string, docs array<int>, counts array<int>, ids array<long>"


def terms(text: Column) -> Column:
    """The terms of a text as an array; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def known_terms(wanted: DataFrame) -> bytes:
    """Bits of fixed number, set for the hashes of all terms."""
    h = F.crc32(F.col("term").cast("binary")) % KNOWN
    blocks = wanted.select(F.shiftright(h, 15).alias("block"), (h % 32768).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = bytearray(KNOWN // 8)
    for r in blocks.collect():  # at most 256 rows of 4 KB
        table[r.block * 4096 : (r.block + 1) * 4096] = r.bits
    return bytes(table)


def index(docs: DataFrame, known: bytes | None = None) -> DataFrame:
    """The index (block, term, docs, counts, ids) of docs (doc_id, text), as a stored table.

    docs: places in the block; counts: the term's occurrences in each. A block's own row has no term; its
    counts are the documents' numbers of terms and ids their ids. known: a table of terms to keep.
    """
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])

    def rows(block: int, ids: list, lengths: list[int], postings: dict[bytes, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        one = [pa.array([x], schema.field(k).type) for k, x in enumerate((block, None, None, lengths, ids))]
        yield pa.RecordBatch.from_arrays(one, schema=schema)
        found = list(postings.items())
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            ends = pa.array(np.cumsum([0, *(len(p[0]) for _, p in part)]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.fromiter(chain.from_iterable(p[k] for _, p in part), np.int32))) for k in (0, 1))
            texts = pa.array([t for t, _ in part], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), texts, *lists, pa.nulls(len(part), schema.field("ids").type)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[int] = []
        postings: dict[bytes, tuple[list, list]] = {}
        size = 0
        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for doc_id, text in zip(own, texts, strict=True):
                words = (text.as_py() or b"").translate(BYTES).split()
                for term, n in Counter(words).items():
                    h = crc32(term) % KNOWN
                    if known is None or known[h >> 3] >> (h & 7) & 1:
                        docs, counts = postings.get(term) or postings.setdefault(term, ([], []))
                        docs.append(len(ids))
                        counts.append(n)
                        size += 1
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) == BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield from rows(block, ids, lengths, postings)
                    block, ids, lengths, postings, size = block + 1, [], [], {}, 0
        if ids:
            yield from rows(block, ids, lengths, postings)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, INDEX), "index")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def sliced(places: np.ndarray, impacts: np.ndarray, bits: int, words: int) -> np.ndarray:
    """bits x words bitmaps of the impacts at the places, least significant first."""
    cells = np.zeros((bits, words * 64), np.uint8)
    cells[:, places] = impacts >> np.arange(bits)[:, None] & 1
    return np.packbits(cells, axis=1, bitorder="little").view(np.uint64)


def added(slices: np.ndarray, queries: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """queries x width x words: sums of the queries' rows of slices. queries: rows, by descending sizes."""
    total = np.zeros((len(queries), width, slices.shape[2]), np.uint64)
    bits = slices.shape[1]
    for t in range(queries.shape[1]):
        n = int((sizes > t).sum())
        rows, carry = queries[:n, t], np.zeros((n, slices.shape[2]), np.uint64)
        for b in range(width):
            old = total[:n, b]
            if b < bits:
                new = slices[rows, b]
                either = old ^ new
                new &= old
                total[:n, b] = either ^ carry
                carry = new | (either & carry)
            else:
                total[:n, b], carry = old ^ carry, old & carry
                if not carry.any():
                    break
    return total


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the documents that are surely among the k best, and of those that tie for the places left.

    Going down the slices: if the candidates with this bit are too many, only they stay; else they are in.
    """
    tied = np.bitwise_or.reduce(total, axis=1)
    sure = np.zeros_like(tied)
    for b in range(total.shape[1] - 1, -1, -1):
        with_bit = tied & total[:, b]
        more = sure | with_bit
        n = np.bitwise_count(more).sum(1, dtype=np.int64)[:, None]
        tied = np.where(n > k, with_bit, np.where(n == k, np.uint64(0), tied & ~total[:, b]))
        sure = np.where(n > k, sure, more)
    return sure, tied


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(post: pa.Table, block: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    """item, doc_id, score: the k best of one block for each of a chunk's queries."""
    found: tuple[list, list, list] = ([], [], [])
    if len(post):
        lengths = _lists(block["counts"])[0].astype(np.int64)
        ids = block["ids"].combine_chunks().values
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((numbers, ~missing))  # null ids first
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        norm = 10 + 90 * lengths * n_docs // n_terms
        docs, ends = _lists(post["docs"])
        counts = _lists(post["counts"])[0].astype(np.int64)
        w = post["w"].to_numpy()
        impacts = [w[r] * (1_000_000_000 * counts[a:b] // (1000 * counts[a:b] + 8 * norm[docs[a:b]])) for r, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        places = [place[docs[a:b]] for a, b in zip(ends, ends[1:], strict=False)]
        rows_of: dict[int, list[int]] = {}
        for r, items in enumerate(post["items"].to_pylist()):
            for i in items:
                rows_of.setdefault(i, []).append(r)
        items = sorted(rows_of, key=lambda i: (-len(rows_of[i]), i))
        sizes = np.array([len(rows_of[i]) for i in items])
        queries = np.full((len(items), sizes[0]), len(post))  # rows of no query's are the zero row
        for q, i in enumerate(items):
            queries[q, : sizes[q]] = rows_of[i]
        bits = max(int(x.max()) for x in impacts).bit_length() or 1
        width = bits + int(sizes[0]).bit_length()
        step = max(1, BITMAPS // (8 * ((len(post) + 1) * bits + len(items) * width)))  # words at a time
        for low in range(0, len(order), step * 64):
            words = min(step, -(-(len(order) - low) // 64))
            slices = np.zeros((len(post) + 1, bits, words), np.uint64)
            for r in range(len(post)):
                own = (places[r] >= low) & (places[r] < low + words * 64)
                slices[r] = sliced(places[r][own] - low, impacts[r][own], bits, words)
            total = added(slices, queries, sizes, width)
            sure, tied = best(total, k)
            for q, i in enumerate(items):
                top = _places(sure[q])
                at = np.concatenate([top, _places(tied[q])[: k - len(top)]])  # ties by id
                scores = ((total[q][:, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) << np.arange(width, dtype=np.uint64)[:, None]).sum(0, dtype=np.uint64)
                found[0].extend([i] * len(at))
                found[1].extend(None if missing[d] else int(numbers[d]) for d in order[at + low])
                found[2].extend(scores.astype(np.int64).tolist())
    return pa.table([pa.array(x, pa.int64()) for x in found], names=["item", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """queries (item_id, text): each one's k best documents as item_id, rank, doc_id, score."""
    items = queries.select("item_id", F.array_distinct(terms(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "queries")
    chunks = max(1, -(-items.count() // CHUNK))
    wanted = items.select("item", F.pmod(F.xxhash64("item"), F.lit(chunks)).alias("chunk"), F.explode("terms").alias("term"))
    table = index(docs, known_terms(wanted))
    blocks, postings = table.where("term IS NULL").select("block", "counts", "ids"), table.where("term IS NOT NULL")
    told = blocks.agg(F.sum(F.size(F.filter("counts", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).first()
    n_docs, n_terms = told.n or 0, told.l or 1
    df = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = wanted.groupBy("chunk", "term").agg(F.collect_list("item").alias("items")).join(df.select("term", weight.alias("w")), "term")
    weighted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = postings.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(weighted, ["term", "salt"]).select("block", "chunk", "docs", "counts", "w", "items")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")
    every = blocks.select(*(F.col(c).alias(c) for c in blocks.columns), each)

    def work(post: pa.Table, block: pa.Table) -> pa.Table:
        return search_block(post, block, n_docs, n_terms, k)

    found = asked.groupBy("block", "chunk").cogroup(every.groupBy("block", "chunk")).applyInArrow(work, "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
