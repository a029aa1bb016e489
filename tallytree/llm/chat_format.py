r"""Chat formatting: conversations as marked text with a loss mask, assembled column by column.

A turn becomes ``[INST]role[/INST]text</s>``. These marks and ``<s>`` are control strings: inside a role or a
text each gets one more backslash after its first character (``<\/s>``, and ``<\\/s>`` for a text that
holds ``<\/s>``), which reading takes away again. The loss mask is the assistants' texts, as spans of code points.

Turns are dealt out by ranges of (conversation, turn, role, hash of the text), so a long conversation lies in several tasks.
Each Arrow batch of turns is written into one buffer: lengths of all segments, their
cumulative offsets, and for marks and contents the indices at which their bytes go. A batch gives a piece
for each conversation that it touches; pieces are rows, never joined, and are read back as a stream.

A null text or role is empty, a null turn comes first, a null conversation is one. Turns with equal
numbers are ordered by role and hash of the text; repeated rows are turns of their own. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.llm.common import stored

OPEN, MIDDLE, CLOSE = b"[INST]", b"[/INST]", b"</s>"
#: Control strings with any number of backslashes: what precedes them and what follows.
CONTROLS = [("[", r"\[(\\*/?INST\])"), ("<", r"<(\\*/?s>)")]
ESCAPED = [(re.compile(rf"{re.escape(a)}\\(\\*/?{b})"), rf"{a}\1") for a, b in (("[", r"INST\]"), ("<", "s>"))]
TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
LEARNED = "assistant"
#: Bytes of contents whose indices are made at a time.
SLICE = 4 << 20
PIECES = "conv_id long, piece long, n_turns long, text string, loss array<struct<start:long,length:long>>"
SAYS = "</s>[INST] ok [/INST]"


def escaped(texts: pa.Array) -> pa.Array:
    """Texts without control strings; null is empty."""
    texts = pc.fill_null(texts, "")
    for first, pattern in CONTROLS:
        texts = pc.replace_substring_regex(texts, pattern, first + r"\\\1")
    return texts


def unescaped(text: str) -> str:
    for pattern, plain in ESCAPED:
        text = pattern.sub(plain, text)
    return text


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contents and offsets of a string array."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def assembled(segments: list[bytes | pa.Array], n: int) -> tuple[pa.Buffer, np.ndarray]:
    """n rows of segments in one buffer, and where each row begins (n + 1 offsets). bytes: the same in every row."""
    columns = [x if isinstance(x, bytes) else _bytes(x) for x in segments]
    sizes = np.column_stack([np.full(n, len(x)) if isinstance(x, bytes) else np.diff(x[1]) for x in columns])
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    starts, total = ends - sizes, int(ends[-1, -1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    share = (ends[:, -1] - 1) // SLICE  # rows of one share are written together
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for k, x in enumerate(columns):
            if isinstance(x, bytes):
                out[starts[a:b, k, None] + np.arange(len(x))] = np.frombuffer(x, np.uint8)
            elif b - a == 1:
                out[starts[a, k] : ends[a, k]] = x[0][x[1][a] : x[1][b]]
            else:
                data, at = x
                moved = np.repeat(starts[a:b, k] - at[a:b], sizes[a:b, k])
                out[moved + np.arange(at[a], at[b])] = data[at[a] : at[b]]
    return buffer, np.concatenate([starts[:, 0], [total]])


def _pieces(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
    """A piece for each run of rows with one conversation."""
    conv, role, text = batch.column(0), escaped(batch.column(1)), escaped(batch.column(2))
    n = len(conv)
    buffer, begins = assembled([OPEN, role, MIDDLE, text, CLOSE], n)
    numbers, missing = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (missing[1:] != missing[:-1])])
    heads = np.flatnonzero(new)
    bounds = np.concatenate([heads, [n]])
    in_role, in_text = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (role, text))
    ends = np.cumsum(in_role + in_text + len(OPEN + MIDDLE + CLOSE))
    inside = ends - len(CLOSE) - in_text  # where texts begin, in code points of the batch
    before = np.concatenate([[0], ends])[heads]
    learned = pc.equal(pc.fill_null(batch.column(1), ""), LEARNED).to_numpy(zero_copy_only=False)
    spans = pa.StructArray.from_arrays([pa.array((inside - np.repeat(before, np.diff(bounds)))[learned]), pa.array(in_text[learned])], names=["start", "length"])
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(learned)])[bounds].astype(np.int32)), spans)
    texts = pa.StringArray.from_buffers(len(heads), pa.py_buffer(begins[bounds].astype(np.int32)), buffer)
    columns = [conv.take(pa.array(heads)), pa.array(first + np.arange(len(heads))), pa.array(np.diff(bounds)), texts, loss]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "n_turns", "text", "loss"])


def formatted(turns: DataFrame) -> DataFrame:
    """Pieces of formatted conversations, in their order by ``piece``, from turns (conv_id, turn, role, text).

    loss: spans of the piece's text that are learned, in code points.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    order = ["conv_id", "turn", "role", "_hash"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 40
        for batch in batches:
            if len(batch):
                made = _pieces(batch, piece)
                piece += len(made)
                yield made

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "_text")
    return stored(dealt.mapInArrow(work, PIECES), "chats")


def turns_of(text: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted piece."""
    found, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        found.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"A formatted text cannot be read at {at}.")
    return found


def read_back(pieces: DataFrame) -> DataFrame:
    """A row for each conversation: numbers and digests of its turns and of what is learned, from its pieces in a row."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def told(conv, n_turns, turns, n_loss, loss, chars) -> tuple:
        return conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), chars

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            done = []
            for conv, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if state is None or state[0] != conv:
                    done += [told(*state)] if state else []
                    state = [conv, 0, sha256(), 0, sha256(), 0]
                whole = text.as_py()
                for role, said in turns_of(whole):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in spans.as_py():
                    learned = unescaped(whole[span["start"] : span["start"] + span["length"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(whole)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, told(*state), strict=True))], schema=schema)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "text", "loss")
    return ordered.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, read back from their formatted pieces."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", SAYS), (-1, 1, LEARNED, SAYS)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(own.unionByName(more)))
