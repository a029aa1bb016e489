"""The pipeline on odd tables: nulls in any column, repeated rows, shared ids, clashing names, very long texts, no rows."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _row string, h string, component_id string"


def said(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def table():
    rng = random.Random(21)
    long = "\n".join(said(rng, 40) for _ in range(2000))  # more than 0.5 MB in lines that differ
    whole = [said(rng, 60) for _ in range(5)]
    rows = [(1, whole[0], "en", "s"), (1, whole[0], "en", "s"), (None, whole[1], None, None), (None, whole[2], "en", "s"), (2, None, None, None), (3, "", "en", None), (None, None, None, None), (4, " \t\n", "en", "s")]
    rows += [(5, long, "en", "s"), (6, whole[3], None, "s"), (7, whole[3] + " again", "en", None), (8, whole[4], "en", "s")]
    return [(i, t, lang, s, None if t is None else len(t), "x", "x", "x", "x") for i, t, lang, s in rows], whole, long


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    import corpus_pipeline

    folder, now, kept = tmp_path_factory.mktemp("odd"), spark.createDataFrame(table()[0], SCHEMA).repartition(3), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, str(folder))
        assert k == 4 or made.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        made.write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        kept.append(now.collect())
    return kept


def test_rows_after_each_stage(results):
    _, whole, long = table()
    first = Counter((r.doc_id, r.text) for r in results[0])
    assert first == Counter([(1, whole[0]), (1, whole[0]), (None, whole[1]), (None, whole[2]), (5, long), (6, whole[3]), (7, whole[3] + " again"), (8, whole[4])])
    assert all(r.n_chars == len(r.text) and {r["_text"], r["_row"], r.h, r.component_id} == {"x"} for k in range(4) for r in results[k])
    lines = Counter((r.doc_id, r.text) for r in results[1])
    assert lines[5, long] == 1 and lines[7, ""] == 1 and lines[6, whole[3]] == 1 and sum(lines.values()) == 8
    assert lines[1, whole[0]] == 2  # rows that repeat id and text are one document there
    groups = Counter((r.doc_id, r.text) for r in results[2])
    assert groups == Counter({**{k: 1 for k in lines}})
    assert Counter((r.doc_id, r.text) for r in results[3]) == groups


def test_every_token_is_packed_once(results):
    pieces = results[4]
    ids = Counter(r.doc_id for r in results[3])
    ends = Counter(r.doc_id for r in pieces if r.start + r.length == r.doc_tokens)
    assert ends == ids
    cells = Counter((r.sequence_id, r.offset + k) for r in pieces for k in range(r.length))
    assert max(cells.values()) == 1 and max(at for _, at in cells) < 2048
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, set()).update(range(r.offset, r.offset + r.length))
    assert all(v == set(range(len(v))) for v in by.values())


def test_no_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_the_packing_is_near_its_bound(spark):
    """No more sequences than 2 % above the fewest that hold all tokens, on documents of many lengths."""
    from tallytree.llm import packing

    rng = random.Random(4)
    docs = spark.createDataFrame([(k, said(rng, rng.choice([3, 20, 60, 150, 400, 900]))) for k in range(400)], "doc_id long, text string").withColumn("lang", F.lit("x"))
    pieces = packing.packed_documents(docs).collect()
    tokens = sum(r.length for r in pieces)
    used = len({r.sequence_id for r in pieces})
    assert tokens == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    assert used <= -(-tokens // 2048) * 1.02 + 1
