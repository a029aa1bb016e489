"""The pipeline on a small table: each stage's decisions take effect and clean documents stay."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrstv"]
    said = lambda n: " ".join(rng.choice(vocabulary, n))
    clean = [said(50) + "\n" + said(40) for _ in range(6)]
    near = clean[0].split(" ")
    near[10] = "other"
    rows = [*clean, " ".join(near), clean[1], "too short", None, said(40) + " write bob@site.org " + said(10)]
    docs = spark.createDataFrame([(i, t, "en", "h", None if t is None else len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns, name
            now.write.parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
            kept[k] = {r.doc_id: r.text for r in now.collect()}
            assert all(r.n_chars == len(r.text) for r in now.collect())
    assert set(kept[0]) == {0, 1, 2, 3, 4, 5, 6, 7, 10}
    assert kept[1][7] == "" and all(kept[1][i] == clean[i] for i in range(6))
    assert kept[1][6] == "" and set(range(6)) <= set(kept[2])
    assert "[email]" in kept[3][10] and all(kept[3][i] == clean[i] for i in range(6))
    pieces = now.collect()
    assert {r.doc_id for r in pieces} == set(kept[3]) and all(0 <= r.offset and r.offset + r.length <= 2048 for r in pieces)
