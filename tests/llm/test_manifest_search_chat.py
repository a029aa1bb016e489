"""The manifest, lexical search and chat formatting against brute force, with nulls, ties, long, empty and repeated rows."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallytree.llm import chat_format, lexical_search, merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, _key string, rank string, path string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels_above(nodes):
    """All levels of a tree, from the leaves to the root."""
    every = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        every.append(nodes)
    return every


def path_of(levels, k):
    out = []
    for nodes in levels[:-1]:
        run = k // 3 * 3
        out.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 3])))
        k //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 80, 82, 244])
def test_traversal_gives_every_path(n):
    leaves = [digest(str(k)) for k in range(n)]
    levels = levels_above(leaves)
    for step in (1, 2, 3):
        got = list(merkle_manifest.traversal(leaves, merkle_manifest.height(n), step))
        assert got == [path_of(levels, k) for k in range(n)]


def test_a_block_holds_few_subtrees():
    """What is kept beside the leaves does not grow with their number."""
    tree = merkle_manifest.Subtree([digest(str(k)) for k in range(3**7)], 0, 2, 0).complete()
    assert [len(x) for x in tree.nodes] == [9, 3] and tree.root == levels_above([digest(str(k)) for k in range(9)])[-1][0]


def test_paths_over_several_blocks(spark):
    """A source of more than one block, small sources, a null one, ties of ids, and clashing names."""
    rows = [(k, "big", None, 1, f"text {k}", "x", "x", "x", "x") for k in range(5000)]
    rows += [(1, None, "en", None, "a", "", "", "", ""), (None, None, "en", 2, None, "", "", "", ""), (7, "é", "en", 1, "", "", "", "", ""), (7, "é", "en", 1, "", "", "", "", ""), (9, "one", "de", 3, "x" * 3_000_000, "", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    leaves = docs.select("doc_id", "source", merkle_manifest.leaf_digest(F.col("text")).alias("digest"))
    got = merkle_manifest.authentication_paths(leaves).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], digest(*map(field, r[:5]))))
    trees = {s: levels_above([d for _, d in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s, v in by.items()}
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_above([trees[s][-1][0] for s in sources])
    assert len(got) == len(rows) and Counter((r.source, r.digest) for r in got) == Counter((s, d) for s, v in by.items() for _, d in v)
    used = {}
    for r in got:
        at = trees[r.source][0].index(r.digest, used.get((r.source, r.digest), -1) + 1)
        used[r.source, r.digest] = at
        assert r.subroot == trees[r.source][-1][0] and r.root == top[-1][0]
        assert [(x["left"], x["right"]) for x in r.path] == path_of(trees[r.source], at) + path_of(top, sources.index(r.source))


def test_manifest_query_finds_tampered_texts(spark, tmp_path):
    texts = ["one\ntwo", "plain", None, "", "\n", "three\n\nfour"]
    docs = spark.createDataFrame([(k, "s", "en", 1, texts[k % len(texts)]) for k in range(60)], "doc_id long, source string, lang string, n_chars long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in merkle_manifest.op11_merkle_manifest(spark, str(tmp_path)).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id % len(texts)] or "")
        assert r.verified == (not changed) and r.verified == (r.folded_root == r.root)


def test_manifest_without_rows_and_with_one(spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle_manifest.op11_merkle_manifest(spark, f"{tmp_path}/none").isEmpty()
    spark.createDataFrame([(3, "s", None, None, "t")], schema).write.parquet(f"{tmp_path}/one/documents.parquet")
    (r,) = merkle_manifest.op11_merkle_manifest(spark, f"{tmp_path}/one").collect()
    assert r.leaf == r.subroot == r.root == digest("1:3", "1:s", "-", "-", "1:t") and r.proof_sha256 == digest("")


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "é", "_", "日本語", "A1", "\x00", "it's"]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(k, said(rng.randrange(60))) for k in range(300)]
    docs += [(k, "w1 w2 w3") for k in range(300, 400)] + [(None, "w1 w2 w3"), (400, None), (401, ""), (402, " .,\n"), (403, "w5 " * 100_000), (5, docs[5][1])]
    items = [(k, said(rng.randrange(1, 30))) for k in range(40)] + [(100, None), (101, "?!"), (102, "nothing of this"), (103, "w1 w1 W2 w3"), (104, said(3000)), (None, "w7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "term", "ids")}).repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("item", "terms", "chunk")})
    got = [tuple(r) for r in lexical_search.search(frame, queries).collect()]
    assert Counter(got) == Counter(ranking(docs, items))
    assert lexical_search.search(frame.limit(0), queries).isEmpty() and lexical_search.search(frame, queries.limit(0)).isEmpty()


def test_more_queries_than_a_chunk_holds(spark):
    docs = [(k, f"a b{k % 7} c{k % 11} d{k}") for k in range(200)]
    items = [(k, f"a b{k % 7} d{k % 210}") for k in range(600)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3).collect()
    assert Counter(map(tuple, got)) == Counter(ranking(docs, items, 3))


def test_slices_add_up_and_give_the_best():
    """Sums of bitmaps are sums of numbers; going down them finds the k largest and all that tie."""
    rng = np.random.default_rng(1)
    words, n_rows = 3, 9
    impacts = rng.integers(0, 1000, (n_rows, words * 64)) * (rng.random((n_rows, words * 64)) < 0.3)
    slices = np.zeros((n_rows + 1, 10, words), np.uint64)
    for r in range(n_rows):
        at = np.flatnonzero(impacts[r])
        slices[r] = lexical_search.sliced(at, impacts[r][at], 10, words)
    queries = np.array([[0, 1, 2, 3, 4], [5, 6, 7, n_rows, n_rows], [8, n_rows, n_rows, n_rows, n_rows]])
    total = lexical_search.added(slices, queries, np.array([5, 3, 1]), 14)
    whole = np.vstack([impacts, np.zeros(words * 64, int)])
    numbers = sum((np.unpackbits(total[:, b].copy().view(np.uint8), axis=1, bitorder="little").astype(int) << b) for b in range(14))
    assert (numbers == whole[queries].sum(1)).all()
    for k in (1, 5, 50, 500):
        sure, tied = lexical_search.best(total, k)
        for q in range(3):
            top = sorted((-numbers[q][d], d) for d in np.flatnonzero(numbers[q]))[:k]
            sure_at, tied_at = (np.flatnonzero(np.unpackbits(x[q].copy().view(np.uint8), bitorder="little")) for x in (sure, tied))
            picked = sorted([*sure_at, *tied_at[: k - len(sure_at)]])
            assert picked == sorted(d for _, d in top)


def test_terms_of_bytes_are_the_patterns():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x250), rng.randrange(0x4E00, 0x4E20), 0x1F600])) for _ in range(60))
        assert [t.decode() for t in text.encode().translate(lexical_search.BYTES).split()] == terms(text)


CONTROL = re.compile(r"\[(\\*)(/?INST\])|<(\\*)(/?s>)")


def escaped(text):
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text or "")


def test_escapes_are_reversed():
    rng = random.Random(4)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", "/", "INST]", "s>", "[\\INST]", "<\\\\/s>", "é", "日", "\n", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)] + [None]
    made = chat_format.escaped(pa.array(texts)).to_pylist()
    assert made == [escaped(t) for t in texts]
    for text, one in zip(texts, made, strict=True):
        assert chat_format.unescaped(one) == (text or "") and not re.search(r"\[/?INST\]|</?s>", one)
        assert chat_format.turns_of(f"[INST]{one}[/INST]{one}</s>") == [(text or "", text or "")]


def test_assembly_copies_every_segment():
    rng = random.Random(2)
    for n in (1, 2, 40):
        a = ["é" * rng.randrange(5) for _ in range(n)]
        b = ["x" * rng.choice([0, 3, 3_000_000 if n < 40 else 9, 7]) for _ in range(n)]
        at = pa.array(["left out", *b]).slice(1)
        buffer, begins = chat_format.assembled([b"<", pa.array(a), b"|", at, b">"], n)
        whole = "".join(f"<{x}|{y}>" for x, y in zip(a, b, strict=True)).encode()
        assert bytes(buffer) == whole and begins.tolist() == [0, *np.cumsum([len(f"<{x}|{y}>".encode()) for x, y in zip(a, b, strict=True)])]


def test_conversations_are_read_back(spark):
    say = "</s>[INST] ok [/INST]"
    rows = [(c, t, "assistant" if t % 2 else "user", f"{say} {c} é日" * (t + 1)) for c in range(30) for t in range(c % 5 + 1)]
    rows += [(100, None, "user", None), (100, 0, None, ""), (100, 0, "assistant", "tie"), (100, 0, "assistant", "tie"), (None, 1, "assistant", "\n"), (None, 0, "tool", "[\\INST]"), (101, 0, "assistant", "z<s>" * 700_000)]
    rows += [(102, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("piece", "loss", "_text", "n_turns")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)  # a long conversation in several pieces
    try:
        pieces = chat_format.formatted(turns.repartition(5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pieces.where("conv_id = 102").count() > 1 and pieces.agg(F.sum("n_turns")).first()[0] == len(rows)
    got = {r.conv_id: r for r in chat_format.read_back(pieces).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(got) == set(by) and len(got) == len(by)
    for conv, own in by.items():
        own.sort()
        learned = [t for *_, role, t in own if role == "assistant"]
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == digest(*(f"{role}\n{t}\n" for *_, role, t in own))
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, learned)), digest(*learned))
        assert r.formatted_chars == sum(17 + len(escaped(role)) + len(escaped(t)) for *_, role, t in own)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = chat_format.op13_chat_format(spark, str(tmp_path)).collect()
    assert r.conv_id == -1 and r.n_turns == 2 and r.loss_chars == 21 and r.loss_sha256 == digest(chat_format.SAYS)
