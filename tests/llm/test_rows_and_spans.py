"""Rows without ids, short texts, and spans of adversarial strings, against brute force."""

import random
import re
from collections import Counter
from hashlib import sha256

from tallytree.llm import fingerprints, jaccard_join, personal_data, substring_dedup

A, B, C = ("one two three four five six", "seven eight nine ten eleven", "red green blue black white grey")


def test_exactly_one_of_each_group_stays(spark):
    """Rows that share an id or have none count one by one; the smallest id of a group stays, and its extra columns."""
    rows = [(1, A, "p"), (1, A, "q"), (2, B, "r"), (None, A, "s"), (None, C, "t"), (5, A, "u"), (7, None, "v"), (8, "", "w"), (None, None, "x"), (9, C, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    got = [tuple(r) for r in jaccard_join.one_of_each(docs).collect()]
    assert Counter((i, t) for i, t, _ in got) == Counter([(1, A), (2, B), (9, C), (7, None), (8, ""), (None, None)])
    assert {x for *_, x in got} <= {r[2] for r in rows} and jaccard_join.one_of_each(docs).columns == docs.columns
    assert jaccard_join.one_of_each(docs.limit(0)).isEmpty()


def test_near_copies_leave_and_others_stay(spark):
    rng = random.Random(1)
    said = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], 0
    for _ in range(60):
        base = said(200)
        groups += 1
        for _ in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(200)] = "edited"
            rows.append((len(rows), " ".join(words)))
    left = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in left) == sorted({find(k) for k in range(len(rows))})


def test_short_texts_are_alike_only_if_their_words_are(spark):
    texts = ["a", "b c", "d e f", "d  e\nf", "", None, "zz", "zz"]
    got = {r.doc_id: r for r in fingerprints.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1e-12).collect()}
    assert all(r.fingerprint == "" for r in got.values())
    assert [got[k].near_next for k in range(8)] == [0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert got[4].contained_in_next == 1.0 and got[0].contained_in_next == 0.0 and got[2].contained_in_next == 1.0
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % 8] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[k].edited_text == edited and got[k].near_edited == float(t.split() == edited.split())


def test_edited_sketches_against_brute_force(spark):
    """Likeness to the edited text is that of the two sets of shingles when every hash is kept."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 3, 7, 40, 300]))) for _ in range(40)]
    got = {r.doc_id: r for r in fingerprints.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1.0).collect()}

    def shingles(text):
        w = text.split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b = shingles(t), shingles(edited)
        assert abs(got[k].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
        assert len(got[k].edited_fingerprint.split(",")) == max(1, len(b))


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans_of_adversarial_strings(spark, tmp_path):
    rng = random.Random(12)
    parts = ["a@b.c", "@", ".", "-", "+", " ", "1", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "411111111111111", "+1 (555) 010-9999", "+49", "192.168.0.1", "10.0.0", "x", "é", "😀", "\n", "00", "%", "a.b", "(", ")", "5500005555555559", "card", "phone:"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["1" * 400, "1." * 300, "a@" * 300, None, "+1" * 200]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spans_seen = 0
    for r in personal_data.op5_pii(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        want, counts = [], {}
        for kind, pattern in PATTERNS.items():
            own = [m for m in pattern.finditer(text) if holds(kind, m[0])]
            counts[kind] = len(own)
            want += [f"{kind}:{m.start()}:{m.end()}" for m in own]
        spans_seen += len(want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts.values()), text
        assert r.base_sha256 == sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set((r.spans or "").split(","))
    assert spans_seen > 2000


def test_passages_of_rows_that_share_an_id(spark):
    """Of rows with one id, or none, only the first keeps a passage; their own words stay."""
    said = " ".join(f"p{k}" for k in range(40))
    rows = [(1, said), (1, said), (2, said), (None, said), (None, said), (None, f"before {said} after"), (3, None), (3, "")]
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == Counter([(1, 40, 0), (1, 40, 40), (2, 40, 40), (None, 40, 40), (None, 40, 40), (None, 42, 40), (3, 0, 0), (3, 0, 0)])
    assert {r.kept_text for r in got if r.n_words == 42} == {"before after"}
