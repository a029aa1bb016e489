"""The corpus operators on small tables against brute force, with nulls, ties, empty and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallytree.llm import fingerprints, jaccard_join, line_dedup, merge_dropout, ngram_lm, packing, personal_data, quality_rules, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, _id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)]
    said = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = said(60)
    base = said(120)
    near = base.split()
    near[50] = "changed"
    rows = [said(40) + "\n" + said(30), base, " ".join(near), base, passage + " " + said(30), said(30) + " " + passage, "one two", "one two", "", None, "  \t\n ", "a b c d e f g h " * 6, said(3000)]
    return list(enumerate(rows, 1))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", None if t is None else len(t), "x", "y") for i, t in texts()]
    return spark.createDataFrame([*rows, rows[1]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t in texts():
        w, at = words(t), collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        repeat = len({q for v in at.values() if len(v) > 1 for k in v for q in range(k, k + 8)})
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), repeat)
        assert got[i].base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w))
    assert quality_rules.judged(empty).count() == 0
    assert quality_rules.kept_documents(docs).columns == docs.columns


def test_lines_above_the_limit_reject_documents(spark):
    rows = [(k, "common line of words here\n" + " ".join("u" + chr(97 + k) + chr(97 + j % 26) + chr(97 + j // 26) for j in range(5 if k < 3 else 40)), "en", "h", 0, "", "") for k in range(12)]
    limits = quality_rules.Limits(max_documents=5, max_share=0.0, least_kept=0.6, least_words=1)
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA), limits, with_text=True).collect()}
    assert all(r.n_excess_lines == 1 and r.n_lost_words == 5 for r in got.values())
    assert not got[0].kept and got[5].kept and got[5].text == rows[5][1].split("\n")[1]


def test_fingerprints(docs, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprinted(docs).collect()}
    rows = sorted(texts() + [texts()[1]], key=lambda x: (x[0], x[1] or ""))
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        if i != 2:
            assert got[i].n_chars == len(t) and got[i].edited_text == t[: len(t) - q] + after[:q]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[2].fingerprint == got[4].fingerprint and got[7].fingerprint == got[8].fingerprint and got[7].near_next == 1
    assert fingerprints.fingerprinted(empty).count() == 0


def test_substring_dedup(docs, empty):
    rows = substring_dedup.without_repeats(docs, 20).collect()
    got = {r.doc_id: r for r in sorted(rows, key=lambda r: -r.n_removed)}
    again = max((r for r in rows if r.doc_id == 2), key=lambda r: r.n_removed)  # the same row once more loses all
    assert len(rows) == len(texts()) + 1 and again.n_removed == again.n_words > 100 and again.kept_text == ""
    seen, cover = set(), {}
    for i, t in texts():
        w = words(t)
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        cover[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    for i, e in cover.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == e
    assert substring_dedup.without_repeats(empty).count() == 0


def test_toxicity(spark, empty):
    rng = np.random.default_rng(3)
    said = lambda: " ".join("".join(rng.choice(list("aeiou"), 2)) + "".join(rng.choice(list("nrst"), 2)) for _ in range(20))
    bad = ["moron", "stupid", "loser", "ass", "slot"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        rows.append((k, said() + (" " + bad[k // 4 % 5] if toxic else "")))
        labels.append((k, 1, int(toxic)))
    disguised = {1000: "m0r0n", 1001: "st.u.p.i.d", 1002: "l o s e r", 1003: "mooooron", 2000: "stuupid", 2001: "mmoorroonn", 2002: "455", 2003: "$1077", 2004: "l. o. s. e. r.", 2005: "5tup1d!", 2006: "m-o-r-o-n"}
    rows += [(k, said() + " " + w) for k, w in disguised.items()] + [(1004, None), (1005, ""), (1006, said())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    held = F.pmod(toxicity.id_crc(F.col("doc_id")), F.lit(5)) == 0
    got = {r.doc_id: r for r in toxicity.scored(docs, marks, held).collect()}
    right = [got[k].predicted == int(k % 4 == 0) for k in range(400) if got[k].held_out]
    assert np.mean(right) > 0.95 and len(got) == len(rows)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400))
    assert {w: got[k].score for k, w in disguised.items() if got[k].predicted != 1} == {}
    assert got[1004].predicted == got[1005].predicted == got[1006].predicted == 0
    assert toxicity.scored(empty, marks, F.lit(False)).count() == 0
    assert toxicity.scored(docs, marks.where("toxic = 0"), held).where("score >= 0.5").count() == 0


def test_doubled_letters_apart_are_decided_as_by_the_whole_search():
    rng = np.random.default_rng(8)
    said = b"   ".join("".join(rng.choice(list("aeinrst"), rng.integers(2, 9))).encode() for _ in range(3000))
    c = toxicity.CLASS[np.frombuffer(b"   " + said + b" ", np.uint8)].astype(np.int32)
    counts = np.bincount(c[:-3] << 15 | c[1:-2] << 10 | c[2:-1] << 5 | c[3:], minlength=toxicity.CELLS).astype(float)
    restorer, n, changed = toxicity.Restorer(toxicity.character_model(counts)), 0, 0
    for _ in range(5000):
        w = "".join(rng.choice(list("aeinrstzé"), rng.integers(1, 12)))
        apart = restorer._apart(w)
        if apart is not None:
            assert apart == restorer._word(w), w
            n, changed = n + 1, changed + (apart != w)
    assert n > 3000 and changed > 100
    long = "a1" * 50_000
    assert len(restorer.word(long)) >= 50_000 and restorer.word("") == ""


def test_personal_data(spark, empty):
    t = "mail é bob@site.org or +49 (30) 123-4567, card 4111 1111 1111 1111, ip 10.0.0.300 and 10.0.0.7. IBAN account DE89370400440532013000"
    docs = spark.createDataFrame([(1, t, "x"), (2, None, "x"), (3, "", "x"), (4, "4111111111111112", "x")], "doc_id long, text string, _m_email string")
    got = {r.doc_id: [(s.kind, t[s.start : s.end]) for s in r._spans] for r in personal_data.with_spans(docs).collect()}
    assert got[1] == [("email", "bob@site.org"), ("ip", "10.0.0.7"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567"), ("iban", "DE89370400440532013000")]
    assert got[2] == got[3] == got[4] == []
    assert "[email]" in personal_data.redacted(docs).where("doc_id = 1").first().text
    assert personal_data.with_spans(empty).count() == 0


def line_brute(rows):
    exp, sets, raw = {}, [], set()
    for i, t in rows:
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset(words(line))
            if not w:
                continue
            if line in raw or any(100 * len(w & s) >= 80 * len(w | s) for s in sets):
                gone.append(k)
            raw.add(line)
            sets.append(w)
        exp[i] = gone
    return exp


@pytest.mark.parametrize("exact", [32, 1])
def test_line_dedup(spark, empty, monkeypatch, exact):
    monkeypatch.setattr(line_dedup, "EXACT", exact)
    rng = np.random.default_rng(7)
    lines = []
    for _ in range(12):
        base = list(rng.choice([f"t{k}" for k in range(60)], 12, replace=False))
        for _ in range(5):
            x = list(base)
            for p in rng.choice(12, rng.integers(0, 4), replace=False):
                x[p] = f"t{rng.integers(60)}"
            lines.append(" ".join(x))
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[4 * k : 4 * k + 4])) for k in range(15)] + [(20, None), (21, "\n \n"), (22, lines[0] + "\n\n" + lines[0])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, d string")
    got = {r.d: list(r.gone) for r in line_dedup.removed_lines(docs).collect()}
    exp = line_brute(rows)
    assert {i: g for i, g in exp.items() if g} == got
    if exact == 32:
        kept = {r.doc_id: r.text for r in line_dedup.without_later_lines(docs).collect()}
        for i, t in rows:
            assert kept[i] == (t if not exp[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in exp[i]))
        assert line_dedup.without_later_lines(empty).count() == 0 and line_dedup.without_later_lines(docs).columns == docs.columns


def test_ngram_jaccard_join(docs, empty):
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in (2, 3, 4)] == [2, 2, 2] and got[8].component_id == 7
    assert [got[i].component_id for i in (9, 10, 11)] == [9, 10, 11] and got[9].n_shingles == 0 and got[7].n_shingles == 1
    assert got[5].component_id == 5 and got[6].component_id == 6
    assert {r.doc_id for r in jaccard_join.one_of_each(docs).collect()} == {1, 2, 5, 6, 7, 9, 10, 11, 12, 13}
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_lm_scoring(docs, empty):
    held = F.pmod(ngram_lm.id_crc(F.col("doc_id")), F.lit(7)) == 2
    got = {r.doc_id: r for r in ngram_lm.scored(docs, held).collect()}
    rows = texts() + [texts()[1]]
    count = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words((t or "").lower()), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*words((t or "").lower()), None]
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        assert got[i].train_tokens == n and got[i].n_tokens == len(tokens) and got[i].n_known == sum(count[w] > 0 for w in tokens)
        assert np.isclose(got[i].base_score, base) and np.isfinite(got[i].score) and got[i].score <= 0
    assert ngram_lm.scored(empty, F.lit(False)).count() == 0


def lm_brute(rows, held):
    """Scores from counts in dictionaries: discounted n-grams seen three times or more, else back off."""
    count = collections.Counter()
    for i, t in rows:
        if i not in held:
            x = [None, *words((t or "").lower()), None]
            count.update((w,) for w in x[1:])
            count.update(g for n in (2, 3) for g in zip(*(x[k:] for k in range(n)), strict=False))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    arcs = collections.defaultdict(list)
    for g, c in count.items():
        if len(g) > 1 and c >= 3:
            arcs[g[:-1]].append(c)
    left = lambda c: max(1 - sum(x - 0.75 for x in arcs[c]) / count[c], 1e-12) if c in arcs else 1.0

    def p(g):
        if len(g) == 1:
            return (count[g] + 1) / (n + v + 1)
        more = (count[g] - 0.75) / count[g[:-1]] if count[g] >= 3 else 0
        return more + left(g[:-1]) * p(g[1:])

    return {i: sum(np.log10(p(tuple(x[max(0, k - 2) : k + 1]))) for k in range(1, len(x))) for i, t in rows for x in [[None, *words((t or "").lower()), None]]}


def test_lm_keeps_ngrams_by_count_at_any_size(spark):
    """3.2e6 tokens: an n-gram and a word seen 3 times count as they do on a small table."""
    rng = np.random.default_rng(4)
    said = lambda n: " ".join(rng.choice([f"v{k}" for k in range(30)], n))
    rows = [(k, said(60)) for k in range(40)] + [(k, "rare phrase here " + said(20)) for k in range(40, 44)] + [(44, None), (45, "rare phrase here and v1 v2 never")]
    rows += [(k, "x " * 800_000) for k in range(46, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram_lm.scored(docs, F.col("doc_id").isin(43, 45)).collect()}
    exp = lm_brute(rows[:46] + [(46, rows[46][1])] * 4, {43, 45})
    assert all(np.isclose(got[i], exp[i], rtol=1e-9) for i in range(46))


def test_packing(docs, empty):
    got = packing.packed_documents(docs).collect()
    assert all(r.length <= 2048 for r in got)
    table = packing.WordTokens(packing.default_tokenizer())
    for i, t in texts():
        ids = np.array([*table.ids(t or ""), 1], "<u4")
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        pieces = list(dict.fromkeys(pieces))
        assert sum(p[1] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[a : a + n]) == c and total == len(ids) for a, n, c, total in pieces)
    seen = collections.defaultdict(list)
    for r in got:
        seen[r.sequence_id].append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(empty).count() == 0


def test_merge_dropout(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.default_model())
    odd = ["a  b\n\n c", " ", "日本語 ☃ 🎉\t\r x", "<s> </s><unk>", "x" * 300, "\n", "", "é▁ y▁"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string").union(docs.select("doc_id", "text"))
    plain = {r.doc_id: list(r.ids) for r in merge_dropout.encoded(more, dropout=0.0).collect()}
    wanted = {**{100 + k: t for k, t in enumerate(odd)}, **dict(texts())}
    assert all(plain[i] == model.encode(t or "") for i, t in wanted.items() if "▁" not in (t or ""))
    a = merge_dropout.encoded(more, seed=1)
    b = {r.doc_id: list(r.ids) for r in merge_dropout.encoded(more, seed=2).collect()}
    back = {r.doc_id: r.text for r in merge_dropout.decoded(a).collect()}
    assert all(back[i] == (t or "") for i, t in wanted.items())
    first = {r.doc_id: list(r.ids) for r in a.collect()}
    assert first[13] != plain[13] and first[13] != b[13] and first == {r.doc_id: list(r.ids) for r in merge_dropout.encoded(more, seed=1).collect()}
    told = {r.doc_id: r for r in merge_dropout.round_trips(more).collect()}
    assert all(told[i].lossless and told[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in wanted.items())
    assert merge_dropout.round_trips(empty).count() == 0
    v = merge_dropout.segmenter(merge_dropout.default_model(), 0.5, 1, 4).vocabulary
    chunks = [" internationalization", "x", " the", "aaaa" * 5]
    ids, n = v.symbols(chunks)
    keys = np.arange(4, dtype=np.uint64)
    flat, sizes = merge_dropout.joint_agenda(ids, n, keys, 0.5, v)
    for k, (stop, size, e, c) in enumerate(zip(np.cumsum(sizes), sizes, np.cumsum(n), n, strict=True)):
        assert flat[stop - size : stop].tolist() == merge_dropout.agenda(ids[e - c : e].tolist(), k, 0.5, v)


def test_merge_dropout_decides_for_every_occurrence():
    s = merge_dropout.Segmenter(merge_dropout.default_model(), 0.1, 3)
    v, odd = s.vocabulary, [" internationalization", " ☃the", "x" * 60]
    text = " internationalization the of" * 3000 + "".join(odd)
    chunks = merge_dropout.CHUNKS.findall(f" {text}")
    keys = s.keys([7], np.array([len(chunks)])).tolist()
    each = [v.spelled(merge_dropout.agenda(v.symbols([c])[0].tolist(), k, 0.1, v)) for c, k in zip(chunks, keys, strict=True)]
    assert s.encode([text], [7])[0].tolist() == [i for x in each for i in x]
    forms = collections.defaultdict(collections.Counter)
    for c, x in zip(chunks, each, strict=True):
        forms[c][tuple(x)] += 1
    assert len(forms[" internationalization"]) > 20 and len(forms[" the"]) > 1


def test_letters_that_change_when_normalised():
    """Ids of whole words equal the tokenizer's, where lower-casing makes marks."""
    table = packing.WordTokens(packing.default_tokenizer())
    texts = ["\u0130,", "a\u0130.) b", "\u01c5;", "cafe\u0301, caf\u00e9,", "\ufb01ne. \u1e9e!", "x\u0345, \u03b1\u0345."]
    for text, ids in zip(texts, table.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == table.ids(text), text


def test_fingerprints_follow_the_fraction(spark):
    """Every sketch, the next document's too, holds the hashes below the given fraction and no other."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (0, 3, 60, 400, 401)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, half = ({r.doc_id: r for r in fingerprints.fingerprinted(docs, f).collect()} for f in (1.0, 0.25))
    for i, text in enumerate(texts):
        w = text.split()
        every = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        all_hashes = set(filter(None, whole[i].fingerprint.split(",")))
        few = set(filter(None, half[i].fingerprint.split(",")))
        assert len(all_hashes) == len(every)
        limit = -(2**63) + 2**62
        assert few == {h for h in all_hashes if int(h, 16) - (1 << 64) * (int(h, 16) >> 63) < limit}
        after = set(filter(None, half[(i + 1) % len(texts)].fingerprint.split(",")))
        union = len(few | after)
        alike = float(w == texts[(i + 1) % len(texts)].split())
        assert abs(half[i].near_next - (len(few & after) / union if union else alike)) < 1e-12


def test_lines_of_rows_with_one_id_or_none(spark):
    """Texts that share an id, or have none, keep lines that only others lose."""
    a, b = "one two three four five", "six seven eight nine ten"
    docs = spark.createDataFrame([(1, a), (None, f"{a}\n{b}"), (None, f"{b} eleven\nother words stay here now"), (2, None), (2, "")], "doc_id long, text string")
    got = sorted((r.text or "") for r in line_dedup.without_later_lines(docs).where("doc_id IS NULL").collect())
    both = "\n".join(got)
    assert a not in both and "other words stay here now" in both
    assert (b in both.split("\n")) != (f"{b} eleven" in both)


def test_line_dedup_of_near_copies_after_some_too_far(spark, monkeypatch):
    """Near copies whose earliest are too far from all others don't make all their pairs."""
    made, join = [], line_dedup.prefix_join

    def counted(*args):
        made.append(join(*args))
        return made[-1]

    monkeypatch.setattr(line_dedup, "prefix_join", counted)
    rng = np.random.default_rng(11)
    base, rows = [f"w{k}" for k in range(60)], []
    for d in range(300):
        x = list(base)
        for p in rng.choice(60, 5 if d < 6 else 3, replace=False):
            x[p] = f"e{d}x{p}"
        rows.append((d, " ".join(x)))
    got = {r.d: list(r.gone) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: g for i, g in line_brute(rows).items() if g} == got
    assert 0 < len(got) and made[0].count() < 5000
