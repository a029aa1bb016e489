"""Removal of lines that repeat an earlier line, by an exact set-similarity join of their tokens.

Everything is SQL functions. A line is the set of its words. Words are ordered by rarity: a
table of ``CELLS`` counts, filled from all documents, gives each word a level, and within a
level the hash decides. Two lines of similarity 0.8 or more share a word among their first
n - ceil(0.8 n) + 1; lines meet in a join on such a word if their sizes (length filter), the
word's places (positional filter) and the parities of 64 or 128 cells of their words still allow
the overlap. What is left is verified on the whole sets.

Equal lines are one line from the start. A great many near copies of one line must not make
all their pairs, so lines that have two of a few picked words in common first meet the
``HEADS`` earliest of these lines only. Whoever matches there needs no further partner; the join then
looks for partners of the rest, among all lines. No match is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallytree.llm.common import bit_table, cell, documents, level_of, level_table, line_words, may_hold, put_back, set_aside, stored

#: Levels up to EXACT are counts; above, four levels to a doubling.
EXACT, MOST = 32, 126
LOW = (1 << 56) - 1
LAST = 2**63 - 1
#: Lines of more words have parities of 128 cells.
SHORT = 40
#: Earliest lines of a key that the others meet first. One edited copy may be too far from the very earliest, but seldom from all of these.
HEADS = 8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key() -> list[Column]:
    """Documents are told apart by id and text; rows that repeat both count as one."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th")]


def _name() -> list[Column]:
    """A line's 128-bit name."""
    return [F.xxhash64("line").alias("lh"), F.xxhash64(F.lit(7), "line").alias("lg")]


def line_rows(docs: DataFrame) -> DataFrame:
    """(d, th, l, line) of every line; the text's hash is worked out before its lines are dealt out."""
    return docs.select(*_key(), _lines(F.col("text")).alias("lines")).select("d", "th", F.posexplode("lines").alias("l", "line"))


def rarity(docs: DataFrame) -> DataFrame:
    """(cell, level) from the counts of all words of all documents."""
    each = docs.select(F.explode(_lines(F.col("text"))).alias("line")).select(F.explode(line_words(F.col("line"))).alias("w"))
    n = each.select(cell(F.xxhash64("w")).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(F.least(F.lit(MOST), EXACT + F.floor(4 * F.log2(F.col("n") / EXACT))))
    return n.select("cell", level.cast("int").alias("level"))


def tokens(line: Column) -> Column:
    """Hashes of a line's different words."""
    return F.array_distinct(F.transform(line_words(line), lambda w: F.xxhash64(w)))


def different_lines(docs: DataFrame) -> DataFrame:
    """One row for each different line that has words.

    lh, lg: its name; d, th, l: its first place; c: how often it occurs; n: its size; k, k2: parities;
    prefix: its rarest words, rarest first, without the ``once`` first that occur once.
    """
    levels = level_table(stored(rarity(docs), "rarity"))
    rows = line_rows(docs).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("d", "th", "l", *_name(), "line", levels.alias("levels"))

    def told(t: Column) -> Column:
        # Everything in one expression: the scalar must not become a column of rows.
        key = F.transform(t, lambda h: F.shiftleft(level_of(F.col("levels"), h).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(LOW))))
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        parity = F.aggregate(t, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))
        # Short lines need 64 cells only; the other 64 of long lines split these in two.
        second = F.when(F.size(t) > SHORT, F.aggregate(t, F.lit(0).cast("long"), lambda acc, h: F.when(h.bitwiseAND(F.lit(64)) != 0, acc.bitwiseXOR(bit(h))).otherwise(acc))).otherwise(F.lit(0).cast("long"))
        first = F.size(t) - F.floor((8 * F.size(t) + 9) / 10).cast("int") + 1
        several = lambda p: F.struct(F.size(p).alias("all"), F.filter(p, lambda x: F.shiftright(x, 56) != 1).alias("words"))
        return F.struct(F.size(t).alias("n"), parity.alias("k"), second.alias("k2"), F.transform(F.array(F.slice(F.sort_array(key), F.lit(1), first)), several)[0].alias("p"))

    rows = rows.select("d", "th", "l", "lh", "lg", F.transform(F.array(tokens(F.col("line"))), told)[0].alias("t"))
    rows = rows.select("d", "th", "l", "lh", "lg", "t.n", "t.k", "t.k2", (F.col("t.p.all") - F.size("t.p.words")).alias("once"), F.col("t.p.words").alias("prefix"))
    one = rows.groupBy("lh", "lg").agg(F.min(F.struct("d", "th", "l", "n", "k", "k2", "once", "prefix")).alias("s"), F.count(F.lit(1)).alias("c"))
    return one.select("lh", "lg", "c", "s.*")


#: Size, place of the word and whether a partner is still looked for share a column: short rows make a small shuffle.
N = {c: f"cast(shiftright({c}.ni, 32) as int)" for c in "xy"}
I = {c: f"(cast({c}.ni & 4294967295L as int) div 2)" for c in "xy"}
#: Overlap that two lines need, and whether two lines can still reach it from where they share a word.
BOTH = f"({N['x']} + {N['y']})"
NEED = f"((8 * {BOTH} + 17) div 18)"
ROOM = f"{BOTH} - 2 * {NEED}"
PARITIES = f"bit_count(x.k ^ y.k) <= {ROOM} AND (x.k2 = 0 OR y.k2 = 0 OR bit_count(x.k2 ^ y.k2) + bit_count(x.k ^ x.k2 ^ y.k ^ y.k2) <= {ROOM})"
SIMILAR = f"x.lh <> y.lh AND 10 * least({N['x']}, {N['y']}) >= 8 * greatest({N['x']}, {N['y']}) AND {PARITIES}"
ABLE = f"{SIMILAR} AND least({N['x']} - {I['x']}, {N['y']} - {I['y']}) >= {NEED}"


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x.lh", "y.lh").alias("x"), F.greatest("x.lh", "y.lh").alias("y")).distinct()


def prefix_rows(lines: DataFrame) -> DataFrame:
    """(token, lh, d, k, k2, ni): a row for each rare word of each line. lines may tell in ``open`` if a partner is looked for."""
    open_ = F.col("open").cast("int") if "open" in lines.columns else F.lit(1)
    each = lines.select("lh", "d", "k", "k2", "n", "once", open_.alias("open"), F.posexplode("prefix").alias("i", "token"))
    return each.select("token", "lh", "d", "k", "k2", F.expr("shiftleft(cast(n as bigint), 32) | ((once + i) * 2L) | open").alias("ni"))


def first_look(lines: DataFrame) -> DataFrame:
    """Pairs of a line and each of the ``HEADS`` earliest lines that share two of its three picked words.

    Picked are the least hashes of the rare words that come more than EXACT times, as those of
    many near copies do. Only keys of two words or more lines go on, so little is shuffled twice.
    """
    often = F.transform(F.filter("prefix", lambda x: F.shiftright(x, 56) > EXACT), lambda x: x.bitwiseAND(F.lit(LOW)))
    rows = lines.select("lh", "d", "k", "k2", F.expr("shiftleft(cast(n as bigint), 32)").alias("ni"), F.slice(F.sort_array(often), 1, 3).alias("p"))
    two = [F.when(F.size("p") > b, F.xxhash64(F.get("p", F.lit(a)), F.get("p", F.lit(b)))) for a, b in ((0, 1), (0, 2), (1, 2))]
    rows = rows.select("lh", "d", "k", "k2", "ni", F.explode(F.array(*two)).alias("key")).where("key IS NOT NULL")
    again = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "again")
    rows = rows.where(may_hold(bit_table(again.select(F.col("key").alias("h"))), F.col("key"))).join(again, "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("d", "lh"))
    heads = rows.withColumn("nth", nth).where(F.col("nth") <= HEADS).drop("nth")
    return _pairs(rows.alias("y").join(heads.alias("x"), (F.col("x.key") == F.col("y.key")) & F.expr(f"x.d <= y.d AND {SIMILAR}")))


def prefix_join(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Pairs of a line that is not matched yet and a line not after it that share a rare word."""
    # Only lines that may be matched take part in the join that tells.
    maybe = may_hold(bit_table(matched.select(F.col("lh").alias("h"))), F.col("lh"))
    told = lines.where(maybe).join(matched.withColumn("m", F.lit(True)), ["lh", "lg"], "left").withColumn("open", F.col("m").isNull()).drop("m")
    rows = prefix_rows(lines.where(~maybe).withColumn("open", F.lit(True)).unionByName(told))
    x, y = rows.alias("x"), rows.alias("y")
    # Said of both sides, so that it filters neither and one shuffle serves both.
    wanted = "(y.ni % 2 = 1 OR x.lh = y.lh) AND x.d <= y.d"
    return _pairs(x.join(y, (F.col("x.token") == F.col("y.token")) & F.expr(f"{wanted} AND {ABLE}")))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lh, lg) of the later line of each pair whose similarity is 0.8 or more."""
    pairs = stored(pairs, "pairs")
    # A table of fixed size tells most other lines before their words are looked at.
    bits = bit_table(pairs.select(F.col("x").alias("h")).union(pairs.select("y")))
    rows = line_rows(docs).select("d", "th", "l", *_name(), "line").where(may_hold(bits, F.col("lh")))
    rows = rows.select("d", "th", "l", "lh", "lg", tokens(F.col("line")).alias("t"))
    sets = rows.groupBy("lh", "lg").agg(F.min(F.struct("d", "th", "l", "t")).alias("s"))
    x, y = (sets.select(F.col("lh").alias(a), F.col("lg").alias(f"g{a}"), F.col("s").alias(f"s{a}")) for a in ("x", "y"))
    both = F.size(F.array_intersect("sx.t", "sy.t"))
    good = pairs.join(x, "x").join(y, "y").where(100 * both >= 80 * (F.size("sx.t") + F.size("sy.t") - both))
    x_later = F.struct("sx.d", "sx.th", "sx.l") > F.struct("sy.d", "sy.th", "sy.l")
    later = F.when(x_later, F.struct(F.col("x").alias("lh"), F.col("gx").alias("lg"))).otherwise(F.struct(F.col("y").alias("lh"), F.col("gy").alias("lg")))
    return stored(good.select(later.alias("s")).select("s.*").distinct(), "matched")


def later_matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All different lines, and (lh, lg) of those that are similar to an earlier one."""
    lines = stored(different_lines(docs), "lines")
    seen = verified(docs, first_look(lines))
    return lines, seen.union(verified(docs, prefix_join(lines, seen))).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(d, th, gone): for each document that loses lines, their numbers from 0, ascending."""
    lines, matched = later_matches(docs)
    maybe = may_hold(bit_table(matched.select(F.col("lh").alias("h"))), F.col("lh"))
    told = lines.select("lh", "lg", "c", F.col("d").alias("d0"), F.col("th").alias("th0"), F.col("l").alias("l0")).where((F.col("c") > 1) | maybe)
    told = stored(told.join(matched.withColumn("m", F.lit(True)), ["lh", "lg"], "left").where("c > 1 OR m").drop("c"), "told")
    each = line_rows(docs).select("d", "th", "l", *_name()).where(may_hold(bit_table(told.select(F.col("lh").alias("h"))), F.col("lh")))
    gone = each.join(told, ["lh", "lg"]).where("m OR d <> d0 OR th <> th0 OR l <> l0")
    return gone.groupBy("d", "th").agg(F.array_sort(F.collect_set("l")).alias("gone"))


def without_later_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that repeat an earlier one, with the columns of docs.

    A line goes if an earlier line of the input (smaller doc_id, or same document and sooner)
    has the same text or a word set of Jaccard similarity 0.8 or more, whether or not that
    one goes too. Lines are split at line feeds, words at ASCII white space; words are
    compared as they are. Lines without words stay. A null text stays null, a text that
    loses all lines becomes empty, and a null id counts as larger than all others. Texts that
    share an id are in the order of a hash; rows that repeat both id and text are one
    document and lose the same lines. Other columns are kept; an empty table gives no rows.
    """
    gone = removed_lines(docs).select(F.col("d").alias("_d"), F.col("th").alias("_th"), F.col("gone").alias("_gone"))
    told = set_aside(docs, "doc_id", "text").withColumns(dict(zip(("_d", "_th"), _key(), strict=True))).join(gone, ["_d", "_th"], "left")
    left = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return put_back(told.select("doc_id", text.alias("text"), "_all"), docs.columns, ("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_removed of every document, and the numbers of its removed lines."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    gone = removed_lines(docs)
    told = docs.select("doc_id", *_key(), F.size(_lines(F.col("text"))).cast("long").alias("n_lines")).join(gone, ["d", "th"], "left")
    return told.select("doc_id", "n_lines", F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
