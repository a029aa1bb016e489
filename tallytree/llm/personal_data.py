"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts scores.

Everything is SQL functions. A kind's matches come from regexp_extract_all; their places from
splitting the text by the same expression and adding up lengths, in code points. Texts that
cannot hold a kind are told by one cheap test and not split. Expressions are written so that
they match in linear time: a run of characters is entered at its start only, where a later
start could not match either, and repeats do not backtrack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.llm.common import documents, put_back, set_aside

#: Code points of text before and after a span that are searched for context words.
BEFORE, AFTER = 48, 24
CONTEXT_GAIN = 0.3
#: Words nearby that make a span less likely to be someone's data.
LOWERS = "example|sample|dummy|placeholder"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _folded(text: Column, start: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Folds step(sum, character, place from 0) over the characters of a short text."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.aggregate(places, start, lambda acc, i: step(acc, F.substr(text, i, F.lit(1)), i - 1))


def luhn(m: Column) -> Column:
    def step(acc: Column, c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return _folded(F.reverse(_digits(m)), F.lit(0), step) % 10 == 0


def mod97(m: Column) -> Column:
    """The check of international account numbers: country and check digits last, letters as 10 to 35."""
    moved = F.concat(F.substr(m, F.lit(5), F.length(m)), F.substr(m, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column, _: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(F.ascii(c) >= 65, (acc * 100 + letter) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return _folded(moved, F.lit(0), step) == 1


def _n_digits(least: int, most: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(least, most)


def _octets(m: Column) -> Column:
    short = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    return F.forall(F.split(m, r"\."), lambda p: short(p) & (F.right(p, F.lit(3)).cast("int") <= 255))


@dataclass(frozen=True)
class Kind:
    """prior: score of a match that passes ``valid``. Base kinds are kept whatever the score."""

    name: str
    pattern: str
    possible: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    prior: float
    context: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), 0.7, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets, 0.6, "address|server|host|ip"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda m: _n_digits(16, 19)(m) & luhn(m), 0.7, "card|credit|visa|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), _n_digits(8, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), mod97, 0.8, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), 0.3, "social|security|ssn", False),
)


def _located(text: Column, matches: Column, kind: Kind) -> Column:
    """Spans of the valid matches: kind, start, end (code points, end exclusive) and score."""
    pieces = F.split(text, kind.pattern, -1)
    near = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(BEFORE)).alias("before"), F.left(p, F.lit(AFTER)).alias("after")))
    after = F.transform(F.slice(near, F.lit(2), F.size(matches)), lambda p: p["after"])
    rows = F.arrays_zip(F.slice(near, F.lit(1), F.size(matches)).alias("p"), matches.alias("m"), after.alias("a"))
    empty = F.expr("struct(0 AS at, cast(array() AS array<struct<kind:string,start:int,end:int,score:double,m:string>>) AS spans)")

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["p"]["n"]
        end = start + F.length(row["m"])
        near = F.concat_ws(" ", row["p"]["before"], row["a"])
        raises, lowers = (F.when(near.rlike(rf"(?i)\b(?:{words})"), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)) for words in (kind.context, LOWERS))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.prior) + raises - lowers))
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"), row["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.filter(F.aggregate(rows, empty, step)["spans"], lambda s: kind.valid(s["m"]))


def with_spans(docs: DataFrame, least_score: float = 0.6) -> DataFrame:
    """docs with _spans: array of kind, start, end, score, by kind in the order of KINDS, then start.

    Base kinds are always kept; the others if checksum and context bring them to least_score.
    A null text has no spans. All columns of docs stay, but for one named _spans, which is
    replaced; repeated rows are kept.
    """
    columns, docs = [c for c in docs.columns if c != "_spans"], set_aside(docs, "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() AS array<string>)")
    found = docs.withColumns({f"_m_{k.name}": F.when(k.possible(text), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in KINDS})
    no_span = F.expr("cast(array() AS array<struct<kind:string,start:int,end:int,score:double>>)")
    parts = []
    for k in KINDS:
        matches = F.col(f"_m_{k.name}")
        spans = _located(text, matches, k)
        if not k.base:
            spans = F.filter(spans, lambda s: s["score"] >= least_score)
        spans = F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "score"))))
        parts.append(F.when(F.size(matches) > 0, spans).otherwise(no_span))
    found = found.select("text", "_all", F.concat(*parts).alias("_spans"))
    return found.select(*(F.col("text") if c == "text" else F.col("_all").getField(c).alias(c) for c in columns), "_spans")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, as in [email]; overlapping spans become one."""
    columns, docs = docs.columns, set_aside(docs, "text")
    spans = F.array_sort("_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.expr("struct(0 AS at, cast('' AS string) AS out)")

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))
    return put_back(with_spans(docs).withColumn("_new", text).select(F.col("_new").alias("text"), "_all"), columns, ("text",))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    counts = [F.size(F.filter(F.transform("_spans", lambda s: s["kind"]), lambda k: k == F.lit(n))).cast("long").alias(f"n_{n}") for n in base]  # noqa: B023
    scores = F.array_join(F.transform("_spans", lambda s: F.format_number(s["score"], 2)), ",")
    known = F.filter("_spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(written(known), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"), scores.alias("scores"))
