"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is one narrow projection of built-in functions over the whole text (no shuffle, no
Python). Per kind: ``regexp_extract_all`` gives the leftmost non-overlapping matches and ``split``
with the same pattern the gaps between them; running sums of both lengths are the code-point
offsets. The running sum is taken in blocks, so it stays near linear in the number of matches.

A span's score is its kind's prior, plus a bonus when a context word of that kind stands in the 40
code points of the text before it or the 20 after it. Spans that pass the kind's validator (octets, Luhn, digit count, mod 97) and score at
least 0.5 are kept. The first four kinds have priors above that: they need no context.

``mask`` replaces the spans that ``find`` gives for the same text; where spans overlap, their union
becomes the kind of the one that starts first (of the first kind, should they start together).

The patterns start only at the first character of a run and use possessive repetition; the matches
are the same as of the plain patterns (any later start in the run fails alike), but a long run
without a match costs linear, not quadratic, time and no stack.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows give repeated
rows; null ids are kept; an empty table gives no rows; other columns are ignored by ``find`` and
kept by ``mask``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import let

THRESHOLD = 0.5
BEFORE, AFTER = 40, 20
_BLOCK = 64
#: code points of a piece: a slice of a text is read from the pieces it lies in, not from the start of the text
_PIECE = 1024


def _ip(m: Column) -> Column:
    """Every part at most 255 (leading zeros allowed)."""
    return F.forall(F.split(m, r"\."), lambda p: let(
        F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))


def _luhn(m: Column) -> Column:
    digits = F.split(F.reverse(F.translate(m, " -", "")), "")
    doubled = F.transform(digits, lambda c, i: let(
        c.cast("int") * (F.lit(1) + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _phone(m: Column) -> Column:
    return F.length(F.translate(m, " ().+-", "")).between(8, 15)


def _mod97(m: Column) -> Column:
    plain = F.translate(m, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: Column | None            # cheap test that a text without it has no match
    valid: Callable[[Column], Column] | None
    prior: float
    words: str                      # context words, alternatives of a pattern
    bonus: float = 0.4


def kinds() -> list[Kind]:
    """The first four are fixed by contract; the others are added by the method."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    local = "[A-Za-z0-9._%+-]"
    return [
        Kind("email", rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
             text.contains("@"), None, 0.8, "e-?mail|mail|contact|write", 0.2),
        Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", digit, _ip, 0.6, "ip|host|server|address|addr"),
        Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", digit, _luhn, 0.7,
             "card|visa|mastercard|credit|karte|carte|tarjeta", 0.3),
        Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", text.contains("+"), _phone, 0.6,
             "phone|tel|call|mobile|fax|t[eé]l[eé]phone|telefon|tel[eé]fono"),
        Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)"
             r"(?![A-Za-z0-9])", digit, _mod97, 0.7, "iban|account|bank|konto|compte|cuenta", 0.3),
        Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", digit, None, 0.3,
             "ssn|social security|tax id"),
        Kind("local_phone", r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
             digit, None, 0.3, "phone|tel|call|mobile|fax|t[eé]l[eé]phone|telefon|tel[eé]fono"),
        Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}+(?![A-Za-z0-9])", digit, None, 0.3,
             "token|api.?key|key|secret|password|passwd"),
    ]


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix folds of an array of longs by an associative ``step`` from 0, in blocks: appending to an array
    copies it, so one fold over n values would copy n*n/2."""
    zero = F.lit(0).cast("bigint")

    def folds(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<bigint>"), lambda acc, x: F.concat(
            acc, F.array(step(x, F.coalesce(F.try_element_at(acc, F.lit(-1)), zero)))))

    def blocks(v: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(_BLOCK)),
                            lambda at: folds(F.slice(v, at + 1, F.lit(_BLOCK))))
        return let(inner, lambda parts: let(
            folds(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda ends: F.flatten(F.zip_with(parts, F.concat(F.array(zero), F.slice(ends, 1, F.size(ends) - 1)),
                                              lambda p, past: F.transform(p, lambda x: step(x, past))))))

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, folds(v)).otherwise(blocks(v)))


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs."""
    return _running(values, lambda x, past: x + past)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}+"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points ``start`` to ``end`` of the text of these pieces, cut at its end."""
    first = F.floor(start / _PIECE).cast("int")
    count = F.floor((end - 1) / _PIECE).cast("int") - first + 1
    return F.when(end > start, F.array_join(F.slice(pieces, first + 1, count), "").substr(
        (start - first * _PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _score(kind: Kind, pieces: Column, start: Column, end: Column) -> Column:
    near = F.concat(_part(pieces, F.greatest(start - BEFORE, F.lit(0)), start), F.lit(" \u0001 "), _part(pieces, end, end + AFTER))
    return F.when(F.lower(near).rlike(rf"(?<![\p{{L}}0-9])(?:{kind.words})(?![\p{{L}}0-9])"),
                  F.lit(kind.prior + kind.bonus)).otherwise(F.lit(kind.prior))


def _spans(kind: Kind) -> Column:
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,match:string,score:double>>")

    def placed(found: Column, gaps: Column, pieces: Column) -> Column:
        lens = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: (F.length(g) + F.length(m)).cast("bigint"))
        ends = F.zip_with(found, running_sum(lens), lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))
        valid = F.filter(ends, lambda s: kind.valid(s["match"])) if kind.valid else ends
        spans = F.transform(valid, lambda s: F.struct(
            F.lit(kind.name).alias("kind"), s["start"], s["end"], s["match"],
            _score(kind, pieces, s["start"], s["end"]).alias("score")))
        return F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(kind.needs, let(found, lambda m: F.when(F.size(m) > 0, let(
        _pieces(text), lambda p: placed(m, F.split(text, kind.pattern, -1), p))).otherwise(none))).otherwise(none)


def find(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and one array of kept spans per kind (``email``, ``ip``, ...), in order of start."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return base.select("doc_id", *[_spans(k).alias(k.name) for k in kinds()])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``find`` by ``[KIND]``, and bring ``n_chars`` up to date.

    All columns stay. A null text stays null."""
    names = docs.columns
    body = F.col("text")

    def rebuilt(spans: Column, reach: Column, pieces: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(reach, 1, F.size(reach) - 1))
        filled = F.zip_with(spans, before, lambda s, past: F.when(
            s["start"] >= past, F.concat(_part(pieces, past, s["start"]), s["tag"])).otherwise(""))
        return F.concat(F.array_join(filled, ""), _part(pieces, F.element_at(reach, -1), F.length(body).cast("bigint")))

    def ordered(at: int, kind: Kind) -> Column:
        return F.transform(_spans(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(at).alias("at"), s["end"].alias("end"), F.lit(f"[{kind.name.upper()}]").alias("tag")))

    out = docs.withColumnRenamed(text, "text") if text != "text" else docs
    every = F.array_sort(F.concat(*[ordered(i, k) for i, k in enumerate(kinds())]))
    out = out.withColumn("text", let(every, lambda spans: F.when(F.size(spans) > 0, let(
        _running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda reach: let(
            _pieces(body), lambda pieces: rebuilt(spans, reach, pieces)))).otherwise(body)))
    out = out.withColumnRenamed("text", text) if text != "text" else out
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(F.col(text)).cast("bigint"))
    return out.select(*[F.col(f"`{c}`") for c in names])


def _digest(spans: list[Column]) -> Column:
    return F.array_join(F.transform(F.concat(*spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    found = find(docs, text, id_col)
    base, every = ["email", "ip", "card", "phone"], [k.name for k in kinds()]
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(_digest([F.col(k) for k in base]), 256).alias("base_sha256"),
        _digest([F.col(k) for k in every]).alias("spans"))
