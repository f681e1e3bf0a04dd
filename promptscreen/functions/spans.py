"""Spans of patterns in a text, as arrays of intervals in code points, without user-defined functions.

A span is struct<start, neg_len, ord, end, dtype, snippet>: the natural order of
structs is by start, then the longer, then the order of detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import contains_any, fence, may_match

SPAN = "struct<start: int, neg_len: int, ord: int, end: int, dtype: string, snippet: string>"


#: Arrays are worked through in parts of so many elements. What an aggregate carries is copied at each step, so one that
#: collects a long array takes the square of its length; parts are short, and only a number is carried from part to part.
PART = 64


def _once(value: Column, body) -> Column:
    """body(value), with value computed once: within a function of array elements an outer expression is else computed for each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(items), F.lit(PART)), lambda i: F.slice(items, i, F.lit(PART)))


def _scan(items: Column, advance, collect) -> Column:
    """Spans of an array that is not empty, made in order with a number carried along, from 0.

    advance(carried, item): the number after an item; collect(carried, spans, item): the spans with what the item adds.
    """
    carried = lambda part, first: F.aggregate(part, first, advance)
    none = F.array().cast(f"array<{SPAN}>")

    def step(a: Column, x: Column) -> Column:
        return F.struct(advance(a["at"], x).alias("at"), collect(a["at"], a["out"], x).alias("out"))

    def one(z: Column) -> Column:
        return F.aggregate(z["part"], F.struct(z["first"].alias("at"), none.alias("out")), step, lambda a: a["out"])

    def all_parts(parts: Column) -> Column:
        firsts = F.aggregate(parts, F.array(F.lit(0)), lambda a, part: F.concat(a, F.array(carried(part, F.element_at(a, -1)))))
        pairs = F.slice(F.arrays_zip(parts.alias("part"), firsts.alias("first")), F.lit(1), F.size(parts))
        return F.flatten(F.transform(pairs, one))

    return _once(_once(items, _parts), all_parts)


def _cut(text: Column, name: str, pattern: str, low: Column, folds: Column | None) -> Column:
    """The gap before each match of a detector and the match, left to right, and the gap at the end; null where there is none.

    Most texts have no match: a literal, or else one search, decides that, and nothing else is computed. low: text in lower case.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    may = may_match(low, name, folds) & text.rlike(P.GATES[name]) if name in P.GATES else may_match(low, name, folds)
    return F.when(may & text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), found.alias("m")))


def _spans(cut: Column) -> Column:
    """Spans of one detector's cuts (order, dtype, parts). Gaps are what split() leaves, so offsets are running sums of lengths."""
    end = lambda at, x: at + F.char_length(x["gap"]) + F.char_length(F.coalesce(x["m"], F.lit("")))

    def add(at: Column, spans: Column, x: Column) -> Column:
        n = F.char_length(x["m"])
        start = at + F.char_length(x["gap"])
        span = F.struct(start.alias("start"), (-n).alias("neg_len"), cut["ord"].alias("ord"), (start + n).alias("end"), cut["dtype"].alias("dtype"), x["m"].alias("snippet"))
        return F.when(x["m"].isNull(), spans).otherwise(F.concat(spans, F.array(span)))  # after the last gap comes no match

    return _scan(cut["parts"], end, add)


def matches(text: Column, detectors: list[tuple[str, str]], low: Column, folds: Column | None = None) -> Column:
    """All matches of detectors (name, pattern), one detector after another."""
    order = [n for n, _ in P.DETECTORS]
    cuts = F.array(*[F.struct(F.lit(order.index(n)).alias("ord"), F.lit(n).alias("dtype"), _cut(text, n, pattern, low, folds).alias("parts")) for n, pattern in detectors])
    # One function for all detectors: an expression for each would take longer to plan than most texts to search.
    return F.when(text.isNotNull(), F.flatten(F.transform(F.filter(cuts, lambda c: c["parts"].isNotNull()), _spans)))


def luhn_ok(snippet: Column) -> Column:
    digits = F.regexp_replace(snippet, r"[^0-9]", "")
    low, high = P.LUHN_DIGITS
    return F.char_length(digits).between(low, high) & F.call_function("luhn_check", digits)


def _checked(spans: Column) -> Column:
    """Spans without cards whose check digit does not hold."""
    return F.filter(spans, lambda s: (s["dtype"] != "CREDIT_CARD") | luhn_ok(s["snippet"]))


def detector(text: Column, name: str, low: Column | None = None) -> Column:
    """Spans of one detector; cards only if their check digit holds."""
    return _checked(matches(text, [(n, p) for n, p in P.DETECTORS if n == name], F.lower(text) if low is None else low))


def all_spans(text: Column, low: Column | None = None, folds: Column | None = None) -> Column:
    """Spans of all detectors, in order. low: text in lower case, if that is at hand; folds: whether it has letters that fold to others."""
    return F.array_sort(_checked(matches(text, P.DETECTORS, F.lower(text) if low is None else low, folds)))


def with_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """df with the spans of all detectors. The text in lower case and the spans are columns of their own and fenced: each search for a literal would else
    make the lower case anew, and the filter that explode() brings along would find all spans a second time."""
    low = df.withColumn("__low", fence(F.lower(F.col(text_col)))).withColumn("__folds", fence(contains_any(F.col("__low"), P.FOLDED)))
    return low.withColumn(out_col, fence(all_spans(F.col(text_col), F.col("__low"), F.col("__folds")))).drop("__low", "__folds")


def resolved(spans: Column) -> Column:
    """Sorted spans without those that begin within the span kept last: leftmost first, the longest of one start. Touching spans stay."""
    kept = _scan(spans, lambda last, s: F.when(s["start"] < last, last).otherwise(s["end"]), lambda last, out, s: F.when(s["start"] < last, out).otherwise(F.concat(out, F.array(s))))
    return F.when(F.size(spans) > 0, kept).otherwise(spans)


def redacted(text: Column, spans: Column, token: str = P.REDACTED) -> Column:
    """text with each of its disjoint, sorted spans replaced.

    A substring is looked for from the beginning, so PART spans at a time are cut out of a piece of the text that holds just these.
    """
    before = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    pairs = F.transform(F.slice(F.arrays_zip(before.alias("at"), spans.alias("s")), F.lit(1), F.size(spans)), lambda x: F.struct(x["at"].alias("at"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end")))

    def cut(z: Column) -> Column:
        parts = F.transform(z["own"], lambda x: F.concat(F.substring(z["piece"], x["at"] - z["at"] + 1, x["start"] - x["at"]), F.lit(token)))
        return F.array_join(parts, "")

    def piece(own: Column) -> Column:
        first, last = F.get(own, F.lit(0))["at"], F.element_at(own, -1)["end"]
        return _once(F.struct(own.alias("own"), F.substring(text, first + 1, last - first).alias("piece"), first.alias("at")), cut)

    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(_once(pairs, _parts), piece), ""), tail)).otherwise(text)


def findings(spans: Column) -> Column:
    """Spans in the form in which they are reported."""
    return F.transform(spans, lambda s: F.struct(s["dtype"].alias("dtype"), s["start"].alias("start"), s["end"].alias("end"), s["snippet"].alias("snippet"), F.lit("HIGH").alias("confidence")))
