"""Column functions on texts and labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def fence(value: Column) -> Column:
    """value, but an expression that the optimizer does not copy: a filter on a column made of many others would else
    be pushed through all of them, each copied wherever it is named. The condition always holds."""
    return F.when(F.rand(1) * 0.5 < 1, value)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def rare_part(word: str) -> str:
    """What to search for in place of a word: the part from a rare letter on. A text without the part is without the word. No i is left out: a dotted
    capital one is an i to patterns, but two letters in lower case."""
    parts = [word[i:] for i in range(len(word)) if i == 0 or len(word) - i >= 4 and "i" not in word[:i]]
    return min(parts, key=lambda x: P.LETTERS.find(x[0]))


#: Patterns whose literals have bits in text_bits(). Bits besides: letters that fold to others, and what the steps of the normaliser need.
LAYER_NAMES = [*[name for _, _, bodies in P.BEHAVIOURS for name, _ in bodies], "RETRIEVAL", "TARGET"]
PARTS = {rare_part(w) for name in LAYER_NAMES for w in P.NEEDED[name]}


def shared_part(word: str) -> str:
    """The shortest of PARTS that a word has, again without leaving an i out: patterns share searches."""
    return min((p for p in PARTS if p in word and "i" not in word.replace(p, "", 1)), key=len)


#: At most 63: they are bits of a long.
BITS = {b: i for i, b in enumerate([*sorted({shared_part(w) for name in LAYER_NAMES for w in P.NEEDED[name]}), "FOLDS", "LEET", "INVISIBLE", "QUOTES", "SYMBOLS", "SPACED"])}


def text_bits(text: Column, low: Column) -> Column:
    """What of BITS a text has, as a number: each literal is searched for once, however many patterns need it. low: text in lower case.

    The bits of texts joined by a space are those of the parts together: none but SPACED is told by what has white space in it, and of five letters apart
    three are in one of the parts.
    """
    own = {
        "FOLDS": contains_any(low, P.FOLDED), "LEET": contains_any(text, list(P.LEET[0])), "INVISIBLE": contains_any(text, list(P.INVISIBLE)), "QUOTES": contains_any(text, P.QUOTE_MARKS),
        "SYMBOLS": text.rlike(P.SYMBOLS_GATE), "SPACED": text.rlike(P.SPACED_PART),
    }
    each = [F.when(own[b] if b in own else low.contains(b), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for b, i in BITS.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def bits_of(text: str) -> int:
    """text_bits() of a text of the driver's, without letters beyond ASCII."""
    low = text.lower()
    own = {
        "FOLDS": any(c in low for c in P.FOLDED), "LEET": any(c in text for c in P.LEET[0]), "INVISIBLE": any(c in text for c in P.INVISIBLE), "QUOTES": any(c in text for c in P.QUOTE_MARKS),
        "SYMBOLS": bool(re.search(P.SYMBOLS_GATE, text)), "SPACED": bool(re.search(P.SPACED_PART.removeprefix(P.UNICODE), text)),
    }
    return sum(1 << i for b, i in BITS.items() if (own[b] if b in own else b in low))


def has_bit(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(1 << BITS[name]).cast("long")) != 0


def words_in(low: Column, words: list[str], bits: Column | None = None) -> Column:
    """contains_any(), where a word is only searched for if the text, by its text_bits(), has a part of the word."""
    if bits is None:
        return contains_any(low, words)
    gates = [next((b for b in BITS if b.islower() and b in w), None) for w in words]
    return reduce(lambda a, b: a | b, [has_bit(bits, g) & low.contains(w) if g else low.contains(w) for g, w in zip(gates, words)])


def may_match(low: Column, name: str, folds: Column | None = None, bits: Column | None = None) -> Column:
    """Whether a text, in lower case, can match a pattern: it holds what the pattern needs, or letters that fold to others (folds, if that is at hand).

    bits: text_bits(), if that is at hand.
    """
    if bits is not None:
        wanted = sum(1 << BITS[b] for b in {*map(shared_part, P.NEEDED[name]), "FOLDS"})
        return bits.bitwiseAND(F.lit(wanted).cast("long")) != 0
    parts = [low.rlike(r"(?U)\d") if w == "digit" else low.contains(w) for w in P.NEEDED[name]]
    return reduce(lambda a, b: a | b, [*parts, contains_any(low, P.FOLDED) if folds is None else folds])


def truncated(prompt: Column) -> Column:
    """First 100 characters, with dots if there are more."""
    return F.when(F.char_length(prompt) > 100, F.concat(F.substring(prompt, 1, 100), F.lit("..."))).otherwise(prompt)


def verdict_of(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, verdict in P.VERDICTS:
        out = out.when(score >= least, verdict)
    return out.otherwise("SAFE")


def normalize_verdict(label: Column) -> Column:
    """A verdict by any of its names, in any case; other labels in upper case."""
    upper = F.upper(label)
    out = None
    for verdict, names in P.VERDICT_ALIASES.items():
        out = F.when(upper.isin(names), verdict) if out is None else out.when(upper.isin(names), verdict)
    return out.otherwise(upper)


def is_correct(expected: Column, actual: Column) -> Column:
    """Whether a verdict is as expected; high risk passes for blocked, not the other way round. Null without an expectation."""
    e, a = normalize_verdict(expected), normalize_verdict(actual)
    return F.when(F.coalesce(expected, F.lit("")) != "", (e == a) | ((e == "BLOCKED") & (a == "HIGH_RISK")))


def is_attack(label: Column) -> Column:
    return normalize_verdict(label).isin(P.ATTACKS)


def mask_key(key: Column) -> Column:
    """A key that can be shown: its ends alone, or stars if it is short."""
    n = F.char_length(key)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "<unset>").when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(key, 1, 3), F.lit("..."), F.right(key, F.lit(4))))


def provider_of(choice: Column) -> Column:
    """Provider of a menu label, by how it begins; google for any other."""
    out = F.when(choice.startswith("google"), "google")
    for name in sorted(P.PROVIDERS, key=len, reverse=True):
        out = out.when(choice.startswith(name), name)
    return out.otherwise("google")


def payload_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
