"""Undoing of obfuscation, step by step; each step is a column of its own, so nothing is computed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import contains_any, fence, has_bit

TECHNIQUES = ["special_char_insertion", "backtick_obfuscation", "space_separated_obfuscation", "latex_encoding", "leetspeak", "invisible_chars"]


def normalize(df: DataFrame, text_col: str = "text", bits_col: str | None = None) -> DataFrame:
    """Adds normalized, techniques, obfuscation_detected and obfuscation_risk. A null text gives nulls. bits_col: text_bits() of the text, if there is such a column."""
    t = F.col(text_col)
    known = (lambda name, other: has_bit(F.col(bits_col), name)) if bits_col else (lambda name, other: other)
    steps = df.withColumn("__h1", known("SYMBOLS", t.rlike(P.SYMBOLS_GATE)))
    steps = steps.withColumn("__n1", F.when(F.col("__h1"), F.regexp_replace(t, P.SYMBOLS_BETWEEN_LETTERS, "$1")).otherwise(t))

    # Single letters in quotes, whose first run is replaced by all of them; the run takes the space after it along.
    letters = F.regexp_extract_all("__n1", F.lit(P.QUOTED_LETTER), F.lit(1))
    run = F.regexp_substr(F.col("__n1"), F.lit(P.QUOTED_RUN))
    steps = steps.withColumn("__run", F.when(known("QUOTES", contains_any(t, P.QUOTE_MARKS)) & t.rlike(P.QUOTED_GATE), F.when(F.size(letters) >= 3, run)))
    at = F.call_function("locate", F.col("__run"), F.col("__n1"))
    spliced = F.concat(F.substring(F.col("__n1"), F.lit(1), at - 1), F.array_join(letters, ""), F.substring(F.col("__n1"), at + F.char_length("__run"), F.char_length("__n1")))
    steps = steps.withColumns({"__h2": F.col("__run").isNotNull(), "__n2": F.when(F.col("__run").isNotNull(), spliced).otherwise(F.col("__n1"))})

    # Letters apart in the original text: the first match that spells a word of interest.
    joined = lambda m: F.lower(F.regexp_replace(m, P.UNICODE + r"\s+", ""))
    spelled = F.filter(F.regexp_extract_all(t, F.lit(P.SPACED_LETTERS), F.lit(0)), lambda m: contains_any(joined(m), P.SPACED_WORDS))
    steps = steps.withColumn("__apart", F.when(known("SPACED", F.lit(True)) & t.rlike(P.SPACED_GATE) & t.rlike(P.SPACED_LETTERS), F.get(spelled, F.lit(0))))
    steps = steps.withColumns({
        "__h3": F.col("__apart").isNotNull(),
        "__n3": F.when(F.col("__apart").isNotNull(), F.replace(F.col("__n2"), F.col("__apart"), joined(F.col("__apart")))).otherwise(F.col("__n2")),
    })

    steps = steps.withColumn("__h4", F.col("__n3").contains(P.LATEX_HEAD) & F.col("__n3").rlike(P.LATEX_TEXT))
    steps = steps.withColumn("__n4", F.when(F.col("__h4"), F.regexp_replace("__n3", P.LATEX_TEXT, "$1")).otherwise(F.col("__n3")))
    # translate() looks up each letter by itself, so it is for texts that it changes.
    touched = F.col("__h1") | F.col("__h2") | F.col("__h3") | F.col("__h4")
    left = lambda name, letters, at: F.when(touched, contains_any(at, list(letters))).otherwise(known(name, contains_any(at, list(letters))))
    steps = steps.withColumn("__n5", F.when(left("LEET", P.LEET[0], F.col("__n4")), F.translate("__n4", *P.LEET)).otherwise(F.col("__n4")))
    steps = steps.withColumn("__n6", F.when(left("INVISIBLE", P.INVISIBLE, F.col("__n5")), F.translate("__n5", P.INVISIBLE, "")).otherwise(F.col("__n5")))
    flags = [F.col("__h1"), F.col("__h2"), F.col("__h3"), F.col("__h4"), F.col("__n4") != F.col("__n5"), F.col("__n5") != F.col("__n6")]
    techniques = F.array_compact(F.array(*[F.when(f, n) for f, n in zip(flags, TECHNIQUES)]))
    out = steps.withColumns({"normalized": fence(F.col("__n6")), "techniques": fence(F.when(t.isNotNull(), techniques))})
    out = out.withColumn("obfuscation_detected", F.size("techniques") > 0)
    out = out.withColumn("obfuscation_risk", F.when(t.isNotNull(), F.when(F.col("obfuscation_detected"), P.OBFUSCATION_RISK).otherwise(0)))
    return out.drop("__h1", "__n1", "__run", "__h2", "__n2", "__apart", "__h3", "__n3", "__h4", "__n4", "__n5", "__n6")
