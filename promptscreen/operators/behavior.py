"""Behaviour layer: which groups of patterns a text has, what it asks for, and a score by their combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import fence, may_match, text_bits, words_in

#: Short names of the groups, in order.
SIGNALS = ["training", "pii", "unfiltered", "jailbreak", "role", "disclosure"]


def first_pattern(text: Column, low: Column, bodies: list[tuple[str, str]], bits: Column | None = None) -> Column:
    """Id of the first pattern that matches, null if none does. low: text in lower case; bits: its text_bits()."""
    out = None
    for name, body in bodies:
        hit = may_match(low, name, bits=bits) & text.rlike(P.ANY_CASE + body)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def flag(text: Column, low: Column, bodies: list[tuple[str, str]], bits: Column | None = None) -> Column:
    """Whether any pattern matches."""
    return reduce(lambda a, b: a | b, [may_match(low, name, bits=bits) & text.rlike(P.ANY_CASE + body) for name, body in bodies])


def behave(df: DataFrame, text_col: str = "normalized", patterns: bool = True, low_col: str | None = None, bits_col: str | None = None) -> DataFrame:
    """Adds has_<signal>, has_retrieval, has_target, has_combination, behavior_risk, behavior_branch, behaviors and matched_patterns.

    With patterns off only flags are searched for. low_col, bits_col: columns of the text in lower case and of its text_bits(), if there are such.
    """
    t, low = F.col(text_col), F.col(low_col or "__low")
    df = df if low_col else df.withColumn("__low", fence(F.lower(t)))
    df = df if bits_col else df.withColumn("__bits", fence(text_bits(t, low)))
    bits = F.col(bits_col or "__bits")
    if patterns:
        out = df.withColumns({f"__p_{s}": first_pattern(t, low, bodies, bits) for s, (_, _, bodies) in zip(SIGNALS, P.BEHAVIOURS)})
        out = out.withColumns({f"has_{s}": F.when(t.isNotNull(), F.col(f"__p_{s}").isNotNull()) for s in SIGNALS})
    else:
        out = df.withColumns({f"has_{s}": flag(t, low, bodies, bits) for s, (_, _, bodies) in zip(SIGNALS, P.BEHAVIOURS)})
    out = out.withColumns({"has_retrieval": may_match(low, "RETRIEVAL", bits=bits) & low.rlike(P.RETRIEVAL), "has_target": may_match(low, "TARGET", bits=bits) & low.rlike(P.TARGET)})
    has = {s: F.col(f"has_{s}") for s in [*SIGNALS, "retrieval", "target"]}
    strong = words_in(low, P.STRONG_TARGETS, bits)
    # Ordered: the first that holds. Nothing counts without a retrieval, role, disclosure or jailbreak signal.
    idle = ~has["retrieval"] & ~has["role"] & ~has["disclosure"] & ~has["jailbreak"]
    cascade = [
        (idle, 0, "benign override"),
        (has["disclosure"], 88, "disclosure"),
        (has["jailbreak"] & (has["role"] | has["unfiltered"] | has["retrieval"]), 90, "jailbreak with overlay"),
        (has["role"] & (has["retrieval"] | has["target"]), 78, "role takeover for data"),
        (has["jailbreak"], 72, "bare jailbreak"),
        (has["retrieval"] & has["target"] & strong, 85, "retrieval of strong target"),
        (has["retrieval"] & has["target"], 65, "retrieval of weak target"),
        (has["unfiltered"] & (has["retrieval"] | has["target"]), 70, "unfiltered request"),
    ]
    risk, branch = F.when(t.isNull(), None), F.when(t.isNull(), None)
    for condition, score, name in cascade:
        risk, branch = risk.when(condition, score), branch.when(condition, name)
    out = out.withColumns({
        "has_combination": has["training"] & (has["pii"] | has["unfiltered"]),
        "behavior_risk": fence(risk.otherwise(0).cast("int")),
        "behavior_branch": branch.otherwise("no signal"),
    })
    groups = [F.when(has[s], F.struct(F.lit(c).alias("category"), F.lit(b).alias("behavior"))) for s, (c, b, _) in zip(SIGNALS, P.BEHAVIOURS)]
    out = out.withColumn("behaviors", F.when(t.isNotNull(), F.array_compact(F.array(*groups))))
    if patterns:
        entries = [F.when(has[s], F.struct(F.lit(b).alias("key"), F.col(f"__p_{s}").alias("value"))) for s, (_, b, _) in zip(SIGNALS, P.BEHAVIOURS)]
        out = out.withColumn("matched_patterns", F.when(t.isNotNull(), F.map_from_entries(F.array_compact(F.array(*entries)))))
        out = out.drop(*[f"__p_{s}" for s in SIGNALS])
    return out.drop(*[c for c, given in (("__low", low_col), ("__bits", bits_col)) if not given])
