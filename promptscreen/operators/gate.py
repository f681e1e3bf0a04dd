"""Data gate: sensitive spans, a redacted copy, and an action by policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions.text import fence, payload_digest


def gate(
    df: DataFrame,
    text_col: str = "text",
    verdict_col: str | None = None,
    auto_redact: bool = True,
    hard_block_keys: bool = True,
    policy: dict[str, str] | None = None,
) -> DataFrame:
    """Adds spans, redacted, action, reason and n_findings. Without verdict_col the intent is SAFE. A null text gives nulls."""
    verdict = F.col(verdict_col) if verdict_col else F.lit("SAFE")
    rules = policy or P.POLICY
    blocking = verdict.isin([v for v, a in rules.items() if a == "BLOCK"]) if any(a == "BLOCK" for a in rules.values()) else F.lit(False)
    out = S.with_spans(df, text_col, "__all")
    out = out.withColumn("spans", fence(S.resolved(F.col("__all")))).drop("__all")
    out = out.withColumn("redacted", S.redacted(F.col(text_col), F.col("spans")))
    n, key = F.size("spans"), F.exists("spans", lambda s: s["dtype"].isin(P.KEY_TYPES))
    cascade = [
        (F.coalesce(blocking, F.lit(False)), "BLOCK", F.lit("High-risk intent")),
        (key & F.lit(hard_block_keys), "BLOCK", F.lit("Live credential found")),
        (n > 0, "REDACT" if auto_redact else "QUARANTINE", F.concat(n.cast("string"), F.lit(" sensitive item(s) found"))),
    ]
    action = reason = F.when(F.col(text_col).isNull(), None)
    for condition, name, why in cascade:
        action, reason = action.when(condition, name), reason.when(condition, why)
    return out.withColumns({"action": fence(action.otherwise("ALLOW")), "reason": reason.otherwise("Clean"), "n_findings": F.when(F.col(text_col).isNotNull(), n)})


def audit_rows(decided: DataFrame, text_col: str = "text", snippets: str = "mask") -> DataFrame:
    """Audit records of gated rows. snippets: raw (as found), mask (their ends) or sha256; raw secrets stay out unless asked for."""
    from ..functions.text import mask_key

    show = {"raw": lambda s: s, "mask": mask_key, "sha256": payload_digest}[snippets]
    found = F.transform(S.findings(F.col("spans")), lambda f: f.withField("snippet", show(f["snippet"])))
    have = set(decided.columns)
    verdict = F.col("verdict") if "verdict" in have else F.lit("SAFE")
    risk = F.col("risk_score") if "risk_score" in have else F.lit(0)
    used = F.col("llm_used") if "llm_used" in have else F.lit(False)
    return decided.select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ts"),
        payload_digest(F.col(text_col)).alias("payload_sha256"), "action", "reason", "redacted", found.alias("findings"),
        verdict.alias("intent_verdict"), risk.alias("risk_score"), used.alias("llm_used"),
    )
