"""The engine in SQL: a table function of findings and SQL functions of the gate, in a session's catalogue.

    register(spark)
    spark.sql("SELECT d.doc_id, f.* FROM documents d, LATERAL findings(d.text) f WHERE is_key(f.dtype)")

findings(text) runs in Python, a row for each span that is kept; all else are SQL functions, which the optimizer
sees through. In a filter or projection of one's own the native columns (spans.all_spans, gate) are the faster form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

from . import patterns as P


def python_pattern(pattern: str) -> re.Pattern:
    """A catalogue's pattern for Python, whose classes are those of Unicode as they are."""
    return re.compile(re.sub(r"^\(\?i?Ud\)", "", pattern), re.IGNORECASE if pattern.startswith(P.ANY_CASE) else 0)


def luhn_ok(snippet: str) -> bool:
    digits = [int(c) for c in reversed(snippet) if c in "0123456789"]
    low, high = P.LUHN_DIGITS
    return low <= len(digits) <= high and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


class Findings:
    """Table function of the spans of a text, overlaps resolved: leftmost first, the longest of one start. Nothing for a null text."""

    def __init__(self) -> None:
        self.detectors = [(n, python_pattern(p)) for n, p in P.DETECTORS]

    def eval(self, text: str) -> Iterator[tuple]:
        if not text:
            return
        found = [(m.start(), -len(m[0]), k, m.end(), name) for k, (name, p) in enumerate(self.detectors) for m in p.finditer(text) if name != "CREDIT_CARD" or luhn_ok(m[0])]
        last = 0
        for start, _, _, end, name in sorted(found):
            if start >= last:
                last = end
                yield name, start, end, text[start:end]


FINDINGS = "dtype string, start int, end int, snippet string"


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_functions() -> dict[str, str]:
    """Statements that make the SQL functions, by name."""
    blocked = _quoted([v for v, a in P.POLICY.items() if a == "BLOCK"])
    aliases = " ".join(f"WHEN upper(label) IN ({_quoted(list(names))}) THEN '{v}'" for v, names in P.VERDICT_ALIASES.items())
    before = "IF(i = 0, 0, spans[i - 1].end)"
    bodies = {
        "is_key(dtype STRING) RETURNS BOOLEAN": f"dtype IN ({_quoted(P.KEY_TYPES)})",
        "verdict_of(score INT) RETURNS STRING": "CASE WHEN score >= 80 THEN 'BLOCKED' WHEN score >= 60 THEN 'HIGH_RISK' WHEN score >= 40 THEN 'MEDIUM_RISK' WHEN score IS NOT NULL THEN 'SAFE' END",
        "normal_verdict(label STRING) RETURNS STRING": f"CASE {aliases} ELSE upper(label) END",
        "payload_digest(payload STRING) RETURNS STRING": "sha2(payload, 256)",
        "gate_action(verdict STRING, n BIGINT, keys BIGINT) RETURNS STRING": f"CASE WHEN verdict IN ({blocked}) OR keys > 0 THEN 'BLOCK' WHEN n > 0 THEN 'REDACT' ELSE 'ALLOW' END",
        "gate_reason(verdict STRING, n BIGINT, keys BIGINT) RETURNS STRING": f"CASE WHEN verdict IN ({blocked}) THEN 'High-risk intent' WHEN keys > 0 THEN 'Live credential found' WHEN n > 0 THEN concat(n, ' sensitive item(s) found') ELSE 'Clean' END",
        "redacted(payload STRING, spans ARRAY<STRUCT<start: INT, end: INT>>) RETURNS STRING": f"CASE WHEN size(spans) > 0 THEN concat(array_join(transform(spans, (s, i) -> concat(substring(payload, {before} + 1, s.start - {before}), '{P.REDACTED}')), ''), substring(payload, element_at(spans, -1).end + 1)) ELSE payload END",
    }
    return {head.split("(")[0]: f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in bodies.items()}


def register(spark: SparkSession) -> list[str]:
    """Puts findings and the SQL functions into the session's catalogue; their names. Functions of these names are replaced."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("findings", udtf(Findings, returnType=FINDINGS))
    for statement in sql_functions().values():
        spark.sql(statement)
    return ["findings", *sql_functions()]


#: The gate as SQL text; {documents} is a table with text and a doc_id that no two rows share. Spans are joined back, as a lateral join leaves out texts without any.
GATE = """
SELECT d.doc_id, gate_action('SAFE', coalesce(n, 0), coalesce(keys, 0)) AS action, gate_reason('SAFE', coalesce(n, 0), coalesce(keys, 0)) AS reason,
       CAST(coalesce(n, 0) AS INT) AS n_findings, payload_digest(redacted(d.text, coalesce(spans, array()))) AS redacted_sha256
FROM {documents} AS d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count_if(is_key(f.dtype)) AS keys, array_sort(collect_list(struct(f.start, f.end))) AS spans FROM {documents}, LATERAL findings(text) AS f GROUP BY doc_id
) AS f ON d.doc_id = f.doc_id
"""
