"""Reported analyses and evaluations as HTML and as plain lines, for people."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def escaped(text: Column) -> Column:
    out = text
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def grade(risk: Column) -> Column:
    """How a risk is coloured."""
    middle, high = P.BAR_GRADES
    return F.when(risk < middle, "low").when(risk < high, "middle").otherwise("high")


def result_html(reported: DataFrame) -> Column:
    """A reported analysis (plans.analyze.result) as a piece of HTML; null for a null text."""
    layer = lambda x: F.concat(F.lit('<li class="'), grade(x["risk"]), F.lit('">'), x["name"], F.lit(" "), x["risk"].cast("string"), F.lit(": "), escaped(x["details"]), F.lit("</li>"))
    head = F.concat(F.lit('<article class="'), F.lower("verdict"), F.lit('"><h2>'), F.col("verdict"), F.lit(" "), F.col("risk_score").cast("string"), F.lit("</h2><p>"), escaped(F.col("prompt")), F.lit("</p><ul>"))
    return F.concat(head, F.array_join(F.transform("layers", layer), ""), F.lit("</ul></article>"))


def trace(reported: DataFrame) -> Column:
    """A reported analysis as lines: what came of it, and a line for each layer."""
    layer = lambda x: F.concat(F.lit("  "), x["name"], F.lit(" "), x["risk"].cast("string"), F.lit(", "), x["details"])
    head = F.concat("verdict", F.lit(", risk "), F.col("risk_score").cast("string"), F.lit(", confidence "), "confidence")
    return F.array_join(F.concat(F.array(head), F.transform("layers", layer)), "\n")


def report_html(text: str) -> str:
    """An evaluation's report (operators.evaluate.report) as a table: a row for each of its lines."""
    cells = [(line[:21].strip(), line[21:].strip()) for line in text.split("\n")]
    return "<table>" + "".join(f"<tr><th>{html.escape(a)}</th><td>{html.escape(b)}</td></tr>" for a, b in cells) + "</table>"
