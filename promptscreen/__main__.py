"""python -m promptscreen: analyzes the lines of standard input, or its arguments, and prints what came of each."""

from __future__ import annotations

import sys


def main(arguments: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.judge import judge_from_env
    from .plans.analyze import analyze, result
    from .plans.views import trace

    texts = [t for t in (arguments or sys.stdin.read().splitlines()) if t.strip()]
    if not texts:
        print("no text given", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("promptscreen").getOrCreate()
    df = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    seen = analyze(df, judge=judge_from_env()).withColumn("__place", F.col("place"))
    reported = result(seen.orderBy("__place"))
    for row in reported.select("prompt", trace(reported).alias("lines")).toLocalIterator():
        print(f"{row.prompt}\n{row.lines}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
