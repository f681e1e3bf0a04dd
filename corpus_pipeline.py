"""A training corpus from documents, stage by stage; each stage is written and read again."""

from __future__ import annotations

from promptscreen.llm.common import materialize
from promptscreen.llm.stages import jaccard_stage, mixing_stage, packing_stage, quality_stage, secret_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: SQL cannot express the classifier, the secret scan and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Applies STAGES to documents; each stage's rows go through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
